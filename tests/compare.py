"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NULL"
        return repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(name: str, spark, con, sf_dir: str) -> tuple[bool, str]:
    from corpusmill.plans.catalog import load

    queries, oracles = load()
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in oracles:
        return True, f"rows={len(got[1])} {spent:.1f}s (no sql)"
    relation = con.sql(oracles[name])
    want = rows_of(relation.columns, relation.fetchall())
    total = time.time() - start
    note = f"rows={len(got[1])} spark={spent:.1f}s duck={total - spent:.1f}s"
    if got == want:
        return True, note
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    missing = [r for r in want[1] if r not in set(got[1])][:2]
    extra = [r for r in got[1] if r not in set(want[1])][:2]
    return False, (f"{note} want_rows={len(want[1])}\n   spark-only: "
                   f"{[tuple(c[:300] for c in r) for r in extra]}\n   sql-only:   "
                   f"{[tuple(c[:300] for c in r) for r in missing]}")


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from corpusmill.plans.catalog import load
    from corpusmill.session import build_session

    sf = sys.argv[1]
    patterns = sys.argv[2:]
    session = build_session("local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    failed = []
    names = [n for n in load()[0] if not patterns or any(p in n for p in patterns)]
    for query_name in names:
        try:
            ok, message = compare(query_name, session, connection, sf)
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", query_name, message, flush=True)
        if not ok:
            failed.append(query_name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
