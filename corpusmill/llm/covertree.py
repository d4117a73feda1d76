"""Vectors within a cosine of each other, by dual traversal of cover trees.

Vectors of a label are laid into blocks around pivots. A block holds a cover tree:
nested nets of halving radii, each node with the distance of its farthest
descendant. Two blocks, then two nodes, are compared only if their centres are no farther
apart than the reach and both covering radii; pairs of vectors that remain are
tested by their cosine, so the links are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.graph import components
from corpusmill.llm.stores import prepare, stored
from corpusmill.llm.vectors import chunked, matrix, unit, usable

BLOCK = 1024
PIVOTS = 4096
RADII = (1.0, 0.5, 0.25)
SLACK = 1e-7  # rounding of distances


def build(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A cover tree of unit vectors: per level (centres, their covering radii, each vector's node).

    Nets are nested: the centres of a level are centres of the next. A vector's node on a
    level is an ancestor of its node on the next.
    """
    apart = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
    centres: list[int] = []
    nets = []
    for radius in RADII:
        covered = (apart[centres] <= radius).any(axis=0) if centres else np.zeros(len(x), bool)
        centres = list(centres)
        while not covered.all():
            new = int(np.argmin(covered))
            centres.append(new)
            covered |= apart[new] <= radius
        nets.append(np.array(centres))
    levels, node = [], np.zeros(len(x), int)
    for depth, net in enumerate(nets):
        near = apart[net]
        if depth:  # a node's parent is the nearest centre above; its vectors are among its parent's
            parent = levels[-1][2][net]
            near = np.where(parent[:, None] == levels[-1][2][None, :], near, np.inf)
        node = near.argmin(axis=0)
        radii = np.zeros(len(net))
        np.maximum.at(radii, node, apart[net[node], np.arange(len(x))])
        levels.append((net, radii, node))
    return levels


def traverse(x: np.ndarray, tx: list, y: np.ndarray, ty: list, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``x`` and ``y`` that the covering radii do not rule out."""
    open_ = None
    for depth, ((cx, rx, nx), (cy, ry, ny)) in enumerate(zip(tx, ty, strict=True)):
        bound = rx[:, None] + ry[None, :] + reach + SLACK
        if open_ is None:
            open_ = 2 - 2 * (x[cx] @ y[cy].T) <= bound ** 2
        else:
            up_x, up_y = tx[depth - 1][2][cx], ty[depth - 1][2][cy]
            i, j = np.nonzero(open_[up_x[:, None], up_y[None, :]])
            if len(i) * 8 > len(cx) * len(cy):
                near = 2 - 2 * (x[cx] @ y[cy].T) <= bound ** 2
                open_ = near & open_[up_x[:, None], up_y[None, :]]
            else:
                open_ = np.zeros(bound.shape, bool)
                d = 2 - 2 * np.einsum("ij,ij->i", x[cx[i]], y[cy[j]])
                open_[i, j] = d <= bound[i, j] ** 2
        if not open_.any():
            return np.zeros(0, int), np.zeros(0, int)
    nx, ny = tx[-1][2], ty[-1][2]
    return np.nonzero(open_[nx[:, None], ny[None, :]])


def _local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


BLOCKS = "label int, dim int, block long, centre array<double>, radius double, n int, payload binary"
FOUND = "rid long, links long, peer long"


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("rid")
    raw = matrix(frame["embedding"])
    x = unit(raw)
    mean = x.mean(axis=0)
    payload = (frame["rid"].to_numpy("<i8").tobytes() + frame["w"].to_numpy("<i8").tobytes()
               + raw.astype("<f8").tobytes())
    head = frame.iloc[0]
    return pd.DataFrame({"label": [int(head["label"])], "dim": [raw.shape[1]], "block": [int(head["rid"])],
                         "centre": [mean.tolist()], "radius": [float(np.linalg.norm(x - mean, axis=1).max())],
                         "n": [len(x)], "payload": [payload]})


def _unpack(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, w = np.frombuffer(payload, "<i8", n), np.frombuffer(payload, "<i8", n, 8 * n)
    return ids, w, np.frombuffer(payload, "<f8", -1, 16 * n).reshape(n, -1)


def _matcher(threshold: float):
    reach = sqrt(max(0.0, 2 - 2 * threshold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple] = {}

        def block(number: int, payload: bytes, n: int) -> tuple:
            if number not in kept:
                if len(kept) > 8:
                    kept.clear()
                ids, w, raw = _unpack(payload, n)
                x = unit(raw)
                kept[number] = ids, w, raw, np.linalg.norm(raw, axis=1), x, build(x)
            return kept[number]

        for batch in batches:
            for a, na, pa, b, nb, pb in batch[["a", "n_a", "payload_a", "b", "n_b", "payload_b"]].itertuples(index=False):
                ids_a, w_a, raw_a, len_a, x, tx = block(a, pa, na)
                ids_b, w_b, raw_b, len_b, y, ty = block(b, pb, nb)
                i, j = traverse(x, tx, y, ty, reach)
                if a == b:
                    i, j = i[i < j], j[i < j]
                keep = np.zeros(len(i), bool)
                for at in range(0, len(i), 1 << 17):  # the exact test, on the vectors as they are
                    p, q = i[at:at + (1 << 17)], j[at:at + (1 << 17)]
                    dot = np.einsum("ij,ij->i", raw_a[p], raw_b[q])
                    keep[at:at + (1 << 17)] = dot / (len_a[p] * len_b[q]) >= threshold
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                ids = ids_a if a == b else np.concatenate([ids_a, ids_b])
                j_all = j if a == b else j + len(ids_a)
                links = np.zeros(len(ids), "i8")
                np.add.at(links, i, w_b[j])
                np.add.at(links, j_all, w_a[i])
                root = _local_components(len(ids), i, j_all)
                used = np.flatnonzero(links)
                yield pd.DataFrame({"rid": ids[used], "links": links[used], "peer": ids[root[used]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their lengths agree, and their
    cosine, in double precision, is ``threshold`` or more (0 < threshold <= 1).
    ``component_id`` is the smallest id reachable; ``kept`` says whether it is the
    row's own. Null, empty or zero vectors, or such with null or non-finite
    components, link with nothing, as do rows without a label. Repeated rows link
    with each other. A null id never is a component's id unless it is alone.
    No rows give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull())
    same = F.when(F.col("ok"), F.md5(F.to_json(F.struct("label", "embedding")).cast("binary")))
    rows = stored(rows.withColumn("same", same), "vectors")
    # equal vectors of a label are one node of weight w
    folded = (rows.where("ok").groupBy("same").agg(F.count("*").alias("w"), F.first("label").alias("label"),
                                                   F.first("embedding").alias("embedding")))
    folded = stored(folded.withColumn("rid", F.monotonically_increasing_id()), "nodes")
    total = folded.count()
    wanted = min(PIVOTS, -(-total // BLOCK))
    mark = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(1 << 30))
    pivots = folded.where(mark < int((1 << 30) * (wanted / max(1, total)))).select("label", "embedding").collect()
    centres: dict[tuple, np.ndarray] = {}
    for r in pivots:  # PIVOTS rows, in expectation
        centres.setdefault((r["label"], len(r["embedding"])), []).append(r["embedding"])
    centres = {k: unit(np.array(v, "f8")) for k, v in centres.items()}
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.full(len(batch), -1)
            dims = batch["embedding"].map(len).to_numpy() if len(batch) else np.zeros(0, int)
            for (label, dim), c in shared.value.items():
                mine = np.flatnonzero((batch["label"].to_numpy() == label) & (dims == dim))
                if len(mine):
                    cells[mine] = (unit(matrix(batch["embedding"].iloc[mine])) @ c.T).argmax(axis=1)
            yield pd.DataFrame({"rid": batch["rid"], "cell": cells, "dim": dims})

    cells = folded.select("rid", "label", "embedding").mapInPandas(assign, "rid long, cell int, dim int")
    placed = folded.join(cells, "rid").select("rid", "w", "label", "embedding", "dim", "cell")
    placed = chunked(placed, ["label", "dim", "cell"], F.xxhash64("rid"), BLOCK)
    blocks = stored(placed.groupBy("label", "dim", "cell", "chunk").applyInPandas(_pack, BLOCKS), "blocks")
    reach = sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    meta = blocks.select("label", "dim", "block", "centre", "radius", "n")
    left, right = (meta.select("label", "dim", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "centre", "radius")))
                   for s in ("a", "b"))
    apart = F.aggregate(F.zip_with("centre_a", "centre_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0),
                        lambda total, d: total + d, F.sqrt)
    pairs = (left.join(right, ["label", "dim"]).where("block_a <= block_b")
             .where(apart <= F.col("radius_a") + F.col("radius_b") + reach)
             .select(F.col("block_a").alias("a"), F.col("block_b").alias("b")))
    for side in ("a", "b"):
        pairs = pairs.join(blocks.select(F.col("block").alias(side), F.col("n").alias(f"n_{side}"),
                                         F.col("payload").alias(f"payload_{side}")), side)
    found = stored(pairs.mapInPandas(_matcher(threshold), FOUND), "near")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("peer").alias("b")))
    nodes = (folded.select("same", "rid", "w").join(links, "rid", "left")
             .join(roots.withColumnRenamed("node", "rid"), "rid", "left")
             .select("same", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                     F.coalesce("component", "rid").alias("component")))
    joined = rows.select("vec_id", "same").join(nodes, "same", "left")
    least = joined.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("vec_id").alias("least"))
    return joined.join(least, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("least", "vec_id")).alias("kept"))
