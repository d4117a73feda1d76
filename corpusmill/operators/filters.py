"""Include and exclude rules on content, metadata and paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smart_case(pattern: str, anchored: bool) -> str:
    """A rule in lower case ignores case; an anchored one must match from the first character."""
    flags = "(?i)" if pattern == pattern.lower() else ""
    return flags + (r"\A(?:" + pattern + ")" if anchored else pattern)


def _listed(rules: str | Sequence[str]) -> list[str]:
    found = [r.strip() for r in (rules.split(",") if isinstance(rules, str) else rules)]
    if not all(found):
        raise ValueError("empty filter rule")
    return found


def content_predicate(rules: str | Sequence[str], text: Column) -> Column:
    """``+re`` must match at the start, ``-re`` must not; all rules hold together."""
    kept = F.lit(True)
    for rule in _listed(rules):
        if rule[0] not in "+-" or not rule[1:].strip():
            raise ValueError(f"a content rule starts with + or -: {rule!r}")
        hit = text.rlike(smart_case(rule[1:].strip(), anchored=True))
        kept = kept & (hit if rule[0] == "+" else ~hit)
    return kept


@dataclass(frozen=True)
class MetadataRule:
    kind: str
    wanted: bool
    key: str | None
    value: str | None

    @classmethod
    def parse(cls, text: str) -> MetadataRule:
        kind, sign, body = text[:1], text[1:2], text[2:].strip()
        if kind not in ("k", "v", "b") or sign not in ("+", "-") or not body:
            raise ValueError(f"a metadata rule reads [kvb][+-]regex: {text!r}")
        if kind == "k":
            return cls(kind, sign == "+", body, None)
        if kind == "v":
            return cls(kind, sign == "+", None, body)
        key, colon, value = body.partition(":")
        if not colon or not key or not value:
            raise ValueError(f"a b rule reads key:value: {text!r}")
        return cls(kind, sign == "+", key, value)


def parse_metadata_rules(rules: str | Sequence[str]) -> list[MetadataRule]:
    parsed = [MetadataRule.parse(r) for r in _listed(rules)]
    keys = [(r.wanted, r.key) for r in parsed if r.kind == "b"]
    if len(keys) != len(set(keys)):
        raise ValueError("several b rules name the same key; use one wider regex")
    return parsed


def metadata_predicate(rules: str | Sequence[str], metadata: Column) -> Column:
    """Predicate over a MAP<STRING,STRING>.

    An exclusion on key and value (``b-``) also drops rows on which no key matches.
    """
    kept = F.lit(True)
    for rule in parse_metadata_rules(rules):
        key = smart_case(rule.key, True) if rule.key else None
        value = smart_case(rule.value, True) if rule.value else None
        if rule.kind == "k":
            hit = F.exists(F.map_keys(metadata), lambda k: k.rlike(key))
        elif rule.kind == "v":
            hit = F.exists(F.map_values(metadata), lambda v: v.rlike(value))
        else:
            hit = F.exists(F.map_entries(metadata), lambda e: e["key"].rlike(key) & e["value"].rlike(value))
        hit = F.coalesce(hit, F.lit(False))
        if rule.kind == "b" and not rule.wanted:
            has_key = F.coalesce(F.exists(F.map_keys(metadata), lambda k: k.rlike(key)), F.lit(False))
            kept = kept & has_key & ~hit
        else:
            kept = kept & (hit if rule.wanted else ~hit)
    return kept


def metadata_keys(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    return df.select(F.explode(F.map_keys(metadata)).alias("key")).distinct()


def _any_key(metadata: str, pattern: str) -> Column:
    return F.exists(F.map_keys(metadata), lambda k: k.rlike(pattern))


def check_metadata_rules(df: DataFrame, rules: str | Sequence[str], metadata: str = "metadata") -> None:
    """Refuse a key rule that matches no key anywhere; one aggregate, one row back."""
    keys = sorted({r.key for r in parse_metadata_rules(rules) if r.key})
    if not keys:
        return
    seen = df.agg(*[
        F.max(_any_key(metadata, smart_case(key, True))).alias(f"k{i}")
        for i, key in enumerate(keys)]).first()
    unused = [key for i, key in enumerate(keys) if not seen[f"k{i}"]]
    if unused:
        raise ValueError(f"no metadata key matches {unused}")


def path_predicate(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Any include rule, then no exclude rule; both search anywhere in the path."""
    kept = F.lit(True)
    if include:
        any_hit = F.lit(False)
        for rule in include:
            any_hit = any_hit | path.rlike(smart_case(rule, anchored=False))
        kept = any_hit
    for rule in exclude:
        kept = kept & ~path.rlike(smart_case(rule, anchored=False))
    return kept


def useless_path_rules(df: DataFrame, path: str, include: Sequence[str] = (),
                       exclude: Sequence[str] = ()) -> list[str]:
    """Rules that change nothing, in one pass: includes as a whole, excludes one by one in turn."""
    column = F.col(path)
    tests = []
    if include:
        tests.append(("include", F.count_if(~path_predicate(column, include))))
    done: list[str] = []
    for rule in exclude:
        before = path_predicate(column, include, done)
        tests.append((rule, F.count_if(before & column.rlike(smart_case(rule, anchored=False)))))
        done.append(rule)
    if not tests:
        return []
    row = df.agg(*[t.alias(f"c{i}") for i, (_, t) in enumerate(tests)]).first()
    return [name for i, (name, _) in enumerate(tests) if row[f"c{i}"] == 0]


def filter_store(df: DataFrame, content_rules=None, metadata_rules=None, text: str = "page_content",
                 metadata: str = "metadata", allow_empty: bool = False) -> DataFrame:
    """Keep the chunks every rule allows, before any vector is read; rules that leave none are an error unless ``allow_empty``."""
    kept = F.lit(True)
    if metadata_rules:
        check_metadata_rules(df, metadata_rules, metadata)
        kept = kept & metadata_predicate(metadata_rules, F.col(metadata))
    if content_rules:
        kept = kept & content_predicate(content_rules, F.col(text))
    found = df.filter(kept)
    if (content_rules or metadata_rules) and not allow_empty and found.isEmpty():
        raise ValueError("no document is left after the filters")
    return found

