"""Kind and value of the selector strings that pick items out of a library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Selector words, by connector.
LIBRARY_WORDS = ("library", "*", "all")
REFERENCE_KINDS = {
    "tag": ("tag",),
    "items": ("item", "items", "key", "keys"),
    "search": ("search", "saved_search", "savedsearch"),
    "collection": ("collection", "col"),
}
REFERENCE_LISTS = ("tag", "items")
BOOKMARK_WORDS = {
    "favourites": ("favourites", "favorites", "favourited", "favorited"),
    "archived": ("archived",),
}
BOOKMARK_KINDS = {
    "tag": ("tag",),
    "ids": ("id", "ids", "bookmark", "bookmarks"),
    "search": ("search",),
    "list": ("list", "lst"),
}
BOOKMARK_LISTS = ("ids",)


def _parse(selector: Column, words: dict, kinds: dict, lists: tuple, default: str) -> Column:
    s = F.trim(selector)
    low = F.lower(s)
    prefix = F.when(F.contains(s, F.lit(":")), F.trim(F.split_part(low, F.lit(":"), F.lit(1))))
    rest = F.trim(F.regexp_replace(s, r"\A[^:]*:", ""))
    kind = F.when(low.isin(*LIBRARY_WORDS), "library")
    for name, spelled in words.items():
        kind = kind.when(low.isin(*spelled), name)
    for name, spelled in kinds.items():
        kind = kind.when(prefix.isin(*spelled), name)
    known = [p for spelled in kinds.values() for p in spelled]
    whole = F.array(F.when(prefix.isin(*known), rest).otherwise(s))
    listed = F.filter(F.transform(F.split(rest, ","), lambda t: F.trim(t)), lambda t: t != "")
    splits = [p for name in lists for p in kinds[name]]
    no_value = low.isin(*LIBRARY_WORDS, *[w for spelled in words.values() for w in spelled])
    values = F.when(no_value, F.expr("cast(array() as array<string>)")).when(
        prefix.isin(*splits), listed).otherwise(whole)
    return F.struct(kind.otherwise(default).alias("kind"), values.alias("values"))


def reference_selector(selector: Column) -> Column:
    """library, tag, items, search or collection, with the values asked for."""
    return _parse(selector, {}, REFERENCE_KINDS, REFERENCE_LISTS, "collection")


def bookmark_selector(selector: Column) -> Column:
    """library, favourites, archived, tag, ids, search or list, with the values asked for."""
    return _parse(selector, BOOKMARK_WORDS, BOOKMARK_KINDS, BOOKMARK_LISTS, "list")


def collection_path(path: Column) -> Column:
    """Parts of a nested collection path; ``%%`` separates like a slash."""
    parts = F.split(F.replace(path, F.lit("%%"), F.lit("/")), "/")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
