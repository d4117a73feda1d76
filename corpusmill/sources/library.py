"""A reference library: items with attachments and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators.tree import descendants, resolve_path
from corpusmill.sources.headers import creator_names, labelled_lines, tag_names, with_header

TEXT_MODES = ("file", "fulltext", "hybrid")
# Item types that belong to another item, and the conditions a saved search may hold.
CHILD_TYPES = ("attachment", "note", "annotation")
LINKED_URL, LINKED_FILE = "linked_url", "linked_file"


def bibliography_header(data: dict[str, Column]) -> Column:
    return labelled_lines({
        "Title": data["title"], "Authors": creator_names(data["creators"]), "Date": data["date"],
        "Item type": data["itemType"], "Publication": data["publicationTitle"], "DOI": data["DOI"],
        "URL": data["url"], "Tags": tag_names(data["tags"], "tag"), "Zotero key": data["key"]})


def item_url(href: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(href, F.lit("")), F.concat(F.lit("zotero://select/library/items/"), key))


def metadata_text(header: Column, abstract: Column) -> Column:
    return F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(header, F.lit("\n\nAbstract:\n"), abstract)).otherwise(header)


def attachment_place(link_mode: Column, content_type: Column, filename: Column, url: Column) -> Column:
    """struct(filetype, path) of an attachment; NULL when it is neither stored nor linked."""
    pdf = content_type == "application/pdf"
    kind = F.when(pdf, "pdf").otherwise("auto")
    return (F.when(link_mode == LINKED_URL, F.when(url.isNotNull(), F.struct(F.lit("url").alias("filetype"), url.alias("path"))))
            .when(filename.isNotNull(), F.struct(kind.alias("filetype"), filename.alias("path"))))


def fan_out(items: DataFrame, children: DataFrame, text_mode: str = "file", include_metadata: bool = True,
            include_notes: bool = False) -> DataFrame:
    """Documents of each item: its metadata, its attachments, its notes.

    ``items``: key, title, header, abstract. ``children``: parent_key, child_key,
    item_type, title, fulltext, filetype, path, note. Children are joined once;
    which document each becomes is a matter of columns. Items without children
    keep their metadata document, which needs no join at all.
    """
    if text_mode not in TEXT_MODES:
        raise ValueError(f"text mode is one of {TEXT_MODES}, got {text_mode!r}")
    has = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    none = F.lit(None).cast("string")
    joined = children.withColumnRenamed("title", "child_title").join(
        items.select(F.col("key").alias("parent_key"), "title", "header"), "parent_key")
    is_file, is_note = F.col("item_type") == "attachment", F.col("item_type") == "note"
    full = F.lit(text_mode in ("fulltext", "hybrid")) & has(F.col("fulltext"))
    branch = (F.when(is_file & full, "fulltext")
              .when(is_file & F.lit(text_mode != "fulltext") & F.col("path").isNotNull(), "file")
              .when(is_note & F.lit(include_notes) & has(F.col("note")), "note"))
    content = (F.when(branch == "fulltext", with_header(F.col("header"), F.col("fulltext")))
               .when(branch == "note", F.when(F.col("header") != "", F.concat("header", F.lit("\n\nNote:\n"), "note")).otherwise(F.col("note"))))
    shown = F.when(branch == "note", F.concat("title", F.lit(" (note)"))).otherwise(F.coalesce(F.nullif("child_title", F.lit("")), "title"))
    parts = joined.withColumn("branch", branch).filter(F.col("branch").isNotNull()).select(
        F.col("parent_key").alias("key"), "child_key", "branch", shown.alias("title"),
        F.when(F.col("branch") == "file", F.col("filetype")).otherwise("txt").alias("filetype"),
        F.when(F.col("branch") == "file", F.col("path")).alias("path"), content.alias("content"))
    if not include_metadata:
        return parts
    own = items.select("key", none.alias("child_key"), F.lit("metadata").alias("branch"),
                       F.concat("title", F.lit(" (metadata)")).alias("title"), F.lit("txt").alias("filetype"),
                       none.alias("path"), metadata_text(F.col("header"), F.col("abstract")).alias("content"))
    return own.filter(has(F.col("content"))).unionByName(parts)


def saved_search(items: DataFrame, conditions: list[tuple[str, str]]) -> DataFrame:
    """Items of a saved search; conditions other than tag, title, quicksearch and itemType are ignored."""
    kept = F.lit(True)
    for name, value in conditions:
        low = value.lower()
        if name == "tag":
            kept = kept & F.exists("tags", lambda t: t["tag"] == value)
        elif name == "title" or name.startswith("quicksearch"):
            kept = kept & F.contains(F.lower("title"), F.lit(low))
        elif name == "itemType":
            kept = kept & (F.col("itemType") == value)
    return items.filter(kept)


def resolve(items: DataFrame, collections: DataFrame, membership: DataFrame, kind: str, values: list[str],
            searches: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Items a selector asks for, each once, children left out. ``membership``: item_key, collection_key."""
    parents = items.filter(~F.col("itemType").isin(*CHILD_TYPES))
    if kind == "library":
        return parents
    if kind == "items":
        return parents.filter(F.col("key").isin(*values))
    if kind == "tag":
        return parents.filter(F.forall(F.array(*[F.lit(v) for v in values]),
                                       lambda v: F.array_contains(F.transform("tags", lambda t: t["tag"]), v)))
    if kind == "search":
        if values[0] not in (searches or {}):
            raise ValueError(f"no saved search {values[0]!r}")
        return saved_search(parents, searches[values[0]])
    if kind == "collection":
        path = [p.strip() for p in values[0].replace("%%", "/").split("/") if p.strip()]
        top = resolve_path(collections, path)
        below = descendants(collections.filter("parent is not null").select("key", "parent"),
                            collections.filter(F.col("key") == top).select("key"))
        inside = membership.join(below.select(F.col("key").alias("collection_key")), "collection_key")
        return parents.join(inside.select(F.col("item_key").alias("key")).distinct(), "key", "left_semi")
    raise ValueError(f"unknown selector {kind!r}")
