"""Bookmarks: one artifact each, chosen by kind and by what was asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.sources.headers import labelled_lines, tag_names, with_header

CONTENT_SOURCES = ("auto", "native", "parse")
ASSET_KINDS = ("pdf", "fullPageArchive", "precrawledArchive")


def ids_of_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Names to ids; an unknown name is an error that lists what there is."""
    missing = wanted.select("name").distinct().join(known.select("name"), "name", "left_anti").take(1)
    if missing:
        some = [r["name"] for r in known.select("name").distinct().sort("name").take(20)]
        raise ValueError(f"unknown name {missing[0]['name']!r}; known: {some}")
    return wanted.join(known, "name")


def header(bookmark: dict[str, Column]) -> Column:
    return labelled_lines({
        "Title": F.coalesce(F.nullif(bookmark["title"], F.lit("")), bookmark["content_title"]),
        "URL": F.coalesce(F.nullif(bookmark["url"], F.lit("")), bookmark["source_url"]),
        "Author": bookmark["author"], "Publisher": bookmark["publisher"], "Date": bookmark["date"],
        "Tags": tag_names(bookmark["tags"], "name"), "Note": bookmark["note"], "Summary": bookmark["summary"],
        "Karakeep id": bookmark["id"]})


def web_url(bookmark_id: Column, endpoint: str | None, url: Column, source_url: Column) -> Column:
    fallback = F.coalesce(F.nullif(url, F.lit("")), source_url, F.lit(""))
    if not endpoint:
        return fallback
    base = endpoint.split("/api/v1")[0].rstrip("/")
    return F.when(bookmark_id.isNotNull(), F.concat(F.lit(base + "/dashboard/preview/"), bookmark_id)).otherwise(fallback)


def stored_asset(pdf_id: Column, archive_id: Column, assets: Column) -> Column:
    """The stored file of a link: its pdf, its archive, else the first asset of a known kind."""
    known = F.filter(assets, lambda a: a["assetType"].isin(*ASSET_KINDS))
    return F.coalesce(F.nullif(pdf_id, F.lit("")), F.nullif(archive_id, F.lit("")), F.get(known, F.lit(0))["id"])


def artifact(kind: Column, text: Column, html: Column, asset_id: Column, head: Column, wanted: str = "auto",
             asset_type: Column | None = None) -> Column:
    """struct(filetype, content, asset_id) of a bookmark, NULL when it has nothing to offer.

    ``text`` is a note's text or a file's extracted text. ``wanted``: auto,
    native (what the service extracted) or parse (the stored file). An asset's file is offered
    if ``asset_type`` says pdf; without that column every file counts as one.
    """
    if wanted not in CONTENT_SOURCES:
        raise ValueError(f"content source is one of {CONTENT_SOURCES}, got {wanted!r}")
    has = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    none = F.lit(None).cast("string")
    as_text = F.struct(F.lit("txt").alias("filetype"), with_header(head, text).alias("content"), none.alias("asset_id"))
    as_html = F.struct(F.lit("local_html").alias("filetype"), with_header(head, html).alias("content"), none.alias("asset_id"))
    as_file = F.struct(F.lit("pdf").alias("filetype"), none.alias("content"), asset_id.alias("asset_id"))
    note, asset, link = kind == "text", kind == "asset", kind == "link"
    is_pdf = F.lit(True) if asset_type is None else F.coalesce(asset_type == "pdf", F.lit(False))
    chosen = F.when(note & has(text), as_text)
    if wanted in ("auto", "native"):
        chosen = chosen.when(asset & has(text), as_text)
    if wanted in ("auto", "parse"):
        chosen = chosen.when(asset & has(asset_id) & is_pdf, as_file)
    chosen = chosen.when(asset & has(text), as_text)
    if wanted == "native":
        return chosen.when(link & has(html), as_html)
    order = ((html, as_html), (asset_id, as_file)) if wanted == "auto" else ((asset_id, as_file), (html, as_html))
    for column, result in order:
        chosen = chosen.when(link & has(column), result)
    return chosen


# What ``is:`` asks for, by the column or kind it names.
STATES = {"fav": "favourited", "favourited": "favourited", "archived": "archived", "text": "text", "link": "link", "asset": "asset"}
# A term: perhaps negated; a tag, a named value (quoted or not), a quoted phrase, or a word.
TERM = r'-?(?:#"[^"]*"|#\S+|(?:list|is):"[^"]*"|(?:list|is):\S+|"[^"]*"|\S+)'


def search_terms(text: Column) -> Column:
    """The terms of a search as array<struct<negated, kind, value>>: ``word``, ``"a phrase"``, ``#tag``, ``list:x``, ``is:x``, each after ``-``.

    Values are lower-cased and without quotes; terms without a value are left out. All terms must hold.
    """
    def term(raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"\A-(?=.)", "")
        kind = F.when(bare.startswith("#"), "tag").when(bare.rlike(r"\A(?i)list:"), "list").when(bare.rlike(r"\A(?i)is:"), "is").otherwise("word")
        value = F.regexp_replace(F.when(kind == "word", bare).otherwise(F.regexp_replace(bare, r"\A(?:#|[^:\"]*:)", "")), '"', "")
        return F.struct((raw != bare).alias("negated"), kind.alias("kind"), F.lower(F.trim(value)).alias("value"))

    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), term)
    return F.filter(found, lambda t: t["value"] != "")


def term_holds(term: Column) -> Column:
    """Whether a term holds for a bookmark: columns title, text, url, tags, lists, kind, favourited, archived."""
    words = F.lower(F.concat_ws("\n", "title", "text", "url"))
    lowered = lambda names: F.transform(F.coalesce(F.col(names), F.array().cast("array<string>")), F.lower)
    state = F.create_map(*[x for word, name in STATES.items() for x in (F.lit(word), F.lit(name))])
    asked = F.try_element_at(state, term["value"])
    holds = (F.when(term["kind"] == "tag", F.array_contains(lowered("tags"), term["value"]))
             .when(term["kind"] == "list", F.array_contains(lowered("lists"), term["value"]))
             .when((term["kind"] == "is") & (asked == "favourited"), F.col("favourited"))
             .when((term["kind"] == "is") & (asked == "archived"), F.col("archived"))
             .when(term["kind"] == "is", F.coalesce(F.col("kind") == asked, F.lit(False)))
             .otherwise(F.contains(words, term["value"])))
    return F.coalesce(holds, F.lit(False)) != term["negated"]


def resolve_bookmarks(bookmarks: DataFrame, selectors: DataFrame) -> DataFrame:
    """Each distinct ``selector`` with the bookmarks it means, each once.

    Bookmarks have id (text), title, text, url, tags and lists (arrays of names), kind (text, link or asset),
    favourited and archived. Kinds of selectors: all of the library, favourites, archived ones, those with a tag, in a list,
    of given ids, or that a search finds. A tag, list or id that no bookmark has is an error. Tags, lists
    and ids are joins on their names; searches, a stated set, are held against every bookmark in one pass.
    """
    from corpusmill.functions.selectors import bookmark_selector
    from corpusmill.operators.lineage import checkpointed

    parsed = checkpointed(selectors.select("selector").distinct().withColumn("s", bookmark_selector(F.col("selector"))).select(
        "selector", F.col("s.kind").alias("wanted"), F.col("s.values").alias("values")))
    empty = parsed.where(~F.col("wanted").isin("library", "favourites", "archived") & (F.size("values") == 0)).take(1)
    if empty:
        raise ValueError(f"the selector {empty[0]['selector']!r} names nothing")
    named = parsed.where(F.col("wanted").isin("tag", "list", "ids")).select("selector", "wanted", F.explode("values").alias("name"))
    held = bookmarks.select("id", F.explode(F.concat(
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda n: F.struct(F.lit("tag").alias("wanted"), n.alias("name"))),
        F.transform(F.coalesce("lists", F.array().cast("array<string>")), lambda n: F.struct(F.lit("list").alias("wanted"), n.alias("name"))),
        F.array(F.struct(F.lit("ids").alias("wanted"), F.col("id").alias("name"))))).alias("h")).select("id", "h.*")
    by_name = checkpointed(named.join(held, ["wanted", "name"]).select("selector", "wanted", "name", "id"))
    unknown = named.join(by_name.select("wanted", "name").distinct(), ["wanted", "name"], "left_anti").take(1)
    if unknown:
        kind = unknown[0]["wanted"]
        some = [r["name"] for r in held.where(F.col("wanted") == kind).select("name").distinct().sort("name").take(20)]
        raise ValueError(f"unknown {kind} {unknown[0]['name']!r}; known: {some}")
    searches = parsed.where(F.col("wanted") == "search").select("selector", search_terms(F.col("values")[0]).alias("terms"))
    flags = parsed.where(F.col("wanted").isin("library", "favourites", "archived")).select("selector", F.col("wanted").alias("flag"))
    fits = (F.col("flag") == "library") | ((F.col("flag") == "favourites") & F.col("favourited")) | ((F.col("flag") == "archived") & F.col("archived"))
    meant = bookmarks.join(searches, F.col("id").isNotNull() & F.forall("terms", term_holds)).select("selector", "id").unionByName(
        bookmarks.join(flags, F.col("id").isNotNull() & F.coalesce(fits, F.lit(False))).select("selector", "id"))
    chosen = by_name.select("selector", "id").unionByName(meant).distinct()
    return chosen.join(bookmarks, "id")
