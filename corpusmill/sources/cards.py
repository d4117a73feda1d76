"""Flash cards: one document per note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.html import html_to_text, take_media
from corpusmill.functions.text import content_hash, strip, strip_cloze
from corpusmill.operators.lineage import checkpointed

PLACEHOLDERS = r"\{([^}]*)\}"
BUILT_IN = ("allfields", "tags", "image_ocr_alt")


def shown_field(value: Column) -> Column:
    return strip(html_to_text(strip_cloze(value)))


def all_fields(names: Column, values: Column) -> Column:
    """``name: 'value'`` blocks of the fields that are not blank."""
    pairs = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda p: strip(p["value"]) != "")
    return F.array_join(F.transform(pairs, lambda p: F.concat(
        F.lower(p["name"]), F.lit(": '"), shown_field(p["value"]), F.lit("'"))), "\n\n")


def tag_block(tags: Column, render_filter: str | None = None) -> Column:
    shown = F.filter(tags, lambda t: t.rlike(r"\A(?:" + render_filter + ")")) if render_filter else tags
    return F.when(F.size(tags) > 0, F.concat(F.lit("\n"), strip(F.array_join(shown, "\n")), F.lit("\n"))).otherwise("")


def fill_template(template: str, names: Column, values: Column, tags: Column | None = None,
                  tag_render_filter: str | None = None) -> Column:
    """A card template with its fields filled in; fields are matched in lower case."""
    import re

    text = F.lit(template)
    if "{allfields}" in template:
        text = F.replace(text, F.lit("{allfields}"), all_fields(names, values))
    if "{tags}" in template:
        if tags is None:
            raise ValueError("the template asks for tags")
        text = F.replace(text, F.lit("{tags}"), tag_block(tags, tag_render_filter))
    lowered = F.transform(names, lambda n: F.lower(n))
    for field in sorted({p for p in re.findall(PLACEHOLDERS, template) if p.lower() not in BUILT_IN}):
        at = F.array_position(lowered, field.lower())
        value = F.when(at > 0, F.get(values, (at - 1).cast("int")))
        # a card without the field yields NULL, which check_template reports
        text = F.replace(text, F.lit("{" + field + "}"), html_to_text(strip_cloze(value)))
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\xa0"), F.lit(" "))


def image_captions(media: Column) -> Column:
    """Title and alternative text of the images taken out of a card."""
    def caption(m: Column) -> Column:
        title = F.nullif(strip(F.regexp_extract(m["media"], r'title="([^"]*)"', 1)), F.lit(""))
        alt = F.nullif(strip(F.regexp_extract(m["media"], r'alt="([^"]*)"', 1)), F.lit(""))
        lines = F.concat_ws("\n", F.concat(F.lit("Title: '"), title, F.lit("'")), F.concat(F.lit("Alt: '"), alt, F.lit("'")))
        return F.when(lines != "", F.concat(F.lit("\n<OCR of '"), m["mark"], F.lit("'>\n"), lines,
                                            F.lit("\n</OCR of '"), m["mark"], F.lit("'>")))

    images = F.filter(media, lambda m: m["mark"].startswith("[IMAGE_"))
    return F.array_join(F.transform(images, caption), "")


def load_cards(cards: DataFrame, template: str = "{allfields}\n{image_ocr_alt}", deck: str | None = None,
               notetype: str | None = None, tag_filter: str | None = None,
               tag_render_filter: str | None = None) -> DataFrame:
    """Cards to documents.

    ``cards``: cid, nid, codeck, cdeck, nmodel, ntags, nflds, fields_name, cqueue, cmod.
    First card per note and first note per text are found by a minimum over ids alone,
    combined on the map side; the notes are then looked up, so no text is sorted.
    """
    df = cards.withColumn("codeck", F.when(strip(F.col("codeck")) == "", F.col("cdeck")).otherwise(F.col("codeck")))
    df = df.withColumn("codeck", F.replace("codeck", F.lit("\x1f"), F.lit("::")))
    df = df.withColumn("nmodel", F.lower("nmodel")).filter(F.col("cqueue") != "suspended")
    if deck:
        df = df.filter(F.col("codeck").startswith(deck))
    if notetype:
        df = df.filter(F.col("nmodel").rlike("(?i)" + notetype))
    if tag_filter:
        df = df.filter(F.exists("ntags", lambda t: t.rlike(r"\A(?:" + tag_filter + ")")))
    filled = fill_template(template, F.col("fields_name"), F.col("nflds"), F.col("ntags"), tag_render_filter)
    notes = df.join(df.groupBy("nid").agg(F.min("cid").alias("cid")), ["nid", "cid"], "left_semi")
    texts = notes.withColumn("s", take_media(filled, links=False))
    marker = F.lit("{image_ocr_alt}")
    body = strip(F.replace(F.col("s.content"), marker, image_captions(F.col("s.media"))))
    texts = texts.select("nid", "codeck", "ntags", "cmod", body.alias("page_content"), F.col("s.media").alias("media"))
    kept = checkpointed(texts.filter(F.col("page_content") != "").withColumn("content_hash", content_hash(F.col("page_content"))))
    first = kept.groupBy("content_hash").agg(F.min("nid").alias("nid"))
    return (kept.join(first, ["content_hash", "nid"], "left_semi")
            .select("nid", "page_content", "content_hash", F.col("codeck").alias("anki_deck"),
                    F.array_join("ntags", " ").alias("anki_tags"), F.col("cmod").alias("anki_modtime"),
                    F.to_json(F.map_from_entries("media")).alias("anki_media")))


def check_template(cards: DataFrame, template: str) -> None:
    """Refuse a template that names a field some card lacks; one row comes back."""
    import re

    wanted = sorted({p.lower() for p in re.findall(PLACEHOLDERS, template)} - set(BUILT_IN))
    if not re.findall(PLACEHOLDERS, template):
        raise ValueError("the card template holds no placeholder")
    if not wanted:
        return
    row = cards.agg(*[F.count_if(~F.array_contains(F.transform("fields_name", lambda n: F.lower(n)), w)).alias(w)
                      for w in wanted]).first()
    missing = [w for w in wanted if row[w]]
    if missing:
        raise ValueError(f"fields {missing} are missing on some cards")
