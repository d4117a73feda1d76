"""Text out of html, by regular expressions inside the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.let import let
from corpusmill.functions.text import strip

# The commonest entities, and those HTML 4 names besides.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"), ("&amp;", "&"),
]

NODES = (
    r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
    r"|<[a-z!/?][^>]*>|[^<]+|<"
)


NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, **{e[1:-1]: c for e, c in ENTITIES if e[1] != "#"}}
ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"


def _decode(text: Column) -> Column:
    """Named and numeric entities as characters; unknown ones stay. The ampersand comes last on purpose."""
    names = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])

    def char(entity: Column) -> Column:
        body = F.substring(entity, 2, 9)
        number = F.when(body.startswith("#x") | body.startswith("#X"), F.conv(F.regexp_extract(body, "[0-9a-fA-F]+", 0), 16, 10))
        code = number.otherwise(F.regexp_extract(body, r"\d+", 0)).try_cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        one = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(body.startswith("#"), F.when(valid, one)).otherwise(F.try_element_at(names, F.regexp_replace(body, ";", "")))

    def put(acc: Column, entity: Column) -> Column:
        return let(char(entity), lambda c: F.when(c.isNull(), acc).otherwise(F.replace(acc, entity, c)))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    last = F.filter(found, lambda e: e == "&amp;")
    decoded = F.aggregate(F.concat(F.filter(found, lambda e: e != "&amp;"), last), text, put)
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_to_text(html: Column, remove_image: bool = False) -> Column:
    """All text nodes, trimmed and joined by spaces; list items and ``<br>`` break lines.

    Script, style, comment and doctype contents count as text nodes, and image
    tags stay in place unless ``remove_image`` is set.
    """
    plain = F.regexp_replace(strip(_decode(html)), "\n{2,}", "\n")
    tagged = F.contains(html, F.lit("<"))
    for seam in ("</li><li>", "</ul><ul>"):
        html = F.replace(html, F.lit(seam), F.lit("<br>"))
    for line_break in ("<br>", "</br>"):
        html = F.replace(html, F.lit(line_break), F.lit("\n"))

    def shown(node: Column) -> Column:
        code = r"(?is)^<(?:script|style)\b[^>]*>|</(?:script|style)\s*>$"
        return (
            F.when(node.rlike(r"(?i)^<(?:script|style)\b[^>]*>"), strip(F.regexp_replace(node, code, "")))
            .when(node.startswith("<!--"), strip(F.regexp_replace(node, r"^<!--|-->$", "")))
            .when(node.rlike(r"(?i)^<!doctype"), strip(F.regexp_replace(node, r"(?i)^<!doctype|>$", "")))
            .when(node.rlike(r"(?i)^<img\b"), F.lit("") if remove_image else node)
            .when(node.rlike(r"(?i)^<[a-z!/?]"), F.lit(""))
            .otherwise(strip(_decode(node)))
        )

    nodes = F.transform(F.regexp_extract_all(html, F.lit(NODES), F.lit(0)), shown)
    joined = F.array_join(F.filter(nodes, lambda n: n != ""), " ")
    return F.when(tagged, F.regexp_replace(joined, "\n{2,}", "\n")).otherwise(plain)


def visible_text(html: Column) -> Column:
    """Text a reader sees: no scripts, styles, comments or tags; nothing put between nodes."""
    bare = F.regexp_replace(
        html, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", "")
    return strip(_decode(F.regexp_replace(bare, r"(?is)<[a-z!/?][^>]*>", "")))


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"<[a-zA-Z]")


def clean_if_html(text: Column) -> Column:
    return F.when(looks_like_html(text), visible_text(text)).otherwise(text)


def page_title(html: Column) -> Column:
    """Content of the title element, NULL when missing or blank."""
    return F.nullif(strip(_decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


# Media placeholders

# What counts as an image, a sound and a link inside a card.
IMAGE = r"(?s)<img .*?src=.*?/?>"
SOUND = r"\[sound:\w+\.\w{2,3}\]"
LINK = r"[A-Za-z0-9]+://[A-Za-z0-9%-_]+(?:/[A-Za-z0-9%-_])*(?:#|\\?)[A-Za-z0-9%-_&=]*"


def _swap(state: Column, found: Column, label: str) -> Column:
    """Replace each distinct find by ``[label_i]`` and remember what it stood for."""
    pairs = F.transform(found, lambda m, i: F.struct(
        F.concat(F.lit(f"[{label}_"), (i + 1).cast("string"), F.lit("]")).alias("mark"), m.alias("media")))

    def step(acc: Column, pair: Column) -> Column:
        usable = F.contains(acc["content"], pair["media"]) & ~F.contains(acc["content"], pair["mark"])
        return F.struct(
            F.when(usable, F.replace(acc["content"], pair["media"], pair["mark"]))
            .otherwise(acc["content"]).alias("content"),
            F.when(usable, F.concat(acc["media"], F.array(pair))).otherwise(acc["media"]).alias("media"),
        )

    return F.aggregate(pairs, state, step)


# a space before or after the colon and slashes of an address
BROKEN_ADDRESS = r"(?<=\bhttps?) (?=://)|(?<=://) "


def take_media(content: Column, images: bool = True, links: bool = True, sounds: bool = True) -> Column:
    """Swap media for placeholders: struct of ``content`` and the ``media`` pairs taken out."""
    if links:
        content = F.regexp_replace(content, BROKEN_ADDRESS, "")
    state = F.struct(content.alias("content"),
                     F.expr("cast(array() as array<struct<mark:string,media:string>>)").alias("media"))
    for wanted, pattern, label in ((images, IMAGE, "IMAGE"), (sounds, SOUND, "SOUND"), (links, LINK, "LINK")):
        if wanted:
            state = let(state, _swapper(pattern, label))
    return state


def _swapper(pattern: str, label: str):
    def run(state: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(state["content"], F.lit(pattern), F.lit(0)))
        return _swap(F.struct(state["content"].alias("content"), state["media"].alias("media")), found, label)

    return run


def put_media_back(state: Column) -> Column:
    return F.aggregate(F.reverse(state["media"]), state["content"],
                       lambda acc, pair: F.replace(acc, pair["mark"], pair["media"]))
