"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reading model and digest width.
LETTERS_PER_WORD = 6
WORDS_PER_MINUTE = 250
HASH_WIDTH = 20
CHARS_PER_TOKEN = 4.0


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_WIDTH)


def est_tokens(text: Column) -> Column:
    """Deterministic token estimate; pass another column function where a tokenizer is at hand."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("bigint")


def reading_minutes(n_chars: Column) -> Column:
    return n_chars / LETTERS_PER_WORD / WORDS_PER_MINUTE


def doc_reading_time(text: Column) -> Column:
    return F.round(reading_minutes(F.length(text)), 3)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


# The characters counted as white space at the ends of a text.
SPACES = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


# What Windows-1252 shows in place of Latin-1's control characters.
_SHOWN = {n: c for n in range(0x80, 0xA0) if (c := bytes([n]).decode("cp1252", "ignore"))}
WINDOWS_1252, LATIN_1 = "".join(_SHOWN.values()), "".join(map(chr, _SHOWN))


def repair_double_encoding(text: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1 or Windows-1252, when the whole text fits that story."""
    given, text = text, F.translate(text, WINDOWS_1252, LATIN_1)
    # The well-formed multi-byte sequences of UTF-8, as Latin-1 characters.
    sequences = (
        "[Â-ß][\u0080-¿]"
        "|à[ -¿][\u0080-¿]"
        "|[á-ìîï][\u0080-¿]{2}"
        "|í[\u0080-\u009f][\u0080-¿]"
        "|ð[\u0090-¿][\u0080-¿]{2}"
        "|[ñ-ó][\u0080-¿]{3}"
        "|ô[\u0080-\u008f][\u0080-¿]{2}"
    )
    # most texts have no character that could begin a sequence, and go no further
    led = given.rlike("[Â-ô]")
    broken = text.rlike(sequences) & ~F.regexp_replace(text, sequences, "").rlike("[^\u0000-\u007f]")
    return F.when(led & broken, F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")).otherwise(given)


def double_encode(text: Column) -> Column:
    """The damage that :func:`repair_double_encoding` undoes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


# Flash cards and markdown

def strip_cloze(text: Column) -> Column:
    return F.regexp_replace(text, r"\{\{c\d+::|\}\}", " ")


MD_IMAGE_TARGET = r"\s*(?:\([^\)]+\)|\[[^\]]+\])"


def markdown_images_to_name(text: Column) -> Column:
    """Replace a markdown image by its alternative text, shortened past 16 characters."""
    long_name = r"!\[([^\]]{8})[^\]]+([^\]]{8})\]" + MD_IMAGE_TARGET
    short_name = r"!\[([^\]]{0,16})\]" + MD_IMAGE_TARGET
    return F.regexp_replace(F.regexp_replace(text, long_name, "$1…$2"), short_name, "$1")


def markdown_images_to_mark(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[[^\]]*\]" + MD_IMAGE_TARGET, "[IMAGE]")


def markdown_links_to_text(text: Column) -> Column:
    return F.regexp_replace(text, r"\[([^\]]+)\]\(https?://[^)]+\)", "$1")


def reader_title(text: Column) -> Column:
    """Title line of a reader-service reply, NULL when the first line is none."""
    first = F.split_part(text, F.lit("\n"), F.lit(1))
    return F.when(first.startswith("Title: "), first.substr(F.lit(8), F.length(first)))


def reader_body(text: Column) -> Column:
    """What follows the first body mark, NULL without one."""
    mark = "Markdown Content:"
    at = F.locate(mark, text)
    return F.when(at > 0, text.substr(at + len(mark), F.length(text)))


def split_query(query: Column) -> Column:
    """A question as (text to embed, text to answer); NULL when it has more than one divider."""
    parts = F.split(query, ">>>>")
    n = F.size(parts)
    return F.when(n <= 2, F.struct(
        strip(parts[0]).alias("to_embed"),
        strip(F.element_at(parts, -1)).alias("to_answer"),
    ))


def parse_scalar(value: Column) -> Column:
    """Typed reading of a setting: (kind, text form of the value)."""
    low = F.lower(value)
    kind = (F.when(low.isin("true", "false"), "bool")
            .when(value.rlike(r"^[0-9]+$"), "int")
            .when(low.isin("none", ""), "none")
            .otherwise("str"))
    shown = (F.when(kind == "bool", low)
             .when(kind == "int", value.try_cast("bigint").cast("string"))
             .when(kind == "str", value))
    return F.struct(kind.alias("kind"), shown.alias("value"))


# Model output

def source_replace(text: Column, ids: Column, prefix: str) -> Column:
    """Turn source ids into numbered links.

    ``ids`` is an array of the numbers in use. They are replaced from the
    highest down, so that the id ending in 2 cannot damage the one ending in 21.
    """
    descending = F.sort_array(ids, asc=False)
    return F.aggregate(descending, text, lambda acc, n: F.replace(
        acc, F.concat(F.lit(prefix), n.cast("string")),
        F.concat(F.lit("["), n.cast("string"), F.lit("](#document-"), n.cast("string"), F.lit(")"))))


def wrap_source(position: Column, answer: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"<doc id=[[{prefix}"), position.cast("string"), F.lit("]]>\n"),
                    answer, F.lit("\n</doc>"))


def collate_line(answer: Column) -> Column:
    fixed = F.replace(F.replace(answer, F.lit("- • "), F.lit("- ")), F.lit("• "), F.lit("- "))
    return lstrip(fixed)


def citation_links(text: Column, template: str, default_source: Column) -> Column:
    """Rewrite ``[p.N]`` and ``[p.N, source]`` with a url template of {page} and {source}."""
    url = template.replace("{page}", "$1")
    head, *tail = url.split("{source}")
    pieces: list[Column] = [F.lit("[p.$1](" + head)]
    for part in tail:
        pieces += [F.regexp_replace(default_source, r"([\\$])", r"\\$1"), F.lit(part)]
    pieces.append(F.lit(")"))
    plain = F.regexp_replace(text, F.lit(r"\[p\.(\d+)\]"), F.concat(*pieces))
    return F.regexp_replace(plain, r"\[p\.(\d+),\s*([^\]]+)\]",
                            "[p.$1](" + url.replace("{source}", "$2") + ")")


# Paths

def path_basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def hide_home(path: Column, home: str) -> Column:
    return F.replace(path, F.lit(home), F.lit("~"))


def is_local_host(url: Column) -> Column:
    # Loopback names and private address ranges.
    host = F.lower(F.coalesce(
        F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?\[([^\]]+)\]", 1), F.lit("")),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\[]+)", 1)))
    second = F.regexp_extract(host, r"^172\.(\d{1,3})(?:\.|$)", 1).try_cast("int")
    return (host.isin("localhost", "127.0.0.1", "::1", "0.0.0.0") | host.endswith(".local")
            | host.startswith("10.") | host.startswith("192.168.")
            | F.coalesce(second.between(16, 31), F.lit(False)))


def model_backend(model: Column) -> Column:
    return F.split_part(model, F.lit("/"), F.lit(1))


def model_cache_name(model: Column) -> Column:
    """A model name as a safe folder name."""
    return F.regexp_replace(model, r"[^A-Za-z0-9]+", "_")
