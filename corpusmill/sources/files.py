"""Files of a distributed file system as documents."""

from __future__ import annotations

import io
import math
import posixpath
import re
import zipfile
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.html import html_to_text, visible_text
from corpusmill.functions.text import CHARS_PER_TOKEN, content_hash, markdown_images_to_mark, strip
from corpusmill.operators.documents import metadata_map
from corpusmill.operators.splitting import check_overlap, cuts

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(filetype: str):
    """Register a loader under the file type it reads."""
    def register(fn):
        LOADERS[filetype] = fn
        return fn
    return register


def load(spark: SparkSession, filetype: str, path: str, **options) -> DataFrame:
    if filetype not in LOADERS:
        raise ValueError(f"no loader for {filetype!r}; known: {sorted(LOADERS)}")
    return LOADERS[filetype](spark, path, **options)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("page_content"))


def _typed(docs: DataFrame, filetype: str, metadata: Column | None = None) -> DataFrame:
    empty = F.expr("cast(map() as map<string,string>)")
    return docs.withColumns({"filetype": F.lit(filetype), "file_hash": content_hash(F.col("page_content")),
                             "metadata": empty if metadata is None else metadata})


@loader("txt")
def load_txt(spark: SparkSession, path: str) -> DataFrame:
    """One document per file."""
    return _typed(_read(spark, path), "txt")


@loader("text")
def load_text(spark: SparkSession, path: str, metadata: dict[str, str] | str | None = None) -> DataFrame:
    """The path is the text itself."""
    import json

    facts = json.loads(metadata) if isinstance(metadata, str) else (metadata or {})
    docs = spark.createDataFrame([(path, path)], "path string, page_content string")
    return _typed(docs, "text", metadata_map({k: F.lit(str(v)) for k, v in facts.items()}) if facts else None)


@loader("string")
def load_string(spark: SparkSession, path: str) -> DataFrame:
    """Pasted text."""
    docs = spark.createDataFrame([("user_string", path)], "path string, page_content string")
    return _typed(docs, "string")


@loader("local_html")
def load_html(spark: SparkSession, path: str, functions: list[Callable[[Column], Column]] | None = None) -> DataFrame:
    """Html files; ``functions`` of the text column run before the tags go."""
    docs = _read(spark, path)
    for fn in functions or ():
        docs = docs.withColumn("page_content", fn(F.col("page_content")))
    return _typed(docs.withColumn("page_content", visible_text(F.col("page_content"))), "local_html")


def json_dict_docs(docs: DataFrame, column: str, template: str, exclude: list[str] | None = None) -> DataFrame:
    """One document per key of a JSON object, through a template with {key} and {value}."""
    if "{key}" not in template or "{value}" not in template:
        raise ValueError("the template needs {key} and {value}")
    kept = [c for c in docs.columns if c != column]
    pairs = docs.select(*kept, F.explode(F.from_json(column, "map<string,string>")).alias("_k", "_v"))
    if exclude:
        pairs = pairs.filter(~F.col("_k").isin(*exclude))
    text = F.replace(F.replace(F.lit(template), F.lit("{key}"), F.col("_k")), F.lit("{value}"), F.col("_v"))
    return pairs.select(*kept, text.alias("page_content"))


@loader("json_dict")
def load_json_dict(spark: SparkSession, path: str, template: str = "{key}: {value}", exclude: list[str] | None = None) -> DataFrame:
    return _typed(json_dict_docs(_read(spark, path), "page_content", template, exclude), "json_dict")


def _home(block: str, chunks: list[str], starts: list[int], marked: str, bare: str) -> int | None:
    """First chunk that holds the block, or that holds it together with the next one."""
    at = marked.find(block)
    if at >= 0:
        chunk = bisect_right(starts, at) - 1
        # the same first place without the marks: no border between chunks makes an earlier match
        if bare.find(block, 0, at - chunk + len(block)) == at - chunk:
            return chunk
    for i, body in enumerate(chunks):
        after = chunks[i + 1] if i + 1 < len(chunks) else ""
        if block in body or (block not in after and block in body + after):
            return i
    return None


# A line that sets a property of the block above it.
PROPERTY = re.compile(r"\s*-?\s*([A-Za-z0-9_-]+)::[ \t]*(.*)")


def _page_chunks(text: str, limit: int, overlap: int) -> tuple[list[tuple[str, dict]], float]:
    """(text, properties) of each chunk of one page, and the share of blocks no chunk holds."""
    blocks: list[str] = []
    props: list[tuple[int, str, str]] = []
    for line in text.split("\n"):
        found = PROPERTY.match(line)
        if found and found[2].strip():
            props.append((len(blocks), found[1], found[2].strip()))
        elif line.strip() and not found:
            blocks.append(line)
    bounds = cuts([math.ceil(len(b) / CHARS_PER_TOKEN) for b in blocks], limit, overlap)
    held = [" ".join(blocks[i:j]) for i, j in bounds]
    starts = list(accumulate((len(c) + 1 for c in held), initial=0))[:-1]
    marked, bare = "\x01".join(held), "".join(held)
    homes = [_home(b.strip(), held, starts, marked, bare) for b in blocks]
    merged: list[dict[str, set]] = [{} for _ in held]
    for number, key, value in props:
        # number 0 is the page itself, whose properties every chunk has
        for spot in range(len(held)) if number == 0 else [homes[number - 1]]:
            if spot is not None:
                merged[spot].setdefault(key, set()).add(value)
    facts = [{k: ",".join(sorted(v)) for k, v in sorted(m.items())} for m in merged]
    return list(zip(held, facts, strict=True)), sum(h is None for h in homes) / len(homes) if homes else 0.0


def outline_chunks(pages: DataFrame, limit: int, overlap: int, text: str = "text") -> DataFrame:
    """Outline pages to chunks that carry the properties of the blocks inside them.

    A block is a line; ``key:: value`` lines after it are its properties, those
    before the first block the page's. A block belongs to the first chunk that
    holds it, or that holds it together with the next. A page is one row, so
    pages run in parallel without an exchange. ``unmatched`` tells the share of
    blocks no chunk holds.
    """
    check_overlap(limit, overlap)
    kept = [f for f in pages.schema.fields if f.name != text]
    names = [f.name for f in kept]
    clean = markdown_images_to_mark(F.replace(text, F.lit("\t"), F.lit("    ")))
    schema = T.StructType([*kept, T.StructField("chunk_no", T.IntegerType()), T.StructField("page_content", T.StringType()),
                           T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
                           T.StructField("unmatched", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *own, body in batch[[*names, "_text"]].itertuples(index=False, name=None):
                chunks, unmatched = _page_chunks(body or "", limit, overlap)
                rows += [(*own, i, content, facts, unmatched) for i, (content, facts) in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=schema.names)

    return pages.select(*names, clean.alias("_text")).mapInPandas(run, schema)


@loader("logseq_markdown")
def load_outline(spark: SparkSession, path: str, limit: int = 3072, overlap: int = 500) -> DataFrame:
    chunks = outline_chunks(_read(spark, path), limit, overlap, "page_content")
    return chunks.withColumns({
        "filetype": F.lit("logseq_markdown"), "file_hash": content_hash(F.col("path")),
        "load_error": F.when(F.col("unmatched") >= 0.5, "most blocks were not found in the chunks")}).drop("unmatched")


def _by_number(name: str) -> tuple:
    return tuple(int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name))


def _tagged(xml: str, tag: str, breaks: str) -> str:
    """The text of all ``tag`` elements, with a line break at each of ``breaks``."""
    xml = re.sub(breaks, "\n", xml)
    return "".join(m.group(1) if m.group(1) is not None else "\n" for m in re.finditer(rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>|\n", xml))


def _open_text(xml: str) -> str:
    """The text of an OpenDocument body: paragraphs and headings are lines, runs of spaces are written out."""
    body = re.sub(r"(?s)\A.*?<office:body\b[^>]*>|</office:body>.*\Z", "", xml)
    body = re.sub(r'<text:s(?:\s+text:c="(\d+)")?\s*/>', lambda m: " " * int(m.group(1) or 1), body.replace("\n", " "))
    body = re.sub(r"<text:tab\b[^>]*/>", "\t", body)
    return re.sub(r"<[^>]*>", "", re.sub(r"</text:(?:p|h)>|<text:line-break\s*/>|<text:(?:p|h)\b[^>]*/>", "\n", body))


def _chapters(archive: zipfile.ZipFile) -> list[str]:
    """The chapters of a book in reading order: its spine, or all pages by name where it has none."""
    pages = sorted((n for n in archive.namelist() if re.fullmatch(r"(?i).*\.x?html?", n)), key=_by_number)
    try:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        root = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(archive.read(root))
    except (KeyError, StopIteration, ElementTree.ParseError):
        return pages
    folder = posixpath.dirname(root)
    places = {e.get("id"): posixpath.normpath(posixpath.join(folder, unquote(e.get("href") or "")))
              for e in package.iter() if e.tag.endswith("}item")}
    spine = [places.get(e.get("idref")) for e in package.iter() if e.tag.endswith("}itemref")]
    return [n for n in spine if n in set(archive.namelist())] or pages


def _word_text(archive: zipfile.ZipFile) -> str:
    if "content.xml" in archive.namelist():
        return _open_text(archive.read("content.xml").decode("utf-8", "replace"))
    return _tagged(archive.read("word/document.xml").decode("utf-8", "replace"), "w:t", r"</w:p>|<w:br\b[^>]*/>")


def _slides_text(archive: zipfile.ZipFile) -> str:
    if "content.xml" in archive.namelist():
        return _open_text(archive.read("content.xml").decode("utf-8", "replace"))
    slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_by_number)
    return "\n".join(_tagged(archive.read(n).decode("utf-8", "replace"), "a:t", r"</a:p>") for n in slides)


def _book_text(archive: zipfile.ZipFile) -> str:
    return "\n".join(archive.read(n).decode("utf-8", "replace").replace("\r\n", "\n") for n in _chapters(archive))


def _zip_loader(spark: SparkSession, path: str, filetype: str, read: Callable[[zipfile.ZipFile], str], html: bool = False) -> DataFrame:
    """One document per file; a file that is no such archive has no text and a ``load_error``."""
    @F.pandas_udf("struct<text:string,error:string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        found = []
        for data in contents:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    found.append((read(archive), None))
            except (zipfile.BadZipFile, KeyError) as error:
                found.append((None, f"not a {filetype} file: {error}"))
        return pd.DataFrame(found, columns=["text", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", run("content").alias("r"), content_hash(F.col("content")).alias("file_hash"))
    text = html_to_text(F.col("r.text")) if html else F.regexp_replace("r.text", "\n{2,}", "\n")
    decoded = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return files.select("path", strip(decoded).alias("page_content"), F.lit(filetype).alias("filetype"), "file_hash",
                        F.expr("cast(map() as map<string,string>)").alias("metadata"), F.col("r.error").alias("load_error"))


@loader("word")
def load_word(spark: SparkSession, path: str) -> DataFrame:
    """Word and OpenDocument text files; old binary ones are reported, not read."""
    return _zip_loader(spark, path, "word", _word_text)


@loader("powerpoint")
def load_powerpoint(spark: SparkSession, path: str) -> DataFrame:
    """Presentations, slide by slide."""
    return _zip_loader(spark, path, "powerpoint", _slides_text)


@loader("epub")
def load_epub(spark: SparkSession, path: str) -> DataFrame:
    """All chapters of a book as one document, in reading order."""
    return _zip_loader(spark, path, "epub", _book_text, html=True)


# Pdf parsers are looked up by name; each is a function from bytes to text.
PDF_PARSERS: dict[str, Callable[[bytes], str]] = {}


def pdf_parser(name: str):
    def register(fn):
        PDF_PARSERS[name] = fn
        return fn
    return register


try:
    import pypdfium2

    @pdf_parser("pypdfium2")
    def _pypdfium2(data: bytes) -> str:
        return "\n".join(page.get_textpage().get_text_range() for page in pypdfium2.PdfDocument(data))
except ImportError:
    pass

try:
    import pdfminer.high_level

    @pdf_parser("pdfminer")
    def _pdfminer(data: bytes) -> str:
        return pdfminer.high_level.extract_text(io.BytesIO(data))
except ImportError:
    pass


def parse_with(name: str, content: Column) -> Column:
    """What one parser makes of each file, without blank pages; null where it fails or finds nothing."""
    parse = PDF_PARSERS[name]

    @F.pandas_udf("string")
    def run(files: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            try:
                pages = [page for page in (parse(data) or "").split("\f") if page.strip()]
            except Exception:  # noqa: BLE001 - a parser that fails is simply not a candidate
                return None
            return "\n".join(pages) or None

        return files.map(one)

    return run(content)


@loader("pdf")
def load_pdf(spark: SparkSession, path: str, parsers: list[str] | None = None) -> DataFrame:
    """Pdf files through the named parsers in turn: a file whose text is sure to be prose, or that three
    parsers could read, goes to no further one. The likeliest prose wins."""
    from corpusmill.functions.text import repair_double_encoding
    from corpusmill.operators.documents import language_probability
    from corpusmill.operators.staged import fall_through

    names = parsers or list(PDF_PARSERS)
    unknown = [n for n in names if n not in PDF_PARSERS]
    if unknown or not names:
        raise ValueError(f"no such pdf parser: {unknown}; available: {sorted(PDF_PARSERS)}")
    files = spark.read.format("binaryFile").load(path)
    found = fall_through(files.select("path", "content"), "path",
                         [(n, lambda _, n=n: repair_double_encoding(parse_with(n, F.col("content")))) for n in names], language_probability)
    known = files.select("path", content_hash(F.col("content")).alias("file_hash"))
    return found.join(known, "path").select(
        "path", F.col("content").alias("page_content"), F.lit("pdf").alias("filetype"), "file_hash",
        F.create_map(F.lit("pdf_loader_name"), F.col("stage")).alias("metadata"),
        F.when(F.col("stage").isNull(), "no parser succeeded").alias("load_error"))
