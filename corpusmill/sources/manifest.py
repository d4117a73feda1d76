"""Manifests: what to load, expanded until nothing is left to expand."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.filetypes import infer_filetype
from corpusmill.functions.text import content_hash, strip
from corpusmill.operators.filters import path_predicate, useless_path_rules
from corpusmill.operators.lineage import checkpointed

# The file types that stand for more entries, and those a folder may not hold.
RECURSIVE_TYPES = ("recursive_paths", "json_entries", "toml_entries", "link_file", "youtube_playlist", "ddg", "zotero", "karakeep")
NOT_RECURSED = ("recursive_paths", "json_entries", "youtube", "anki")
# Arguments an entry may carry, with their types.
ENTRY_FIELDS = {
    "path": str, "filetype": str, "file_hash": str, "source_tag": str, "recur_parent_id": str, "subitem_link": str,
    "title": str, "loading_failure": str, "playlist_title": str, "anki_deck": str, "anki_notetype": str,
    "anki_profile": str, "anki_template": str, "anki_tag_filter": str, "anki_tag_render_filter": str,
    "audio_backend": str, "audio_unsilence": bool, "doccheck_max_token": int, "doccheck_min_lang_prob": float,
    "doccheck_min_token": int, "json_dict_exclude_keys": list, "json_dict_template": str, "load_functions": list,
    "metadata": (dict, str), "online_media_resourcetype_regex": str, "online_media_url_regex": str,
    "pdf_parsers": (str, list), "whisper_lang": str, "whisper_prompt": str, "youtube_audio_backend": str,
    "youtube_language": str, "youtube_translation": str, "deepgram_kwargs": dict, "pattern": str,
    "recursed_filetype": str, "include": list, "exclude": list,
}


def check_entry(entry: dict, mode: str = "warn") -> tuple[dict, list[str]]:
    """Entry and complaints about it. strict raises, warn keeps, strip drops what is unknown or mistyped."""
    if mode not in ("strict", "warn", "strip"):
        raise ValueError("mode is strict, warn or strip")
    if not entry:
        raise ValueError("empty entry")
    complaints, kept = [], {}
    for key, value in entry.items():
        kind = ENTRY_FIELDS.get(key)
        if kind is None:
            complaints.append(f"unknown argument {key!r}")
        elif value is not None and not isinstance(value, kind):
            complaints.append(f"argument {key!r} is a {type(value).__name__}")
        else:
            kept[key] = value
            continue
        if mode != "strip":
            kept[key] = value
    if complaints and mode == "strict":
        raise ValueError("; ".join(complaints))
    return kept, complaints


def _without_dash(line: Column) -> Column:
    return strip(F.regexp_replace(strip(line), r"\A-", ""))


def json_lines(lines: DataFrame, line: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Entries of a JSON-lines manifest as a map ``args``; comments and blank lines are skipped.

    ``defaults`` are the parent's arguments; the line's own win, and the file type starts as auto.
    """
    body = lines.withColumn("_l", _without_dash(F.col(line))).filter((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    own = F.from_json("_l", "map<string,string>")
    base = F.create_map(*[F.lit(x) for pair in {**(defaults or {}), "filetype": "auto"}.items() for x in pair])
    args = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    return body.withColumn("args", args).drop("_l", line)


def toml_entries(text: str) -> list[dict]:
    """One entry per table of a TOML manifest; a manifest file is small and read on the driver."""
    entries = []
    for name, tables in tomllib.loads(text).items():
        if not isinstance(tables, list) or len(tables) != 1:
            raise ValueError(f"[[{name}]] must appear exactly once")
        entries.append({"filetype": "auto", **tables[0]})
    return entries


def link_lines(lines: DataFrame, line: str) -> DataFrame:
    """Links of a link file: the target of a markdown link, else the bare address."""
    body = _without_dash(F.col(line))
    target = F.nullif(F.regexp_extract(body, r"\]\((https?://[^)\s]+)\)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(body, r"(https?://\S+)", 1), F.lit(""))
    return lines.filter(F.contains(F.col(line), F.lit("http"))).withColumn("path", F.coalesce(target, bare)).drop(line)


def recursive_paths(spark: SparkSession, folder: str, pattern: str = "*", recursed_filetype: str = "auto",
                    include: list[str] | None = None, exclude: list[str] | None = None,
                    on_useless: str = "warn") -> DataFrame:
    """Files below a folder. Spark lists them in parallel and reads no content here."""
    if recursed_filetype in NOT_RECURSED:
        raise ValueError(f"a folder cannot hold {recursed_filetype!r} entries")
    below, last = pattern.rpartition("/")[::2]
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", last or "*").load(folder).select("path"))
    if below.strip("/"):  # the directory part of the pattern: * stays within a folder, ** does not
        start = re.escape(re.sub(r"^[a-z0-9]+:/*", "", folder).strip("/"))
        inner = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p))
                        for p in re.split(r"(\*\*/|\*\*|\*|\?)", f"{below.strip('/')}/"))
        files = files.filter(F.col("path").rlike(f"(?:^|/){start}/{inner}[^/]*$"))
    useless = useless_path_rules(files, "path", include or (), exclude or ())
    if useless and on_useless == "crash":
        raise ValueError(f"these rules filter nothing: {useless}")
    kept = files.filter(path_predicate(F.col("path"), include or (), exclude or ()))
    return kept.select("path", F.lit(recursed_filetype).alias("filetype"),
                       content_hash(F.concat(F.lit(folder), F.lit("\n"), F.lit(pattern))).alias("recur_parent_id"))


def with_filetype(manifest: DataFrame) -> DataFrame:
    """Settle entries whose file type is auto."""
    return manifest.withColumn("filetype", F.when(F.col("filetype") == "auto", infer_filetype(F.col("path"))).otherwise(F.col("filetype")))


def expand(manifest: DataFrame, children_of: Callable[[DataFrame], DataFrame], recursive=RECURSIVE_TYPES) -> DataFrame:
    """Replace recursive entries by what they stand for until none is left.

    ``manifest``: path, filetype and whatever else an entry carries. ``children_of`` turns the
    open entries into rows of the same columns. A round works on all open entries at once and is
    stored. A chain of entries without a cycle is no longer than the distinct entries met,
    so more rounds than these are an error.
    """
    state = manifest.withColumn("round", F.lit(0))
    done, met, number = None, None, 0
    while True:
        number += 1
        state = checkpointed(state)
        is_open = F.col("filetype").isin(*recursive)
        settled = state.filter(~is_open)
        done = settled if done is None else done.unionByName(settled)
        pending = state.filter(is_open)
        if pending.isEmpty():
            return done
        here = pending.select("path", "filetype")
        met = checkpointed((here if met is None else met.unionByName(here)).distinct())
        if number > met.count():
            raise ValueError("the manifest keeps expanding into itself")
        state = children_of(pending).select(*manifest.columns, F.lit(number).alias("round"))


def unique_entries(manifest: DataFrame) -> DataFrame:
    """Each distinct entry once, in an order that depends on content only."""
    return manifest.dropDuplicates().orderBy("file_hash") if "file_hash" in manifest.columns else manifest.dropDuplicates()


def piped_entry(data: bytes, folder: str) -> dict:
    """What to make of piped input: an address, a path, a manifest, text, or bytes."""
    import json

    try:
        text = data.decode()
    except UnicodeDecodeError:
        target = Path(folder) / "piped.bin"
        target.write_bytes(data)
        return {"path": str(target), "filetype": "auto"}
    stripped = text.strip()
    one_line = stripped and "\n" not in stripped
    if one_line and stripped.startswith(("http://", "https://")):
        return {"path": stripped, "filetype": "auto"}
    if one_line and len(stripped) < 4096 and Path(stripped).exists():
        return {"path": stripped, "filetype": "auto"}
    suffix, filetype = "txt", "txt"
    try:
        json.loads(stripped.splitlines()[0] if stripped else "")
        suffix, filetype = "json", "json_entries"
    except ValueError:
        try:
            if any(isinstance(v, list) for v in tomllib.loads(stripped).values()):
                suffix, filetype = "toml", "toml_entries"
        except tomllib.TOMLDecodeError:
            pass
    target = Path(folder) / f"piped.{suffix}"
    target.write_text(text)
    return {"path": str(target), "filetype": filetype}
