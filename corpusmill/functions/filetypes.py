"""Which loader a path belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules, searched anywhere in the path; the first hit wins.
# The dots are wildcards on purpose.
FILETYPE_RULES = [
    ("youtube_playlist", "youtube.*playlist"),
    ("youtube", r"youtube|invidi|youtu\."),
    ("logseq_markdown", ".*logseq.*.md"),
    ("txt", ".txt$|.md$"),
    ("online_pdf", "^http.*pdf.*"),
    ("pdf", ".*pdf$"),
    ("url", "^http"),
    ("local_html", r"\.html?$"),
    ("local_audio", ".*(mp3|m4a|ogg|flac)$"),
    ("epub", ".epub$"),
    ("powerpoint", ".ppt$|.pptx$|.odp$"),
    ("word", ".doc$|.docx$|.odt$"),
    ("local_video", ".mp4|.avi|.mkv"),
    ("json_entries", ".*.json"),
    ("toml_entries", ".*.toml"),
]

# The bucket of a requested url, by resource type first, then by url.
MEDIA_RULES = [
    ("media", "media", None),
    ("mpeg", "mpeg", None),
    ("m3u", "m3u", ".m3u"),
    ("mp3", "mp3", ".mp3"),
    ("mp4", "mp4", ".mp4"),
]


def infer_filetype(path: Column) -> Column:
    """File type of a path, NULL where only its content can tell."""
    chosen = None
    for name, rule in FILETYPE_RULES:
        hit = path.rlike(rule)
        if name == "local_html":
            hit = hit & ~path.startswith("http")
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen


def filetype_by_magic(head: Column) -> Column:
    """Second opinion from the first bytes of a file."""
    sign = F.hex(F.substring(head, 1, 4))
    return (F.when(sign == "25504446", "pdf")
            .when(sign.startswith("494433") | sign.startswith("FFFB"), "local_audio")
            .when(F.contains(F.decode(F.substring(head, 1, 80), "ISO-8859-1"), F.lit("application/epub+zip")), "epub"))


def media_bucket(url: Column, resource_type: Column, url_regex: str | None = None,
                 resource_regex: str | None = None) -> Column:
    chosen = F.when(F.lit(False), "")
    if url_regex:
        chosen = chosen.when(url.rlike(r"\A(?:" + url_regex + ")"), "url_regex")
    if resource_regex:
        chosen = chosen.when(resource_type.rlike(r"\A(?:" + resource_regex + ")"), "resourcetype_regex")
    for name, kind, suffix in MEDIA_RULES:
        hit = F.contains(resource_type, F.lit(kind))
        if suffix:
            hit = hit | F.contains(url, F.lit(suffix))
        chosen = chosen.when(hit, name)
    return chosen.otherwise("nonmedia")
