"""Answers as pages of an outline: tags linked, lines made safe."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub_tags(tags: Column) -> Column:
    """Tags that are part of another tag of the same list."""
    return F.filter(tags, lambda t: F.exists(tags, lambda o: (o != t) & F.contains(o, t)))


def _whole_word(tag: Column) -> Column:
    return F.concat(F.lit(r"(?i)\b\Q"), tag, F.lit(r"\E\b"))


def link_tags(text: Column, longer: Column, shorter: Column) -> Column:
    """Link whole-word tags in place; append to each line the shorter tags it mentions."""
    linked = F.aggregate(longer, text, lambda acc, t: F.regexp_replace(
        acc, _whole_word(t), F.concat(F.lit("[["), F.regexp_replace(t, r"([\\$])", r"\\$1"), F.lit("]]"))))

    def with_tags(line: Column) -> Column:
        found = F.filter(shorter, lambda t: F.regexp_like(line, _whole_word(t)))
        head = F.regexp_replace(line, r"\s+\z", "")
        return F.when(F.size(found) > 0, F.concat(head, F.array_join(F.transform(
            found, lambda t: F.concat(F.lit(" [["), t, F.lit("]]"))), ""))).otherwise(line)

    return F.array_join(F.transform(F.split(linked, "\n"), with_tags), "\n")


def page_text(folder: str, name: str) -> str:
    """What a page says now; to be kept while a text for it is made."""
    target = Path(folder) / f"{name}.md"
    return target.read_text() if target.exists() else ""


def append_page(folder: str, name: str, body: str, known: str | None = None) -> Path:
    """Add to a page file. ``known`` is what the page said when the text was made: if it says something
    else now, the text goes to a conflict file beside it."""
    target = Path(folder) / f"{name}.md"
    before = page_text(folder, name)
    if known is not None and before != known:
        target = target.with_suffix(".conflict.md")
        before = page_text(folder, f"{name}.conflict")
    target.write_text(f"{before.rstrip()}\n{body}\n" if before.strip() else f"{body}\n")
    return target
