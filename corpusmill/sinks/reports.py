"""Reports for people: a summary file, an answer with its sources, a notification."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.answers import think_answer
from corpusmill.functions.text import source_replace

MAX_NOTICE_BYTES = 4_000


def write_summary(path: str, header: str, passes: dict[int, str]) -> list[Path]:
    """Append a summary as an indented outline; earlier passes go to files numbered beside it."""
    target, written = Path(path), []
    last = max(passes)
    for number, text in sorted(passes.items()):
        file = target if number == last else target.with_name(f"{target.stem}.{number + 1}.md")
        before = file.read_text() if file.exists() else ""
        head = header + (f"\n    Recursive summary pass: {number + 1}/{len(passes)}" if len(passes) > 1 else "")
        body = "\n".join(f"    {line.rstrip()}" for line in text.split("\n"))
        file.write_text(before + ("\n\n\n" if before.strip() else "") + f"{head}\n{body}")
        written.append(file)
    return written


def answer_report(answers: DataFrame, final: str, sources: list[int], prefix: str = "DOC_") -> str:
    """Sources last to first with their facts and intermediate answers, then the final answer.

    ``answers``: source_no, page_content, metadata, wrapped. At most top-k rows.
    """
    ids = F.array(*[F.lit(n) for n in sources])
    shown = answers.select("source_no", F.trim("page_content").alias("text"), "metadata", source_replace(
        think_answer(F.col("wrapped"))["answer"], ids, prefix).alias("answer"))
    parts = ["---", "# Intermediate answers for each document:"]
    for row in shown.orderBy(F.desc("source_no")).toLocalIterator():
        facts = "\n".join(f"* **{k}**: `{v}`" for k, v in (row["metadata"] or {}).items())
        quoted = "\n".join("> " + line for line in ("### Intermediate answer:\n" + row["answer"]).split("\n"))
        parts.append(f'<a id="document-{row["source_no"]}"></a>\n\n## Document #{row["source_no"]}\n```\n{row["text"]}\n```\n{facts}\n{quoted}')
    parts += ["---", "\n".join("> " + line for line in f"# Answer:\n{final}".split("\n"))]
    return "\n".join(parts)


def notify(callback: Callable[[str], str], text: str) -> str:
    """Call a notification hook, which must give its text back."""
    if callback(text) != text:
        raise ValueError("the notification callback must return its text")
    return text


def notice_parts(text: str) -> tuple[str, bytes | None]:
    """A notice that is too long goes out as a file with a short note."""
    data = text.encode()
    return (text, None) if len(data) <= MAX_NOTICE_BYTES else ("The result is attached.", data)
