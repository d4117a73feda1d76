"""The prompt: history, completion and settings."""

from __future__ import annotations

import json
from pathlib import Path

from corpusmill.config import parse

RETRIEVERS = ("basic", "multiquery", "knn", "svm", "parent")
SETTING_TYPES = {"top_k": (int, str), "relevancy": (float, int), "retriever": (str,), "task": (str,), "multiline": (bool,)}


def remember(path: str, prompt: str, timestamp: float) -> list[dict]:
    """Add a prompt to the history file: each prompt once, at its latest time, in order of time."""
    file = Path(path)
    known = json.loads(file.read_text()) if file.exists() else []
    times = {entry["prompt"]: entry["timestamp"] for entry in known}
    times[prompt] = max(timestamp, times.get(prompt, timestamp))
    ordered = [{"prompt": p, "timestamp": t} for p, t in sorted(times.items(), key=lambda x: x[1])]
    file.write_text(json.dumps(ordered, indent=1))
    return ordered


def complete(typed: str, words: list[str], prompts: list[str], settings: list[str]) -> list[str]:
    """Up to three words that go on from the last one, then earlier prompts that go on from all of it."""
    if typed.startswith("/"):
        return [f"/{s}" for s in settings if s.startswith(typed[1:])]
    last = typed.split(" ")[-1]
    by_word = [w for w in words if last and w.startswith(last) and w != last][:3]
    return by_word + [p for p in prompts if typed and p.startswith(typed) and p != typed]


def setting(command: str) -> tuple[str, object]:
    """``/name value`` or ``/name=value``, checked."""
    name, _, raw = command.lstrip("/").replace("=", " ", 1).partition(" ")
    if name not in SETTING_TYPES:
        raise ValueError(f"no setting {name!r}; known: {sorted(SETTING_TYPES)}")
    try:
        value = float(raw) if name == "relevancy" else parse(raw.strip())
    except ValueError:
        raise ValueError(f"{name} cannot be {raw!r}") from None
    if not isinstance(value, SETTING_TYPES[name]):
        raise ValueError(f"{name} cannot be {raw!r}")
    if name == "retriever" and not set(str(value).split("_")) <= set(RETRIEVERS):
        raise ValueError(f"a retriever is made of {RETRIEVERS}")
    if name == "relevancy" and not -1.5 <= float(value) <= 1.0:
        raise ValueError("relevancy is between -1.5 and 1")
    if name == "top_k":
        from corpusmill.plans.query import parse_top_k

        parse_top_k(value)
    return name, value
