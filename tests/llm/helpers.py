"""Small tables for the tests of the training-data operators."""

import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(None, None)[: 4 - len(r)]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(d, t, la, s, None if t is None else len(t)) for d, t, la, s in full], SCHEMA)


def crc(data: bytes) -> int:
    return zlib.crc32(data)


ODD_ROWS = [
    (1, "the cat  sat\n on the mat "), (2, ""), (3, None), (None, "no id here"), (5, "same text"),
    (5, "same text"), (6, "naïve café 漢字 😀\tend"), (7, " lead"), (8, "x" * 5000), (9, "word " * 4000),
    (10, "<|endoftext|> inside <|endoftext|>"), (11, "\n\n"), (12, "a"),
]
