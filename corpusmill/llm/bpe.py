"""Token ids of whole texts, inside tasks, by the tokenizers and sentencepiece libraries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_encoders: dict[tuple, ByWord] = {}
# a space after which another white space follows, or that ends the text, belongs to a run
_RUN = re.compile(r" (?=\s|\Z)")
ROWS, CHARACTERS = 4096, 2_000_000
SPACE_MARK = "▁"


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary that ships with ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_vocabulary() -> str:
    """Path of the sentencepiece model that ships with ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def slices(texts: Sequence[str], rows: int = ROWS, characters: int = CHARACTERS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with at most ``rows`` texts and ``characters`` characters, or one longer text."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        if at > start and (at - start >= rows or held + len(text) > characters):
            yield start, at
            start, held = at, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


class Memory:
    """Values of keys met lately, in two generations of about ``most`` keys.

    A key that is met again moves to the new generation; when that is full, the
    old one is dropped. So frequent keys stay, whenever they are first met.
    """

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def find(self, keys: list[str]) -> tuple[list, list[int]]:
        """The value of each key, and the places of keys without one."""
        got, holes = list(map(self.new.get, keys)), []
        if None in got:
            old, new = self.old, self.new
            for at, value in enumerate(got):
                if value is None:
                    value = old.get(keys[at])
                    if value is None:
                        holes.append(at)
                    else:
                        got[at] = new[keys[at]] = value
        return got, holes

    def keep(self, found: dict) -> None:
        self.new.update(found)
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


class ByWord:
    """Encodes texts word by word and remembers the ids of words it has met.

    Right where no token holds a space behind another character, so that the word
    after a single space has the same ids wherever it stands. Texts in which spaces
    form runs are encoded as a whole, like all texts where ``by_word`` is off.
    ``max_words`` bounds the memory, not the result.
    """

    headed = False  # whether a text's first word differs from one after a space
    lead = ""       # what makes the first word like the others
    spaced: np.ndarray  # ids whose token starts with a space

    def __init__(self, size: int, by_word: bool, dtype: str | None, max_words: int = 240_000):
        # two bytes an id where the vocabulary allows it
        self.dtype, self.by_word = np.dtype(dtype or ("<u2" if size <= 1 << 16 else "<u4")), by_word
        if size > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"{size} ids do not fit in {self.dtype}")
        self.words, self.heads = Memory(max_words), Memory(max_words // 8)

    def _whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space; a token that starts with one starts a word."""
        runs = [words[at:at + 256] for at in range(0, len(words), 256)]
        out: list[bytes] = []
        for some, raw in zip(runs, self._whole([self.lead + " ".join(some) for some in runs]), strict=True):
            cuts = np.flatnonzero(self.spaced[np.frombuffer(raw, self.dtype)])
            if len(cuts) != len(some):
                out.extend(self._whole([self.lead + w for w in some]))
                continue
            at = [*(cuts * self.dtype.itemsize).tolist(), len(raw)]
            out.extend(raw[at[i]:at[i + 1]] for i in range(len(some)))
        return out

    def _plain(self, text: str) -> bool:
        return self.by_word and not _RUN.search(text)

    def _look_up(self, memory: Memory, keys: list[str], learn) -> list[bytes]:
        """The ids of distinct keys; an empty one has none."""
        got, holes = memory.find(keys)
        if holes:
            found = {"": b""}
            wanted = [key for at in holes if (key := keys[at])]
            found.update(zip(wanted, learn(wanted), strict=True))
            for at in holes:
                got[at] = found[keys[at]]
            memory.keep(found)
        return got

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that can be encoded by word, one after another, and how many each has.

        The words of all texts are numbered by Arrow; each distinct one is looked up once.
        """
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        keys, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype("i8")
        values = self._look_up(self.words, keys, self._learn)
        if self.headed:
            heads = list({keys[n] for n in number[at[:-1]].tolist()})
            place = {head: len(values) + i for i, head in enumerate(heads)}
            number[at[:-1]] = [place[keys[n]] for n in number[at[:-1]].tolist()]
            values = values + self._look_up(self.heads, heads, self._whole)
        flat, of_value = _flat(values, self.dtype)
        lengths = of_value[number]
        return _gather(flat, (np.cumsum(of_value) - of_value)[number], lengths), np.add.reduceat(lengths, at[:-1])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the end)."""
        distinct = list(dict.fromkeys(texts))
        plain, odd = [], []
        for i, text in enumerate(distinct):
            if text:
                (plain if self._plain(text) else odd).append(i)
        lengths = np.zeros(len(distinct), "i8")
        parts = [np.zeros(0, self.dtype)]
        if plain:
            ids, lengths[plain] = self._by_words([distinct[i] for i in plain])
            parts.append(ids)
        if odd:
            ids, lengths[odd] = _flat(self._whole([distinct[i] for i in odd]), self.dtype)
            parts.append(ids)
        flat, order = np.concatenate(parts), np.array(plain + odd, "i8")
        if len(distinct) < len(texts) or odd:
            begins = np.zeros(len(distinct), "i8")
            begins[order] = np.cumsum(lengths[order]) - lengths[order]
            number = {text: i for i, text in enumerate(distinct)}
            rows = np.array([number[text] for text in texts], "i8")
            flat, lengths = _gather(flat, begins[rows], lengths[rows]), lengths[rows]
        return flat, np.concatenate([[0], np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of the encoder's width."""
        flat, at = self.encode_flat(texts)
        raw, at = flat.tobytes(), (at * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def _flat(values: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Arrays given as bytes, one after another, and their lengths."""
    return np.frombuffer(b"".join(values), dtype), np.array([len(v) for v in values], "i8") // dtype.itemsize


def _gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that start at ``begins``, one after another."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(begins - before, lengths) + np.arange(lengths.sum())]


class Encoder(ByWord):
    """A vocabulary of the tokenizers library, given by its file.

    Texts are encoded by word where the file's rule cuts at spaces and changes
    nothing before (byte-level, by pattern, without added space or normalisation). With
    ``plain_specials`` the strings of special tokens are ordinary text.
    """

    headed, lead = True, " "

    def __init__(self, vocabulary: str, dtype: str | None = None, plain_specials: bool = False,
                 max_words: int = 240_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(vocabulary, encoding="utf-8") as source:
            rules = json.load(source)
        cut = rules.get("pre_tokenizer") or {}
        by_word = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
                   and not rules.get("normalizer"))
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1
        super().__init__(size, bool(by_word), dtype, max_words)
        self.spaced = np.zeros(size, bool)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # texts that hold a special token's string; ordinary added tokens are matched in any case
        special = [t.content for t in added if not (plain_specials and t.special)]
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.spaced[number] = token.startswith("Ġ")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def spelling(self) -> list[bytes]:
        """The bytes of each id; byte-level entries are decoded, special tokens are their strings."""
        letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(letters)]
        byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
        out = [b""] * len(self.spaced)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            known = all(c in byte_of for c in token)
            out[number] = bytes(byte_of[c] for c in token) if known else token.encode()
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _plain(self, text: str) -> bool:
        return super()._plain(text) and not (self.special and self.special.search(text))


class Pieces(ByWord):
    """A sentencepiece model, given by its file. It adds a space before each text.

    Texts are encoded by word where no piece holds the space mark behind another
    character. Texts with the mark itself, or where spaces form runs, are encoded whole.
    """

    def __init__(self, model: str, dtype: str | None = None, max_words: int = 240_000):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.names = names
        crossing = any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", name) for name in names)
        prefixed = self.model.encode(["a"], out_type=str)[0][:1] == [SPACE_MARK + "a"]
        super().__init__(len(names), prefixed and not crossing, dtype, max_words)
        self.spaced = np.array([name.startswith(SPACE_MARK) for name in names])

    def spelling(self) -> list[bytes]:
        """The bytes of each id: the piece in UTF-8 with the mark as a space; <0xHH> is that byte."""
        return [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else
                b"" if self.model.is_control(i) else name.replace(SPACE_MARK, " ").encode()
                for i, name in enumerate(self.names)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.dtype).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def _plain(self, text: str) -> bool:
        return super()._plain(text) and SPACE_MARK not in text and text[0] != " "


def encoder(vocabulary: str, dtype: str | None = None, plain_specials: bool = False, max_words: int = 240_000) -> Encoder:
    """The encoder of this worker process; it is built once and keeps its words."""
    key = (vocabulary, dtype, plain_specials, max_words)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def pieces(model: str, max_words: int = 240_000) -> Pieces:
    """The sentencepiece encoder of this worker process."""
    if (model, max_words) not in _encoders:
        _encoders[(model, max_words)] = Pieces(model, max_words=max_words)
    return _encoders[(model, max_words)]
