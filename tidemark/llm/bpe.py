"""Operator 5, BPE encoding and decoding by per-prefix dynamic programming.

The encoding of a word ends, for each of its prefixes, in one certain token: the token t that matches a suffix of the
prefix and for which the pair (last token of what precedes t, t) is one that merging leaves apart. An automaton over the
vocabulary finds the tokens that end at each position, a pair test on the merge table picks the right one, and back
pointers from the end of the word give the ids. The work is linear in the matches; no merge queue is run.

The vocabulary file (a parameter) says how text is cut into words: NFC, blanks, lower case, then its pattern. Texts with
characters beyond the Latin blocks are cut by the file's own normalizer and pre-tokenizer, so that character classes agree.

Cases: null text is empty; an empty text has no ids and decodes to an empty text; the strings of special tokens in a
text become these tokens; ids decode to the tokens' strings joined by one space (the file has no decoder); a repeated row
gives its row each time; other columns are kept; very long words cost time in proportion to their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

END = "\n"  # stands for the end-of-word suffix; no vocabulary character is a blank
CACHE_WORDS = 100_000
CACHE_PAIRS = 250_000
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
KINDS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "packed": T.BinaryType(), "decoded": T.StringType()}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    free = iter(range(256, 512))
    return [letters.get(b) or chr(next(free)) for b in range(256)]


class Vocabulary:
    """Merge tables and automaton of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = [""] * (1 + max([*ids.values(), *self.specials.values()]))
        for s, i in [*ids.items(), *self.specials.items()]:
            self.text[i] = s
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = {}, {}
        for a, b in model["merges"]:
            i, j, k = ids[a], ids[b], ids[a + b]
            self.merged[i, j] = k
            self.left[k], self.right[k] = i, j
        self.first_merge = min(self.left)
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            key = s[: -len(suffix)] + END if s.endswith(suffix) else s
            self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.letters = byte_letters()
        self.shown = dict(enumerate(self.letters))
        self.packed = [int(i).to_bytes(4, "little") for i in range(len(self.text))]
        self.tested: dict[int, bool] = {}  # by both tokens
        self.words: dict[str, bytes] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.latin = re.compile("[\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")
        self.blanks = re.compile(f"[{BLANK}]+")
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.latin_words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANK}\p{{L}}\p{{N}}]+")

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a, b as they are when they stand side by side.

        Going back through the merges, latest first, no pair across the border may have been merged before its sides were.
        """
        x, y, limit, first = a, b, len(self.text), self.first_merge
        while True:
            m = self.merged.get((x, y))
            if m is not None and m < limit:
                return False
            if max(x, y) < first:
                return True
            if x > y:
                limit, x = x, self.right[x]
            else:  # of equal merges the left one goes first
                limit, y = y + 1, self.left[y]

    def encode_word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        s = word.encode("utf-8").decode("latin-1").translate(self.shown) + END
        n = len(s)
        last = [-1] * (n + 1)  # by length of prefix: its last token, and where that begins
        start = [0] * (n + 1)
        tested, apart = self.tested, self.apart
        for end, (token, size) in self.automaton.iter(s):
            end += 1
            if last[end] < 0:
                at = end - size
                if at:
                    before = last[at]
                    if before < 0:
                        continue
                    key = before << 20 | token
                    fits = tested.get(key)
                    if fits is None:
                        fits = tested[key] = apart(before, token)
                    if not fits:
                        continue
                last[end], start[end] = token, at
        out, at = [], n
        while at:
            out.append(self.packed[last[at]])
            at = start[at]
        out.reverse()
        return b"".join(out)

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if self.latin.fullmatch(text):
            return self.latin_words.findall(unicodedata.normalize("NFC", text).lower())
        shown = {c: b for b, c in enumerate(self.letters)}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(shown[c] for c in w).decode("utf-8") for w, _ in cut]

    def encode(self, text: str) -> bytes:
        if self.split is not None and "<|" in text:
            parts = self.split.split(text)
        else:
            parts = [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.specials[part]], "<u4").tobytes())
                continue
            words = self.pieces(part)
            known = self.words
            for w in set(words).difference(known):
                known[w] = self.encode_word(w)
            out += map(known.__getitem__, words)
            if len(known) > CACHE_WORDS:
                known.clear()
            if len(self.tested) > CACHE_PAIRS:
                self.tested.clear()
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.text.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker and file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _path(vocab: str) -> str:
    """A file name, or the name of a public vocabulary that each executor has installed."""
    if "/" in vocab:
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


def encode(docs: DataFrame, vocab: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the outputs: n_tokens, ids, packed (ids as little-endian bytes), decoded."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, KINDS[c]) for c in outputs])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(_path(vocab))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                packed = [v.encode(x or "") for x in batch.column("_text").to_pylist()]
                made = {"packed": lambda p=packed: pa.array(p, pa.binary()), "n_tokens": lambda p=packed: pa.array([len(x) // 4 for x in p], pa.int64()), "decoded": lambda p=packed: pa.array([v.decode(x) for x in p], pa.string()), "ids": lambda p=packed: pa.array([np.frombuffer(x, "<i4") for x in p], pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_arrays([batch.column(f"_k{i}") for i in range(len(kept))] + [made[c]() for c in outputs], [*kept, *outputs])

    given = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)), F.col(text).alias("_text"))
    return given.mapInArrow(run, schema)


def decode(rows: DataFrame, vocab: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null."""
    schema = T.StructType([f for f in rows.schema if f.name != out] + [T.StructField(out, T.StringType())])
    kept = [c for c in rows.columns if c != out]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(_path(vocab))
        for batch in batches:
            texts = [None if x is None else " ".join(map(v.text.__getitem__, x)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    return rows.mapInArrow(run, schema)
