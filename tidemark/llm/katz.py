"""Operator 7, LM scoring: a Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

Events are the words seen in training, the end of a text, and one class for all unseen words (V + 1 in all). Counts
above CUT are trusted; smaller ones are discounted by Good-Turing ratios of counts of counts. The mass that a context's
discounts free goes to the events not seen after it, in proportion to their unigram probability, so each context's
probabilities sum to 1. Bigrams seen once are kept, with a discount of their own.

Count tables live in partitions, by word hash and by context hash, and texts stay in bundles:
1. each bundle sends its different words with their training counts to the words' partitions, which sum and reply;
2. each bundle sends its different bigrams, as (context, word, training count, word's total), to the contexts' partitions,
   which sum, and reply with the bigram's count and the context's sums;
3. each bundle scores its texts from the replies: log10 of the bigram's discounted share, or of backoff weight times
   unigram share.
All messages are packed arrays, all counts 64 bits wide; the words after one context are told apart by 48 bits of their hash.
The number of partitions grows with the number of bundles, so that what a task holds does not grow with the corpus; the number
of messages is that of bundles times partitions. Nothing but counts of counts reaches the driver. A context with more than one in HOT * partitions of all tokens is dealt out by word, and its partial sums
(of fewer contexts than HOT * partitions) are added up before scoring.

Cases: null text is empty and has one token, the end; a corpus without training rows leaves N = V = 0: every token is the
unseen class, with probability 1 (score 0) and base log10(0.5 / 0.5); repeated rows count as often as they stand;
a null doc_id has the remainder of the empty string's crc32; an empty table gives an empty result; other columns are
carried by `score_texts` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundles import beside, bundled, pack, unpack
from .common import lean, stored
from .graph import bounds, groups
from .words import U, hashes

BUNDLE_BYTES = 6 << 20
CUT = 5
HOT = 4
HOT_PARTS = 4096
PART_BUNDLES = 4  # a partition counts the tokens of so many bundles, on average, or fewer
END = U(0x1F83D9ABFB41BD6B)
BEGIN = U(0x5BE0CD19137E2179)
HOT_ROW = np.dtype([("c", np.uint64), ("s", np.float64, CUT + 2)])
LOW48 = U((1 << 48) - 1)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(16)) % U(parts)).astype(np.int64)


@dataclass
class Tokens:
    """Of one bundle: hash of each token (words, then the end), text of each, and each text's number of tokens."""

    hash: np.ndarray
    owner: np.ndarray
    size: np.ndarray
    unique: np.ndarray = None
    index: np.ndarray = None

    @staticmethod
    def read(body: np.ndarray, ends: np.ndarray) -> Tokens:
        words, size = hashes(body, ends)
        size = size + 1
        close = np.cumsum(size) - 1
        h = np.empty(int(size.sum()), U)
        is_end = np.zeros(len(h), bool)
        is_end[close] = True
        h[is_end], h[~is_end] = END, words
        t = Tokens(h, np.repeat(np.arange(len(size)), size), size)
        t.unique, t.index = np.unique(h, return_inverse=True)
        return t

    def before(self) -> np.ndarray:
        """Index of the token before each one; len(unique) for the beginning of a text."""
        out = np.empty(len(self.index), np.int64)
        out[1:] = self.index[:-1]
        out[np.cumsum(self.size) - self.size] = len(self.unique)
        return out


class Sending:
    """Rows of a bundle's messages to partitions, and the order that replies come in."""

    def __init__(self, part: np.ndarray):
        self.order = np.argsort(part, kind="stable")
        sorted_part = part[self.order]
        self.cut = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]])) if len(part) else np.zeros(0, np.int64)
        self.parts = sorted_part[self.cut] if len(part) else sorted_part
        self.cut = np.append(self.cut, len(part))

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        x = x[self.order]
        return [x[a:b] for a, b in zip(self.cut[:-1], self.cut[1:], strict=True)]


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte plane by byte plane, so that their common leading bytes cost nothing."""
    return pack(np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(z: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(z).reshape(8, -1).T).view(U).ravel(), dtype=U)


def pack_counts(x: np.ndarray) -> bytes:
    """64-bit counts, byte plane by byte plane: the planes of zeros cost nothing."""
    return pack(np.ascontiguousarray(x, U).view(np.uint8).reshape(-1, 8).T)


def unpack_counts(z: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(z).reshape(8, -1).T).view(np.int64).ravel()


def pack_sums(sums: np.ndarray) -> bytes:
    """Rows of contexts' sums: the counts, all whole numbers, byte plane by byte plane, and the probabilities as they are."""
    whole = np.ascontiguousarray(sums[:, :-1].T).astype(np.int64)
    return whole.view(np.uint8).reshape(-1, 8).T.tobytes() + sums[:, -1].tobytes()


def unpack_sums(raw: np.ndarray) -> np.ndarray:
    n = len(raw) // (8 * (CUT + 2))
    whole, chance = np.split(raw, [8 * n * (CUT + 1)])
    whole = np.ascontiguousarray(whole.reshape(8, n * (CUT + 1)).T).view(np.int64).reshape(CUT + 1, n)
    return np.column_stack([whole.T, np.frombuffer(chance.tobytes())])


def _table(rows: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in rows.values()], list(rows))


def _words_out(bundles: DataFrame, parts: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, z, ends, rest in zip(*(batch.column(c) for c in ("bundle", "z", "ends", "rest")), strict=True):
                t = Tokens.read(unpack(z.as_py()), ends.values.to_numpy())
                train = rest.values.field("train").to_numpy(zero_copy_only=False)
                n = np.bincount(t.index, weights=train[t.owner], minlength=len(t.unique)).astype(np.int64)
                s = Sending(part_of(t.unique, parts))
                yield _table({"part": (s.parts, pa.int64()), "bundle": ([bundle.as_py()] * len(s.parts), pa.int64()), "a": ([pack_sorted(x) for x in s.split(t.unique)], pa.binary()), "b": ([pack_counts(x) for x in s.split(n)], pa.binary())})

    return bundles.select("bundle", "z", "ends", "rest").mapInArrow(run, "part long, bundle long, a binary, b binary")


def added(index: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of n by index, as whole numbers."""
    out = np.zeros(size, np.int64)
    np.add.at(out, index, n)
    return out


def _histogram(counts: np.ndarray) -> bytes:
    return np.bincount(np.minimum(counts, CUT + 2).astype(np.int64), minlength=CUT + 3).astype(np.int64).tobytes()


def _words_back(sent: DataFrame) -> DataFrame:
    """Replies (bundle, part, a: totals) and, with a null bundle, each partition's counts of counts (a) and sum (n)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["part"]):
            cut = bounds(whole, ["part"])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                rows = whole.slice(i, j - i)
                each = [unpack_sorted(x.as_py()) for x in rows.column("a")]
                n = np.concatenate([unpack_counts(x.as_py()) for x in rows.column("b")])
                unique, index = np.unique(np.concatenate(each), return_inverse=True)
                total = added(index, n, len(unique))
                back = np.split(total[index], np.cumsum([len(x) for x in each])[:-1])
                part = rows.column("part")[0].as_py()
                yield _table({"bundle": ([*rows.column("bundle").to_pylist(), None], pa.int64()), "part": ([part] * (len(each) + 1), pa.int64()), "a": ([*map(pack_counts, back), _histogram(total)], pa.binary()), "n": ([0] * len(each) + [int(total.sum())], pa.int64())})

    return stored(sent.repartition("part").sortWithinPartitions("part", "bundle").mapInArrow(run, "bundle long, part long, a binary, n long"), "words")


@dataclass
class Shape:
    """What the model needs besides its tables: sizes and discounts."""

    parts: int
    total: int  # training tokens
    types: int
    texts: int  # training texts: the count of the beginning
    keep1: np.ndarray  # by count up to CUT: the kept share of a unigram's count
    unseen: float
    keep2: np.ndarray | None = None
    hot: dict[int, np.ndarray] | None = None
    hot_parts: int = 0  # contexts with more than one in so many of all tokens are dealt out

    def unigram(self, n: np.ndarray) -> np.ndarray:
        """Probabilities of words by their training counts; 0 stands for the class of unseen words."""
        kept = np.where(n <= CUT, self.keep1[np.minimum(n, CUT)], 1.0)
        return np.where(n > 0, kept * n * (1 - self.unseen) / max(self._mass, 1e-300), self.unseen)

    _mass: float = 1.0  # discounted counts of all seen words


def discounts(by_count: np.ndarray, first: int = 1) -> np.ndarray:
    """Katz's shares kept of counts 0..CUT, from the numbers of types by count; 0 below `first`, 1 where ratios fail."""
    n = by_count.astype(float)
    keep = np.ones(CUT + 1)
    keep[:first] = 0
    base = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 0.0
    for r in range(first, CUT + 1):
        if n[r] and n[r + 1] and base < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - base) / (1 - base)
            if 0 < d < 1:
                keep[r] = d
    if (keep[first:] == 1).all():
        keep[first:] = 1 - 0.5 / np.arange(first, CUT + 1)  # too few counts for ratios: half a count off each
    return keep


def _shape(words: DataFrame, texts: int, parts: int) -> Shape:
    by = np.zeros(CUT + 3, np.int64)
    total = 0
    for r in words.where("bundle is null").select("a", "n").toLocalIterator():  # one short row for each partition
        by += np.frombuffer(bytes(r.a), np.int64)
        total += r.n
    types = int(by[1:].sum())
    keep = discounts(by)
    small = (np.arange(CUT + 1) * by[: CUT + 1]).astype(float)
    mass = float((keep * small).sum() + total - small.sum())
    s = Shape(parts, total, types, texts, keep, 1.0 if not total else max(1 - mass / total, 0.5 / (total + 1)))
    s._mass, s.hot_parts = mass, HOT * min(parts, HOT_PARTS)  # so many contexts at most are hot
    return s


def _totals(t: Tokens, rows: pa.RecordBatch, parts: int) -> np.ndarray:
    """Training totals of a bundle's different words, from the replies."""
    s = Sending(part_of(t.unique, parts))
    by = dict(zip(rows.column("part").to_pylist(), rows.column("a"), strict=True))
    out = np.empty(len(t.unique), np.int64)
    out[s.order] = np.concatenate([unpack_counts(by[p].as_py()) for p in s.parts.tolist()]) if len(s.parts) else []
    return out


class Bigrams:
    """The different bigrams of a bundle, in the order they are sent; one with a word that training never saw is not sent."""

    def __init__(self, t: Tokens, totals: np.ndarray, shape: Shape):
        first, second = t.before(), t.index
        self.pair, self.index = np.unique(first * (len(t.unique) + 1) + second, return_inverse=True)
        self.first, self.second = np.divmod(self.pair, len(t.unique) + 1)
        self.contexts = np.append(t.unique, BEGIN)
        self.counts = np.append(totals, shape.texts)  # of contexts
        self.sent = np.flatnonzero((self.counts[self.first] > 0) & (totals[self.second] > 0))
        c, w = self.contexts[self.first[self.sent]], t.unique[self.second[self.sent]]
        self.hot = self.counts[self.first[self.sent]] * shape.hot_parts > shape.total
        self.sending = Sending(np.where(self.hot, part_of((c ^ w * U(0x9E3779B97F4A7C15)), shape.parts), part_of(c, shape.parts)))
        self.c, self.w = c, w


def _bigrams_out(bundles: DataFrame, words: DataFrame, shape: Shape) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bundle"]):
            cut = bounds(group, ["bundle"])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                t = Tokens.read(unpack(group.column("z")[i].as_py()), group.column("ends")[i].values.to_numpy())
                totals = _totals(t, group.slice(i + 1, j - i - 1), shape.parts)
                train = group.column("rest")[i].values.field("train").to_numpy(zero_copy_only=False)
                b = Bigrams(t, totals, shape)
                n = np.bincount(b.index, weights=train[t.owner], minlength=len(b.pair)).astype(np.int64)[b.sent]
                s = b.sending
                low = b.w & LOW48
                rows = {"part": (s.parts, pa.int64()), "bundle": ([group.column("bundle")[i].as_py()] * len(s.parts), pa.int64())}
                heads, runs, hot = [], [], []
                for c, is_hot in zip(s.split(b.c), s.split(b.hot), strict=True):
                    new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                    heads.append(pack_sorted(c[new]))
                    runs.append(pack(np.diff(np.append(new, len(c))).astype(np.uint32)))
                    hot.append(pack(is_hot[new].astype(np.uint8)))
                rows |= {"c": (heads, pa.binary()), "runs": (runs, pa.binary()), "hot": (hot, pa.binary())}
                # a message's different words once, and each bigram's place among them
                names, places, sums = [], [], []
                for x, m in zip(s.split(low), s.split(totals[b.second[b.sent]]), strict=True):
                    own, at, place = np.unique(x, return_index=True, return_inverse=True)
                    names.append(pack_sorted(own))
                    places.append(pack(place.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)))
                    sums.append(pack_counts(m[at]))
                rows |= {"w": (names, pa.binary()), "at": (places, pa.binary()), "n": (list(map(pack_counts, s.split(n))), pa.binary()), "m": (sums, pa.binary())}
                yield _table(rows)

    replies = words.where("bundle is not null").select("bundle", "part", "a")
    return beside(bundles.select("bundle", "z", "ends", "rest"), replies, ["part", "a"]).mapInArrow(run, "part long, bundle long, c binary, runs binary, hot binary, w binary, at binary, n binary, m binary")


def _bigrams_back(sent: DataFrame, shape: Shape) -> DataFrame:
    """Replies: a, the bigrams' counts; b, of each context the number of types by count 1..CUT, the count of larger ones,
    and the unigram probability of all its types. With a null bundle: counts of counts (a), and sums of hot contexts (b)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["part"]):
            cut = bounds(whole, ["part"])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                rows = whole.slice(i, j - i)
                heads = [unpack_sorted(x.as_py()) for x in rows.column("c")]
                runs = [unpack(x.as_py(), np.uint32) for x in rows.column("runs")]
                sizes = [int(x.sum()) for x in runs]
                w, m = [], []
                for x, at, sums in zip(*(rows.column(k) for k in ("w", "at", "m")), strict=True):
                    own, each = unpack_sorted(x.as_py()), unpack_counts(sums.as_py())
                    place = unpack(at.as_py(), np.uint16 if len(own) <= 1 << 16 else np.uint32)
                    w.append(own[place])
                    m.append(each[place])
                n = np.concatenate([unpack_counts(x.as_py()) for x in rows.column("n")])
                m = np.concatenate(m)
                contexts, c = np.unique(np.concatenate(heads), return_inverse=True)
                place = np.repeat(c, np.concatenate(runs))  # of each bigram: its context's number
                w = np.concatenate(w)
                order = np.lexsort((w, place))
                new = np.ones(len(order), bool)
                new[1:] = (place[order][1:] != place[order][:-1]) | (w[order][1:] != w[order][:-1])
                kind = np.empty(len(order), np.int64)
                kind[order] = np.cumsum(new) - 1
                total = added(kind, n, int(new.sum()))
                owner, more = place[order][new], m[order][new].astype(np.int64)
                seen = total > 0
                sums = np.zeros((len(contexts), CUT + 2))
                for r in range(1, CUT + 1):
                    sums[:, r - 1] = np.bincount(owner[total == r], minlength=len(contexts))
                sums[:, CUT] = np.bincount(owner[total > CUT], weights=total[total > CUT], minlength=len(contexts))
                sums[:, CUT + 1] = np.bincount(owner[seen], weights=shape.unigram(more[seen]), minlength=len(contexts))
                counts = np.split(total[kind], np.cumsum(sizes)[:-1])
                at = np.split(c, np.cumsum([len(x) for x in heads])[:-1])
                is_hot = np.zeros(len(contexts), bool)
                is_hot[c] = np.concatenate([unpack(x.as_py()) for x in rows.column("hot")])
                partial = np.empty(int(is_hot.sum()), HOT_ROW)
                partial["c"], partial["s"] = contexts[is_hot], sums[is_hot]
                some = sums[:, : CUT + 1].any(1) & ~is_hot
                # of a context without types, its place in the reply is one bit
                back = [pack(np.packbits(some[k]).tobytes() + pack_sums(sums[k][some[k]])) for k in at]
                part = rows.column("part")[0].as_py()
                yield _table({"bundle": ([*rows.column("bundle").to_pylist(), None], pa.int64()), "part": ([part] * (len(at) + 1), pa.int64()), "a": ([*map(pack_counts, counts), _histogram(total)], pa.binary()), "b": ([*back, pack(partial.tobytes())], pa.binary())})

    return stored(sent.repartition("part").sortWithinPartitions("part", "bundle").mapInArrow(run, "bundle long, part long, a binary, b binary"), "bigrams")


def _reply_sums(b: Bigrams, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the sent bigrams, and for each of them its context's sums, in the bundle's own order."""
    s = b.sending
    by_a = dict(zip(rows.column("part").to_pylist(), rows.column("a"), strict=True))
    by_b = dict(zip(rows.column("part").to_pylist(), rows.column("b"), strict=True))
    counts, sums = np.empty(len(b.sent), np.int64), np.zeros((len(b.contexts), CUT + 2))
    if len(s.parts):
        counts[s.order] = np.concatenate([unpack_counts(by_a[p].as_py()) for p in s.parts.tolist()])
        for p, first in zip(s.parts.tolist(), s.split(b.first[b.sent]), strict=True):
            heads = first[np.concatenate([[True], first[1:] != first[:-1]])]
            raw = unpack(by_b[p].as_py())
            cut = -(-len(heads) // 8)
            some = np.unpackbits(raw[:cut], count=len(heads)).astype(bool)
            sums[heads[some]] = unpack_sums(raw[cut:])
    return counts, sums


def _hot_sums(bigrams: DataFrame) -> dict[int, np.ndarray]:
    """Sums of hot contexts over all partitions. Fewer than HOT * partitions contexts are hot, as they share one total."""
    names = [f"s{k}" for k in range(CUT + 2)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("b").to_pylist():
                rows = unpack(x, HOT_ROW)
                yield pa.RecordBatch.from_arrays([pa.array(rows["c"].astype(np.int64)), *(pa.array(rows["s"][:, k].copy()) for k in range(CUT + 2))], ["c", *names])

    rows = bigrams.where("bundle is null").select("b").mapInArrow(run, "c long, " + ", ".join(f"{n} double" for n in names))
    return {r.c: np.array([r[n] for n in names]) for r in rows.groupBy("c").agg(*(F.sum(n).alias(n) for n in names)).toLocalIterator()}


def _scores(t: Tokens, totals: np.ndarray, b: Bigrams, counts: np.ndarray, sums: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """For each text: tokens, known tokens, base score, score."""
    n_texts = len(t.size)
    by_text = lambda x: np.bincount(t.owner, weights=x, minlength=n_texts)
    base = np.log10((totals + 0.5) / (shape.total + 0.5 * (shape.types + 1)))
    one = shape.unigram(totals)
    c1 = b.counts.astype(float)
    kept = sums[:, :CUT] @ (shape.keep2[1:] * np.arange(1, CUT + 1)) + sums[:, CUT]
    mass = kept / np.maximum(c1, 1)
    # something is always left for events not seen after the context
    most = c1 / (c1 + 1)
    factor = np.where(mass > most, most / np.maximum(mass, 1e-300), 1.0)
    weight = np.where(kept > 0, (1 - factor * mass) / np.maximum(1 - sums[:, CUT + 1], 1e-12), 1.0)
    c12 = np.zeros(len(b.pair), np.int64)
    c12[b.sent] = counts
    share = np.where(c12 <= CUT, shape.keep2[np.minimum(c12, CUT)], 1.0) * c12 / np.maximum(c1[b.first], 1)
    chance = np.where(c12 > 0, factor[b.first] * share, weight[b.first] * one[b.second])
    return t.size, by_text(totals[t.index] > 0).astype(np.int64), by_text(base[t.index]), by_text(np.log10(chance)[b.index])


def score_texts(docs: DataFrame, train: str = "train") -> DataFrame:
    """docs (without text and the boolean column `train`) with n_tokens, n_known, train_tokens, base_score, score."""
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in docs.columns if c not in (*made, "text", train)]
    docs = docs.select("text", *(F.col(c).alias(f"_{i}") for i, c in enumerate(rest)), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    texts = docs.where("train").count()
    bundles = bundled(docs, BUNDLE_BYTES)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bundles.count() // PART_BUNDLES))
    words = _words_back(_words_out(bundles, parts))
    shape = _shape(words, texts, parts)
    bigrams = _bigrams_back(_bigrams_out(bundles, words, shape), shape)
    by = np.zeros(CUT + 3, np.int64)
    for r in bigrams.where("bundle is null").select("a").toLocalIterator():  # one short row for each partition
        by += np.frombuffer(bytes(r.a), np.int64)
    shape.keep2, shape.hot = discounts(by), _hot_sums(bigrams)

    kind = bundles.schema["rest"].dataType.elementType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bundle"]):
            cut = bounds(group, ["bundle"])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                t = Tokens.read(unpack(group.column("z")[i].as_py()), group.column("ends")[i].values.to_numpy())
                replies = group.slice(i + 1, j - i - 1)
                is_word = pc.is_null(replies.column("b"))
                totals = _totals(t, replies.filter(is_word), parts)
                b = Bigrams(t, totals, shape)
                counts, sums = _reply_sums(b, replies.filter(pc.invert(is_word)))
                for k in np.flatnonzero(b.counts * shape.hot_parts > shape.total):
                    sums[k] = shape.hot.get(int(b.contexts[k].astype(np.int64)), 0)
                n, known, base, score = _scores(t, totals, b, counts, sums, shape)
                yield pa.RecordBatch.from_arrays([group.column("rest")[i].values, pa.array(n), pa.array(known), pa.array(np.full(len(n), shape.total)), pa.array(base), pa.array(score)], ["rest", *made])

    replies = words.where("bundle is not null").select("bundle", "part", "a", F.lit(None).cast("binary").alias("b")).unionByName(bigrams.where("bundle is not null"))
    out = beside(bundles, replies, ["part", "a", "b"]).mapInArrow(run, f"rest {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(*(F.col(f"rest._{i}").alias(c) for i, c in enumerate(rest)), *made)
