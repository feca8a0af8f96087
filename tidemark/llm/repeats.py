"""Operator 6, suffix-array dedup: every byte covered by a SPAN-byte string that starts anywhere else too is removed.

Texts are packed in bundles of a few hundred, so that they move compressed. Then:
1. Anchors (see anchors.py) bring the starts of equal SPAN-byte strings together by one hash each, a fiftieth of the text.
   An anchor seen once ends here. A context that occurs twice as a whole is repeated as a whole, and needs no bytes.
2. The other contexts whose anchor is repeated are the edges of repeats. One copy of each distinct one is fetched, and
   those of an anchor meet in a suffix array: suffixes sorted, longest common prefixes of neighbours, a stack scan for the
   common-prefix intervals of SPAN bytes and more, kept if their occurrences differ in the byte before. Each interval is a
   maximal repeat with all its occurrences.
3. An anchor with more than CROWD distinct contexts (a passage that a large share of texts embeds) is not gathered: hashes
   of its strings are counted in a distributed aggregate instead, with the same result.
4. The spans go back to the bundles.

Cases: null text is empty; texts under SPAN bytes and empty tables lose nothing; copies of a text, repeated rows included,
lose all they share; a cut inside a character leaves bytes that `kept` (text) drops and `kept_sha256` counts; ids may
repeat or be null; other columns, whatever their names, are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SPAN, anchors
from .bundles import beside, bundled, unpack
from .common import lean, stored
from .graph import bounds, groups
from .words import U, mix

BUNDLE_BYTES = 1 << 20
CROWD = 4096
SORTED_BYTES = 1 << 20

def _anchors(bundles: DataFrame) -> DataFrame:
    """anchor, context, bundle, spots: of each different context in a bundle, the places and lengths of its runs."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, z, ends in zip(*(batch.column(c) for c in ("bundle", "z", "ends")), strict=True):
                body, ends = unpack(z.as_py()), ends.values.to_numpy()
                found = [(x[0], x[1], x[2] + a, x[3]) for a, x in ((a, anchors(body[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True) if b - a >= SPAN)]
                if not found:
                    continue
                anchor, context, first, more = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((context, anchor))
                anchor, context, spot = anchor[order], context[order], (first << 8 | more)[order]
                cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])]))
                offsets = np.append(cut, len(spot)) * 8
                spots = pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(spot.astype(np.int64))])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[cut]), pa.array(context[cut]), pa.array(np.full(len(cut), bundle.as_py())), spots], ["anchor", "context", "bundle", "spots"])

    return bundles.select("bundle", "z", "ends").mapInArrow(run, "anchor long, context long, bundle long, spots binary")


def _judged(found: DataFrame) -> DataFrame:
    """bundle, spots, anchor, whole, edge: of contexts whose anchor is repeated.

    whole: the context is repeated as it is; edge: its bytes are needed, once of each different one, as the anchor has
    others. Rows come sorted, and each needs its neighbours only, however many share an anchor.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row of the batch before, not judged yet; and the row before it
        before = None
        for batch in _with_end(batches):
            if batch is None:
                if last is None:
                    return
                table, n = last, 1
            else:
                if not batch.num_rows:
                    continue
                table = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
                n = table.num_rows - 1
            a, c = (table.column(k).to_numpy() for k in ("anchor", "context"))
            many = pc.binary_length(table.column("spots")).to_numpy() > 8
            up = np.zeros(table.num_rows, bool)  # the row above has the same anchor; same context
            up_same = up.copy()
            up[1:] = a[1:] == a[:-1]
            up_same[1:] = up[1:] & (c[1:] == c[:-1])
            if before is not None:
                up[0] = before[0] == a[0]
                up_same[0] = up[0] and before[1] == c[0]
                run_has = before[2] if up_same[0] else False
            else:
                run_has = False
            down, down_same = np.append(up[1:], False), np.append(up_same[1:], False)
            # does the anchor have another context above the row's run of equal contexts?
            of = np.maximum.accumulate(np.where(~up_same, np.arange(table.num_rows), -1))
            above = np.where(of >= 0, up[np.maximum(of, 0)], run_has)
            whole = up_same | down_same | many
            edge = ~down_same & (above | down)
            keep = np.flatnonzero((whole | edge)[:n])
            if len(keep):
                t = table.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([t.column("bundle"), t.column("spots"), t.column("anchor"), pa.array(whole[keep]), pa.array(edge[keep])], ["bundle", "spots", "anchor", "whole", "edge"])
            if batch is None:
                return
            if n:
                before = (a[n - 1], c[n - 1], bool(above[n - 1]))
            last = table.slice(n, 1)

    return found.repartition("anchor").sortWithinPartitions("anchor", "context", "bundle").mapInArrow(run, "bundle long, spots binary, anchor long, whole boolean, edge boolean")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _contexts(bundles: DataFrame, judged: DataFrame) -> DataFrame:
    """anchor, bundle, spot, bytes of each different context that is an edge."""
    edges = judged.where("edge").select("bundle", "spots", "anchor")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["bundle"]):
            cut = bounds(whole, ["bundle"])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if j - i < 2:
                    continue
                body = unpack(whole.column("z")[i].as_py())
                part = whole.slice(i + 1, j - i - 1)
                spot = np.array([int.from_bytes(s[:8], "little") for s in part.column("spots").to_pylist()])
                data = [body[s >> 8 : (s >> 8) + (s & 255) + SPAN].tobytes() for s in spot.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("anchor"), part.column("bundle"), pa.array(spot), pa.array(data, pa.binary())], ["anchor", "bundle", "spot", "bytes"])

    rows = beside(bundles.select("bundle", "z"), edges, ["spots", "anchor"])
    return stored(rows.mapInArrow(run, "anchor long, bundle long, spot long, bytes binary"), "contexts")


def maximal_repeats(texts: list[bytes], family: np.ndarray, span: int = SPAN) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of `span` bytes and more among texts of one family: (length, text of each occurrence, place in it).

    The suffix array holds the suffixes of span bytes and more, sorted by family and first span bytes (ranks of 8 bytes,
    doubled). A run of equal ones is a common-prefix interval; if the bytes before differ (or a text begins), a stack scan
    over the neighbours' common prefixes gives it and the intervals inside it.
    """
    size = np.array([len(t) for t in texts])
    body = np.frombuffer(b"".join(texts) + bytes(span), np.uint8)
    begin = np.cumsum(size) - size
    rank = np.zeros(len(body), np.int64)
    for k in range(4):
        rank[: len(body) - k] |= body[k:].astype(np.int64) << (8 * (3 - k))
    have = 4
    while have < span:
        step = min(have, span - have)
        pair = rank[:-step] << 32 | rank[step:] if have == 4 else rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have += step
    many = np.maximum(size - span + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[text] + place
    key = family[text].astype(np.int64) * (int(rank.max()) + 1 if len(rank) else 1) + rank[at]
    order = np.argsort(key, kind="stable")
    text, place, at, key = text[order], place[order], at[order], key[order]
    cut = np.concatenate([[True], key[1:] != key[:-1], [True]]) if len(key) else np.array([True])
    cut = np.flatnonzero(cut)
    out = []
    if len(cut) < 2:
        return out
    first, count = cut[:-1], np.diff(cut)
    left = np.where(place > 0, body[np.maximum(at - 1, 0)].astype(np.int64), 256 + text)
    diverse = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    for s, n in zip(first[(count > 1) & diverse].tolist(), count[(count > 1) & diverse].tolist(), strict=True):
        i = np.arange(s, s + n)
        tails = [texts[t][p + span :] for t, p in zip(text[i].tolist(), place[i].tolist(), strict=True)]
        inner = sorted(range(n), key=tails.__getitem__)
        i = i[inner]
        tails = [tails[k] for k in inner]
        common = [_common(x, y) for x, y in zip(tails, tails[1:], strict=False)]
        stack: list[tuple[int, int]] = [(0, 0)]  # common prefix beyond span, first of the interval
        for k in range(1, n + 1):
            c = common[k - 1] if k < n else -1
            low = k - 1
            while stack and stack[-1][0] > c:
                length, low = stack.pop()
                if k - low > 1 and (length == 0 or len(set(left[i[low:k]].tolist())) > 1):
                    out.append((span + length, text[i[low:k]], place[i[low:k]]))
            if c >= 0 and (not stack or stack[-1][0] < c):
                stack.append((c, low))
    return out


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    a, b = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
    return int(np.argmax(a != b))


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    """bundle, spots (start << 32 | bytes of each span), from suffix arrays over the contexts of each anchor."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["anchor"]):
            cut = bounds(whole, ["anchor"])
            total = np.concatenate([[0], np.cumsum(pc.binary_length(whole.column("bytes")).to_numpy())])
            k = 0
            while k < len(cut) - 1:  # as many anchors at a time as SORTED_BYTES hold
                to = k + 1
                while to < len(cut) - 1 and total[cut[to + 1]] - total[cut[k]] <= SORTED_BYTES:
                    to += 1
                part = whole.slice(cut[k], cut[to] - cut[k])
                family = np.repeat(np.arange(to - k), np.diff(cut[k : to + 1]))
                spot = part.column("spot").to_numpy()
                spans: dict[int, set[int]] = {}
                for length, text, place in maximal_repeats(part.column("bytes").to_pylist(), family):
                    for t, p in zip(text.tolist(), place.tolist(), strict=True):
                        spans.setdefault(t, set()).add(((int(spot[t]) >> 8) + p) << 32 | length)
                if spans:
                    own = sorted(spans)
                    yield pa.RecordBatch.from_arrays([part.column("bundle").take(pa.array(own)), pa.array([np.array(sorted(spans[t]), np.int64).tobytes() for t in own], pa.binary())], ["bundle", "spots"])
                k = to

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "bundle long, spots binary")


def _counted_spans(contexts: DataFrame) -> DataFrame:
    """As _sorted_spans, from counts of all their strings' hashes; no group is gathered."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, (2, 256), dtype=U)
        base = np.array([[0xD6E8FEB86659FD93], [0xA0761D6478BD642F]], U)
        high = np.multiply.accumulate(np.concatenate([np.ones((2, 1), U), np.repeat(base, 2 * SPAN, 1)], 1), axis=1)
        for batch in batches:
            for bundle, spot, data in zip(*(batch.column(c).to_pylist() for c in ("bundle", "spot", "bytes")), strict=True):
                b = np.frombuffer(data, np.uint8)
                sums = np.concatenate([np.zeros((2, 1), U), np.cumsum(letters[:, b] * high[:, : len(b)], axis=1)], 1)
                n = len(b) - SPAN + 1
                h = mix((sums[:, SPAN:] - sums[:, :-SPAN]) * high[:, 2 * SPAN - np.arange(n)])
                yield pa.RecordBatch.from_arrays([pa.array(h[0].astype(np.int64)), pa.array(h[1].astype(np.int64)), pa.array(np.full(n, bundle)), pa.array([int(x).to_bytes(8, "little") for x in ((spot >> 8) + np.arange(n)) << 32 | SPAN], pa.binary())], ["h", "g", "bundle", "spots"])

    strings = stored(contexts.mapInArrow(run, "h long, g long, bundle long, spots binary"), "strings")
    twice = strings.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1")
    return strings.join(twice, ["h", "g"]).select("bundle", "spots")


def _removed(docs: DataFrame) -> DataFrame:
    """The bundles' rows, each followed by the spans to remove from it."""
    bundles = bundled(docs, BUNDLE_BYTES)
    judged = stored(_judged(_anchors(bundles)), "judged")
    contexts = _contexts(bundles, judged)
    crowded = stored(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select("anchor"), "crowded")
    spans = _sorted_spans(contexts.join(crowded, "anchor", "left_anti"))
    if crowded.limit(1).count():
        few = contexts.join(crowded, "anchor", "left_semi")
        spans = spans.unionByName(_counted_spans(few))
    whole = judged.where("whole").select("bundle", "spots", F.lit(True).alias("whole"))
    return beside(bundles, whole.unionByName(spans.select("bundle", "spots", F.lit(False).alias("whole"))), ["spots", "whole"])


def _rows(docs: DataFrame, outputs: tuple[str, ...]) -> DataFrame:
    """`rest`, a struct of the columns of docs but `text`, and the outputs; names in one can't clash with those in the other."""
    rest = [c for c in docs.columns if c != "text"]
    kinds = {"kept": ("string", pa.string()), "kept_sha256": ("string", pa.string()), "n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64())}
    kind = docs.select(F.struct(*rest).alias("rest")).schema["rest"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bundle"]):
            cut = bounds(group, ["bundle"])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                body = unpack(group.column("z")[i].as_py())
                ends = group.column("ends")[i].values.to_numpy()
                step = np.zeros(len(body) + 1, np.int32)
                part = group.slice(i + 1, j - i - 1)
                for flag in (True, False):
                    mine = part.filter(pc.equal(part.column("whole"), flag))
                    if mine.num_rows:
                        s = np.frombuffer(b"".join(mine.column("spots").to_pylist()), np.int64)
                        start, size = (s >> 8, (s & 255) + SPAN) if flag else (s >> 32, s & 0xFFFFFFFF)
                        np.add.at(step, start, 1)
                        np.add.at(step, start + size, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = ends[:-1][ends[:-1] < len(body)]
                edge[inner] = gone[inner]
                made: dict[str, list] = {c: [] for c in outputs}
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    away = gone[a:b]
                    n = int(away.sum())
                    left = body[a:b][~away].tobytes() if n else body[a:b].tobytes()
                    for c in outputs:
                        made[c].append(b - a if c == "n_bytes" else n if c == "n_removed" else int(edge[a:b].sum()) if c == "n_spans" else sha256(left).hexdigest() if c == "kept_sha256" else left.decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([group.column("rest")[i].values, *(pa.array(made[c], kinds[c][1]) for c in outputs)], ["rest", *outputs])

    return _removed(docs).mapInArrow(run, f"rest {kind}, " + ", ".join(f"{c} {kinds[c][0]}" for c in outputs))


def remove_repeats(docs: DataFrame, outputs: tuple[str, ...] = ("kept", "n_bytes", "n_removed", "n_spans")) -> DataFrame:
    """docs without `text`, with the outputs: kept (the remaining text), kept_sha256, n_bytes, n_removed, n_spans.

    Former columns with the names of outputs are replaced.
    """
    rest = [c for c in docs.columns if c != "text" and c not in outputs]
    return _rows(docs.select("text", *rest), outputs).select("rest.*", *outputs)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with all their columns, whatever their names; text without what repeats, and n_chars (where there is one) of what remains."""
    now = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return _rows(docs, ("kept",)).select(*(now.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
