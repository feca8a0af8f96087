"""Operator 13, exact dedup: an index of live text digests behind cuckoo filters.

The index is a table of shards. A shard holds the SHA-256 digests (keys) of some 65,000 texts, how many live documents have
each, and a cuckoo table in front of them: buckets of four 16-bit tags, two possible buckets for each key. A lookup reads two
buckets; tags that agree are hits, and hits are verified against the stored key. A key goes into a free lane of its buckets or
moves another key on to its other bucket; if that does not end within KICKS rounds (overflow), the table doubles and is filled again from
the stored keys. A key whose last document is deleted leaves its lane. All steps take many keys at a time as arrays.

Dedup of a table:
1. Digests of all texts (A-Z lower-cased) are dealt to their shards, copies combined before, and inserted.
2. Keys of one document are deleted; what stays live is the repeated ones. The tables, two bytes a lane, are sent to all
   tasks while they are within BROADCAST_BYTES, and joined by shard beyond.
3. A text whose tag is not there is alone: it has its result, and never moves. The others are verified against the content: whole
   texts are grouped by digest and bytes, combined before they are dealt, and each group gives its size and largest id.
4. Documents with hits look up their group by digest; where two texts have one digest, by digest and text.

`insert` and `delete` keep an index up to date with batches of documents; `live_count` asks it.

Cases: null text is empty, and empty texts are equal to each other; repeated rows are members of their group like others, and
of equal rows with the largest id one is kept; null ids are smaller than all others (keep_id is null if a group has no other); an
empty table gives an empty result; other columns of the table are ignored by `duplicates` and carried, whatever their names, by
`keep_last`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, small, stored
from .words import LOWER, chunks, raw

LANES = 4
LOAD = 0.9  # of the lanes, at most, when a table is filled anew
KICKS = 200
SHARD_KEYS = 1 << 16
LEAST_SHARDS = 64
FLUSH_KEYS = 1 << 17
CHUNK = 4 << 20
KEY = np.dtype("<u8")
INDEX = "shard int, tags binary, slots binary, keys binary, counts binary"


def digest(body: bytes) -> bytes:
    return sha256(body).digest()


def parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys (n, 4 words): the first bucket before it is cut to the table's size, the tag (not 0), and the step to the other bucket."""
    tag = (keys[:, 2] & 0xFFFF).astype(np.int64)
    tag[tag == 0] = 1
    return (keys[:, 1] & 0x3FFFFFFF).astype(np.int64), tag, tag * 0x5BD1E995 >> 3 & 0x3FFFFFFF


class Cuckoo:
    """The live keys of one shard: tags and slots (numbers of keys) by bucket and lane, keys and counts by number."""

    def __init__(self, expected: int = 0):
        self.keys = np.zeros((max(expected, 16), 4), KEY)
        self.counts = np.zeros(len(self.keys), np.int64)
        self.n = 0
        self.resized = 0
        self._clear(self._size(expected))

    @staticmethod
    def _size(keys: int) -> int:
        """Buckets (a power of two) that hold so many keys."""
        return 1 << max(int(keys / LOAD / LANES), 1).bit_length()

    def _clear(self, buckets: int) -> None:
        self.tags = np.zeros((buckets, LANES), np.uint16)
        self.slots = np.full((buckets, LANES), -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1: tags first, then the stored keys of those that agree."""
        place, tag, step = parts(keys)
        mask = len(self.tags) - 1
        both = np.stack([place & mask, (place ^ step) & mask], 1)
        row, side, lane = np.nonzero(self.tags[both] == tag[:, None, None])
        slot = self.slots[both[row, side], lane]
        same = (self.keys[slot] == keys[row]).all(1)
        found = np.full(len(keys), -1, np.int64)
        found[row[same]] = slot[same]
        return found

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """More documents of keys, which differ from each other."""
        at = self.find(keys)
        self.counts[at[at >= 0]] += counts[at >= 0]
        new = np.flatnonzero(at < 0)
        if not len(new):
            return
        while self.n + len(new) > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        number = np.arange(self.n, self.n + len(new))
        self.keys[number], self.counts[number] = keys[new], counts[new]
        self.n += len(new)
        if not self._insert(number):
            self._refill(2 * len(self.tags))

    def remove(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Fewer documents of keys, which differ from each other; a key without any leaves the table. Unknown keys are ignored."""
        at = self.find(keys)
        known = np.flatnonzero(at >= 0)
        at = at[known]
        self.counts[at] -= counts[known]
        gone = at[self.counts[at] <= 0]
        self.counts[gone] = 0
        place, _, step = parts(self.keys[gone])
        mask = len(self.tags) - 1
        for bucket in (place & mask, (place ^ step) & mask):
            row, lane = np.nonzero(self.slots[bucket] == gone[:, None])
            self.tags[bucket[row], lane] = 0
            self.slots[bucket[row], lane] = -1

    def _refill(self, buckets: int) -> None:
        """A table of another size from the stored keys, the dead ones left out."""
        self.resized += 1
        live = np.flatnonzero(self.counts[: self.n] > 0)
        self.keys, self.counts, self.n = np.append(self.keys[live], np.zeros((16, 4), KEY), 0), np.append(self.counts[live], np.zeros(16, np.int64)), len(live)
        self._clear(buckets)
        while not self._insert(np.arange(self.n)):
            buckets *= 2
            self._clear(buckets)

    def _insert(self, number: np.ndarray) -> bool:
        """Put keys into their lanes; False if some find none (the table is then not to be used)."""
        mask = len(self.tags) - 1
        chance = np.random.default_rng(7)
        place, tag, step = parts(self.keys[number])
        bucket = place & mask
        for _ in range(KICKS):
            for _ in range(2):  # the bucket, then the other one
                left = self._fill(number, tag, bucket)
                number, tag, step, bucket = number[left], tag[left], step[left], (bucket[left] ^ step[left]) & mask
                if not len(number):
                    return True
            first = np.unique(bucket, return_index=True)[1]  # one key moves into each bucket, and another out
            lane = chance.integers(0, LANES, len(first))
            out = self.slots[bucket[first], lane].astype(np.int64)
            self.slots[bucket[first], lane], self.tags[bucket[first], lane] = number[first], tag[first]
            _, out_tag, out_step = parts(self.keys[out])
            rest = np.ones(len(number), bool)
            rest[first] = False
            bucket = np.concatenate([bucket[rest], (bucket[first] ^ out_step) & mask])
            number, tag, step = (np.concatenate(x) for x in ((number[rest], out), (tag[rest], out_tag), (step[rest], out_step)))
        return False

    def _fill(self, number: np.ndarray, tag: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put keys into free lanes of their buckets, as many as there are; the places of the others."""
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        nth = np.cumsum(self.tags[sorted_] == 0, 1)
        fits = rank < nth[:, -1]
        lane = np.argmax(nth == rank[:, None] + 1, 1)[fits]
        self.tags[sorted_[fits], lane] = tag[order[fits]]
        self.slots[sorted_[fits], lane] = number[order[fits]]
        return order[~fits]

    def only(self, least: int) -> Cuckoo:
        """Without the keys of fewer than `least` documents, and no larger than it need be."""
        few = np.flatnonzero((self.counts[: self.n] < least) & (self.counts[: self.n] > 0))
        self.remove(self.keys[few], self.counts[few])
        live = int((self.counts[: self.n] > 0).sum())
        if self._size(live) < len(self.tags):
            self._refill(self._size(live))
        return self

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        if 2 * (self.counts[: self.n] > 0).sum() < self.n:
            self._refill(len(self.tags))
        return self.tags.tobytes(), self.slots.tobytes(), self.keys[: self.n].tobytes(), self.counts[: self.n].tobytes()

    @classmethod
    def unpack(cls, tags: bytes, slots: bytes, keys: bytes, counts: bytes) -> Cuckoo:
        made = cls()
        made.tags, made.slots = np.frombuffer(tags, np.uint16).reshape(-1, LANES).copy(), np.frombuffer(slots, np.int32).reshape(-1, LANES).copy()
        made.keys, made.counts = np.frombuffer(keys, KEY).reshape(-1, 4).copy(), np.frombuffer(counts, np.int64).copy()
        made.n = len(made.counts)
        if not made.n:
            made.keys, made.counts = np.zeros((16, 4), KEY), np.zeros(16, np.int64)
        return made


def _binary(values: np.ndarray, width: int) -> pa.Array:
    """Rows of `width` bytes as a binary column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def digested(docs: DataFrame, shards: int, keep: list[str | Column], text: bool = False) -> DataFrame:
    """The columns `keep` as the struct `row`, with key, shard, place, tag and step; text: and `body`, the normalised bytes."""
    rows = docs.select("text", F.struct(*keep).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, z in chunks(column, CHUNK):
                body, ends = raw(column.slice(a, z - a))
                body = LOWER[body]
                view = memoryview(body)
                found = np.frombuffer(b"".join(digest(view[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), KEY).reshape(-1, 4)
                place, tag, step = parts(found)
                made = [pa.concat_arrays([batch.column("row").slice(a, z - a)]), _binary(found, 32), pa.array((found[:, 0] % np.uint64(shards)).astype(np.int32)), pa.array(place.astype(np.int32)), _binary(tag.astype("<u2"), 2), pa.array(step.astype(np.int32))]
                if text:
                    made.append(pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)]))
                yield pa.RecordBatch.from_arrays(made, ["row", "key", "shard", "place", "tag", "step", "body"][: len(made)])

    return rows.mapInArrow(run, f"row {kind}, key binary, shard int, place int, tag binary, step int" + (", body binary" if text else ""))


def shards_of(rows: int) -> int:
    """Shards (a power of two) for so many documents."""
    return max(LEAST_SHARDS, 1 << max(rows // SHARD_KEYS, 1).bit_length())


def _combined(keys: DataFrame) -> DataFrame:
    """shard, key, n of rows with shard and key: copies that a task meets are counted, FLUSH_KEYS keys at a time."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for shard, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if key in held:
                    held[key][1] += 1
                else:
                    held[key] = [shard, 1]
            if len(held) >= FLUSH_KEYS:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        shard, n = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(list(held), pa.binary()), pa.array(n, pa.int64())], ["shard", "key", "n"])

    return keys.select("shard", "key").mapInArrow(run, "shard int, key binary, n long")


def _updated(index: DataFrame | None, keys: DataFrame, add: bool) -> DataFrame:
    """The shards after the documents of keys(shard, key) came (add) or went; shards that no key reaches stay as they are."""
    rows = _combined(keys).select("shard", F.lit(1).alias("kind"), "key", "n", *(F.lit(None).cast("binary").alias(c) for c in ("tags", "slots", "keys", "counts")))
    if index is not None:
        held = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("n"), "tags", "slots", "keys", "counts")
        rows = held.unionByName(rows)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Cuckoo()
        for batch in batches:
            shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            cut = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]), [True]])) if batch.num_rows else [0]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if now is not None and shard[i] != now:
                    yield packed(now, held)
                if shard[i] != now:
                    now, held = int(shard[i]), Cuckoo()
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    held = Cuckoo.unpack(*(part.column(c)[0].as_py() for c in ("tags", "slots", "keys", "counts")))
                    continue
                found = np.frombuffer(b"".join(part.column("key").to_pylist()), "V32")
                key, of = np.unique(found, return_inverse=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, of, part.column("n").to_numpy())
                (held.add if add else held.remove)(key.view(KEY).reshape(-1, 4), n)
        if now is not None:
            yield packed(now, held)

    def packed(shard: int, held: Cuckoo) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in held.pack())], ["shard", "tags", "slots", "keys", "counts"])

    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, INDEX)


def insert(index: DataFrame | None, docs: DataFrame, shards: int) -> DataFrame:
    """The index (None: an empty one) with the texts of docs, as a stored table; shards must be the same in all calls."""
    return stored(_updated(index, digested(docs, shards, [F.lit(0).alias("no")]), True), "index")


def delete(index: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    """The index without the texts of docs: a digest is live as long as one of its documents is."""
    return stored(_updated(index, digested(docs, shards, [F.lit(0).alias("no")]), False), "index")


def live_count(index: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    """doc_id and n, the live documents of its text's digest in the index (0: none)."""
    asked = digested(docs, shards, ["doc_id"]).select("shard", F.lit(1).alias("kind"), F.col("row.doc_id").alias("doc_id"), "key", *(F.lit(None).cast("binary").alias(c) for c in ("tags", "slots", "keys", "counts")))
    held = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("binary").alias("key"), "tags", "slots", "keys", "counts")
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Cuckoo()
        for batch in batches:
            shard, own = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            cut = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (own[1:] != own[:-1]), [True]])) if batch.num_rows else [0]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(i, j - i)
                if shard[i] != now:
                    now, held = shard[i], Cuckoo()
                if own[i] == 0:
                    held = Cuckoo.unpack(*(part.column(c)[0].as_py() for c in ("tags", "slots", "keys", "counts")))
                    continue
                at = held.find(np.frombuffer(b"".join(part.column("key").to_pylist()), KEY).reshape(-1, 4))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.where(at >= 0, held.counts[np.maximum(at, 0)], 0))], ["doc_id", "n"])

    return held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, f"doc_id {kind}, n long")


def repeated_tags(index: DataFrame, least: int = 2) -> DataFrame:
    """shard, tags, buckets of the filters that hold the keys of `least` documents and more; the others are deleted."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = Cuckoo.unpack(*(batch.column(c)[i].as_py() for c in ("tags", "slots", "keys", "counts"))).only(least)
                if (held.tags != 0).any():
                    yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), pa.array([held.tags.astype("<u2").tobytes()], pa.binary()), pa.array([len(held.tags)], pa.int32())], ["shard", "tags", "buckets"])

    return index.mapInArrow(run, "shard int, tags binary, buckets int")


def _hit() -> Column:
    """Is the row's tag in one of its two buckets? Of rows joined with their shard's filter."""
    inside = []
    for bucket in ("place & (buckets - 1)", "(place ^ step) & (buckets - 1)"):
        inside += [f"substring(tags, ({bucket}) * {2 * LANES} + {2 * k + 1}, 2) = tag" for k in range(LANES)]
    return F.coalesce(F.expr(" or ".join(inside)), F.lit(False))


class _Dedup:
    """Tables of one table's dedup: live filters, content groups, and digests that several texts share."""

    def __init__(self, docs: DataFrame, keep: list[str]):
        self.docs = docs
        self.shards = shards_of(docs.count())
        self.keys = stored(digested(docs, self.shards, keep), "keys")
        index = stored(_updated(None, self.keys, True), "index")
        live = stored(repeated_tags(index), "filters")
        size = live.agg(F.sum(F.octet_length("tags"))).first()[0] or 0
        self.live = small(live, size, 1)
        self.groups = stored(self.content().groupBy("key", "body").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")), "groups")
        self.shared = stored(self.groups.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "shared")
        self.sharing = not self.shared.isEmpty()
        forget(index)

    def asked(self, rows: DataFrame) -> DataFrame:
        """rows with `hit`: whether the filters may hold their digest."""
        return rows.join(self.live, "shard", "left").withColumn("hit", _hit()).drop("tags", "buckets")

    def content(self) -> DataFrame:
        """row, key, body and doc_id of the texts that the filters do not rule out."""
        rows = self.asked(digested(self.docs, self.shards, ["doc_id"], text=True)).where("hit")
        return rows.select("key", "body", "row.doc_id")

    def judged(self) -> DataFrame:
        """row, key, keep_id and group_size of every document."""
        rows = self.asked(self.keys)
        alone = rows.where("not hit").select("row", "key", F.col("row.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        met = rows.where("hit").select("row", "key").join(self.single().select("key", "keep_id", "group_size"), "key").select("row", "key", "keep_id", "group_size")
        return alone.unionByName(met)

    def single(self) -> DataFrame:
        """The groups whose digest no other text has."""
        return self.groups.join(self.shared, "key", "left_anti") if self.sharing else self.groups


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (of the row of its text that stays), group_size, kept, text_sha256 (of the text with A-Z lower-cased)."""
    docs = docs.select("doc_id", "text")
    made = _Dedup(docs, ["doc_id"])
    rows = made.judged().select("row.doc_id", "key", "keep_id", "group_size")
    if made.sharing:  # one digest, several texts: by the texts themselves
        content = made.content().join(made.shared, "key", "left_semi")
        rows = rows.unionByName(content.join(made.groups, ["key", "body"]).select("doc_id", "key", "keep_id", "group_size"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1)
    others = rows.where(~stays).withColumn("kept", F.col("group_size") == 1)
    # of equal rows with the largest id one stays: they are counted, and one of the count is kept
    tops = rows.where(stays).groupBy(*rows.columns).agg(F.count("*").alias("n"))
    tops = tops.select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("no")).select(*rows.columns, (F.col("no") == 1).alias("kept"))
    return others.unionByName(tops).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256"))


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which no equal text has a larger doc_id; one of several with the same."""
    given = docs.select("text", "doc_id", F.struct(*docs.columns).alias("all"))
    made = _Dedup(given.select("doc_id", "text"), ["doc_id"])
    rows = made.asked(digested(given, made.shards, ["all", "doc_id"], text=made.sharing))
    last = F.col("row.doc_id").eqNullSafe(F.col("keep_id"))
    hits = rows.where("hit")
    kept = hits.select("row", "key").join(made.single().select("key", "keep_id"), "key").where(last).groupBy("key").agg(F.any_value("row").alias("row")).select("row.all")
    if made.sharing:
        several = hits.join(made.shared, "key", "left_semi").join(made.groups.select("key", "body", "keep_id"), ["key", "body"]).where(last)
        kept = kept.unionByName(several.groupBy("key", "body").agg(F.any_value("row").alias("row")).select("row.all"))
    return rows.where("not hit").select("row.all").unionByName(kept).select("all.*")


UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same over `documents` as SQL, by the texts themselves.
SQL = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{UP.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""
