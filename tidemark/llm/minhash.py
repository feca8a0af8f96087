"""Operator 3, near-duplicate groups by b-bit MinHash with exact confirmation.

A text's set holds its distinct 5-word shingles. Texts with equal sets are one node. Of each set, HASHES minima are taken;
ROWS of them at a time make a band key, and nodes that share a band key are candidates. Of every minimum the low BITS are
kept and packed; the share of equal low bits, corrected for chance hits, estimates the similarity of a candidate pair.

Links are confirmed on full sets, in passes that contract groups, so that no pass emits a group's pairs wholesale:
1. over the first LEADING bands, each node against the leader of its buckets (the node with the most company), the best
   NEAREST estimates; components follow;
2. over all bands, but only in buckets that hold several components: each node outside the bucket's largest component
   against the most central node of that one. What the first pass has joined takes no part;
3. buckets that still hold several components, compared block by block across components: for each node the best NEAREST
   estimates, ROUNDS times at most (what is left by then is left to step 4, which leaves nothing);
4. components between which an estimate is not MARGIN below the limit form families (told in each block by a tree, not by
   all pairs); a family's nodes come together with their full sets, in blocks, and every such pair across components is
   decided there; only links leave a block.
Buckets are told apart by a map-side aggregate over their keys; large buckets and families are cut into blocks that go to
different tasks. A bucket or family of n nodes in many components takes up to n * n estimates, as any of them may be a link.
A pair at the limit shares no band with probability (1 - 0.75**ROWS)**BANDS, about 3e-7, and is estimated more than MARGIN
below it with probability 1e-12 (fewer than 162 of 280 equal low bits, each equal with probability 0.766): in all about
3e-7. Minima are mixed before their low bits are taken, so that unequal ones agree by chance in any sets, small ones too.
A bucket's components are told apart by 43 bits of a label and their size, which costs a pair in 1e13 at most.

Cases: null, empty or blank texts have no set, are linked with nothing and are their own component; a text of fewer
than five words has its word sequence as its one shingle; equal rows are one node; a null doc_id counts in its group
but is no group's id unless all are null (then the id is null and kept is false); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, lean, small, stored
from .graph import bounds, components, groups
from .words import U, grams, chunks, mix, words

SHINGLE = 5
ROWS, BANDS, BITS = 5, 56, 4
HASHES = ROWS * BANDS
NUMERATOR, DENOMINATOR = 75, 100
MARGIN = 0.2
BLOCK = 1024
NEAREST = 2
LEADING = 8
ROUNDS = 1
_LOW43 = (1 << 43) - 1

_seeds = np.random.Generator(np.random.PCG64(31))
_A = _seeds.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_C = _seeds.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of texts: the number of the first, all their sets one after another, and where each begins (and the end)."""
    for at, to in chunks(column):
        w = words(column.slice(at, to - at))
        h, begin = grams(w.hash, w.first, SHINGLE)
        owner = np.repeat(np.arange(to - at), np.diff(begin))
        order = np.lexsort((h, owner))
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield at, h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=to - at))])


def node_of(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One number for each set that is not empty, the same for equal sets (0 for empty ones)."""
    sums = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)))])
    n = np.diff(begin)
    return np.where(n > 0, mix((sums[begin[1:]] - sums[begin[:-1]]) + n.astype(U) * U(0x9E3779B97F4A7C15)), U(0)).astype(np.int64)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection after which every bit depends on all bits: those of A * low + C * high are only as mixed as the bits below them."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits and band keys of sets; all must have elements."""
    low, high = h.astype(np.uint32), (h >> U(32)).astype(np.uint32)
    minima = np.empty((len(begin) - 1, HASHES), np.uint32)
    for i in range(HASHES):
        minima[:, i] = np.minimum.reduceat(low * _A[i] + high * _C[i], begin[:-1])
    bits = (mix32(minima) & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    packed = bits[:, ::2] | (bits[:, 1::2] << 4)
    keys = np.zeros((len(minima), BANDS), U) + np.arange(1, BANDS + 1, dtype=U)
    wide = minima.reshape(-1, BANDS, ROWS).astype(U)
    for r in range(ROWS):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + wide[:, :, r])
    return packed, keys.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates from packed signatures of equal shape (or to broadcast): equal low bits, less the chance hits."""
    x = a ^ b
    x |= x >> np.uint8(1)
    x |= x >> np.uint8(2)
    differ = np.bitwise_count(x & np.uint8(0x11)).sum(-1, dtype=np.int32)
    share = 1 - differ / HASHES
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), node (null without words), n_shingles, sig, bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for at, h, begin in shingle_sets(text):
                n = np.diff(begin)
                node, some = node_of(h, begin), n > 0
                sig, bands = [None] * len(n), [None] * len(n)
                if some.any():
                    packed, keys = signatures(h, np.append(begin[:-1][some], begin[-1]))
                    for i, s, k in zip(np.flatnonzero(some).tolist(), packed, keys, strict=True):
                        sig[i], bands[i] = s.tobytes(), k
                part = batch.slice(at, len(n))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(node, pa.int64(), mask=~some), pa.array(n.astype(np.int64)), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "node", "n_shingles", "sig", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, node long, n_shingles long, sig binary, bands array<long>")


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(u, v) with est, for those whose estimate is not far below the limit."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(f"sig_{k}").to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in "uv")
                est = similarity(a, c)
                ok = pa.array(est >= NUMERATOR / DENOMINATOR - MARGIN)
                yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok), pa.array(est).filter(ok)], ["u", "v", "est"])

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long, est double")


def _sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, set) of the nodes of pairs, computed again from one document of each."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    ids = stored(rows.where("node is not null").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("th").alias("th")), "wanted")
    n = ids.count()
    keys = small(ids.select("id").distinct(), n, 24)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, begin in shingle_sets(batch.column("text")):
                node = node_of(h, begin)
                some = np.flatnonzero(np.diff(begin))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array([h[begin[i] : begin[i + 1]].tobytes() for i in some], pa.binary())], ["node", "set"])

    own = docs.select("doc_id", "text").join(keys, F.expr("doc_id <=> id"), "left_semi").select("text")
    return stored(own.mapInArrow(run, "node long, set binary").join(small(ids.select("node"), n, 24), "node", "left_semi").dropDuplicates(["node"]), "sets")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets (sorted) have NUMERATOR / DENOMINATOR of their union in common."""
    if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(u, v) with NUMERATOR / DENOMINATOR of their union in common, by full sets."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_u"), b.column("set_v"), strict=True):
                ok.append(linked(*(np.frombuffer(s.as_buffer(), U) for s in (x, y))))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], ["u", "v"])

    return pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long")


def _decided(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    sets = _sets(docs, rows, pairs)
    found = stored(_confirmed(pairs, sets), "links")
    forget(sets)
    return found


def _nearest(pairs: DataFrame) -> DataFrame:
    """u, v of the NEAREST best estimates of each v."""
    order = Window.partitionBy("v").orderBy(F.desc("est"), "u")
    top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEAREST)
    return top.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """block, node, label, is_main: the members(key, node) of keys that hold several labels, dealt to blocks.

    Of a key, the members of its largest component are `main`, the rest `other`. Every block of others meets every block
    of main members and of others; a block has BLOCK members of a kind at most, on average.
    """
    of = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    counts = of.groupBy("key", "label").agg(F.count("*").alias("n"))
    sums = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    cut = lambda n: F.ceil(n / BLOCK).cast("int")
    sums = sums.select("key", F.col("top.label").alias("main"), cut(F.col("top.n")).alias("nm"), cut(F.col("n") - F.col("top.n")).alias("no"))
    part = of.join(sums, "key").withColumn("is_main", F.col("label") == F.col("main"))
    mine = F.pmod(F.xxhash64("node", "key"), F.when(F.col("is_main"), F.col("nm")).otherwise(F.col("no"))).cast("int")
    part = part.withColumn("b", mine)
    to_main = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("b").alias("j")))
    to_other = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least(j, "b").alias("i"), F.greatest(j, "b").alias("j")))
    main = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("b").alias("i"), j.alias("j")))
    part = part.withColumn("at", F.explode(F.when(F.col("is_main"), main).otherwise(F.concat(to_main, to_other))))
    return part.select(F.xxhash64("key", "at").alias("block"), "node", "label", "is_main")


def _across(members: DataFrame, labels: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """What links members(key, node) of different labels may have, by estimates that are not far below the limit.

    how: `best` gives u, v of each node outside the largest component of a key with its best partners; `labels` gives u, v,
    a tree over each set of labels that such estimates connect in a block; `links` gives u, v of the links themselves,
    confirmed on the full sets, which nodes then has as `set`.
    """
    columns = ["node", "sig", "set"] if how == "links" else ["node", "sig"]
    part = _blocks(members, labels).join(nodes.select(*columns), "node")
    low = NUMERATOR / DENOMINATOR - MARGIN

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["block"]):
            node, label = (whole.column(c).to_numpy() for c in ("node", "label"))
            main = whole.column("is_main").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(whole.column("sig").to_pylist()), np.uint8).reshape(whole.num_rows, -1)
            sets = [np.frombuffer(s.as_buffer(), U) for s in whole.column("set")] if how == "links" else []
            edge = bounds(whole, ["block"])
            us, vs, es = [], [], []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                inside = np.arange(a, z)
                others = inside[~main[a:z]]
                against = inside[main[a:z]] if main[a:z].any() else others
                own, number = np.unique(label[a:z], return_inverse=True)  # labels of the block, and the tree each is in
                tree = np.arange(len(own))
                for x in others:
                    y = against[label[against] != label[x]]
                    if how == "labels":  # what is connected already needs no estimate
                        y = y[tree[number[y - a]] != tree[number[x - a]]]
                    est = similarity(sig[x], sig[y])
                    near = np.flatnonzero(est >= low)
                    if how == "best" and len(near):
                        near = near[[est[near].argmax()]]
                    elif how == "labels" and len(near):
                        joined = np.unique(tree[number[y[near] - a]])
                        us.append(own[joined])
                        vs.append(np.full(len(joined), own[tree[number[x - a]]]))
                        es.append(np.ones(len(joined)))
                        tree[np.isin(tree, joined)] = tree[number[x - a]]
                        continue
                    elif how == "links":
                        near = near[[linked(sets[x], sets[k]) for k in y[near]]] if len(near) else near
                    us.append(node[y[near]])
                    vs.append(np.full(len(near), node[x]))
                    es.append(est[near])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, es)], ["u", "v", "est"])

    found = part.repartition("block").sortWithinPartitions("block", "is_main").mapInArrow(run, "u long, v long, est double")
    return _nearest(found.distinct()) if how == "best" else found.select("u", "v").distinct()


def _keyed(coded: DataFrame, bands: int) -> DataFrame:
    """key, node, code of the first `bands` band keys of coded(node, code, bands)."""
    return coded.select("node", "code", F.explode(F.slice("bands", 1, bands)).alias("key"))


def _mixed(coded: DataFrame, bands: int) -> DataFrame:
    """The keys whose nodes differ in code, with the largest code, z."""
    sums = _keyed(coded, bands).groupBy("key").agg(F.min("code").alias("a"), F.max("code").alias("z"))
    return stored(sums.where("a <> z").select("key", "z"), "keys")


def _led(coded: DataFrame, bands: int) -> DataFrame:
    """Pairs (u, v): each node v of a mixed key that has not its largest code, and the head u of that code."""
    keys = _mixed(coded, bands)
    n = keys.count()
    heads = coded.select("code", "head").distinct().join(small(keys.select(F.col("z").alias("code")).distinct(), n, 16), "code").groupBy("code").agg(F.max("head").alias("u"))
    lead = keys.join(small(heads, n, 16), keys.z == heads.code).select("key", "z", "u")
    return _keyed(coded, bands).join(small(lead, n, 32), "key").where("code <> z and u <> node").select("u", F.col("node").alias("v")).distinct()


def _coded(nodes: DataFrame, size: DataFrame, of: str) -> DataFrame:
    """node, bands, code, head, from size(node, <of>, head, size): a code holds a size, capped at 20 bits, and 43 bits of <of>."""
    top = F.least(F.coalesce("size", F.lit(1)), F.lit((1 << 20) - 1)).cast("long")
    code = F.shiftleft(top, 43).bitwiseOR(F.coalesce(of, "node").bitwiseAND(F.lit(_LOW43)))
    return nodes.join(size, "node", "left").select("node", "bands", code.alias("code"), F.coalesce("head", "node").alias("head"))


def _by_component(nodes: DataFrame, labels: DataFrame, company: DataFrame) -> DataFrame:
    """_coded by components: their sizes, and their most central nodes as heads."""
    heads = labels.join(company, "node", "left").groupBy("label").agg(F.max_by("node", F.struct(F.coalesce("size", F.lit(0)), "node")).alias("head"), F.count("*").alias("size"))
    return stored(_coded(nodes, labels.join(heads, "label"), "label"), "coded")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; also th (hash of the text) and label (of the component)."""
    full = stored(_rows(docs), "minhash")
    nodes = stored(full.where("node is not null").select("node", "sig", "bands").dropDuplicates(["node"]), "nodes")
    rows = stored(full.drop("sig", "bands"), "rows")
    forget(full)
    first = nodes.select("node", F.explode(F.slice("bands", 1, LEADING)).alias("key"))
    shared = stored(first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    company = stored(first.join(small(shared, shared.count(), 16), "key").groupBy("node").agg(F.sum("n").alias("size")), "company")
    own = company.select("node", F.col("node").alias("head"), "size")
    tried = links = labels = None
    for bands in (LEADING, BANDS):
        coded = stored(_coded(nodes, own, "head"), "coded") if labels is None else _by_component(nodes, labels, company)
        pairs = _led(coded, bands)
        pairs = pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti")
        pairs = stored(_nearest(_estimated(pairs, nodes)), "pairs")
        forget(coded)
        found = _decided(docs, rows, pairs)
        tried, links = (pairs, found) if tried is None else (tried.union(pairs), links.union(found))
        labels = components(links)

    coded = _by_component(nodes, labels, company)
    keys = _mixed(coded, BANDS)
    members = stored(_keyed(coded, BANDS).join(small(keys.select("key"), keys.count(), 8), "key", "left_semi").select("key", "node"), "members")
    forget(coded, keys)
    for _ in range(ROUNDS):
        pairs = stored(_across(members, labels, nodes, "best").join(tried, ["u", "v"], "left_anti"), "pairs")
        found = _decided(docs, rows, pairs)
        if found.isEmpty():
            break
        tried, links = tried.union(pairs), links.union(found)
        labels = components(links)

    # components that may still be linked meet with their full sets, each node once
    near = stored(_across(members, labels, nodes, "labels"), "pairs")
    if not near.isEmpty():
        family = components(near).select(F.col("node").alias("label"), F.col("label").alias("key"))
        every = nodes.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rest = stored(every.join(family, "label").select("key", "node"), "members")
        whole = nodes.join(_sets(docs, rows, rest.select(F.col("node").alias("u"), F.col("node").alias("v"))), "node")
        labels = components(stored(links.union(_across(rest, labels, whole, "links")), "links"))

    of = rows.join(labels, "node", "left").select("doc_id", "th", "n_shingles", F.coalesce("label", "node").alias("label"))
    ids = stored(of.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "ids")
    out = of.join(small(ids, ids.count(), 24), "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "th", "label")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (its smallest doc_id); rows without words all stay."""
    found = stored(near_duplicates(docs), "groups")
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("k"))
    # a group that holds only null ids is told by its texts' hashes
    keep = first.select(F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th")).union(found.where("label is null").select("doc_id", "th")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    hit = row.join(keep, F.expr("_doc <=> _id and _hash = _th"), "left_semi")
    blank = F.regexp_count(F.coalesce("row.text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) == 0
    return hit.withColumn("_n", F.when(blank, F.monotonically_increasing_id())).dropDuplicates(["_doc", "_hash", "_n"]).select("row.*")
