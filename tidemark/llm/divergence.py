"""Operator 12, source divergence audit: how far the words of each source are from those of its language's other sources.

Each language keeps its terms of LEAST_DOCS documents and more; a source's smoothed share p of a term is a whole number, so all
arithmetic is exact. Two sources differ by the sum of |p - q| over all kept terms of the language.

A source without a term has the same p0 for all of them, so that all terms would add |p0 - q0| each if neither source had
any. What the terms that are there add beyond that is split by how many sources have a term:
* Heavy terms (in more than LIGHT sources, and than a share of the language's) go to dense tiles: a block of terms by a block of
  sources, filled with p0 and then with what is there, and each pair of blocks is subtracted as arrays.
* Light terms: the postings of one source against the p0 of another are read off the source's sorted values and their running
  sums; for sources that share a term, pairs of postings correct it. A light term has few postings, so its pairs are few.
Both are partial sums of whole numbers by pair of sources, and are added.

Counts are combined in each task before they are dealt by term; a term's postings are one row, no longer than the language
has sources, which the result has in pairs anyway.

Cases: null text, lang and source are the empty text; a source without terms is in the result, with p0 for all terms; a language
without kept terms has value 0 in all pairs; a language of one source has no pairs; repeated rows count as often as they are there; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small, stored
from .words import LOWER, chunks, raw

LEAST_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTH = 5
LIGHT = 2
LIGHT_SHARE = 16  # a term in less than one of so many sources is light
TERM_BLOCK = 1024
SOURCE_BLOCK = 256
CHUNK = 4 << 20
GROUP_BYTES = 128

_letters = np.arange(256)
IN_TERM = (_letters >= 0x80) | ((_letters >= 65) & (_letters <= 90)) | ((_letters >= 97) & (_letters <= 122))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it) of docs(lang, source, text), without nulls; not combined across tasks."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in chunks(batch.column("text"), CHUNK):
                part = batch.slice(a, z - a)
                body, ends = raw(part.column("text"))
                inside = np.zeros(len(body) + 1, bool)
                inside[:-1] = IN_TERM[body]
                begin = inside.copy()
                begin[1:] &= ~inside[:-1]
                inner = ends[:-1][ends[:-1] < len(body)]
                begin[inner] = inside[inner]  # a term does not go on in the next text
                start = np.flatnonzero(begin)
                if not len(start):
                    continue
                # the bytes of the terms alone, one after the other
                upto = np.cumsum(inside[:-1], dtype=np.int64)
                offsets = np.append(upto[start] - 1, upto[-1]).astype(np.int32)
                terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(LOWER[body[inside[:-1]]])).dictionary_encode()
                names, code = terms.dictionary, terms.indices.to_numpy().astype(np.int64)
                doc = np.searchsorted(ends, start, "right") - 1
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                key = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                _, first, key = np.unique(key, return_index=True, return_inverse=True)  # first: a row of each source
                k = len(names)
                pair, of_pair = np.unique(doc * k + code, return_counts=True)
                row, of_row = np.unique(key[pair // k] * k + pair % k, return_inverse=True)
                n, have = np.zeros(len(row), np.int64), np.bincount(of_row, minlength=len(row))
                np.add.at(n, of_row, of_pair)
                at = pa.array(first[row // k])
                yield pa.RecordBatch.from_arrays([part.column("lang").take(at), part.column("source").take(at), names.take(pa.array(row % k)), pa.array(n), pa.array(have.astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, terms: str) -> Column:
    """p, in parts of SCALE; whole-number arithmetic, also where the product is beyond 64 bits."""
    return F.expr(f"if({total} + {SMOOTH} * {terms} > 0, 1 + (cast({n} + {SMOOTH} as decimal(28, 0)) * {SCALE}BD) div cast({total} + {SMOOTH} * {terms} as decimal(28, 0)), null)")


class _Language:
    """Stored tables: postings of the kept terms with p, and the sources with their place in the language and p0."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
        counts = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("p"))
        kept = stored(by_term.where(F.col("docs") >= LEAST_DOCS), "terms")
        by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
        by_source = kept.select("lang", F.explode("p").alias("p")).groupBy("lang", "p.source").agg(F.sum("p.n").alias("source_n"))
        groups = docs.select("lang", "source").distinct()
        size = F.count("*").over(Window.partitionBy("lang"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        sources = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["source_n", "terms", "lang_n"])
        sources = sources.select("lang", "source", place.alias("no"), size.alias("sources"), "source_n", "terms", "lang_n", share("0L", "source_n", "terms").alias("p0"))
        self.sources = stored(sources, "sources")
        self.n_sources = self.sources.count()
        post = kept.select("lang", "term", F.col("n").alias("term_n"), F.size("p").alias("k"), F.explode("p").alias("x")).select("lang", "term", "term_n", "k", "x.source", "x.n")
        met = post.join(self.near(self.sources.select("lang", "source", "no", "sources", "source_n", "terms", "lang_n", "p0")), ["lang", "source"])
        p, q = share("n", "source_n", "terms"), share("term_n", "lang_n", "terms")
        heavy = (F.col("k") > LIGHT) & (F.col("k") * LIGHT_SHARE > F.col("sources"))
        self.postings = stored(met.select("lang", "source", "no", "term", "p0", p.alias("p"), q.alias("q"), heavy.alias("heavy")), "postings")

    def near(self, df: DataFrame) -> DataFrame:
        """df, of a row a source, for a join."""
        return small(df, self.n_sources, GROUP_BYTES)


def heavy_sums(postings: DataFrame, sources: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """lang, a, b (places of two sources, a < b), value: the sum of |p - q| - |p0 - q0| over the heavy terms, from dense tiles.

    A tile is a block of terms; the postings of each block of sources meet those of every other one, with the sources' p0.
    """
    block = F.floor(F.col("no") / SOURCE_BLOCK).cast("int")
    terms = postings.where("heavy").select("lang", "no", F.xxhash64("term").alias("t"), "term", "p")
    per_lang = terms.groupBy("lang").agg(F.ceil(F.count_distinct("term") / TERM_BLOCK).alias("tiles"))
    blocks = sources.groupBy("lang").agg(F.ceil(F.max("sources") / SOURCE_BLOCK).cast("int").alias("blocks"))
    facts = near(per_lang.join(blocks, "lang"))
    # every pair of blocks that a block of sources is in: (j, b) with j < b, and (b, j) with j >= b
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("b")).alias("i"), F.greatest(j, F.col("b")).alias("j"))))
    own = terms.withColumn("b", block).join(facts, "lang").withColumn("tile", F.pmod("t", "tiles"))
    own = own.select("lang", "tile", meets.alias("m"), F.lit(1).alias("kind"), "no", "term", "p")
    zero = sources.withColumn("b", block).join(facts, "lang").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    zero = zero.select("lang", "tile", meets.alias("m"), F.lit(0).alias("kind"), "no", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    rows = zero.unionByName(own).select("lang", "tile", "m.i", "m.j", "kind", "no", "term", "p")

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        """One block of terms of one pair of blocks of sources: both as dense arrays, each row of one less all of the other."""
        kind, no, p = (table.column(c).to_numpy() for c in ("kind", "no", "p"))
        base, post = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        names, at = np.unique(no[base], return_index=True)
        code = table.column("term").combine_chunks().take(pa.array(post)).dictionary_encode().indices.to_numpy()
        dense = np.repeat(p[base][at][:, None], (int(code.max()) + 1) if len(code) else 0, 1)
        dense[np.searchsorted(names, no[post]), code] = p[post]
        side = names // SOURCE_BLOCK
        a, b, value = [], [], []
        for x in np.flatnonzero(side == key[2].as_py()):
            other = np.flatnonzero((side == key[3].as_py()) & (names > names[x]))
            a.append(np.full(len(other), names[x]))
            b.append(names[other])
            value.append(np.abs(dense[other] - dense[x]).sum(1) - dense.shape[1] * np.abs(p[base][at][other] - p[base][at][x]))
        a, b, value = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b, value))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64())})

    return rows.groupBy("lang", "tile", "i", "j").applyInArrow(tile, "lang string, a int, b int, value long")


def light_sums(postings: DataFrame, sources: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """lang, a, b, value: partial sums to be added: |p0 - q0| for all kept terms, and what the light terms add by postings and pairs."""
    light = postings.where("not heavy")
    # by source: sorted values with their numbers, against all p0 of the language
    values = light.groupBy("lang", "no", "p0", "p").agg(F.count("*").alias("c")).groupBy("lang", "no", "p0").agg(F.sort_array(F.collect_list(F.struct("p", "c"))).alias("v"))
    sources = sources.where("terms > 0")
    every = sources.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("no", "p0"))).alias("all"))
    rows = sources.select("lang", "no", "p0", "terms").join(values.drop("p0"), ["lang", "no"], "left").join(near(every), "lang")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, no, p0, v, every, terms in zip(*(batch.column(c) for c in ("lang", "no", "p0", "v", "all", "terms")), strict=True):
                no, p0 = no.as_py(), p0.as_py()
                other, q0 = (every.values.field(c).to_numpy() for c in ("no", "p0"))
                p, c = (v.values.field(k).to_numpy() for k in ("p", "c")) if v.is_valid else (np.zeros(0, np.int64),) * 2
                many, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * p)])
                k = np.searchsorted(p, q0)
                apart = (q0 * many[k] - total[k]) + (total[-1] - total[k]) - q0 * (many[-1] - many[k])
                # what all terms add counts once for the pair, with its smaller source
                value = apart - many[-1] * np.abs(p0 - q0) + np.where(no < other, terms.as_py() * np.abs(p0 - q0), 0)
                keep = other != no
                out = [np.minimum(no, other)[keep], np.maximum(no, other)[keep], value[keep]]
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * int(keep.sum()), pa.string()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["lang", "a", "b", "value"])

    alone = rows.select("lang", "no", "p0", "v", "all", "terms").mapInArrow(run, "lang string, a int, b int, value long")
    lists = light.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "p0")).alias("l")).where(F.size("l") > 1)
    pairs = lists.select("lang", "l", F.explode("l").alias("x")).select("lang", "x", F.explode(F.filter("l", lambda y: y["no"] > F.col("x.no"))).alias("y"))
    far = lambda c, d: F.abs(F.col(c) - F.col(d))
    shared = pairs.select("lang", F.col("x.no").alias("a"), F.col("y.no").alias("b"), (far("x.p", "y.p") - far("x.p", "y.p0") - far("x.p0", "y.p") + far("x.p0", "y.p0")).alias("value"))
    return alone.unionByName(shared)


def divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: the other sources of the language by distance, farthest first; part
    `term`: the `top` kept terms that the source uses more than its language does."""
    found = _Language(docs)
    sums = heavy_sums(found.postings, found.sources, found.near).unionByName(light_sums(found.postings, found.sources, found.near))
    sums = stored(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "sums")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = found.sources.select("lang", "no", "source", "sources")
    pairs = name.select("lang", F.col("no").alias("a"), "source", F.explode(F.sequence(F.lit(0), F.col("sources").cast("int") - 1)).alias("b")).where("a <> b")
    item = name.select("lang", F.col("no").alias("b"), F.col("source").alias("item"))
    pairs = pairs.join(found.near(item), ["lang", "b"]).join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same over `documents` as SQL: every kept term of every source against every other source.
SQL = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{UP.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT a.*, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY a.lang, source) + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY a.lang, term) + 5)) // (sum(n) OVER (PARTITION BY a.lang) + 5 * v)::HUGEINT AS q FROM a JOIN v ON v.lang = a.lang),
s AS (SELECT y.lang, y.source, z.source AS item, sum(abs(y.p - z.p)) AS value FROM p y JOIN p z ON y.lang = z.lang AND y.term = z.term AND y.source <> z.source GROUP BY 1, 2, 3),
x AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM x UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}"""
