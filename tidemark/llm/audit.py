"""Operator 11, filter interaction audit: what five filters remove alone, together and in every order.

Each document gets a mask of the filters it fails. Four bits are read off its text; the fifth, a duplicate of a smaller id, comes
from partition refinement:
1. One pass over the texts gives each its length and the hashes of its successive blocks (64 code points, then up to 256, 1,024, ...).
   Documents of one length are a class; classes of one document are dropped.
2. Round by round a class splits by the next block's hash, and classes of one document are dropped, until no text has blocks left. The rounds
   read the narrow table of hashes, of which few rows are left after the first ones.
3. The texts of the classes that survive are compared in full: grouped by class and text, combined before they are dealt.
   Ids above their text's smallest are duplicates.
Then documents are counted by part and mask (32 rows a part at most), and all orders are sums over these counts.

Cases: null text is empty (fails A only, unless it is a duplicate: 0 words are not under 80 percent distinct); empty texts are
equal to each other; a null id has no smaller one and is smaller than none; repeated rows have one id, so none is a duplicate of the
other; null and empty lang are one part; a document is good or toxic if any of its label rows says so; an empty table has no parts; other
columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

FILTERS = "ABCDE"
BLOCK = 64
GROWTH_BITS = 2  # each block ends at four times the length of the one before
STEPS = "array<struct<filter_order:string,step:int,bit:int,before:int>>"


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    chars = F.length(text)
    tests = (n < 100, 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"), 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * chars.cast("long"), text.rlike(r"[#$%&*|]"))
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def block_hashes(text: str, chars: str) -> Column:
    """The hashes of a text's successive blocks, all of it."""
    start = f"if(k = 0, 0, shiftleft({BLOCK}, {GROWTH_BITS} * (k - 1)))"
    ends = f"shiftleft({BLOCK}, {GROWTH_BITS} * k)"
    last = f"greatest(0, cast(ceil(log2(greatest({chars}, 1) / {BLOCK}D) / {GROWTH_BITS}D) as int))"
    return F.expr(f"transform(sequence(0, {last}), k -> xxhash64(substring({text}, {start} + 1, {ends} - {start})))")


def _split(key: Column, block: Column) -> Column:
    return F.xxhash64(key, block)


def refined(classes: DataFrame) -> DataFrame:
    """The final keys of classes(chars, blocks) that hold two rows and more, by refinement; a table of keys."""
    now = stored(classes.select(F.xxhash64("chars").alias("key"), F.col("blocks").alias("left")), "classes")
    rounds = now.agg(F.max(F.size("left"))).first()[0] or 0
    for k in range(rounds + 1):
        many = now.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        rest = now.join(many, "key", "left_semi")
        if k < rounds:  # texts of one length have the same number of blocks: a class is at its end as a whole
            step = F.when(F.size("left") > 0, _split(F.col("key"), F.element_at("left", 1))).otherwise(F.col("key"))
            rest = rest.select(step.alias("key"), F.when(F.size("left") > 0, F.slice("left", 2, F.greatest(F.size("left") - 1, F.lit(0)))).otherwise(F.col("left")).alias("left"))
        after = stored(rest, "classes")
        forget(now)
        now = after
        if now.isEmpty():
            break
    out = stored(now.select("key").distinct(), "survivors")
    forget(now)
    return out


def _key() -> Column:
    """The class a text ends in when no block is left."""
    return F.aggregate("blocks", F.xxhash64("chars"), _split)


def profiled(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D, chars, blocks and key of every document, and its text."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chars", F.length("text"))
    return rows.withColumn("blocks", block_hashes("text", "chars")).withColumn("key", _key())


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every document."""
    docs = docs.select("doc_id", "text", "lang")
    rows = profiled(docs)
    profile = stored(rows.select("doc_id", "part", failures(F.col("text")).alias("mask"), "chars", "blocks", "key"), "profile")
    survivors = refined(profile.select("chars", "blocks"))
    full = rows.select("doc_id", "part", "key", "text").join(survivors, "key", "left_semi")
    groups = stored(full.groupBy("key", "text").agg(F.min("doc_id").alias("first_id")), "groups")
    shared = stored(groups.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "shared")
    again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    every = profile.select("doc_id", "part", "mask", "key")
    if shared.isEmpty():
        met = every.join(groups.select("key", "first_id"), "key", "left")
        return met.select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    # classes that hold several texts after all (equal hashes): by the texts themselves
    met = every.join(shared, "key", "left_anti").join(groups.join(shared, "key", "left_anti").select("key", "first_id"), "key", "left")
    several = full.join(shared, "key", "left_semi").join(groups.select("key", "text", "first_id"), ["key", "text"]).withColumn("mask", failures(F.col("text")))
    return met.select("doc_id", "part", (F.col("mask") + again).alias("mask")).unionByName(several.select("doc_id", "part", (F.col("mask") + again).alias("mask")))


def mask_counts(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail."""
    known = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return marked.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def orders() -> str:
    """All orders of the filters and their steps, as JSON: the step's bit, and the bits before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append({"filter_order": "".join(order), "step": k + 1, "bit": bit, "before": before})
            before |= bit
    return json.dumps(out)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step; kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: see the contract of operator 11."""
    counts = stored(mask_counts(masks(docs), labels), "masks")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 at most
    steps = parts.withColumn("s", F.explode(F.from_json(F.lit(orders()), STEPS))).select("part", "m", "s.*")
    total = lambda what, test: F.expr(f"aggregate(filter(m, x -> {test}), 0L, (t, x) -> t + x.{what})")
    here = "(x.mask & before) = 0 and (x.mask & bit) <> 0"
    out = steps.select(
        "part", "filter_order", "step", "bit",
        total("n", "(x.mask & (before | bit)) = 0").alias("kept"),
        total("n", here).alias("removed"),
        total("n", "(x.mask & bit) <> 0 and (x.mask & before) <> 0").alias("redundant"),
        total("n", "x.mask = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    shares = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "bit"]).drop("bit")


#: The same over `documents` and `labels` as SQL, every document in every order.
SQL = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY 1, 2),
o(o) AS (SELECT '' UNION ALL SELECT o || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(o, c)),
s AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[k] AS filter, list_transform(range(1, k), lambda i: instr('ABCDE', o[i])) AS before, instr('ABCDE', o[k]) AS own FROM (SELECT o FROM o WHERE length(o) = 5), range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, filter, n, good, toxic, fails[own] AS fails_it, len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS many FROM m, s),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_it), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails_it), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails_it AND many = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails_it), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_it), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (filter), sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r"""
