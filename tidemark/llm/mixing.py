"""Operator 8, mixing sources to target weights by nested hash thresholds.

A document's place in its source is a hash of its id and text (60 bits of an MD5). Words are summed by source and leading hash
bits; the bucket in which a source's budget falls is split by the next bits, and only that bucket, until it holds one hash. A
document is then in or out by comparing its hash with its source's threshold: no sort, no rank. Thresholds are nested:
a larger budget keeps all that a smaller one keeps, and the same rows give the same mix in any order.

A target of q whole sources and a rest repeats every document q times and those under the threshold once more.

Cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, last; rows with equal id and
text share a hash, and if the threshold falls on it, as many of them go in as bring the source nearest to its target; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import WORD, small, stored

WEIGHTS = (5, 2, 1)
REPEATS = 3
LEVEL_BITS = 12
LEVELS = 5
SOURCE_ROW_BYTES = 400


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(no, src, source_size, target) of each source of sizes(no, src, size); no: the source is null.

    Sources in code-point order take the weights in turn. A source is full at `repeats` times its size; the level
    (words per unit of weight) rises until no other source is above its limit. The state between rounds is one number.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("no", "src").agg(F.sum("size").alias("source_size")).orderBy("no", "src")
    ranked = sums.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[0][2], float(weights[x[1] % len(weights)])))
    kind = T.StructType([T.StructField("no", T.BooleanType()), T.StructField("src", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("w", T.DoubleType())])
    table = stored(spark.createDataFrame(ranked, kind).withColumn("limit", F.lit(float(repeats)) * F.col("source_size")), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    full = lambda level: F.col("w") * F.lit(level) > F.col("limit")
    level, before = 0.0, -1
    while True:
        row = table.agg(F.sum(F.when(~full(level), F.col("w"))).alias("w"), F.sum(F.when(full(level), F.col("limit"))).alias("used"), F.count_if(full(level)).alias("n")).first()
        if row.n == before or not row.w:
            break
        level, before = (total - float(row.used or 0)) / row.w, row.n
    return table.select("no", "src", "source_size", F.when(full(level), F.col("limit")).otherwise(F.col("w") * level).alias("target"))


def _thresholds(docs: DataFrame, weights: tuple[float, ...], repeats: int):
    """The plan of each source, and the function that tells a row's copies from its hash and its source's plan."""
    rows = stored(_sized(docs).select("no", "src", "size", "h"), "mix")
    targets = source_targets(rows, weights, repeats)
    n_sources = targets.count()
    near = lambda df: small(df, n_sources, SOURCE_ROW_BYTES)
    whole = F.least(F.lit(repeats).cast("long"), F.floor(F.col("target") / F.col("source_size") + 1e-9))
    plan = targets.withColumn("q", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)).cast("long"))
    plan = stored(plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("q") * F.col("source_size"))), "plan")

    edge = plan.select("no", "src", F.col("rest").alias("left"), F.lit(0).cast("long").alias("edge"))
    upto = Window.partitionBy("no", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    level = 0
    while level < LEVELS:
        level += 1
        inside = rows.where("size > 0").withColumn("parent", _prefix(level - 1)).join(near(edge.select("no", "src", "left", "edge")), ["no", "src"]).where("parent = edge")
        sums = inside.groupBy("no", "src", "left", _prefix(level).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        first = sums.withColumn("cum", F.sum("words").over(upto)).where("cum > left").groupBy("no", "src").agg(F.min_by(F.struct("bucket", "words", "cum", "left", "n"), "bucket").alias("b"))
        edge = stored(first.select("no", "src", (F.col("b.left") - F.col("b.cum") + F.col("b.words")).alias("left"), F.col("b.bucket").alias("edge"), F.col("b.words").alias("words"), F.col("b.n").alias("n")), "edge")
        if (edge.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    # of the last bucket as many rows go in as bring the source nearest to its target; without one (nothing left out) all do
    last = edge.select("no", "src", "edge", F.floor(F.col("left") * F.col("n") / F.col("words") + 0.5).alias("edge_in"))
    place = _prefix(level)
    more = F.when(F.col("q") >= repeats, 0).when(F.col("edge").isNull(), (F.col("rest") > 0).cast("int")).otherwise((place < F.col("edge")).cast("int"))
    on_edge = F.coalesce((F.col("q") < repeats) & (F.col("size") > 0) & (place == F.col("edge")), F.lit(False))
    return near(stored(plan.join(near(last), ["no", "src"], "left"), "plan")), F.col("q") + more, on_edge


def _taken(rows: DataFrame, plan: DataFrame, copies, on_edge) -> DataFrame:
    """rows (with the plan's columns) and `copies`. Rows on the edge are one hash: equal ones, which are counted, not ranked."""
    met = rows.join(plan, ["no", "src"]).withColumns({"copies": copies.cast("long"), "_on": on_edge})
    at = met.where("_on")
    columns = [c for c in met.columns if c != "_on"]
    same = at.groupBy(*columns).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("no", "src").orderBy(F.xxhash64(*columns)).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("edge_in") - F.coalesce(F.sum("_n").over(before), F.lit(0))
    each = same.withColumn("_in", inside).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    each = each.withColumn("copies", F.col("copies") + (F.col("_k") <= F.col("_in")).cast("long"))
    return met.where("not _on").select(*columns).unionByName(each.select(*columns))


def _prefix(level: int):
    return F.expr(f"shiftrightunsigned(h, {LEVEL_BITS * (LEVELS - level)})") if level else F.lit(0).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "no": F.col("source").isNull(),
            "src": F.coalesce("source", F.lit("")),
            "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "h": F.conv(F.left(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))), F.lit(LEVEL_BITS * LEVELS // 4)), 16, 10).cast("long"),
        }
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies (how often the document is taken)."""
    docs = docs.select("doc_id", "text", "source")
    plan, copies, on_edge = _thresholds(docs, weights, repeats)
    taken = _taken(_sized(docs).select("doc_id", "no", "src", "size", "h"), plan, copies, on_edge)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (not at all for 0)."""
    plan, copies, on_edge = _thresholds(docs.select("doc_id", "text", "source"), weights, repeats)
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    taken = _taken(_sized(row).select("row", "no", "src", "size", "h"), plan, copies, on_edge)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


#: The same as SQL, for the default weights and repeats: a cumulative sum in the order of hashes.
SQL = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), {LEVEL_BITS * LEVELS // 4}) AS BIGINT) AS h FROM documents),
s AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w, 3.0::DOUBLE * source_size AS most FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1)),
k AS (SELECT *, most / w AS full_at, coalesce(sum(most) OVER (ORDER BY most / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER (ORDER BY most / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total FROM s),
l AS (SELECT arg_min((total - used) / free, full_at) FILTER ((total - used) / free <= full_at) AS level FROM k),
t AS (SELECT source, source_size, CASE WHEN w * level > most OR level IS NULL THEN most ELSE w * level END AS target FROM s, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size + 1e-9) AS BIGINT)) ELSE 0 END AS q FROM t),
r AS (SELECT *, greatest(0, target - q * source_size) AS rest FROM q),
g AS (SELECT source, h, count(*) AS n, CAST(sum(size) AS BIGINT) AS words, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE size > 0 GROUP BY 1, 2),
m AS (SELECT g.source, h, CASE WHEN q >= 3 THEN 0 WHEN before + words <= rest THEN n WHEN before > rest THEN 0 ELSE floor((rest - before) * n / words + 0.5) END AS more FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
o AS (SELECT d.*, row_number() OVER (PARTITION BY source, h ORDER BY size) AS rn FROM d)
SELECT o.doc_id, o.size, r.source_size, r.target, CASE WHEN o.size > 0 THEN o.size * (q + CASE WHEN rn <= more THEN 1 ELSE 0 END) ELSE 0 END AS taken FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source LEFT JOIN m ON m.source IS NOT DISTINCT FROM o.source AND m.h = o.h"""
