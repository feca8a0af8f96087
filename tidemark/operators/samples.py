"""Tests of one sample against another: Kolmogorov-Smirnov, moments, Jarque-Bera, and the score made of them.

Samples are rows (sample, value). Which ones are compared is a small table of pairs (a, b); a sample's rows are
repeated once for each pair it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL = 0.05
TOLERANCE = 0.05
PASS = 0.7
TESTS_WEIGHT = 0.7
NEUTRAL = 0.5  # the bias part of the score where no third sample is given
LEAST_NORMAL = 20  # rows for a test of normality
RANGES = 4096
MOMENTS = ("mean", "variance", "skewness", "kurtosis")


def finite(df: DataFrame, sample: str, value: str) -> DataFrame:
    """sample, v of the rows whose value is a finite number."""
    v = F.col(value).cast("double")
    return df.select(F.col(sample).alias("sample"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def moments(values: DataFrame) -> DataFrame:
    """sample, n, mean, variance (n - 1), skewness and excess kurtosis (of the population)."""
    return values.groupBy("sample").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))


def kolmogorov(x: Column) -> Column:
    """The chance of a larger gap, from the limit distribution of sqrt(n m / (n + m)) times the gap."""
    sums = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sums)))


def largest_gap(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, ks, p_value: the largest distance of two samples' distributions.

    Equal values are counted first. The running counts of a pair are put together from ranges: counts by range are summed up
    from the lowest on (RANGES rows a pair), and only inside a range are values ordered. No task holds a sample.
    """
    counted = values.groupBy("sample", "v").agg(F.count("*").alias("c"))
    own = pairs.select(F.col("a").alias("sample"), "a", "b", F.lit(1).alias("first")).unionByName(pairs.select(F.col("b").alias("sample"), "a", "b", F.lit(0).alias("first")))
    x = counted.join(own, "sample").select("a", "b", "v", (F.col("c") * F.col("first")).alias("ca"), (F.col("c") * (1 - F.col("first"))).alias("cb"))
    ends = x.groupBy("a", "b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b")).where("n_a > 0 and n_b > 0")
    place = F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))
    x = x.join(ends, ["a", "b"]).withColumn("r", F.coalesce(place, F.lit(0)))
    below = Window.partitionBy("a", "b").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("a", "b", "r").agg(F.sum("ca").alias("sa"), F.sum("cb").alias("sb"))
    starts = starts.select("a", "b", "r", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("sa", "sb")))
    upto = Window.partitionBy("a", "b", "r").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    runs = x.join(starts, ["a", "b", "r"]).withColumns({"fa": F.col("sa") + F.sum("ca").over(upto), "fb": F.col("sb") + F.sum("cb").over(upto)})
    gap = runs.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(F.abs(F.col("fa") / F.col("n_a") - F.col("fb") / F.col("n_b"))).alias("ks"))
    scale = F.sqrt(F.col("n_a").cast("double") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return gap.withColumn("p_value", kolmogorov(scale * F.col("ks")))


def normality(m: DataFrame) -> DataFrame:
    """sample, n, statistic, p_value of Jarque and Bera's test, from `moments`; null under LEAST_NORMAL rows."""
    jb = F.when(F.col("n") >= LEAST_NORMAL, F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4))
    return m.select("sample", "n", jb.alias("statistic")).withColumn("p_value", F.exp(-F.col("statistic") / 2))


def bias_reduction(m: DataFrame, triples: DataFrame) -> DataFrame:
    """sample, metric, value, before, target, reduction (percent) and improvement (0 to 1) of triples(sample, original, target).

    How much nearer than the original a sample is to the target, for each moment and the ratio of mean to deviation.
    """
    ratio = F.when(F.col("variance") > 0, F.col("mean") / F.sqrt("variance")).otherwise(0.0)
    long = m.withColumn("sharpe_ratio", ratio).select("sample", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in (*MOMENTS, "sharpe_ratio")))).alias("r")).select("sample", "r.*")
    side = lambda name: long.select(F.col("sample").alias(f"_{name}"), F.col("metric").alias(f"_m{name}"), F.col("value").alias(f"_v{name}"))
    x = triples.join(long, "sample")
    for name in ("original", "target"):
        x = x.join(side(name), (F.col(name) == F.col(f"_{name}")) & (F.col("metric") == F.col(f"_m{name}")))
    far = lambda c: F.abs(F.col(c) - F.col("_vtarget"))
    x = x.withColumn("reduction", F.when(far("_voriginal") > 0, (far("_voriginal") - far("value")) / far("_voriginal") * 100).otherwise(0.0))
    return x.select("sample", "original", "target", "metric", "value", F.col("_voriginal").alias("before"), F.col("_vtarget").alias("wanted"), "reduction", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reduction") / 100)).alias("improvement"))


def compared(values: DataFrame, pairs: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """a, b, ks, ks_p, the relative difference of each moment of a from b's, jb, jb_p (of a), passed_tests, score, passed.

    A failed test counts by its p-value over LEVEL; that of a moment is 1 - difference. bias: (a, b, bias), the mean improvement.
    """
    m = moments(values)
    side = lambda name: m.select(F.col("sample").alias(name), *(F.col(k).alias(f"{k}_{name}") for k in MOMENTS))
    x = largest_gap(values, pairs).withColumnRenamed("p_value", "ks_p").join(side("a"), "a").join(side("b"), "b")
    x = x.join(normality(m).select(F.col("sample").alias("a"), F.col("statistic").alias("jb"), F.col("p_value").alias("jb_p")), "a")
    apart = lambda k: F.when(F.abs(f"{k}_b") > 1e-10, F.abs((F.col(f"{k}_a") - F.col(f"{k}_b")) / F.col(f"{k}_b"))).otherwise(F.abs(f"{k}_a"))
    x = x.withColumns({f"{k}_gap": apart(k) for k in MOMENTS})
    partly = lambda p: F.least(F.lit(1.0), F.coalesce(p, F.lit(0.0)) / LEVEL)
    passes = [F.coalesce(F.col(p) > LEVEL, F.lit(False)) for p in ("ks_p", "jb_p")] + [F.coalesce(F.col(f"{k}_gap") <= TOLERANCE, F.lit(False)) for k in MOMENTS]
    chances = [F.col("ks_p"), F.col("jb_p")] + [F.when(F.col(f"{k}_gap") <= 1, 1 - F.col(f"{k}_gap")).otherwise(0.0) for k in MOMENTS]
    total = sum((F.when(ok, 1.0).otherwise(partly(p)) for ok, p in zip(passes, chances, strict=True)), F.lit(0.0)) / len(passes)
    x = x.withColumns({"_tests": total, "passed_tests": sum((ok.cast("int") for ok in passes), F.lit(0))})
    if bias is not None:
        x = x.join(bias.select("a", "b", "bias"), ["a", "b"], "left")
    rest = F.coalesce(F.col("bias"), F.lit(NEUTRAL)) if bias is not None else F.lit(NEUTRAL)
    x = x.withColumn("score", TESTS_WEIGHT * F.col("_tests") + (1 - TESTS_WEIGHT) * rest)
    return x.select("a", "b", "n_a", "n_b", "ks", "ks_p", *(f"{k}_gap" for k in MOMENTS), "jb", "jb_p", "passed_tests", "score", (F.col("score") >= PASS).alias("passed"))
