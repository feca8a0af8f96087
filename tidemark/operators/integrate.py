"""Several sources of one series: quality scores, best source, priorities, averages and modes, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.returns import consistent

PRICES = ("open", "high", "low", "close")


def quality(panel: DataFrame) -> DataFrame:
    """ticker, source, n, issues (names), missing (share of empty price cells), score of 100 and what is taken off."""
    cells = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in PRICES), F.lit(0))
    unique = [F.try_divide(F.count_distinct(c), F.count("*")) for c in PRICES]
    bad_range = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    q = panel.groupBy("ticker", "source", "source_priority").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("high") < F.col("low")).alias("inverted"),
        F.count_if(bad_range).alias("outside"),
        F.count_if(F.least(*PRICES) <= 0).alias("nonpositive"),
        (F.sum(cells) / (4 * F.count("*"))).alias("missing"),
        (F.count("*") - F.count_distinct("date")).alias("repeated"),
        sum((F.when(u < 0.5, 1).otherwise(0) for u in unique), F.lit(0)).alias("flat"),
    )
    names = F.array_compact(F.array(F.when(F.col("inverted") > 0, "inverted"), F.when(F.col("outside") > 0, "outside"), F.when(F.col("nonpositive") > 0, "nonpositive"), F.when(F.col("missing") > 0.1, "missing"), F.when(F.col("repeated") > 0, "repeated")))
    q = q.withColumn("issues", names)
    return q.select("ticker", "source", "source_priority", "n", "issues", "missing", (100 - 10 * F.size("issues") - 50 * F.col("missing") - 20 * F.col("flat")).alias("score"))


def best_rows(panel: DataFrame) -> DataFrame:
    """Of each ticker and day the row of the best source: its score, and 10 more if the row is consistent; then priority."""
    scored = panel.join(quality(panel).select("ticker", "source", "score"), ["ticker", "source"])
    row = F.col("score") + F.when(F.coalesce(consistent(), F.lit(False)), 10).otherwise(0)
    w = Window.partitionBy("ticker", "date").orderBy(F.desc("row_score"), "source_priority")
    return scored.withColumn("row_score", row).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "score")


def by_priority(panel: DataFrame) -> DataFrame:
    """Each cell from the first source (by priority) that has it, on the days of the first source: one aggregate, no joins."""
    cell = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_priority")))
    out = panel.groupBy("ticker", "date").agg(*(cell(c).alias(c) for c in PRICES), F.min("source_priority").alias("first"))
    return out.where("first = 1").drop("first")


def averaged(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ticker", "date").agg(*(F.avg(c).alias(c) for c in PRICES), F.count("*").alias("sources"))


def voted(panel: DataFrame) -> DataFrame:
    """The most frequent value of each cell, the smallest of equally frequent ones."""
    return panel.groupBy("ticker", "date").agg(*(F.mode(c, True).alias(c) for c in PRICES))


def repaired(rows: DataFrame, version: str | None = None) -> DataFrame:
    """Repeated days removed (the last by `version` stays), high and low widened to hold open and close, short gaps filled
    forward, rows under half full dropped, and the adjusted close taken from the close where there is none."""
    if version:
        last = Window.partitionBy("ticker", "source", "date").orderBy(F.desc(version))
        rows = rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", version)
    rows = rows.withColumns({"high": F.greatest("open", "high", "close"), "low": F.least("open", "low", "close")})
    w = Window.partitionBy("ticker", "source").orderBy("date").rowsBetween(-5, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in PRICES})
    full = filled.where(sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in PRICES), F.lit(0)) >= 2)
    return full if "adj_close" in full.columns else full.withColumn("adj_close", F.col("close"))


def _by_day(events: DataFrame, by: str, order: list[str], back: bool, count) -> DataFrame:
    """events with _k: the running sum of `count` in order (or from the end), of a group of any size: day by day, and then days.

    Only a day of a group is ordered as a whole; the sums of days, which the calendar bounds, are carried over.
    """
    turn = F.desc if back else F.asc
    x = events.withColumns({"_day": F.to_date(order[0]), "_c": count})
    days = x.groupBy(by, "_day").agg(F.sum("_c").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(by).orderBy(turn("_day")).rowsBetween(Window.unboundedPreceding, -1))
    carried = days.select(F.col(by).alias("_by"), F.col("_day").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(by)).alias("_all"))
    inside = F.sum("_c").over(Window.partitionBy(by, "_day").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_in", inside).join(carried, F.col(by).eqNullSafe(F.col("_by")) & F.col("_day").eqNullSafe(F.col("_of")))
    return x.withColumn("_k", F.col("_before") + F.col("_in"))


def smoothed(events: DataFrame, by: str, value: str, order: list[str], alpha: float = 0.1) -> DataFrame:
    """Exponential average of each group's values in order (a time first), from weighted sums: the first value seeds it."""
    x = _by_day(events, by, order, True, F.lit(1).cast("long"))
    weight = F.pow(F.lit(1 - alpha), F.col("_k") - 1) * F.when(F.col("_k") == F.col("_all"), 1.0).otherwise(alpha)
    return x.groupBy(by).agg(F.sum(weight * F.col(value)).alias("ema"), F.count("*").alias("n"))


def longest_runs(events: DataFrame, by: str, failed, order: list[str]) -> DataFrame:
    """The longest run of consecutive failures of each group: islands numbered by a running count of successes."""
    x = _by_day(events.withColumn("_f", failed), by, order, False, F.when(F.col("_f"), 0).otherwise(1).cast("long"))
    runs = x.groupBy(by, "_k").agg(F.count_if("_f").alias("run"))
    return runs.groupBy(by).agg(F.max("run").alias("longest"))
