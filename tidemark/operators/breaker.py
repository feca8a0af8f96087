"""A circuit breaker over calls: closed, open after a number of failures in a row, and one trial when its pause is over.

In batch a group's calls are cut into days. What a day does to the state is a small function of the state that it begins with: a value
for each number of failures so far, and one for each call of the day that could be the trial of a pause begun before. Days of
a group are composed in order (as many as the calendar has), and then each day is replayed from its own first state. So a group of
any size is spread over its days. A stream keeps the same state by group.

States are told as (failures, until): failures in a row while closed and until = null, or the end of the pause.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES, PAUSE = 5, 60.0
OUTCOME = "outcome string"


def _seconds(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")) / 1e6


def play(at: np.ndarray, failed: np.ndarray, state: tuple[int, float | None], most: int, pause: float) -> tuple[list[str], tuple[int, float | None]]:
    """The outcome of each call (ok, failed, rejected) in order, and the state after them."""
    run, until = state
    out = []
    for t, bad in zip(at.tolist(), failed.tolist(), strict=True):
        if until is not None and t < until:
            out.append("rejected")
            continue
        trial, until = until is not None, None
        run = 0 if not bad else run + 1
        if bad and (trial or run >= most):
            run, until = 0, t + pause
        out.append("failed" if bad else "ok")
    return out, (run, until)


def effects(at: np.ndarray, failed: np.ndarray, most: int, pause: float) -> tuple[list[tuple[int, float | None]], list[tuple[float, int, float | None]]]:
    """What a day does: the state after it for each number of failures before it; and for each call that could be the trial of a
    pause begun before, its time and the state after. From the last call backwards."""
    n = len(at)
    next_trial = np.searchsorted(at, at + pause, "left")
    closed = [(f, None) for f in range(most)]  # after the calls from the one looked at on
    trials: list[tuple[int, float | None]] = [(0, None)] * n
    for j in range(n - 1, -1, -1):
        k = int(next_trial[j])
        opened = trials[k] if k < n else (0, float(at[j]) + pause)
        if failed[j]:
            trials[j] = opened
            closed = [*closed[1:], opened]
        else:
            trials[j] = closed[0]
            closed = [closed[0]] * most
    could = int(np.searchsorted(at, at[0] + pause, "left")) + 1 if n else 0
    return closed, [(float(at[j]), *trials[j]) for j in range(min(could, n))]


def after(state: tuple[int, float | None], closed: list, trials: list) -> tuple[int, float | None]:
    """The state after a day with these effects."""
    run, until = state
    if until is None:
        return closed[run]
    return next(((r, u) for t, r, u in trials if t >= until), state)


def calls(events: DataFrame, by: str, time: str, failed: Column, order: list[str], most: int = FAILURES, pause: float = PAUSE) -> DataFrame:
    """events with `outcome`: ok, failed, or rejected while the breaker of their group `by` is open. Calls go by time, then `order`."""
    x = events.withColumns({"_bad": F.coalesce(failed, F.lit(False)), "_at": _seconds(time)}).withColumn("_day", F.floor(F.col("_at") / 86400))
    kind = x.schema[by].dataType.simpleString()

    def effect(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_at", *order])
        closed, trials = effects(rows["_at"].to_numpy(float), rows["_bad"].to_numpy(bool), most, pause)
        none = lambda u: float("nan") if u is None else u
        return pd.DataFrame({by: [key[0]], "_day": [key[1]], "closed": [[float(v) for r, u in closed for v in (r, none(u))]], "trials": [[float(v) for t, r, u in trials for v in (t, r, none(u))]]})

    days = x.select(by, "_day", "_at", "_bad", *order).groupBy(by, "_day").applyInPandas(effect, f"`{by}` {kind}, _day long, closed array<double>, trials array<double>")

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state: tuple[int, float | None] = (0, None)
        some = lambda u: None if np.isnan(u) else float(u)
        out = []
        for r in rows.sort_values("_day").itertuples():
            out.append((key[0], r[2], state[0], float("nan") if state[1] is None else state[1]))
            c, t = np.reshape(r.closed, (-1, 2)), np.reshape(r.trials, (-1, 3))
            state = after(state, [(int(a), some(b)) for a, b in c], [(float(a), int(b), some(e)) for a, b, e in t])
        return pd.DataFrame(out, columns=[by, "_day", "_run", "_until"])

    starts = days.groupBy(by).applyInPandas(compose, f"`{by}` {kind}, _day long, _run int, _until double")
    met = x.join(starts.withColumnsRenamed({by: "_by", "_day": "_of"}), F.col(by).eqNullSafe(F.col("_by")) & F.col("_day").eqNullSafe(F.col("_of"))).drop("_by", "_of")
    given = [f.name for f in events.schema]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + f", {OUTCOME}"

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_at", *order])
        until = rows["_until"].iloc[0]
        state = (int(rows["_run"].iloc[0]), None if pd.isna(until) else float(until))
        return rows[given].assign(outcome=play(rows["_at"].to_numpy(float), rows["_bad"].to_numpy(bool), state, most, pause)[0])

    return met.groupBy(by, "_day").applyInPandas(replay, shape)


def calls_stream(events: DataFrame, by: str, time: str, failed: Column, order: list[str], most: int = FAILURES, pause: float = PAUSE) -> DataFrame:
    """The same over a stream whose calls come in order of time from batch to batch: by, the columns `order`, outcome."""
    x = events.select(by, *order, _seconds(time).alias("_at"), F.coalesce(failed, F.lit(False)).alias("_bad"))
    shape = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in (by, *order)) + f", {OUTCOME}"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["_at", *order])
        before, until = state.get if state.exists else (0, None)
        out, now = play(rows["_at"].to_numpy(float), rows["_bad"].to_numpy(bool), (before, until), most, pause)
        state.update(now)
        yield rows[[by, *order]].assign(outcome=out)

    return x.groupBy(by).applyInPandasWithState(run, shape, "failures int, until double", "append", GroupStateTimeout.NoTimeout)
