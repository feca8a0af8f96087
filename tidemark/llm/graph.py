"""Connected components of large graphs, and whole groups of rows inside partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(u, v): the smallest node of its component.

    Each round a node takes the smallest of itself and its neighbours, and then what that one took, so that long paths shrink by
    halves; edges are then those between what was taken, once each, so that a round meets only what the ones before have not
    joined. Rounds end when no edge is left; each is a table in the shared folder. Minima combine map-side. What was taken is
    broadcast while it is small; beyond that the join of a hub's edges is split as a skewed one at run time.
    """
    links = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    labels = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("low")), "lows")
        n = low.count()
        step = stored(low.join(small(low.select(F.col("node").alias("low"), F.col("low").alias("label")), n, 16), "low").select("node", "label"), "labels")
        if labels is None:
            after = step
        else:
            after = stored(labels.join(small(step.select(F.col("node").alias("label"), F.col("label").alias("top")), n, 16), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        at = lambda c: small(step.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), n, 16)
        met = links.join(at("u"), "u").join(at("v"), "v").where("_u <> _v")
        left = stored(met.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct(), "links")
        forget(low, links)
        if labels is not None:
            forget(labels, step)
        if left.isEmpty():
            forget(left)
            return after
        links, labels = left, after


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The record batches of a partition sorted by keys, cut anew so that no group is split; several groups share one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        new = np.zeros(n, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
            if held and c[0] != held[-1].column(k)[held[-1].num_rows - 1].as_py():
                new[0] = True
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, cuts[0])] if cuts[0] else held
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if cuts[-1] > cuts[0]:
            yield batch.slice(cuts[0], cuts[-1] - cuts[0])
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bounds(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where each group of a batch sorted by keys begins, and the end."""
    new = np.zeros(batch.num_rows + 1, bool)
    new[0] = new[-1] = True
    for k in keys:
        c = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
