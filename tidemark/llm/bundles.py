"""Texts packed some megabytes at a time, so that they move compressed and are read in a few array passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored
from .words import chunks, raw


def pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unpack(z: bytes, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), kind)


def bundled(docs: DataFrame, size: int) -> DataFrame:
    """bundle, z (packed bytes), ends (of the texts in them), rest (the other columns of each text), as a stored table.

    A bundle has about `size` bytes of text, or one longer text. Its number is fixed once stored.
    """
    rest = [c for c in docs.columns if c != "text"]
    given = docs.select("text", F.struct(*rest).alias("rest"))
    kind = given.schema["rest"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for at, to in chunks(column, size):
                body, ends = raw(column.slice(at, to - at))
                rows = batch.column("rest").slice(at, to - at)
                yield pa.RecordBatch.from_arrays([pa.array([pack(body)], pa.binary()), pa.array([ends], pa.list_(pa.int64())), pa.ListArray.from_arrays([0, to - at], pa.concat_arrays([rows]))], ["z", "ends", "rest"])

    packed = given.mapInArrow(run, f"z binary, ends array<long>, rest array<{kind}>")
    return stored(packed.withColumn("bundle", F.monotonically_increasing_id()), "bundles")


def beside(bundles: DataFrame, more: DataFrame, columns: list[str]) -> DataFrame:
    """Each bundle's row (kind 0), and after it the rows of `more` for it (kind 1), together in one partition."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    own = [c for c in bundles.columns if c != "bundle"]
    left = bundles.select("bundle", F.lit(0).alias("kind"), *own, *(none(more, c) for c in columns))
    right = more.select("bundle", F.lit(1).alias("kind"), *(none(bundles, c) for c in own), *columns)
    return left.unionByName(right).repartition("bundle").sortWithinPartitions("bundle", "kind")
