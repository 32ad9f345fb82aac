"""Dealing the rows of buckets into bounded units of work.

Rows that are alone in their bucket go first. The few buckets of more than BLOCK rows are
broadcast by name (their number is checked), so the rows of a hot bucket are never
joined or gathered by its key. Buckets of up to BLOCK rows go together, about UNIT rows
to a unit. A larger bucket is dealt into blocks by a hash of ``rep``, and every two
blocks of it meet in a unit of their own: so a task holds at most two blocks, however
hot a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK = 1_024
UNIT = 8_192
GROUP = ["t", "part", "i", "j"]
#: Names of hot buckets that are broadcast, at most; more are joined.
HOT = 100_000


def runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of equal neighbours."""
    cut = np.flatnonzero(np.diff(key)) + 1
    return list(zip([0, *cut], [*cut, len(key)], strict=True))


def shared(rows: DataFrame) -> DataFrame:
    """Rows (t, key, ...) that are not alone in their bucket, with ``bucket_n``, its size."""
    sizes = stored(rows.groupBy("t", "key").agg(F.count("*").alias("bucket_n")).where("bucket_n > 1"))
    hot = sizes.where(F.col("bucket_n") > BLOCK)
    if hot.limit(HOT + 1).count() > HOT:
        return rows.join(sizes, ["t", "key"])
    marked = rows.join(F.broadcast(hot), ["t", "key"], "left")
    cold = marked.where("bucket_n IS NULL").drop("bucket_n").join(sizes.where(F.col("bucket_n") <= BLOCK), ["t", "key"])
    return marked.where("bucket_n IS NOT NULL").unionByName(cold)


def dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``shared`` with their unit of work (t, part, i, j) and block: small buckets together, hot ones in pairs of blocks."""
    parts = F.lit(max(1, rows.count() // UNIT))
    small = rows.where(F.col("bucket_n") <= BLOCK).select("t", F.pmod(F.xxhash64("t", "key"), parts).alias("part"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "key", *columns)
    blocks = F.ceil(F.col("bucket_n") / BLOCK).cast("int")
    large = rows.where(F.col("bucket_n") > BLOCK).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.select("t", (-1 - F.abs(F.xxhash64("t", "key") % F.lit(1 << 62))).alias("part"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", *columns)
    return small.unionByName(large)


def pairs_of(bucket: np.ndarray, block: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of a unit sorted by bucket, the rows to compare: x with y (the same ones if i == j)."""
    for a, b in runs(bucket):
        if i == j:
            yield (np.arange(a, b),) * 2
        else:
            x, y = a + np.flatnonzero(block[a:b] == i), a + np.flatnonzero(block[a:b] == j)
            if len(x) and len(y):
                yield x, y
