"""BM25 as columns, with the single-precision steps that make scores reproducible bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
DECAY_FLOOR, HALF_LIFE_DAYS = 0.25, 45.0


def idf(n: Column, df: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.log(1 + (n - df + 0.5) / (df + 0.5)).cast("float")


def saturation(tf: Column, length: Column, average: Column) -> Column:
    """0 where the average length is not positive."""
    tf = tf.cast("double")
    return F.when(average > 0, tf / (K1 * ((1 - B) + B * length.cast("double") / average) + tf)).otherwise(0.0).cast("float")


def share(tf: Column, length: Column, average: Column, n: Column, df: Column) -> Column:
    """One occurrence's part of a score in single precision, the same for every query."""
    return (idf(n, df).cast("double") * saturation(tf, length, average).cast("double")).cast("float")


def weighted(one: Column, weight: Column) -> Column:
    """A share times its term's weight in a query: a product of floats, as a double for the sum."""
    return (one * weight.cast("float")).cast("float").cast("double")


def ranker_idf(n: Column, df: Column) -> Column:
    """Double precision; 1 for a term that no document has."""
    n, df = n.cast("double"), df.cast("double")
    return F.coalesce(F.log(1 + (n - df + 0.5) / (df + 0.5)), F.lit(1.0))


def temporal_factor(timestamp: Column, now: str, exact: Column, literal: Column) -> Column:
    """0.25 + 0.75 * 2^(-age in days / 45), age in whole seconds and not negative; its root with a literal match; 1 if exact or undated."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(timestamp)) / F.lit(86400.0))
    decay = DECAY_FLOOR + (1 - DECAY_FLOOR) * F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS)
    return F.when(exact | timestamp.isNull(), 1.0).when(literal, F.sqrt(decay)).otherwise(decay)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """sum(min) / (sum(a) + sum(b) - sum(min)) of two maps term -> weight; 0 for two empty maps."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    both = total(F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)))))
    union = total(a) + total(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)
