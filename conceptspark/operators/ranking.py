"""Exact ranks and running totals that never sort one whole group in a single task.

Every helper splits a group into ordered buckets, ranks inside a bucket, and adds the size of the buckets
before it. A group holding a third of all rows is thus spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.operators.joins import join_counted
from conceptspark.session import cut_lineage


def hash_order(seed, key) -> Column:
    """Reproducible pseudo-random order: the md5 of ``seed|key``."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string") if not isinstance(seed, Column) else seed.cast("string"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def _with_offset(df: DataFrame, keys: list[str], bucket: str, weight: Column) -> DataFrame:
    """Attach ``_before``: the weight of all earlier buckets of the same keys (bounded bucket table).

    The bucket table is dealt by keys and bucket before the join. It lies by keys after its window, and where a session lets joins follow
    part of their keys (``fixtures.CO_PARTITION``) all rows of a key would be moved to it, into one task.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("_w"))
    w = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, bucket, F.coalesce(F.sum("_w").over(w), F.lit(0)).alias("_before"))
    return df.join(offsets.repartition(*keys, bucket), [*keys, bucket])


def rank_by_hash(df: DataFrame, keys: list[str], order: str, name: str = "rank", tie: str | None = None) -> DataFrame:
    """1-based position inside ``keys`` by an md5 column ``order``; 4096 buckets of its first three digits."""
    bucketed = df.withColumn("_bucket", F.substring(order, 1, 3))
    inner = W.partitionBy(*keys, "_bucket").orderBy(order, *([tie] if tie else []))
    return (
        _with_offset(bucketed, keys, "_bucket", F.lit(1))
        .withColumn(name, F.row_number().over(inner) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_bucket``: ranges of ``order`` taken from the data, which also splits a hot key and a narrow span of values.

    The rows are written once, so that the bucket of a row stays fixed when tasks are retried.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()))


def running_total(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Inclusive running sum of ``weight`` by ascending ``value``; one row per (keys, value), rows of a NULL value go."""
    ranged = _ranged(df.where(F.col(value).isNotNull()), [*keys, value])
    inner = W.partitionBy("_bucket", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        _with_offset(ranged, keys, "_bucket", F.col(weight))
        .withColumn(name, F.sum(weight).over(inner) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def rank_by_range(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """1-based position inside ``keys`` for any sortable ``order``."""
    ranged = _ranged(df, [*keys, *order])
    inner = W.partitionBy("_bucket", *keys).orderBy(*order)
    return (
        _with_offset(ranged, keys, "_bucket", F.lit(1))
        .withColumn(name, F.row_number().over(inner) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): exact median of the non-null values, the mean of both middle ones for an even number.

    Values are counted map-side; the middle places are then found in running totals over ranges of the distinct values, so that no
    task holds the values of a whole group. Groups without a value have no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ends = running_total(counts, keys, "_v", "_n", "_end")
    sizes = ends.groupBy(*keys).agg(F.max("_end").alias("_size"))
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    held = lambda place: (F.col("_end") >= place) & (F.col("_end") - F.col("_n") < place)
    placed = join_counted(ends, sizes, keys).where(held(low) | held(high))
    ours = lambda place: F.max(F.when(held(place), F.col("_v").cast("double")))
    return placed.groupBy(*keys).agg(((ours(low) + ours(high)) / 2).alias(name))


def consecutive_pairs(df: DataFrame, keys: list[str], order: str, before: str, width: int = 4096) -> DataFrame:
    """(keys, before, order) for every value of the integer column ``order`` that has a predecessor in ``keys``.

    Neighbours inside a bucket come from a window over the bucket, neighbours across buckets from the
    first and last value of the buckets; duplicates of (keys, order) are allowed.
    """
    bucketed = df.select(*keys, order, F.floor(F.col(order) / width).alias("_bucket"))
    inner = W.partitionBy(*keys, "_bucket").orderBy(order)
    inside = bucketed.distinct().select(*keys, F.lag(order).over(inner).alias(before), order)
    edges = bucketed.groupBy(*keys, "_bucket").agg(F.min(order).alias(order), F.max(order).alias("_last"))
    outer = W.partitionBy(*keys).orderBy("_bucket")
    across = edges.select(*keys, F.lag("_last").over(outer).alias(before), order)
    return inside.unionByName(across).where(F.col(before).isNotNull())
