"""Leak-free stratified splits, reproducible on any engine that has md5."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.operators.joins import join_counted
from conceptspark.operators.ranking import hash_order, rank_by_hash


def _share_out(table: DataFrame, total: str, part: str, whole: str, name: str) -> DataFrame:
    """Split ``total`` over the classes in proportion part/whole by largest remainder, ties to the smaller label.

    ``table`` has one row per (target, class); products use decimals so that they cannot overflow.
    """
    product = f"CAST({total} AS DECIMAL(18,0)) * CAST({part} AS DECIMAL(18,0))"
    floor = F.expr(f"CASE WHEN {whole} > 0 THEN {product} div CAST({whole} AS DECIMAL(18,0)) ELSE 0 END")
    rest = F.expr(f"CASE WHEN {whole} > 0 THEN {product} % CAST({whole} AS DECIMAL(18,0)) ELSE 0 END")
    per_target = W.partitionBy("target")
    ranked = table.withColumn("_floor", floor.cast("long")).withColumn("_rest", rest)
    place = F.row_number().over(per_target.orderBy(F.desc("_rest"), "label"))
    missing = F.col(total) - F.sum("_floor").over(per_target)
    extra = F.when(place <= missing, 1).otherwise(0)
    return ranked.withColumn(name, F.col("_floor") + extra).drop("_floor", "_rest")


def class_quotas(labels: DataFrame) -> DataFrame:
    """Per (target, label): rows, and how many of them go to train and val (70/15/15 in two stages)."""
    per_class = labels.groupBy("target", "label").agg(F.count("*").alias("n_k"))
    sized = (
        per_class.withColumn("n", F.sum("n_k").over(W.partitionBy("target")))
        .withColumn("n_train", F.expr("(7 * n) div 10"))
        .withColumn("n_rest", F.col("n") - F.col("n_train"))
        .withColumn("n_val", F.expr("n_rest div 2"))
    )
    trained = _share_out(sized, "n_train", "n_k", "n", "train_k").withColumn("rest_k", F.col("n_k") - F.col("train_k"))
    return _share_out(trained, "n_val", "rest_k", "n_rest", "val_k")


def repeated_splits(labels: DataFrame, seeds: list[int]) -> DataFrame:
    """(target, seed, transcript_id, label, split) for every seed, from (target, transcript_id, label).

    The order inside a class is md5 of seed and id; positions are counted over hash buckets, so a class
    holding most of the rows is ranked by many tasks.
    """
    seeded = labels.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    keyed = seeded.withColumn("_order", hash_order(F.col("seed"), "transcript_id"))
    ranked = rank_by_hash(keyed, ["target", "seed", "label"], "_order", "_rank", tie="transcript_id")
    quotas = class_quotas(labels).select("target", "label", "train_k", "val_k")
    split = (
        F.when(F.col("_rank") <= F.col("train_k"), "train")
        .when(F.col("_rank") <= F.col("train_k") + F.col("val_k"), "val")
        .otherwise("test")
    )
    return join_counted(ranked, quotas, ["target", "label"]).select(
        "target", "seed", "transcript_id", "label", split.alias("split")
    )


def stratified_split(labels: DataFrame, seed: int = 42) -> DataFrame:
    return repeated_splits(labels, [seed])


def restrict_split(splits: DataFrame, labelled: DataFrame) -> DataFrame:
    """Members of a split that also have a label for another target."""
    return splits.join(labelled.select("transcript_id"), "transcript_id", "left_semi")


def split_metadata(splits: DataFrame) -> DataFrame:
    return splits.groupBy("target", "seed", "split", "label").agg(F.count("*").alias("n"))


def split_leakage(splits: DataFrame, labels: DataFrame) -> DataFrame:
    """Per target and seed: ids found in more than one split, and labelled ids in none."""
    placed = splits.groupBy("target", "seed", "transcript_id").agg(
        F.min("split").alias("_lo"), F.max("split").alias("_hi")
    )
    known = labels.select("target", "transcript_id").distinct()
    expected = known.groupBy("target").agg(F.count("*").alias("_expected"))
    seen = (
        placed.join(known.withColumn("_known", F.lit(1)), ["target", "transcript_id"], "left")
        .groupBy("target", "seed")
        .agg(F.count("_known").alias("_found"), F.count_if(F.col("_lo") != F.col("_hi")).alias("n_leaked"))
    )
    return seen.join(expected, "target").select(
        "target", "seed", "n_leaked", (F.col("_expected") - F.col("_found")).alias("n_unplaced")
    )


def holdout(ids: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Mark ceil(fraction·n) ids, the first in hash order, as ``held_out``."""
    keyed = ids.withColumn("_order", hash_order(seed, "transcript_id"))
    ranked = rank_by_hash(keyed, [], "_order", "_rank", tie="transcript_id")
    wanted = math.ceil(ids.count() * fraction)
    return ranked.withColumn("held_out", F.col("_rank") <= wanted).drop("_order", "_rank")
