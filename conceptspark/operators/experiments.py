"""Experiment grid, class weights and the worklist of experiments still to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptspark.functions.vocabulary import (
    CLASSICAL_ARCHITECTURES,
    MODALITY_COMBOS,
    NEURAL_ARCHITECTURES,
    TARGETS,
)

GRID_SCHEMA = "tag string, target string, combo string, architecture string, backend string"


def experiment_grid(spark: SparkSession) -> DataFrame:
    """Targets by modality combinations by architectures; ``single`` takes one modality only."""
    single = F.size(F.split("combo", "-")) == 1
    literal = lambda names: F.explode(F.array(*[F.lit(n) for n in names]))
    backends = F.explode(
        F.array(
            F.struct(F.lit("neural").alias("backend"), F.array(*[F.lit(a) for a in NEURAL_ARCHITECTURES]).alias("archs")),
            F.struct(F.lit("classical").alias("backend"), F.array(*[F.lit(a) for a in CLASSICAL_ARCHITECTURES]).alias("archs")),
        )
    )
    grid = (
        spark.range(1)
        .select(literal(TARGETS).alias("target"))
        .select("target", literal(MODALITY_COMBOS).alias("combo"))
        .select("target", "combo", backends.alias("_b"))
        .select("target", "combo", "_b.backend", F.explode("_b.archs").alias("architecture"))
        .where((F.col("architecture") != "single") | single)
    )
    return grid.select(
        F.concat_ws("_", "target", "backend", "architecture", "combo").alias("tag"),
        "target",
        "combo",
        "architecture",
        "backend",
    )


def sized_grid(grid: DataFrame, splits: DataFrame) -> DataFrame:
    """The grid with the number of examples each experiment would train, validate and test on."""
    sizes = splits.groupBy("target").agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")]
    )
    return grid.join(sizes, "target")


def pending_experiments(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Grid rows without a result. A failed experiment counts as done through its error row."""
    return grid.join(done.select("tag"), "tag", "left_anti")


def grid_counts(grid: DataFrame) -> DataFrame:
    return grid.groupBy("target", "backend").agg(F.count("*").alias("n"))


def class_weights(train: DataFrame, n_classes: dict[str, int] | None = None) -> DataFrame:
    """n / (k · count) per class, from train rows (target, label) only.

    ``n_classes`` names k for targets some of whose classes may be absent from ``train``; else k counts the classes present.
    """
    counts = train.groupBy("target", "label").agg(F.count("*").alias("n"))
    totals = counts.groupBy("target").agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    k = F.col("_k")
    for target, number in (n_classes or {}).items():
        k = F.when(F.col("target") == target, F.lit(number)).otherwise(k)
    return counts.join(totals, "target").select(
        "target", "label", "n", (F.col("_n") / (k * F.greatest(F.col("n"), F.lit(1)))).alias("weight")
    )
