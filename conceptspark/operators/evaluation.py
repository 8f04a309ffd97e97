"""Confusion, macro-F1, seeded confidence intervals, selection, paired deltas and complementarity.

Predictions are one long table: config columns, ``seed``, ``split``, ``transcript_id``, ``y``, ``yhat``. The first
aggregation reduces it to counts per class pair; everything later works on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.functions.stats import mcnemar_p, t_975

EFFECT_FLOOR = 0.01


def confusion_matrix(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per (true, predicted) with zero cells over all labels that occur under the keys."""
    counts = predictions.groupBy(*keys, "y", "yhat").agg(F.count("*").alias("n"))
    labels = (
        counts.select(*keys, F.explode(F.array("y", "yhat")).alias("_l"))
        .groupBy(*keys)
        .agg(F.collect_set("_l").alias("_labels"))
    )
    cells = labels.select(*keys, F.explode("_labels").alias("y"), "_labels").select(
        *keys, "y", F.explode("_labels").alias("yhat")
    )
    return cells.join(counts, [*keys, "y", "yhat"], "left").na.fill(0, ["n"])


def class_report(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs in truth or prediction; 0 on zero division."""
    counts = predictions.groupBy(*keys, "y", "yhat").agg(F.count("*").alias("n"))
    n = F.col("n")
    same = F.when(F.col("y") == F.col("yhat"), n).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    per_side = counts.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), n.alias("support"), zero.alias("predicted"), same.alias("hit")),
                F.struct(F.col("yhat").alias("label"), zero.alias("support"), n.alias("predicted"), zero.alias("hit")),
            )
        ).alias("_c"),
    ).select(*keys, "_c.*")
    summed = per_side.groupBy(*keys, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    hit, support, predicted = F.col("hit"), F.col("support"), F.col("predicted")
    return summed.select(
        *keys,
        "label",
        ratio(hit, predicted).alias("precision"),
        ratio(hit, support).alias("recall"),
        ratio(2 * hit, support + predicted).alias("f1"),
        "support",
    )


def macro_f1(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return class_report(predictions, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def _majority(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent label per keys, ties to the smallest."""
    counts = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("majority"))


def _majority_score(majority: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Macro-F1 of always answering ``majority`` on ``truth``: only that class scores above zero."""
    counts = truth.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    joined = counts.join(majority, keys)
    is_major = F.col("label") == F.col("majority")
    out = joined.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        F.sum(F.when(is_major, F.col("n")).otherwise(0)).alias("_hit"),
        (F.count("*") + F.when(F.max(is_major.cast("int")) == 1, 0).otherwise(1)).alias("_classes"),
    )
    return out.select(*keys, (2 * F.col("_hit") / (F.col("_n") + F.col("_hit")) / F.col("_classes")).alias("macro_f1"))


def chance_baseline(splits: DataFrame, kind: str = "train_majority") -> DataFrame:
    """Majority-class macro-F1: learnt on train and scored on test, or over the whole label set."""
    if kind == "train_majority":
        keys = ["target", "seed"]
        return _majority_score(
            _majority(splits.where("split = 'train'"), keys), splits.where("split = 'test'"), keys
        )
    if kind == "all_labels":
        return _majority_score(_majority(splits, ["target"]), splits, ["target"])
    raise ValueError(f"unknown chance baseline: {kind}")


def seed_ci(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and 95 % t interval over the seeds."""
    base = values.groupBy(*keys).agg(
        F.count(value).alias("n_seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    n = F.col("n_seeds")
    margin = t_975(n - 1) * F.col("std") / F.sqrt(n)
    return base.withColumns({"ci_low": F.col("mean") - margin, "ci_high": F.col("mean") + margin})


def run_summary(scores: DataFrame, config: list[str]) -> DataFrame:
    """Per configuration: mean validation and test score with the interval of the test score."""
    mean_val = scores.where("split = 'val'").groupBy(*config).agg(F.avg("macro_f1").alias("mean_val"))
    return seed_ci(scores.where("split = 'test'"), config, "macro_f1").join(mean_val, config)


def select_configs(summary: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Best configuration per keys by mean validation score."""
    w = W.partitionBy(*keys).orderBy(F.desc("mean_val"), *tie)
    return summary.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _passes(both_sides: bool) -> Column:
    excludes = F.col("ci_low") > 0
    if both_sides:
        excludes = excludes | (F.col("ci_high") < 0)
    return F.coalesce(excludes & (F.col("mean") >= EFFECT_FLOOR), F.lit(False))


def paired_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str = "macro_f1") -> DataFrame:
    """Interval of the per-seed difference a − b, with ``real_effect``."""
    left = a.select(*keys, "seed", F.col(value).alias("_a"))
    right = b.select(*keys, "seed", F.col(value).alias("_b"))
    deltas = left.join(right, [*keys, "seed"]).withColumn("delta", F.col("_a") - F.col("_b"))
    return seed_ci(deltas, keys, "delta").withColumn("real_effect", _passes(both_sides=True))


def verdict(intervals: DataFrame, both_sides: bool = True) -> DataFrame:
    """PASS when the interval excludes zero and the mean reaches the effect floor."""
    return intervals.withColumn("verdict", F.when(_passes(both_sides), "PASS").otherwise("FAIL"))


def paired_answers(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both predictions per example: ``y``, ``ok_a``, ``ok_b``."""
    left = a.select(*keys, "transcript_id", "y", (F.col("yhat") == F.col("y")).alias("ok_a"))
    right = b.select(*keys, "transcript_id", (F.col("yhat") == F.col("y")).alias("ok_b"))
    return left.join(right, [*keys, "transcript_id"])


def complementarity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline a against fusion b: who is right where, as counts and fractions."""
    ok_a, ok_b = F.col("ok_a"), F.col("ok_b")
    cells = paired_answers(a, b, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(ok_a & ok_b).alias("both_right"),
        F.count_if(~ok_a & ok_b).alias("only_fusion"),
        F.count_if(ok_a & ~ok_b).alias("only_baseline"),
        F.count_if(~ok_a & ~ok_b).alias("neither"),
    )
    return cells.withColumns(
        {
            "both_share": F.col("both_right") / F.col("n"),
            **{f"{c}_share": F.col(c) / F.col("n") for c in ("only_fusion", "only_baseline", "neither")},
        }
    )


def mcnemar_exact(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Exact McNemar test of the discordant answers."""
    cells = complementarity(a, b, keys).select(*keys, F.col("only_baseline").alias("b"), F.col("only_fusion").alias("c"))
    return cells.withColumn("p_value", mcnemar_p("b", "c"))


def class_accuracy_delta(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    pairs = paired_answers(a, b, keys).groupBy(*keys, "y").agg(
        F.count("*").alias("n"),
        F.avg(F.col("ok_a").cast("double")).alias("baseline_accuracy"),
        F.avg(F.col("ok_b").cast("double")).alias("fusion_accuracy"),
    )
    return pairs.withColumn("delta", F.col("fusion_accuracy") - F.col("baseline_accuracy"))


def complementarity_table(cells: DataFrame, scores: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """Cells beside the two scores, by fusion-only share descending."""
    config = ["target", "combo", "architecture"]
    own = scores.select(*config, F.col("macro_f1").alias("fusion_f1"))
    base = scores.where(F.col("combo") == baseline).select("target", "architecture", F.col("macro_f1").alias("baseline_f1"))
    return (
        cells.join(own, config)
        .join(base, ["target", "architecture"])
        .withColumn("f1_delta", F.col("fusion_f1") - F.col("baseline_f1"))
        .orderBy(F.desc("only_fusion_share"), *config)
    )


def complementarity_summary(table: DataFrame) -> DataFrame:
    """Mean shares and score difference per target and architecture."""
    columns = ["only_fusion_share", "only_baseline_share", "both_share", "f1_delta"]
    return table.groupBy("target", "architecture").agg(*[F.avg(c).alias(c) for c in columns])


def comparison_table(summary: DataFrame) -> DataFrame:
    return summary.orderBy("target", F.desc("mean"), "combo", "architecture")


def best_by_target(summary: DataFrame) -> DataFrame:
    """Configuration with the best mean test score per target."""
    ranked = F.struct(F.round("mean", 9), "combo", "architecture")
    return summary.groupBy("target").agg(
        F.max_by(F.struct("combo", "architecture", "mean"), ranked).alias("_best")
    ).select("target", "_best.*")


def gate_summary(table: DataFrame) -> DataFrame:
    """Per target: best baseline, best fusion with its fusion-only share, and the difference."""
    order = F.struct(F.round("fusion_f1", 9), "combo", "architecture")
    best = table.groupBy("target").agg(
        F.max("baseline_f1").alias("best_baseline"),
        F.max_by(F.struct("combo", "architecture", "fusion_f1", "only_fusion_share"), order).alias("_b"),
    )
    return best.select(
        "target",
        "best_baseline",
        F.col("_b.combo").alias("combo"),
        F.col("_b.architecture").alias("architecture"),
        F.col("_b.fusion_f1").alias("best_fusion"),
        F.col("_b.only_fusion_share").alias("only_fusion_share"),
        (F.col("_b.fusion_f1") - F.col("best_baseline")).alias("delta"),
    )


def ablation_summary(scores: DataFrame, chance: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Interval per variant, and paired deltas between variants or against ``chance``.

    ``scores`` is (target, variant, seed, macro_f1), ``chance`` the same without variant.
    """
    own = seed_ci(scores, ["target", "variant"], "macro_f1").select(
        "target", F.col("variant").alias("item"), "mean", "std", "ci_low", "ci_high", F.lit(None).cast("boolean").alias("real_effect")
    )
    base = chance.withColumn("variant", F.lit("chance")).select("target", "variant", "seed", "macro_f1")
    everything = scores.select("target", "variant", "seed", "macro_f1").unionByName(base)
    wide = F.array(
        *[
            F.struct(F.lit(name).alias("item"), F.lit(sign).alias("sign"), F.lit(variant).alias("of"))
            for name, sides in pairs.items()
            for sign, variant in zip((1.0, -1.0), sides)
        ]
    )
    # a seed's difference is the signed sum of its two scores; seeds lacking one side are left out
    deltas = (
        everything.select("*", F.explode(wide).alias("_p"))
        .where(F.col("_p.of") == F.col("variant"))
        .groupBy("target", "_p.item", "seed")
        .agg(F.sum(F.col("_p.sign") * F.col("macro_f1")).alias("delta"), F.count("*").alias("_sides"))
        .where("_sides = 2")
    )
    paired = seed_ci(deltas, ["target", "item"], "delta").withColumn("real_effect", _passes(True))
    return own.unionByName(paired.select(own.columns))
