"""Splits, experiment bookkeeping and the statistical protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.fixtures import SEEDS
from conceptspark.operators import evaluation, experiments, splits
from conceptspark.plans.features import rounded
from conceptspark.plans.registry import query
from conceptspark.session import cut_lineage

CONFIG = ["target", "combo", "architecture"]
T9 = "2.262157162798"


@query(
    "d01_stratified_split",
    "SELECT target, seed, transcript_id, label, split FROM fx_splits WHERE seed = 42 AND target = 'cohort'",
)
def _(c):
    return splits.stratified_split(c.target_labels.where("target = 'cohort'"), 42)


@query("d02_repeated_splits", "SELECT target, seed, transcript_id, label, split FROM fx_splits")
def _(c):
    return splits.repeated_splits(c.target_labels, SEEDS)


@query(
    "d03_restrict_split",
    """SELECT transcript_id, target, seed, label, split FROM fx_splits WHERE target = 'cohort' AND transcript_id IN
        (SELECT transcript_id FROM fx_adoption WHERE label IN ('tool_user', 'integrated'))""",
)
def _(c):
    adoption = c.target_labels.where("target = 'ai_adoption'")
    return splits.restrict_split(c.splits.where("target = 'cohort'"), adoption)


@query(
    "d04_split_by_own_label",
    "SELECT target, seed, transcript_id, label, split FROM fx_splits WHERE seed = 42 AND target = 'stance_ambivalence'",
)
def _(c):
    return splits.stratified_split(c.target_labels.where("target = 'stance_ambivalence'"), 42)


@query("d05_split_metadata", "SELECT target, seed, split, label, count(*) AS n FROM fx_splits GROUP BY ALL")
def _(c):
    return splits.split_metadata(c.splits)


@query(
    "d06_split_leakage",
    """SELECT s.target, s.seed, count(*) FILTER (k > 1) AS n_leaked,
        max(n_all) - count(DISTINCT transcript_id) AS n_unplaced
    FROM (SELECT target, seed, transcript_id, count(DISTINCT split) AS k FROM fx_splits GROUP BY ALL) s
    JOIN (SELECT target, count(DISTINCT transcript_id) AS n_all FROM fx_target_labels GROUP BY 1) USING (target)
    GROUP BY ALL""",
)
def _(c):
    return splits.split_leakage(c.splits, c.target_labels)


@query(
    "d08_holdout",
    """SELECT graph_id AS transcript_id, rn <= ceil(n * 0.1) AS held_out FROM (
        SELECT graph_id, row_number() OVER (ORDER BY md5(concat('42|', graph_id)), graph_id) AS rn, count(*) OVER () AS n
        FROM fx_graphs)""",
)
def _(c):
    return splits.holdout(c.graphs.select(F.col("graph_id").alias("transcript_id")))


# experiments


@query(
    "m09_class_weights",
    """SELECT target, label, n, round(sum(n) OVER (PARTITION BY target) / (count(*) OVER (PARTITION BY target) * n), 6) AS weight
    FROM (SELECT target, label, count(*) AS n FROM fx_splits WHERE seed = 42 AND split = 'train' GROUP BY ALL)""",
)
def _(c):
    train = splits.stratified_split(c.target_labels, 42).where("split = 'train'")
    return rounded(experiments.class_weights(train))


GRID = {
    "fx_grid": """
        SELECT concat_ws('_', target, backend, architecture, combo) AS tag, target, combo, architecture, backend
        FROM (SELECT unnest(['ai_adoption', 'cohort', 'stance_ambivalence']) AS target)
        CROSS JOIN (SELECT unnest(['text', 'stats', 'graph', 'text-stats', 'text-graph', 'text-stats-graph']) AS combo)
        CROSS JOIN (SELECT unnest(['single', 'stacked', 'gated', 'late']) AS architecture, 'neural' AS backend
            UNION ALL SELECT unnest(['logistic', 'random_forest', 'gradient_boost', 'svm']), 'classical')
        WHERE architecture <> 'single' OR combo NOT LIKE '%-%'""",
    "fx_grid_sizes": """
        SELECT target, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
            count(*) FILTER (split = 'test') AS n_test FROM fx_splits WHERE seed = 42 GROUP BY 1""",
}


def finished_tags(c):
    """Tags of the grid that the predictions of the single sweep's seed answer already."""
    backend = F.when(F.col("architecture") == "stacked", "neural").otherwise("classical")
    tag = F.concat_ws("_", "target", backend, "architecture", "combo").alias("tag")
    return c.predictions_of([42]).select(tag).distinct()


@query("m10_experiment_grid", "SELECT * FROM fx_grid JOIN fx_grid_sizes USING (target)", GRID)
def _(c):
    grid = experiments.experiment_grid(c.spark)
    return experiments.sized_grid(grid, splits.stratified_split(c.target_labels, 42))


@query(
    "m11_pending_experiments",
    """SELECT * FROM fx_grid WHERE tag NOT IN (
        SELECT concat_ws('_', target, CASE architecture WHEN 'stacked' THEN 'neural' ELSE 'classical' END, architecture, combo)
        FROM fx_predictions WHERE seed = 42)""",
    GRID,
)
def _(c):
    return experiments.pending_experiments(experiments.experiment_grid(c.spark), finished_tags(c))


@query(
    "x20_grid_counts",
    """SELECT target, backend, count(*) AS n, CAST(sum(n_train) AS BIGINT) AS n_train FROM fx_grid
    JOIN fx_grid_sizes USING (target) GROUP BY ALL""",
    GRID,
)
def _(c):
    grid = experiments.sized_grid(experiments.experiment_grid(c.spark), splits.stratified_split(c.target_labels, 42))
    totals = grid.groupBy("target", "backend").agg(F.sum("n_train").alias("n_train"))
    return experiments.grid_counts(grid).join(totals, ["target", "backend"])


# protocol

SCORES = {
    "fx_counts": "SELECT target, combo, architecture, seed, split, y, yhat, count(*) AS n FROM fx_predictions GROUP BY ALL",
    "fx_report": """
        SELECT target, combo, architecture, seed, split, label, sum(tp) AS tp, sum(support) AS support,
            sum(predicted) AS predicted
        FROM (SELECT target, combo, architecture, seed, split, y AS label,
                CASE WHEN y = yhat THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM fx_counts
            UNION ALL SELECT target, combo, architecture, seed, split, yhat, 0, 0, n FROM fx_counts) GROUP BY ALL""",
    "fx_f1": """
        SELECT target, combo, architecture, seed, split, avg(2.0 * tp / (support + predicted)) AS macro_f1
        FROM fx_report GROUP BY ALL""",
    "fx_summary": f"""
        SELECT target, combo, architecture, count(*) FILTER (split = 'test') AS n_seeds,
            avg(macro_f1) FILTER (split = 'test') AS mean, stddev_samp(macro_f1) FILTER (split = 'test') AS std,
            mean - {T9} * std / sqrt(10.0) AS ci_low, mean + {T9} * std / sqrt(10.0) AS ci_high,
            avg(macro_f1) FILTER (split = 'val') AS mean_val FROM fx_f1 GROUP BY ALL""",
    "fx_selected": """
        SELECT * FROM fx_summary QUALIFY row_number() OVER (PARTITION BY target, combo
            ORDER BY mean_val DESC, architecture) = 1""",
    "fx_delta": f"""
        SELECT target, combo, count(*) AS n_seeds, avg(d) AS mean, stddev_samp(d) AS std,
            mean - {T9} * std / sqrt(10.0) AS ci_low, mean + {T9} * std / sqrt(10.0) AS ci_high
        FROM (SELECT b.target, b.combo, b.seed, b.macro_f1 - a.macro_f1 AS d
            FROM fx_f1 b JOIN fx_selected s ON s.target = b.target AND s.combo = b.combo AND s.architecture = b.architecture
            JOIN fx_selected t ON t.target = b.target AND t.combo = 'text'
            JOIN fx_f1 a ON a.target = t.target AND a.combo = 'text' AND a.architecture = t.architecture
                AND a.seed = b.seed AND a.split = 'test'
            WHERE b.split = 'test' AND b.combo <> 'text') GROUP BY ALL""",
    "fx_pairs": """
        SELECT b.target, b.combo, b.architecture, b.transcript_id, b.y, a.yhat = a.y AS ok_a, b.yhat = b.y AS ok_b
        FROM fx_predictions b JOIN fx_predictions a USING (target, architecture, seed, transcript_id, split)
        WHERE b.split = 'test' AND b.seed = 42 AND a.combo = 'text' AND b.combo LIKE '%-%'""",
    "fx_cells": """
        SELECT target, combo, architecture, count(*) AS n, count(*) FILTER (ok_a AND ok_b) AS both_right,
            count(*) FILTER (NOT ok_a AND ok_b) AS only_fusion, count(*) FILTER (ok_a AND NOT ok_b) AS only_baseline,
            count(*) FILTER (NOT ok_a AND NOT ok_b) AS neither FROM fx_pairs GROUP BY ALL""",
    "fx_comp": """
        SELECT c.*, both_right / n AS both_share, only_fusion / n AS only_fusion_share, only_baseline / n AS only_baseline_share,
            neither / n AS neither_share, f.macro_f1 AS fusion_f1, b.macro_f1 AS baseline_f1,
            f.macro_f1 - b.macro_f1 AS f1_delta
        FROM fx_cells c JOIN fx_f1 f ON f.target = c.target AND f.combo = c.combo AND f.architecture = c.architecture
            AND f.seed = 42 AND f.split = 'test'
        JOIN fx_f1 b ON b.target = c.target AND b.combo = 'text' AND b.architecture = c.architecture
            AND b.seed = 42 AND b.split = 'test'""",
}


def scores(c, seeds=SEEDS):
    return evaluation.macro_f1(c.predictions_of(seeds), [*CONFIG, "seed", "split"])


def summary(c):
    return evaluation.run_summary(scores(c), CONFIG)


@query(
    "x01_confusion_matrix",
    """SELECT k.target, k.combo, k.architecture, k.seed, a.label AS y, b.label AS yhat, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT target, combo, architecture, seed FROM fx_counts) k
    JOIN (SELECT DISTINCT target, combo, architecture, seed, label FROM fx_report WHERE split = 'test') a
        USING (target, combo, architecture, seed)
    JOIN (SELECT DISTINCT target, combo, architecture, seed, label FROM fx_report WHERE split = 'test') b
        USING (target, combo, architecture, seed)
    LEFT JOIN (SELECT * FROM fx_counts WHERE split = 'test') c ON c.target = k.target AND c.combo = k.combo
        AND c.architecture = k.architecture AND c.seed = k.seed AND c.y = a.label AND c.yhat = b.label""",
    SCORES,
)
def _(c):
    return evaluation.confusion_matrix(c.predictions.where("split = 'test'"), [*CONFIG, "seed"])


@query(
    "x02_class_report",
    """SELECT target, combo, architecture, seed, split, label,
        round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision,
        round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
        round(2.0 * tp / (support + predicted), 6)::DOUBLE AS f1, support::BIGINT AS support FROM fx_report""",
    SCORES,
)
def _(c):
    return rounded(evaluation.class_report(c.predictions, [*CONFIG, "seed", "split"]))


@query(
    "x03_macro_f1",
    "SELECT target, combo, architecture, seed, split, round(macro_f1, 6) AS macro_f1 FROM fx_f1",
    SCORES,
)
def _(c):
    return rounded(scores(c))


CHANCE = {
    "fx_majority": """
        SELECT target, seed, label AS major FROM (SELECT target, seed, label, count(*) AS n FROM fx_splits
            WHERE split = 'train' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY target, seed ORDER BY n DESC, label) = 1""",
    "fx_chance": """
        SELECT s.target, s.seed, 2.0::DOUBLE * count(*) FILTER (label = major) / (count(*) + count(*) FILTER (label = major))
            / count(DISTINCT label) AS macro_f1
        FROM fx_splits s JOIN fx_majority USING (target, seed) WHERE split = 'test' GROUP BY ALL""",
}


@query("x04_chance_train_majority", "SELECT target, seed, round(macro_f1, 6) AS macro_f1 FROM fx_chance", CHANCE)
def _(c):
    return rounded(evaluation.chance_baseline(c.splits))


@query(
    "x04_chance_all_labels",
    """SELECT target, round(2.0::DOUBLE * max(n) / (sum(n) + max(n)) / count(*), 6) AS macro_f1
    FROM (SELECT target, label, count(*) AS n FROM fx_target_labels GROUP BY ALL) GROUP BY 1""",
)
def _(c):
    return rounded(evaluation.chance_baseline(c.target_labels, "all_labels"))


@query(
    "x05_seed_ci",
    f"""SELECT target, count(*) AS n_seeds, round(avg(macro_f1), 6) AS mean, round(stddev_samp(macro_f1), 6) AS std,
        round(avg(macro_f1) - {T9} * stddev_samp(macro_f1) / sqrt(10.0), 6) AS ci_low,
        round(avg(macro_f1) + {T9} * stddev_samp(macro_f1) / sqrt(10.0), 6) AS ci_high FROM fx_chance GROUP BY 1""",
    CHANCE,
)
def _(c):
    return rounded(evaluation.seed_ci(evaluation.chance_baseline(c.splits), ["target"], "macro_f1"))


ROUNDED = ", ".join(f"round({x}, 6) AS {x}" for x in ("mean", "std", "ci_low", "ci_high"))


@query(
    "x06_select_configs",
    f"SELECT target, combo, architecture, n_seeds, {ROUNDED}, round(mean_val, 6) AS mean_val FROM fx_selected",
    SCORES,
)
def _(c):
    return rounded(evaluation.select_configs(summary(c), ["target", "combo"], ["architecture"]))


def text_deltas(c):
    """Selected fusion minus selected text configuration; the few score rows are computed once and reused."""
    table = cut_lineage(scores(c))
    summed = evaluation.run_summary(table, CONFIG)
    chosen = evaluation.select_configs(summed, ["target", "combo"], ["architecture"]).select(CONFIG)
    mine = table.where("split = 'test'").join(chosen, CONFIG, "left_semi")
    text = mine.where("combo = 'text'").select("target", "seed", F.col("macro_f1").alias("text_f1"))
    joined = mine.where("combo <> 'text'").join(text, ["target", "seed"])
    a = joined.select("target", "combo", "seed", "macro_f1")
    b = joined.select("target", "combo", "seed", F.col("text_f1").alias("macro_f1"))
    return evaluation.paired_delta(a, b, ["target", "combo"])


@query(
    "x07_paired_delta",
    f"""SELECT target, combo, n_seeds, {ROUNDED}, (ci_low > 0 OR ci_high < 0) AND mean >= 0.01 AS real_effect
    FROM fx_delta""",
    SCORES,
)
def _(c):
    return rounded(text_deltas(c))


@query(
    "x08_verdict",
    """SELECT target, combo, CASE WHEN (ci_low > 0 OR ci_high < 0) AND mean >= 0.01 THEN 'PASS' ELSE 'FAIL' END AS two_sided,
        CASE WHEN ci_low > 0 AND mean >= 0.01 THEN 'PASS' ELSE 'FAIL' END AS one_sided FROM fx_delta""",
    SCORES,
)
def _(c):
    deltas = text_deltas(c).drop("real_effect")
    both = evaluation.verdict(deltas).withColumnRenamed("verdict", "two_sided")
    return evaluation.verdict(both, both_sides=False).select("target", "combo", "two_sided", F.col("verdict").alias("one_sided"))


def fusion_pair(c):
    """Text baseline repeated for each fusion combination, and the fusions, at one seed."""
    at = c.predictions_of([42]).where("split = 'test'")
    combos = F.array(*[F.lit(x) for x in ("text-stats", "text-graph", "text-stats-graph")])
    text = at.where("combo = 'text'").withColumn("combo", F.explode(combos))
    return text, at.where(F.col("combo").contains("-"))


@query(
    "x09_mcnemar_exact",
    """SELECT target, combo, architecture, only_baseline AS b, only_fusion AS c,
        round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_baseline, only_fusion) + 1), lambda k:
            exp(lgamma(only_baseline + only_fusion + 1) - lgamma(k + 1) - lgamma(only_baseline + only_fusion - k + 1)
                - (only_baseline + only_fusion) * ln(2))))), 6) AS p_value FROM fx_cells""",
    SCORES,
)
def _(c):
    return rounded(evaluation.mcnemar_exact(*fusion_pair(c), CONFIG))


@query(
    "x10_run_summary",
    f"SELECT target, combo, architecture, n_seeds, {ROUNDED}, round(mean_val, 6) AS mean_val FROM fx_summary",
    SCORES,
)
def _(c):
    return rounded(summary(c))


VARIANTS = {"text": "text", "stats": "label_bag", "graph": "structure", "text-stats": "full", "text-graph": "masked"}
PAIRS = {"full-label_bag": ("full", "label_bag"), "structure-chance": ("structure", "chance"), "masked-full": ("masked", "full")}
ABLATION = {
    **CHANCE,
    **SCORES,
    "fx_variant_scores": """
        SELECT target, CASE combo WHEN 'text' THEN 'text' WHEN 'stats' THEN 'label_bag' WHEN 'graph' THEN 'structure'
            WHEN 'text-stats' THEN 'full' WHEN 'text-graph' THEN 'masked' END AS variant, seed, macro_f1
        FROM fx_f1 WHERE split = 'test' AND architecture = 'logistic' AND combo <> 'text-stats-graph'
        UNION ALL SELECT target, 'chance', seed, macro_f1 FROM fx_chance""",
    "fx_ablation": """
        SELECT target, variant AS item, macro_f1 AS v, false AS paired FROM fx_variant_scores WHERE variant <> 'chance'
        UNION ALL SELECT a.target, concat(a.variant, '-', b.variant), a.macro_f1 - b.macro_f1, true
        FROM fx_variant_scores a JOIN fx_variant_scores b USING (target, seed)
        WHERE concat(a.variant, '-', b.variant) IN ('full-label_bag', 'structure-chance', 'masked-full')""",
}


@query(
    "x11_ablation_summary",
    f"""SELECT target, item, round(mean, 6) AS mean, round(std, 6) AS std, round(ci_low, 6) AS ci_low,
        round(ci_high, 6) AS ci_high,
        CASE WHEN paired THEN (ci_low > 0 OR ci_high < 0) AND mean >= 0.01 END AS real_effect
    FROM (SELECT target, item, paired, avg(v) AS mean, stddev_samp(v) AS std, mean - {T9} * std / sqrt(10.0) AS ci_low,
        mean + {T9} * std / sqrt(10.0) AS ci_high FROM fx_ablation GROUP BY ALL)""",
    ABLATION,
)
def _(c):
    names = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])
    mine = scores(c).where("split = 'test' AND architecture = 'logistic' AND combo <> 'text-stats-graph'")
    variants = mine.select("target", names[F.col("combo")].alias("variant"), "seed", "macro_f1")
    chance = evaluation.chance_baseline(c.splits)
    return rounded(evaluation.ablation_summary(variants, chance, PAIRS))


@query(
    "x15_complementarity",
    """SELECT *, round(both_right / n, 6) AS both_share, round(only_fusion / n, 6) AS only_fusion_share,
        round(only_baseline / n, 6) AS only_baseline_share, round(neither / n, 6) AS neither_share FROM fx_cells""",
    SCORES,
)
def _(c):
    return rounded(evaluation.complementarity(*fusion_pair(c), CONFIG))


def comp_table(c):
    cells = evaluation.complementarity(*fusion_pair(c), CONFIG)
    return evaluation.complementarity_table(cells, scores(c, [42]).where("split = 'test'"), CONFIG, "text")


@query(
    "x16_complementarity_table",
    """SELECT target, combo, architecture, n, round(only_fusion_share, 6) AS only_fusion_share, round(fusion_f1, 6) AS fusion_f1,
        round(baseline_f1, 6) AS baseline_f1, round(f1_delta, 6) AS f1_delta FROM fx_comp""",
    SCORES,
)
def _(c):
    return rounded(
        comp_table(c).select("target", "combo", "architecture", "n", "only_fusion_share", "fusion_f1", "baseline_f1", "f1_delta")
    )


@query(
    "x16_complementarity_summary",
    """SELECT target, architecture, round(avg(only_fusion_share), 6) AS only_fusion_share,
        round(avg(only_baseline_share), 6) AS only_baseline_share, round(avg(both_share), 6) AS both_share,
        round(avg(f1_delta), 6) AS f1_delta FROM fx_comp GROUP BY ALL""",
    SCORES,
)
def _(c):
    return rounded(evaluation.complementarity_summary(comp_table(c)))


@query(
    "x17_class_accuracy_delta",
    """SELECT target, combo, architecture, y, count(*) AS n, round(avg(ok_a::INT), 6) AS baseline_accuracy,
        round(avg(ok_b::INT), 6) AS fusion_accuracy, round(avg(ok_b::INT) - avg(ok_a::INT), 6) AS delta FROM fx_pairs GROUP BY ALL""",
    SCORES,
)
def _(c):
    return rounded(evaluation.class_accuracy_delta(*fusion_pair(c), CONFIG))


@query(
    "x18_comparison_table",
    f"SELECT target, combo, architecture, n_seeds, {ROUNDED}, round(mean_val, 6) AS mean_val FROM fx_summary",
    SCORES,
)
def _(c):
    return rounded(evaluation.comparison_table(summary(c)))


@query(
    "x18_best_by_target",
    """SELECT target, combo, architecture, round(mean, 6) AS mean FROM fx_summary
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(mean, 9) DESC, combo DESC, architecture DESC) = 1""",
    SCORES,
)
def _(c):
    return rounded(evaluation.best_by_target(summary(c)))


@query(
    "x19_gate_summary",
    """SELECT target, round(best_baseline, 6) AS best_baseline, combo, architecture, round(fusion_f1, 6) AS best_fusion,
        round(only_fusion_share, 6) AS only_fusion_share, round(fusion_f1 - best_baseline, 6) AS delta
    FROM (SELECT *, max(baseline_f1) OVER (PARTITION BY target) AS best_baseline FROM fx_comp)
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(fusion_f1, 9) DESC, combo DESC, architecture DESC) = 1""",
    SCORES,
)
def _(c):
    return rounded(evaluation.gate_summary(comp_table(c)))
