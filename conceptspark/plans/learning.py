"""Classifiers, fusion, probes and importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.fixtures import SEEDS
from conceptspark.operators import evaluation, experiments, features, ladder, models, splits
from conceptspark.operators.stats_vector import graph_stats
from conceptspark.functions.vocabulary import FEATURE_NAMES
from conceptspark.plans.evaluation import finished_tags
from conceptspark.plans.registry import query
from conceptspark.plans.views import h32
from conceptspark.plans.vocabulary import bag, modality
from conceptspark.session import cut_lineage, scratch_path

TARGET = "stance_ambivalence"
PROBE_SEEDS = SEEDS


def histogram(c):
    return ladder.as_features(features.type_histogram(c.nodes, c.edges, c.graphs))


def labelled(c, target: str = TARGET, seeds=(42,)):
    """Splits of one target over the orders that have a graph, computed once."""
    rows = splits.repeated_splits(c.target_labels.where(F.col("target") == target), list(seeds))
    return cut_lineage(splits.restrict_split(rows, c.graphs.select(F.col("graph_id").alias("transcript_id"))))


MADE = {
    "stats": histogram,
    "text": lambda c: modality(bag(c)),
    "graph": lambda c: ladder.as_features(ladder.propagation.propagate(c.nodes, c.edges)),
}


def data(c, combo: str):
    """Feature tables of the modalities in ``combo``."""
    return {name: cut_lineage(MADE[name](c)) for name in combo.split("-")}


def grid_results(c, grid, seeds, labels):
    """Answers and error rows of ``grid`` for ``seeds``, from a fresh folder."""
    return models.run_grid(data(c, "text-stats-graph"), labels, grid, seeds, scratch_path(c.spark, "runs"))


def answers(c, architecture: str, combo: str, target: str = TARGET):
    """Answers of one row of the grid on val and test of all ten seeds."""
    grid = experiments.experiment_grid(c.spark)
    mine = grid.where((F.col("target") == target) & (F.col("architecture") == architecture) & (F.col("combo") == combo))
    found = models.run_grid(data(c, combo), labelled(c, target, SEEDS), mine, SEEDS, scratch_path(c.spark, "runs"))
    failed = F.raise_error(F.col("error")).cast("int")
    y = F.when(F.col("error").isNotNull(), failed).otherwise(F.col("y")).alias("y")
    return found.select("target", "combo", "architecture", "seed", "transcript_id", "split", y, "yhat")


@query("m01_logistic")
def _(c):
    return answers(c, "logistic", "stats")


@query("m02_random_forest")
def _(c):
    return answers(c, "random_forest", "stats")


@query("m03_gradient_boost")
def _(c):
    return answers(c, "gradient_boost", "stats", target="ai_adoption")


@query("m04_svm")
def _(c):
    return answers(c, "svm", "stats")


@query("m05_mlp_single")
def _(c):
    return answers(c, "single", "stats")


@query("m06_mlp_stacked")
def _(c):
    return answers(c, "stacked", "text-stats")


@query("m07_late_fusion")
def _(c):
    return answers(c, "late", "text-stats")


@query("m08_gated_fusion")
def _(c):
    return answers(c, "gated", "text-stats")


# the fusion steps alone, on scores that SQL can derive too

SCORES = {
    "fx_scores": f"""
        SELECT transcript_id, modality, class, {h32("concat_ws('|', transcript_id, modality, class)")} % 1000 / 250.0 AS score
        FROM fx_a CROSS JOIN (VALUES ('graph'), ('stats'), ('text')) m(modality) CROSS JOIN (VALUES (0), (1), (2)) k(class)""",
    "fx_gates": """
        SELECT transcript_id, modality, exp(top) / sum(exp(top)) OVER (PARTITION BY transcript_id) AS gate FROM (
            SELECT transcript_id, modality, max(score) AS top FROM fx_scores GROUP BY ALL)""",
}


def score_rows(c):
    names = F.array(*[F.lit(m) for m in ("graph", "stats", "text")])
    rows = c.annotator_a.select("transcript_id", F.explode(names).alias("modality")).select(
        "*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("class")
    )
    text = F.concat_ws("|", F.col("transcript_id").cast("string"), "modality", F.col("class").cast("string"))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return rows.withColumn("score", h % 1000 / F.lit(250.0))


@query(
    "m07_average_scores",
    "SELECT transcript_id, class, round(avg(score), 6) AS score FROM fx_scores GROUP BY ALL",
    SCORES,
)
def _(c):
    return models.average_scores(score_rows(c)).withColumn("score", F.round("score", 6))


@query(
    "m08_gate_scores",
    """SELECT transcript_id, class, round(sum(gate * score), 6) AS score FROM fx_scores
    JOIN fx_gates USING (transcript_id, modality) GROUP BY ALL""",
    SCORES,
)
def _(c):
    return models.gate_scores(score_rows(c)).withColumn("score", F.round("score", 6))


@query(
    "m08_pick_class",
    """SELECT transcript_id, class AS yhat FROM (SELECT transcript_id, class, sum(gate * score) AS score FROM fx_scores
        JOIN fx_gates USING (transcript_id, modality) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY round(score, 9) DESC, class) = 1""",
    SCORES,
)
def _(c):
    return models.pick_class(models.gate_scores(score_rows(c)))


@query("m12_run_experiments")
def _(c):
    """Every row of the grid that has no result yet, over all targets, with the seed of the single sweep: a score or an error."""
    pending = experiments.pending_experiments(experiments.experiment_grid(c.spark), finished_tags(c))
    labels = splits.restrict_split(splits.repeated_splits(c.target_labels, [42]), c.graphs.select(F.col("graph_id").alias("transcript_id")))
    found = grid_results(c, pending, [42], cut_lineage(labels))
    keys = ["tag", "target", "combo", "architecture", "seed", "split"]
    scores = evaluation.macro_f1(found.where("error IS NULL"), keys).withColumn("error", F.lit(None).cast("string"))
    return scores.unionByName(found.where("error IS NOT NULL").select(*keys, F.lit(None).cast("double").alias("macro_f1"), "error"))


@query("m13_predict_proba")
def _(c):
    """Class probabilities of the test rows of all ten seeds."""
    rows = cut_lineage(labelled(c, seeds=SEEDS).join(histogram(c), "transcript_id"))

    def one(seed):
        mine = rows.where(F.col("seed") == seed)
        fitted = models.fit_logistic(mine.where("split = 'train'"))
        return models.predict_proba(fitted, mine.where("split = 'test'")).select(F.lit(seed).alias("seed"), "transcript_id", "label", "proba")

    with ThreadPoolExecutor(max_workers=4) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, SEEDS))


@query("g20_node_type_reconstruction")
def _(c):
    plain = ladder.node_type_reconstruction(c.nodes, c.edges)
    return plain.withColumn("variant", F.lit("masked"))


@query("g20_node_type_reconstruction_typed")
def _(c):
    return ladder.node_type_reconstruction(c.nodes, c.edges, typed=True).withColumn("variant", F.lit("masked typed"))


def ladder_scores(c):
    table = labelled(c, seeds=PROBE_SEEDS)
    found = ladder.ladder_answers(ladder.arms(c.nodes, c.edges, c.graphs), table, TARGET, PROBE_SEEDS)
    chance = evaluation.chance_baseline(table.where(F.col("seed") == PROBE_SEEDS[0]).drop("seed"), "all_labels")
    return found, chance


@query("x12_edge_ladder")
def _(c):
    """Arms with their interval, then the paired comparisons with verdict."""
    found, chance = ladder_scores(c)
    scores, _ = models.arm_reports(found)
    arm_rows = ladder.ladder_arms(scores, chance).withColumnRenamed("arm", "item").withColumn("verdict", F.lit(None).cast("string"))
    deltas = ladder.ladder_deltas(scores).withColumn("delta_vs_chance", F.lit(None).cast("double"))
    return arm_rows.unionByName(deltas)


@query("x12_edge_ladder_classes")
def _(c):
    found, _ = ladder_scores(c)
    return models.arm_reports(found)[1]


@query("x13_structure_probe")
def _(c):
    table = labelled(c, seeds=PROBE_SEEDS)
    pooled = ladder.as_features(ladder.propagation.propagate(c.nodes, c.edges))
    found = models.probe(cut_lineage(pooled), table, TARGET, PROBE_SEEDS)
    chance = evaluation.chance_baseline(table.where(F.col("seed") == PROBE_SEEDS[0]).drop("seed"), "all_labels")
    return ladder.structure_probe(evaluation.macro_f1(found, ["target", "seed"]), chance)


@query("x14_permutation_importance")
def _(c):
    stats = graph_stats(c.nodes, c.edges, c.graphs)
    rows = labelled(c).join(ladder.as_features(stats), "transcript_id")
    rows = cut_lineage(rows)
    fitted = models.fit_logistic(rows.where("split = 'train'"))
    importance = models.permutation_importance(fitted, rows.where("split = 'val'"), FEATURE_NAMES)
    return models.top_features(importance)
