"""Edge ladder, structure probe and masked-type reconstruction: what the graph structure itself predicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.functions.vocabulary import ENTITY_TYPES
from conceptspark.operators import evaluation, features, models, propagation, splits
from conceptspark.session import cut_lineage

# Paired comparisons of the ladder, as (name, arm, compared arm).
COMPARISONS = [
    ("typed_minus_untyped", "typed", "untyped"),
    ("untyped_minus_histogram", "untyped", "no_edges"),
    ("typed_minus_histogram", "typed", "no_edges"),
]


def as_features(df: DataFrame) -> DataFrame:
    columns = [c for c in df.columns if c != "graph_id"]
    return df.select(F.col("graph_id").alias("transcript_id"), F.array(*columns).alias("features"))


def arms(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> dict[str, DataFrame]:
    """Feature tables of the three arms, computed once and reused by every seed."""
    return {
        "no_edges": cut_lineage(as_features(features.type_histogram(nodes, edges, graphs))),
        "untyped": cut_lineage(as_features(propagation.propagate(nodes, edges))),
        "typed": cut_lineage(as_features(propagation.propagate(nodes, edges, typed=True))),
    }


def ladder_answers(tables: dict[str, DataFrame], labelled: DataFrame, target: str, seeds: list[int]) -> DataFrame:
    out = None
    for name, table in tables.items():
        one = models.probe(table, labelled, target, seeds).withColumn("arm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return cut_lineage(out)


def ladder_deltas(scores: DataFrame) -> DataFrame:
    """Interval and verdict of each paired comparison from (target, arm, seed, macro_f1)."""
    out = None
    for name, a, b in COMPARISONS:
        one = evaluation.paired_delta(scores.where(F.col("arm") == a), scores.where(F.col("arm") == b), ["target"])
        one = evaluation.verdict(one).withColumn("item", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.drop("real_effect")


def ladder_arms(scores: DataFrame, chance: DataFrame) -> DataFrame:
    """Interval per arm and its distance to the chance score."""
    own = evaluation.seed_ci(scores, ["target", "arm"], "macro_f1")
    base = chance.select("target", F.col("macro_f1").alias("_chance"))
    return own.join(base, "target").withColumn("delta_vs_chance", F.col("mean") - F.col("_chance")).drop("_chance")


def structure_probe(scores: DataFrame, chance: DataFrame) -> DataFrame:
    """Per target: mean F1, interval of the per-seed gain over chance, and the one-sided verdict."""
    base = chance.select("target", F.col("macro_f1").alias("_chance"))
    gains = scores.join(base, "target").withColumn("delta", F.col("macro_f1") - F.col("_chance"))
    level = gains.groupBy("target").agg(F.avg("macro_f1").alias("mean_f1"), F.max("_chance").alias("chance"))
    interval = evaluation.seed_ci(gains, ["target"], "delta")
    return evaluation.verdict(interval, both_sides=False).join(level, "target")


def node_type_reconstruction(
    nodes: DataFrame, edges: DataFrame, typed: bool = False, masked: bool = True, ratio: float = 0.15, seed: int = 42,
    max_iter: int = 50,
) -> DataFrame:
    """Accuracy of predicting node types from the neighbourhood on a 10 % holdout of graphs.

    Masked nodes enter the propagation without their type; a logistic model is trained on the masked nodes of
    the other graphs. Unmasked, every node keeps its type, which bounds what can be reached.
    """
    marks = propagation.mask_node_types(nodes, ratio, seed).select("graph_id", "id", "type", "masked")
    own = features.node_features(nodes, edges).join(marks.drop("type"), ["graph_id", "id"])
    hidden = F.col("masked") & F.lit(masked)
    own = own.select(
        "graph_id",
        "id",
        *[F.when(hidden, 0.0).otherwise(F.col(c)).alias(c) for c in propagation.CHANNELS if c != "degree"],
        "degree",
    )
    state = propagation.propagate_nodes(nodes, edges, typed=typed, own=own)
    channels = [c for c in state.columns if c not in ("graph_id", "id")]
    code = F.array_position(F.array(*[F.lit(t) for t in ENTITY_TYPES]), F.col("type")).cast("int") - 1
    held = splits.holdout(nodes.select(F.col("graph_id").alias("transcript_id")).distinct(), 0.1, seed)
    rows = cut_lineage(
        state.join(marks.where("masked"), ["graph_id", "id"])
        .where(F.col("type").isin(ENTITY_TYPES))
        .join(held.withColumnRenamed("transcript_id", "graph_id"), "graph_id")
        .select(
            F.concat_ws("|", F.col("graph_id").cast("string"), "id").alias("transcript_id"),
            F.array(*channels).alias("features"),
            code.alias("label"),
            "held_out",
        )
    )
    fitted = models.fit_logistic(rows.where(~F.col("held_out")), max_iter=max_iter)
    answers = fitted.predict(rows.where("held_out"))
    return answers.agg(
        F.count("*").alias("n"), F.avg((F.col("yhat") == F.col("label")).cast("double")).alias("accuracy")
    )
