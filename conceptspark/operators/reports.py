"""Corpus reports: per-graph metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.functions.vocabulary import VALENCES, VERIFY_KEYWORDS
from conceptspark.operators import features, validation
from conceptspark.operators.joins import join_counted
from conceptspark.operators.ranking import exact_medians

CONFLICT = "CONFLICTS_WITH"
MIX_RELATIONS = ["SERVES", "EXPRESSED_VIA", "MODULATED_BY", CONFLICT]


def _is(relation: str) -> Column:
    return F.coalesce(F.col("relation") == relation, F.lit(False))


def _safe(count: str) -> Column:
    return F.greatest(F.col(count), F.lit(1))


def csm_verify_counts() -> Column:
    words = "|".join(VERIFY_KEYWORDS)
    return F.count_if(features.typed("CognitiveStyleMarker") & F.lower(F.coalesce("label", F.lit(""))).rlike(words))


def csm_verify_fraction(nodes: DataFrame) -> DataFrame:
    """Share of markers whose label mentions verification, per graph."""
    counted = nodes.groupBy("graph_id").agg(
        F.count_if(features.typed("CognitiveStyleMarker")).alias("n_csm"), csm_verify_counts().alias("n_verify")
    )
    return counted.select("graph_id", (F.col("n_verify") / _safe("n_csm")).alias("csm_verify_frac"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, graphs: DataFrame, demographics: DataFrame) -> DataFrame:
    """Wide per-graph table: two aggregations, then joins of one row per graph."""
    complete = F.when(features.typed("Construct"), F.coalesce("bipolarity_complete", F.lit(False)).cast("double"))
    by_node = nodes.groupBy("graph_id").agg(
        F.count("*").alias("n_total"),
        *features.type_counts(),
        *[k.alias(f"valence_{v}") for v, k in zip(VALENCES, features.valence_counts())],
        F.avg(features.bipolarity_value()).alias("bipolarity_score"),
        F.avg(complete).alias("bipolarity_complete_frac"),
        csm_verify_counts().alias("_verify"),
    )
    by_edge = edges.groupBy("graph_id").agg(
        F.count("*").alias("n_edges"), F.max(_is(CONFLICT).cast("double")).alias("has_conflict")
    )
    people = demographics.select(F.col("transcript_id").alias("graph_id"), "ai_adoption", "career_stage")
    joined = (
        graphs.select("graph_id", "split")
        .join(by_node, "graph_id", "left")
        .join(by_edge, "graph_id", "left")
        .join(people, "graph_id", "left")
        .na.fill(0)
        .na.fill("unknown", ["ai_adoption", "career_stage", "split"])
    )
    return joined.select(
        "graph_id",
        "split",
        "n_total",
        "n_edges",
        "n_construct",
        "n_value",
        "n_stance",
        "n_csm",
        (F.col("n_construct") / _safe("n_value")).alias("cv_ratio"),
        (F.col("valence_negative") / _safe("n_stance")).alias("neg_frac"),
        *[f"valence_{v}" for v in VALENCES],
        "bipolarity_score",
        "bipolarity_complete_frac",
        F.col("n_csm").alias("csm_count"),
        (F.col("n_csm") > 0).cast("double").alias("csm_present"),
        (F.col("_verify") / _safe("n_csm")).alias("csm_verify_frac"),
        "has_conflict",
        "ai_adoption",
        "career_stage",
    )


def cohort_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, exact median, sample deviation and sum of each metric per cohort."""
    aggregates = [F.count("*").alias("n")]
    for c in columns:
        aggregates += [
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_samp(c).alias(f"std_{c}"),
            F.sum(F.col(c).cast("double")).alias(f"sum_{c}"),
        ]
    key = F.coalesce(F.concat(F.lit("s"), "split"), F.lit("")).alias("_split")  # joins keep a null cohort
    means = metrics.groupBy("split").agg(*aggregates).withColumn("_split", key)
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_m")
    medians = exact_medians(metrics.select(key, listed).select("_split", "_m.*"), ["_split", "metric"], "value")
    wide = medians.groupBy("_split").agg(*[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"median_{c}") for c in columns])
    order = ["split", "n", *[f"{a}_{c}" for c in columns for a in ("mean", "median", "std", "sum")]]
    return means.join(wide, "_split", "left").select(order).orderBy("split")


def corpus_overview(sizes: DataFrame, graphs: DataFrame) -> DataFrame:
    """Totals per cohort and overall: graphs, mean sizes, graphs with violations."""
    rows = sizes.join(graphs.select("graph_id", "split"), "graph_id")
    return (
        rows.rollup("split")
        .agg(
            F.count("*").alias("n_graphs"),
            F.avg("n_nodes").alias("mean_nodes"),
            F.avg("n_edges").alias("mean_edges"),
            F.count_if(F.col("n_violations") > 0).alias("n_with_violations"),
        )
        .na.fill("ALL", ["split"])
    )


def valence_distribution(nodes: DataFrame, graphs: DataFrame) -> DataFrame:
    """Count and share of each valence within its cohort; the totals are sums over the counted table."""
    stances = nodes.where(features.typed("Stance")).select("graph_id", F.coalesce("valence", F.lit("missing")).alias("valence"))
    counts = (
        stances.groupBy("graph_id", "valence").agg(F.count("*").alias("n"))
        .join(graphs.select("graph_id", "split"), "graph_id")
        .groupBy("split", "valence").agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("split").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "split").select("split", "valence", "n", (F.col("n") / F.col("_total")).alias("share"))


def bipolarity_by_cohort(nodes: DataFrame, graphs: DataFrame) -> DataFrame:
    """Mean complete fraction over the graphs that have Constructs."""
    complete = F.coalesce("bipolarity_complete", F.lit(False)).cast("double")
    per_graph = nodes.where(features.typed("Construct")).groupBy("graph_id").agg(F.avg(complete).alias("fraction"))
    return (
        per_graph.join(graphs.select("graph_id", "split"), "graph_id")
        .groupBy("split")
        .agg(F.count("*").alias("n_graphs"), F.avg("fraction").alias("mean_complete"))
    )


def centrality_by_cohort(nodes: DataFrame, degree: DataFrame, topology: DataFrame, graphs: DataFrame) -> DataFrame:
    """Mean degree, mean Value degree (0 without Values) and mean betweenness per cohort."""
    own = degree.join(nodes.select("graph_id", "id", "type"), ["graph_id", "id"], "left")
    per_graph = own.groupBy("graph_id").agg(
        F.avg("degree").alias("mean_degree"),
        F.coalesce(F.avg(F.when(features.typed("Value"), F.col("degree"))), F.lit(0.0)).alias("mean_value_degree"),
    )
    return (
        per_graph.join(topology.select("graph_id", "mean_betweenness", "max_betweenness"), "graph_id")
        .join(graphs.select("graph_id", "split"), "graph_id")
        .groupBy("split")
        .agg(*[F.avg(c).alias(c) for c in ("mean_degree", "mean_value_degree", "mean_betweenness", "max_betweenness")])
    )


def relation_mix(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Per-graph relation shares averaged by cohort, and the share of graphs with a conflict."""
    counted = edges.groupBy("graph_id").agg(
        F.count("*").alias("m"), *[F.count_if(_is(r)).alias(f"m_{r}") for r in MIX_RELATIONS]
    )
    rows = graphs.select("graph_id", "split").join(counted, "graph_id", "left").na.fill(0)
    return rows.groupBy("split").agg(
        *[F.avg(features.share(F.col(f"m_{r}"), F.col("m"))).alias(r.lower()) for r in MIX_RELATIONS],
        F.avg((F.col(f"m_{CONFLICT}") > 0).cast("double")).alias("conflict_prevalence"),
    )


def histogram(df: DataFrame, group: str, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the group's own minimum and maximum; the maximum falls into the last bin."""
    limits = df.groupBy(group).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    place = F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return join_counted(df, limits, [group]).groupBy(group, place.alias("bin")).agg(F.count("*").alias("n"))


def relation_distribution(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Counts per cohort of relation and grounding values, missing ones as MISSING."""
    kinds = F.array(
        F.struct(F.lit("relation").alias("kind"), F.coalesce("relation", F.lit("MISSING")).alias("name")),
        F.struct(F.lit("grounding").alias("kind"), F.coalesce("grounding", F.lit("MISSING")).alias("name")),
        F.when(
            F.col("relation").isin("SUBSUMES", "IMPLIES"),
            F.struct(F.lit("inferential grounding").alias("kind"), F.coalesce("grounding", F.lit("MISSING")).alias("name")),
        ),
    )
    per_graph = edges.select("graph_id", F.explode(F.array_compact(kinds)).alias("_k")).groupBy("graph_id", "_k.kind", "_k.name").agg(
        F.count("*").alias("n")
    )
    return (
        per_graph.join(graphs.select("graph_id", "split"), "graph_id")
        .groupBy("split", "kind", "name")
        .agg(F.sum("n").alias("n"))
    )


def quality_report(sizes: DataFrame, graphs: DataFrame) -> DataFrame:
    """Per cohort and overall: size means and population deviations, violations."""
    rows = sizes.join(graphs.select("graph_id", "split"), "graph_id")
    return (
        rows.rollup("split")
        .agg(
            F.count("*").alias("n_graphs"),
            F.avg("n_nodes").alias("mean_nodes"),
            F.stddev_pop("n_nodes").alias("sd_nodes"),
            F.avg("n_edges").alias("mean_edges"),
            F.stddev_pop("n_edges").alias("sd_edges"),
            F.count_if(F.col("n_violations") > 0).alias("n_with_violations"),
            F.sum("n_violations").alias("n_violations"),
        )
        .na.fill("ALL", ["split"])
    )


def inferential_counts(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    counted = edges.groupBy("graph_id").agg(
        F.count_if(_is("SUBSUMES")).alias("n_subsumes"), F.count_if(_is("IMPLIES")).alias("n_implies")
    )
    rows = graphs.select("graph_id", "split").join(counted, "graph_id", "left").na.fill(0)
    return rows.withColumn("n_inferential", F.col("n_subsumes") + F.col("n_implies"))


def inferential_profile(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Inferential edges per graph by cohort and overall, and the share of graphs with exactly one of each."""
    both_one = (F.col("n_subsumes") == 1) & (F.col("n_implies") == 1)
    return (
        inferential_counts(edges, graphs)
        .rollup("split")
        .agg(
            F.count("*").alias("n_graphs"),
            F.avg("n_inferential").alias("mean_inferential"),
            F.stddev_pop("n_inferential").alias("sd_inferential"),
            F.avg((F.col("n_inferential") == 0).cast("double")).alias("zero_share"),
            F.avg(both_one.cast("double")).alias("one_plus_one_share"),
        )
        .na.fill("ALL", ["split"])
    )


def inferential_distribution(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    return inferential_counts(edges, graphs).groupBy("n_inferential").agg(F.count("*").alias("n_graphs"))


def size_confound(sizes: DataFrame, turn_counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Correlation of edge count with human turns over the graphs whose transcript is known."""
    turns = turn_counts.select(F.col("transcript_id").alias("graph_id"), "n_human_turns")
    joined = sizes.join(turns, "graph_id").agg(
        F.count("*").alias("n"), F.corr(F.col("n_edges").cast("double"), F.col("n_human_turns").cast("double")).alias("r")
    )
    return joined.withColumn("flag", F.coalesce(F.abs("r") > threshold, F.lit(False)))


def corpus_rubric(nodes: DataFrame, sizes: DataFrame, violations: DataFrame, graphs: DataFrame) -> DataFrame:
    """Per extraction model: size consistency, clean graphs, bipolarity, violations and unknown relations."""
    bip = nodes.groupBy("graph_id").agg(F.avg(features.bipolarity_value()).alias("bip"))
    unknown = violations.where("rule = 'V13'").groupBy("graph_id").agg(F.count("*").alias("n_unknown"))
    rows = (
        sizes.join(graphs.select("graph_id", "extraction_model"), "graph_id")
        .join(bip, "graph_id", "left")
        .join(unknown, "graph_id", "left")
        .na.fill(0, ["n_unknown"])
    )
    return rows.groupBy("extraction_model").agg(
        F.count("*").alias("n_graphs"),
        F.avg("n_nodes").alias("mean_nodes"),
        (F.stddev_pop("n_nodes") / F.avg("n_nodes")).alias("cv_nodes"),
        F.count_if(F.col("n_violations") == 0).alias("n_clean"),
        F.coalesce(F.avg("bip"), F.lit(0.0)).alias("mean_bipolarity"),
        F.sum("n_violations").alias("n_violations"),
        F.sum("n_unknown").alias("n_unknown_relations"),
        F.avg("n_edges").alias("mean_edges"),
        F.concat_ws("-", F.min("n_nodes").cast("string"), F.max("n_nodes").cast("string")).alias("node_range"),
        F.concat_ws("-", F.min("n_edges").cast("string"), F.max("n_edges").cast("string")).alias("edge_range"),
    )


def inspect_graph(nodes: DataFrame, edges: DataFrame, graph_id) -> DataFrame:
    """Readable rows of one graph: nodes with their spans, then edges. The id filter reaches the scan."""
    cut = lambda text, n: F.substring(F.coalesce(text, F.lit("")), 1, n)
    spans = F.concat(
        *[F.coalesce(c, F.array().cast("array<string>")) for c in ("grounding_spans", "grounding_spans_positive", "grounding_spans_negative")],
        F.array("grounding_span"),
    )
    kept = F.filter(spans, lambda s: F.coalesce(s, F.lit("")) != "")
    shown = F.array_join(F.transform(kept, lambda s: F.substring(s, 1, 100)), " | ")
    mine = nodes.where(F.col("graph_id") == graph_id).select(
        F.lit("node").alias("kind"), "id", F.col("type").alias("what"), cut(F.col("label"), 40).alias("label"), shown.alias("detail")
    )
    links = edges.where(F.col("graph_id") == graph_id).select(
        F.lit("edge").alias("kind"),
        F.concat_ws("->", "source", "target").alias("id"),
        F.col("relation").alias("what"),
        cut(F.col("rationale"), 40).alias("label"),
        F.coalesce("grounding", F.lit("")).alias("detail"),
    )
    return mine.unionByName(links)


def route_table(scores: DataFrame) -> DataFrame:
    """Routes by macro-F1, best first."""
    return scores.orderBy(F.desc("macro_f1"), "route")


def per_class_long(routes: DataFrame) -> DataFrame:
    """Map column ``per_class`` to rows (route, label, f1)."""
    return routes.select("route", F.explode("per_class").alias("label", "f1"))


def cohort_quality(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Flagship report: repair directions and poles, validate, and profile each cohort.

    Nodes are read once; edges meet the node types once and are repaired, checked and counted in the same
    pass. What is joined in the end is one row per graph.
    """
    repaired = validation.repair_bipolarity(nodes)
    by_node = repaired.groupBy("graph_id").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(features.typed("Construct")).alias("n_construct"),
        F.count_if(features.typed("Stance")).alias("n_stance"),
        F.count_if(features.typed("Stance") & (F.col("valence") == "negative")).alias("n_negative"),
        F.avg(features.bipolarity_value()).alias("bipolarity"),
        F.sum(F.size(validation.node_hits())).alias("node_hits"),
    )
    fixed = validation.swap_reversed(validation.type_endpoints(edges, nodes))
    by_edge = fixed.groupBy("graph_id").agg(
        F.sum(F.size(validation.edge_hits())).alias("edge_hits"), F.count_if("fixed").alias("n_fixed")
    )
    rows = (
        graphs.select("graph_id", "split", F.size(validation.graph_hits()).alias("graph_hits"))
        .join(by_node, "graph_id", "left")
        .join(by_edge, "graph_id", "left")
        .na.fill(0)
    )
    hits = F.col("graph_hits") + F.col("node_hits") + F.col("edge_hits")
    ratio = lambda top, bottom: F.col(top) / _safe(bottom)
    return (
        rows.groupBy("split")
        .agg(
            F.count("*").alias("n_graphs"),
            F.round(F.avg("n_nodes"), 6).alias("mean_nodes"),
            F.round(F.avg(ratio("n_construct", "n_nodes")), 6).alias("mean_construct_ratio"),
            F.round(F.avg(ratio("n_negative", "n_stance")), 6).alias("mean_negative_stance"),
            F.round(F.avg("bipolarity"), 6).alias("mean_bipolarity"),
            F.sum(hits).alias("n_violations"),
            F.count_if(hits == 0).alias("n_clean"),
            F.sum("n_fixed").alias("n_fixed"),
        )
        .orderBy("split")
    )
