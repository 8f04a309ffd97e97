"""Structural features of many graphs at once, without iteration.

Everything is a hash aggregation with map-side partial sums, so a graph that holds a large share of all
rows is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.functions.vocabulary import ENTITY_TYPES, RELATIONS, VALENCES

SHORT = {"Construct": "construct", "Value": "value", "Stance": "stance", "CognitiveStyleMarker": "csm"}


def share(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def typed(name: str) -> Column:
    return F.coalesce(F.col("type") == name, F.lit(False))


def topology_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Listed nodes and implied endpoints, one row per (graph_id, id)."""
    return (
        nodes.select("graph_id", "id")
        .union(edges.select("graph_id", F.col("source")))
        .union(edges.select("graph_id", F.col("target")))
        .distinct()
    )


def distinct_arcs(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", "source", "target").distinct()


def one_per_id(nodes: DataFrame, *fields: str) -> DataFrame:
    """(graph_id, id, fields) with each id once: of rows that repeat an id the last position counts.

    Tables without ``pos`` have no order; the greatest values count there.
    """
    order = F.col("pos") if "pos" in nodes.columns else F.struct(*fields)
    return nodes.groupBy("graph_id", "id").agg(F.max_by(F.struct(*fields), order).alias("_f")).select("graph_id", "id", "_f.*")


def arc_ends(edges: DataFrame) -> DataFrame:
    """(graph_id, id, d): ends of distinct arcs at every node that has any. Both ends of an arc come from one row, so that
    edges that lie by graph stay where they are."""
    end = F.explode(F.array("source", "target")).alias("id")
    return distinct_arcs(edges).select("graph_id", end).groupBy("graph_id", "id").agg(F.count("*").alias("d"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In plus out degree on distinct arcs (a self-loop counts twice); isolated nodes have 0.

    Zero rows of the listed nodes and the counted arc ends go through the same aggregation.
    """
    zeros = nodes.select("graph_id", "id", F.lit(0).cast("long").alias("d"))
    return zeros.union(arc_ends(edges)).groupBy("graph_id", "id").agg(F.sum("d").alias("degree"))


def graph_sizes(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Listed nodes, topology nodes and distinct arcs per graph, with the scaled features."""
    listed = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    topology = topology_nodes(nodes, edges).groupBy("graph_id").agg(F.count("*").alias("n_topology"))
    arcs = distinct_arcs(edges).groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    sized = graphs.select("graph_id")
    for part in (listed, topology, arcs):
        sized = sized.join(part, "graph_id", "left")
    sized = sized.na.fill(0, ["n_nodes", "n_topology", "n_edges"])
    n_total = F.greatest(F.col("n_nodes"), F.lit(1))
    return sized.withColumns({"node_count_norm": n_total / 15.0, "edge_count_norm": F.col("n_edges") / 20.0})


def density(sizes: DataFrame) -> DataFrame:
    n = F.col("n_topology")
    return sizes.select(
        "graph_id", F.when(n < 2, 0.0).otherwise(F.col("n_edges") / (n * (n - 1))).alias("density")
    )


def degree_stats(degree: DataFrame) -> DataFrame:
    return degree.groupBy("graph_id").agg(
        (F.avg("degree") / 5.0).alias("avg_degree_norm"), (F.max("degree") / 10.0).alias("max_degree_norm")
    )


def type_counts() -> list[Column]:
    return [F.count_if(typed(t)).alias(f"n_{SHORT[t]}") for t in ENTITY_TYPES]


def type_profile(nodes: DataFrame) -> DataFrame:
    counted = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), *type_counts())
    shares = {f"{SHORT[t]}_ratio": F.col(f"n_{SHORT[t]}") / F.col("n_nodes") for t in ENTITY_TYPES}
    at_least_one = lambda name: F.greatest(F.col(name), F.lit(1))
    return counted.withColumns(shares).withColumns(
        {
            "construct_value_ratio": F.col("n_construct") / at_least_one("n_value") / 5.0,
            "stance_construct_ratio": F.col("n_stance") / at_least_one("n_construct") / 3.0,
        }
    )


def bipolarity_value() -> Column:
    """1 for a complete Construct, 0.5 for any other Construct, NULL for other nodes."""
    complete = F.coalesce(F.col("bipolarity_complete"), F.lit(False))
    return F.when(typed("Construct"), F.when(complete, 1.0).otherwise(0.5))


def bipolarity_score(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(
        F.coalesce(F.avg(bipolarity_value()), F.lit(0.0)).alias("bipolarity_score")
    )


def construct_degree(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    own = nodes.select("graph_id", "id", "type").join(degree, ["graph_id", "id"])
    of_construct = F.when(typed("Construct"), F.col("degree"))
    return own.groupBy("graph_id").agg(
        (F.coalesce(F.avg(of_construct), F.lit(0.0)) / 5.0).alias("mean_construct_degree"),
        (F.coalesce(F.max(of_construct), F.lit(0)) / 10.0).alias("max_construct_degree"),
    )


def valence_counts() -> list[Column]:
    return [F.count_if(typed("Stance") & (F.col("valence") == v)).alias(f"k_{v}") for v in VALENCES]


def valence_profile(nodes: DataFrame) -> DataFrame:
    """Valence shares among the Stances and the dominant valence; ties go to the earlier valence."""
    counted = nodes.groupBy("graph_id").agg(F.count_if(typed("Stance")).alias("n_stance"), *valence_counts())
    safe = F.greatest(F.col("n_stance"), F.lit(1))
    best = F.array_max(
        F.array(*[F.struct(F.col(f"k_{v}").alias("k"), F.lit(-i).alias("place")) for i, v in enumerate(VALENCES)])
    )
    dominant = F.when(F.col("n_stance") == 0, F.lit(len(VALENCES))).otherwise(-best["place"])
    out = counted.withColumn("_dominant", dominant)
    for v in VALENCES:
        out = out.withColumn(f"{v}_stance_frac", F.col(f"k_{v}") / safe)
    for i, v in enumerate([*VALENCES, "absent"]):
        out = out.withColumn(f"valence_{v}", (F.col("_dominant") == i).cast("double"))
    return out.drop("_dominant", *[f"k_{v}" for v in VALENCES])


def csm_profile(nodes: DataFrame) -> DataFrame:
    counted = nodes.groupBy("graph_id").agg(F.count_if(typed("CognitiveStyleMarker")).alias("n_csm"))
    return counted.select(
        "graph_id",
        "n_csm",
        (F.col("n_csm") > 0).cast("double").alias("csm_present"),
        (F.least(F.col("n_csm"), F.lit(2)) / 2.0).alias("csm_count_clipped"),
    )


def type_histogram(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Eleven shares on raw edges: four node types, six relations, and the mean degree 2E/N."""
    by_type = nodes.groupBy("graph_id").agg(F.count("*").alias("n"), *type_counts())
    by_relation = edges.groupBy("graph_id").agg(
        F.count("*").alias("m"), *[F.count_if(F.col("relation") == r).alias(f"m_{r}") for r in RELATIONS]
    )
    joined = graphs.select("graph_id").join(by_type, "graph_id", "left").join(by_relation, "graph_id", "left").na.fill(0)
    n, m = F.col("n"), F.col("m")
    return joined.select(
        "graph_id",
        *[share(F.col(f"n_{SHORT[t]}"), n).alias(f"h_{SHORT[t]}") for t in ENTITY_TYPES],
        *[share(F.col(f"m_{r}"), m).alias(f"h_{r.lower()}") for r in RELATIONS],
        share(2.0 * m, n).alias("h_mean_degree"),
    )


def node_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Type one-hot and degree on raw edges; dangling ends are ignored."""
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("id"))
    raw = ends.groupBy("graph_id", "id").agg(F.count("*").alias("degree"))
    return one_per_id(nodes, "type").join(raw, ["graph_id", "id"], "left").select(
        "graph_id",
        "id",
        *[typed(t).cast("double").alias(f"is_{SHORT[t]}") for t in ENTITY_TYPES],
        F.coalesce("degree", F.lit(0)).cast("double").alias("degree"),
    )


def edge_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between listed nodes with a relation one-hot; an unknown relation is all zeros."""
    known = nodes.select("graph_id", F.col("id").alias("_id")).distinct()
    inside = edges.join(known.withColumnRenamed("_id", "source"), ["graph_id", "source"], "left_semi").join(
        known.withColumnRenamed("_id", "target"), ["graph_id", "target"], "left_semi"
    )
    return inside.select(
        "graph_id",
        "source",
        "target",
        *[F.coalesce((F.col("relation") == r).cast("double"), F.lit(0.0)).alias(f"r_{r.lower()}") for r in RELATIONS],
    )
