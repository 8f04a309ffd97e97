"""Message passing and colour refinement as rounds of join and aggregation over all graphs.

The number of rounds is a small constant, so each function is one lazy plan. Joins use (graph, node) as key
and every aggregation is a partial sum: a hub node never collects its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.functions.vocabulary import ENTITY_TYPES, RELATIONS
from conceptspark.operators.features import SHORT, node_features, one_per_id
from conceptspark.operators.ranking import hash_order, rank_by_hash

CHANNELS = [f"is_{SHORT[t]}" for t in ENTITY_TYPES] + ["degree"]


def passed_on(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, _own, relation, state columns): the state of a node once or more under its own id (``_own`` 1), and once per
    arc under the arc's target (``_own`` 0).

    Both come from one join that reads the state once and leaves tables that lie by graph where they are. Own rows repeat with the
    arcs of a node, so they are to be taken by a maximum.
    """
    arcs = edges.select("graph_id", F.col("source").alias("id"), "target", F.coalesce("relation", F.lit("")).alias("relation"))
    columns = [c for c in state.columns if c not in ("graph_id", "id")]
    end = F.explode(F.array(F.struct(F.col("id").alias("id"), F.lit(1).alias("_own")), F.struct(F.col("target").alias("id"), F.lit(0).alias("_own"))))
    return (
        state.where(F.col("graph_id").isNotNull() & F.col("id").isNotNull())
        .join(arcs, ["graph_id", "id"], "left")
        .select("graph_id", "relation", *columns, end.alias("_e"))
        .select("graph_id", "_e.id", "_e._own", "relation", *columns)
        .where(F.col("id").isNotNull())
    )


def propagate_nodes(
    nodes: DataFrame, edges: DataFrame, rounds: int = 2, typed: bool = False, own: DataFrame | None = None
) -> DataFrame:
    """Node states after ``rounds`` sum aggregations over in-neighbours and the node itself.

    Typed messages add the relation one-hot to the type channels and are cut at zero, so the same
    neighbour counts differently under different relations. Arcs from unlisted sources drop out of the join;
    unlisted targets have no state of their own and are dropped after the sum.
    """
    state = own if own is not None else node_features(nodes, edges)
    channels = list(CHANNELS)
    if typed:
        channels += [f"r_{r.lower()}" for r in RELATIONS]
        state = state.select("graph_id", "id", *CHANNELS, *[F.lit(0.0).alias(c) for c in channels if c not in CHANNELS])

    def message(c: str) -> Column:
        value = F.col(c)
        if typed and c.startswith("r_"):
            value = value + F.when(F.col("relation") == c[2:].upper(), 1.0).otherwise(0.0)
        sent = F.greatest(F.lit(0.0), value) if typed else value
        return F.coalesce(F.sum(F.when(F.col("_own") == 0, sent)), F.lit(0.0)) + F.max(F.when(F.col("_own") == 1, F.col(c)))

    for step in range(rounds):
        state = (
            passed_on(state, edges)
            .groupBy("graph_id", "id")
            .agg(F.max("_own").alias("_listed"), *[message(c).alias(c) for c in channels])
            .where("_listed = 1")
            .drop("_listed")
        )
        if own is not None and step == 0:  # given states of unlisted nodes are sent once and then dropped
            state = state.join(nodes.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi")
    return state


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int = 2, typed: bool = False) -> DataFrame:
    """Mean-pooled graph vector after ``rounds`` of propagation, one column per channel."""
    state = propagate_nodes(nodes, edges, rounds, typed)
    channels = [c for c in state.columns if c not in ("graph_id", "id")]
    return state.groupBy("graph_id").agg(*[F.avg(c).alias(f"p_{c}") for c in channels])


def digit_block(text: Column, start: int) -> Column:
    """Eight md5 digits as an integer; sums of these are a multiset hash."""
    return F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("long")


def wl_colours(nodes: DataFrame, edges: DataFrame, rounds: int = 2, typed: bool = False) -> DataFrame:
    """Weisfeiler-Lehman colour per node after ``rounds``.

    The multiset of neighbour colours enters through two 32-bit sums of hashed colours: equal multisets give
    equal sums, and the sums are aggregated map-side where a sorted neighbour list could not be.
    """
    state = one_per_id(nodes, "type").select("graph_id", "id", F.md5(F.coalesce("type", F.lit(""))).alias("colour"))
    is_own = F.col("_own") == 1
    for _ in range(rounds):
        token = F.concat_ws("|", F.col("relation"), F.col("colour")) if typed else F.col("colour")
        block = lambda start: F.when(is_own, F.lit(0).cast("long")).otherwise(digit_block(token, start))
        state = (
            passed_on(state, edges)
            .groupBy("graph_id", "id")
            .agg(
                F.max(F.when(is_own, F.col("colour"))).alias("colour"),
                F.sum(block(1)).alias("a"),
                F.sum(block(9)).alias("b"),
            )
            .where(F.col("colour").isNotNull())  # an unlisted target has no colour of its own
            .select(
                "graph_id",
                "id",
                F.md5(F.concat_ws("|", "colour", F.col("a").cast("string"), F.col("b").cast("string"))).alias("colour"),
            )
        )
    return state


def wl_histogram(colours: DataFrame, buckets: int = 64) -> DataFrame:
    """Colour counts per graph folded into ``buckets`` hash buckets, as long rows."""
    bucket = (F.conv(F.substring("colour", 1, 8), 16, 10).cast("long") % buckets).alias("bucket")
    return colours.select("graph_id", bucket).groupBy("graph_id", "bucket").agg(F.count("*").alias("n"))


def mask_node_types(nodes: DataFrame, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """Mark max(1, round(ratio·n)) nodes per graph by hash order; half rounds to even."""
    sizes = nodes.groupBy("graph_id").agg(
        F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(ratio)).cast("long")).alias("_k")
    )
    keyed = nodes.withColumn("_order", hash_order(seed, F.concat_ws("|", F.col("graph_id").cast("string"), "id")))
    return (
        rank_by_hash(keyed, ["graph_id"], "_order", "_rank", tie="id")
        .join(sizes, "graph_id")
        .withColumn("masked", F.col("_rank") <= F.col("_k"))
        .drop("_order", "_rank", "_k")
    )
