"""The graph tables lie by graph: what is computed per graph or per node of a graph reads them where they are."""

import pytest

from pyspark.sql import functions as F

from conceptspark.fixtures import _STORED, CO_PARTITION, WRITERS, Corpus
from conceptspark.operators import documents, features, propagation
from conceptspark.operators.ranking import hash_order, rank_by_hash
from builders import plain_graphs

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, SF)


def test_per_graph_queries_do_not_shuffle(corpus):
    n, e, g = corpus.nodes, corpus.edges, corpus.graphs
    assert exchanges(features.type_histogram(n, e, g)) == 0
    assert exchanges(documents.assemble_graphs(n, e, g)) == 0
    assert exchanges(propagation.propagate(n, e, typed=True)) == 0
    assert exchanges(propagation.wl_histogram(propagation.wl_colours(n, e, typed=True))) == 0


def test_nodes_are_built_without_another_shuffle(corpus):
    assert [exchanges(p.repartition(corpus.buckets, "graph_id")) for p in corpus.node_parts()[:1]] == [0]


@pytest.mark.parametrize("name", ["e04_missing_from", "n05_bipolarity_by_cohort", "s04_explode_nodes", "s04_explode_edges", "n22_corpus_rubric"])
def test_ids_of_all_graphs_are_not_broadcast_for_their_small_files(spark, corpus, name):
    """Files take a fraction of what their rows take in memory: the ids, 16 bytes each, are above this limit, their files are not."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    n = corpus.graphs.count()
    assert corpus.nodes.count() and corpus.edges.count()
    spark.conf.set(limit, str(15 * n))
    try:
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert "BroadcastExchange" not in plan


def test_a_node_listed_twice_sends_and_keeps_its_state_once(spark):
    nodes, edges, _ = plain_graphs(spark, {1: (["c1", "c2"], [("c1", "c2")])})
    once = {r["id"]: r for r in propagation.propagate_nodes(nodes, edges, typed=True).collect()}
    twice = {r["id"]: r for r in propagation.propagate_nodes(nodes.union(nodes), edges, typed=True).collect()}
    assert once == twice and once["c2"]["is_construct"] == 3.0


def test_a_query_of_one_seed_ranks_that_seed_only(spark):
    corpus = Corpus(spark, SF)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(corpus.splits_of([42])) == rows(corpus.splits.where("seed = 42"))
    queries()["x09_mcnemar_exact"](spark, SF)
    assert (spark.sparkContext.applicationId, SF, "splits-42") in _STORED


def test_buckets_are_written_without_sorting_rows(spark, corpus):
    """A task holds one bucket, so its rows need no sort before they are written; the setting lasts for the writes only."""
    before, during = spark.conf.get(WRITERS), []

    def parts():
        during.append(int(spark.conf.get(WRITERS)))
        return [corpus.graphs.where("graph_id % 2 = 0"), corpus.graphs.where("graph_id % 2 = 1")]

    probe = corpus._bucketed("probe", parts)
    assert during == [2] and spark.conf.get(WRITERS) == before
    assert sorted(map(tuple, probe.collect()), key=str) == sorted(map(tuple, corpus.graphs.collect()), key=str)
    assert exchanges(probe.groupBy("graph_id").count()) == 0


def test_a_key_is_ranked_by_many_tasks(spark):
    """Also where joins may follow part of their keys, as they may in a session with a corpus."""
    wanted = {CO_PARTITION: "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = spark.range(2000).select((F.col("id") % 2).alias("k"), "id", hash_order(7, "id").alias("o"))
        ranked = rank_by_hash(rows, ["k"], "o").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for k in (0, 1):
        mine = sorted((r for r in ranked if r.k == k), key=lambda r: r.o)
        assert [r["rank"] for r in mine] == list(range(1, 1001)) and len({r.task for r in mine}) == 4


def test_buckets_follow_the_lines(spark):
    """A task of a bucket holds at most 60,000 order lines."""
    assert Corpus(spark, "/root/testdata/sf0.1").buckets >= 10
