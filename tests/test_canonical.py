import numpy as np
import pytest

from conceptspark.operators import canonical, embeddings
from conceptspark.session import scratch_path

SCHEMA = "type string, id long, vector array<double>"


def cloud(seed=0, centres=6, per=12, dim=8, spread=0.35):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    return np.concatenate([c + spread * rng.normal(size=(per, dim)) for c in base])


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_linkage(x, threshold):
    """One merge at a time on the full distance matrix."""
    d = 1 - unit(x) @ unit(x).T
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > 1:
        best = min(
            ((np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        )
        if best[0] >= threshold:
            break
        _, i, j = best
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


def table(spark, x, type_="t"):
    return spark.createDataFrame([(type_, i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(canonical, "BLOCK", 10)
    monkeypatch.setattr(canonical, "QUERY_CHUNK", 25)


@pytest.mark.parametrize("max_dist", [0.1, 0.4])
def test_pairs_match_brute_force_over_many_cells(spark, small_blocks, max_dist):
    x = cloud()
    d = 1 - unit(x) @ unit(x).T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] < max_dist}
    got = canonical.cosine_pairs(table(spark, x), max_dist).collect()
    assert {(r["id"], r["other"]) for r in got} == want
    assert all(r["distance"] == pytest.approx(d[r["id"], r["other"]], abs=1e-9) for r in got)


@pytest.mark.parametrize("threshold", [0.15, 0.5])
def test_linkage_matches_brute_force(spark, small_blocks, threshold):
    x = cloud(seed=1, centres=5, per=8)
    got = {}
    for r in canonical.average_linkage(table(spark, x), threshold).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(c) for c in got.values()} == brute_linkage(x, threshold)


@pytest.mark.parametrize("finish", [12, 4096])
def test_linkage_is_the_same_wherever_a_task_takes_over(spark, small_blocks, finish, threshold=0.5):
    x = cloud(seed=2, centres=5, per=8)
    x = np.concatenate([x, x[:7], np.zeros((2, 8))])
    got = {}
    for r in canonical.average_linkage(table(spark, x), threshold, finish).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    want = brute_linkage(x[:-2], threshold) | {frozenset([47]), frozenset([48])}
    assert {frozenset(c) for c in got.values()} == want
    assert all(k == min(c) for k, c in got.items())


def test_few_rounds_of_search(spark, monkeypatch):
    calls = []
    search = canonical.similar
    monkeypatch.setattr(canonical, "similar", lambda *a, **k: calls.append(1) or search(*a, **k))
    x = cloud(seed=1, centres=5, per=8)
    assert canonical.average_linkage(table(spark, x), 0.5).count() == 40 and not calls
    # equal vectors do not merge pair by pair
    alike = canonical.average_linkage(table(spark, np.ones((30, 3))), 0.5, finish=0).collect()
    assert {r["cluster"] for r in alike} == {0} and len(calls) <= 2


def test_types_stay_apart_and_single_label_maps_to_itself(spark):
    vec = [1.0, 0.0]
    labels = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "type string, label string")
    vectors = spark.createDataFrame([("a", "x", vec), ("a", "y", vec), ("b", "x", vec)], "type string, label string, vector array<double>")
    got = {(r["type"], r["label"]): r["canonical"] for r in canonical.build_canonical_map(labels, vectors).collect()}
    assert got == {("a", "x"): "x", ("a", "y"): "x", ("b", "x"): "x"}


def test_map_must_be_locked(spark):
    mapping = spark.createDataFrame([("t", "a", "b")], "type string, label string, canonical string")
    path = scratch_path(spark, "lock")
    with pytest.raises(FileNotFoundError):
        canonical.load_locked_map(spark, path)
    canonical.lock_map(mapping, path, 0.35)
    assert canonical.load_locked_map(spark, path).count() == 1
    with pytest.raises(Exception):
        canonical.lock_map(mapping, path, 0.35)


def test_unknown_labels_stay(spark):
    nodes = spark.createDataFrame([(1, "t", "a"), (1, "t", "z"), (1, "u", "a"), (1, "t", None)], "graph_id long, type string, label string")
    mapping = spark.createDataFrame([("t", "a", "b")], "type string, label string, canonical string")
    got = sorted((r["type"], r["label"] or "") for r in canonical.apply_canonical(nodes, mapping).collect())
    assert got == [("t", ""), ("t", "b"), ("t", "z"), ("u", "a")]
    assert canonical.unmapped_labels(nodes, mapping).first()["n_unmapped"] == 2


def test_empty_graph_has_zero_label_bag(spark):
    nodes = spark.createDataFrame([(1, "t", "a"), (1, "t", "a"), (1, "t", "b")], "graph_id long, type string, label string")
    vectors = spark.createDataFrame([("t", "a", [3.0, 0.0]), ("t", "b", [0.0, 2.0])], "type string, label string, vector array<double>")
    graphs = spark.createDataFrame([(1,), (2,)], "graph_id long")
    got = {r["graph_id"]: r["features"] for r in embeddings.label_bag(nodes, vectors, graphs, 2).collect()}
    assert got[2] == [0.0, 0.0]
    assert got[1] == pytest.approx([2 / 3, 1 / 3])


def test_label_bag_keeps_every_node(spark):
    nodes = spark.createDataFrame([(1, "t", None), (1, "t", "a"), (2, "t", "")], "graph_id long, type string, label string")
    vectors = spark.createDataFrame([("t", None, [0.0, 2.0]), ("t", "a", [1.0, 0.0])], "type string, label string, vector array<double>")
    graphs = nodes.select("graph_id").distinct()
    got = {r["graph_id"]: r["features"] for r in embeddings.label_bag(nodes, vectors, graphs, 2).collect()}
    assert got == {1: [0.5, 0.5], 2: [0.0, 1.0]}
    with pytest.raises(Exception, match="no vector for label t a"):
        embeddings.label_bag(nodes, vectors.where("label IS NULL"), graphs, 2).collect()


def test_gaps_are_errors(spark):
    ids = spark.range(5).withColumnRenamed("id", "transcript_id")
    with pytest.raises(ValueError, match="3"):
        embeddings.assert_complete(ids, ids.where("transcript_id <> 3"), "stats")
    with pytest.raises(KeyError):
        embeddings.select_modalities({"a": ids}, ["b"])
