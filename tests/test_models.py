import numpy as np
import pytest

from conceptspark.functions.vocabulary import TARGETS
from conceptspark.operators import experiments, models, propagation

from builders import plain_graphs


def rows(spark, n=120, classes=3, seed=0):
    """Separable classes; the last class is rare."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = i % classes if i % 4 else 0
        x = rng.normal(scale=0.3, size=3)
        x[y] += 3
        out.append((i, [float(v) for v in x], y))
    return spark.createDataFrame(out, "transcript_id long, features array<double>, label int")


@pytest.mark.parametrize("fit", [
    models.fit_logistic,
    lambda t: models.fit_random_forest(t, trees=5),
    lambda t: models.fit_gradient_boost(t, rounds=2),
    lambda t: models.fit_svm(t, max_iter=10),
    lambda t: models.fit_mlp(t, hidden=8, max_iter=60),
])
def test_separable_data_is_learnt(spark, fit):
    table = rows(spark).cache()
    fitted = fit(table)
    answers = fitted.predict(table)
    assert answers.where("yhat = label").count() / table.count() > 0.95
    proba = models.predict_proba(fitted, table).first()["proba"]
    assert len(proba) == 3 and sum(proba) == pytest.approx(1.0)


def test_balanced_weights(spark):
    table = spark.createDataFrame([("t", y) for y in [0] * 6 + [1] * 2], "target string, label int")
    got = {r["label"]: r["weight"] for r in experiments.class_weights(table).collect()}
    assert got == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}


def test_fusion_steps(spark):
    scores = spark.createDataFrame(
        [(1, "a", 0, 4.0), (1, "a", 1, 0.0), (1, "b", 0, 0.0), (1, "b", 1, 1.0)],
        "transcript_id long, modality string, class int, score double",
    )
    mean = {r["class"]: r["score"] for r in models.average_scores(scores).collect()}
    assert mean == {0: 2.0, 1: 0.5}
    g = np.exp(4) / (np.exp(4) + np.exp(1))
    gated = {r["class"]: r["score"] for r in models.gate_scores(scores).collect()}
    assert gated[0] == pytest.approx(4 * g) and gated[1] == pytest.approx(1 - g)
    assert models.pick_class(models.gate_scores(scores)).first()["yhat"] == 0


def test_grid_size(spark):
    grid = experiments.experiment_grid(spark)
    counts = {(r["target"], r["backend"]): r["n"] for r in experiments.grid_counts(grid).collect()}
    assert counts == {(t, b): n for t in TARGETS for b, n in (("neural", 21), ("classical", 24))}
    done = grid.limit(5)
    assert experiments.pending_experiments(grid, done).count() == 130


def test_failing_experiment_is_an_error_row(spark):
    table = rows(spark)
    labelled = table.selectExpr("'t' AS target", "1 AS seed", "transcript_id", "label", "IF(transcript_id % 3 = 0, 'test', 'train') AS split")
    data = {"text": table.select("transcript_id", "features")}
    configs = [dict(target="t", combo="text", architecture=a, seed=1) for a in ("logistic", "nonsense")]
    predictions, errors = models.run_experiments(data, labelled, configs, parallelism=1)
    assert predictions.count() == 40
    assert [e["architecture"] for e in errors] == ["nonsense"]


def test_importance_finds_the_used_feature(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(i % 2), float(rng.normal())], i % 2) for i in range(100)]
    table = spark.createDataFrame(data, "transcript_id long, features array<double>, label int")
    fitted = models.fit_logistic(table)
    out = models.top_features(models.permutation_importance(fitted, table, ["used", "noise"], repeats=4), 2).collect()
    assert out[0]["feature"] == "used" and out[0]["importance"] > 0.2
    assert abs(out[1]["importance"]) < 0.1


def test_every_graph_masks_a_node(spark):
    nodes, _, _ = plain_graphs(spark, {g: ([f"a{i}" for i in range(n)], []) for g, n in ((1, 1), (2, 10), (3, 20))})
    got = {r["graph_id"]: r["n"] for r in propagation.mask_node_types(nodes).where("masked").groupBy("graph_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {1: 1, 2: 2, 3: 3}  # round half to even: 1.5 → 2


def test_colours_tell_a_path_from_a_star(spark):
    path = (["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "d")])
    star = (["a", "b", "c", "d"], [("b", "a"), ("c", "a"), ("d", "a")])
    nodes, edges, _ = plain_graphs(spark, {1: path, 2: star, 3: star})
    colours = {}
    for r in propagation.wl_colours(nodes, edges).collect():
        colours.setdefault(r["graph_id"], []).append(r["colour"])
    assert sorted(colours[2]) == sorted(colours[3]) != sorted(colours[1])
