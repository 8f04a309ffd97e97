import math
import random

import pytest
from pyspark.sql import functions as F

from conceptspark.functions import stats
from conceptspark.operators import evaluation, hypothesis, labels, ranking


def test_t_quantiles_match_published_tables():
    # published two-sided 5 % points
    for df, want in {1: 12.706, 2: 4.303, 5: 2.571, 9: 2.262, 10: 2.228, 30: 2.042, 120: 1.980}.items():
        assert stats.t_quantile_975(df) == pytest.approx(want, abs=6e-4)


def test_tails():
    assert stats.chi2_tail(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert stats.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    assert stats.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    for b, c in [(0, 0), (1, 5), (10, 10), (3, 40), (700, 650)]:
        n = b + c
        want = min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
        assert stats.binomial_two_sided(b, c) == pytest.approx(want)


def long_rows(groups):
    return [("m", g, float(v)) for g, values in groups.items() for v in values]


def ranks(values):
    order = sorted(values)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in values]


@pytest.mark.parametrize(
    "groups",
    [
        {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8, 9], "c": [2.5, 3.5]},
        {"a": [0, 0, 1, 1, -3], "b": [0, 1, 1, 2, 2], "c": [1, 1, 0, -3]},
        {"a": [random.Random(1).randint(-5, 5) / 3 for _ in range(40)], "b": [random.Random(2).randint(-5, 5) / 3 for _ in range(50)]},
    ],
)
def test_rank_tests_against_brute_force(spark, groups):
    df = spark.createDataFrame(long_rows(groups), "metric string, grp string, value double")
    values = [v for g in groups.values() for v in g]
    r = ranks(values)
    n, pos, s = len(values), 0, 0.0
    for g in groups.values():
        s += sum(r[pos : pos + len(g)]) ** 2 / len(g)
        pos += len(g)
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    row = hypothesis.kruskal_wallis(df).first()
    assert row["h"] == pytest.approx(h)
    if len(groups) == 3:
        assert row["p_value"] == pytest.approx(math.exp(-h / 2))
    for row in hypothesis.mann_whitney(df).collect():
        a, b = groups[row["a"]], groups[row["b"]]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        delta = sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b))
        assert row["u"] == pytest.approx(u)
        assert row["cliffs_delta"] == pytest.approx(delta)
        assert 0 <= row["p_value"] <= 1


def test_all_equal_values_have_no_spread(spark):
    df = spark.createDataFrame(long_rows({"a": [1, 1], "b": [1, 1, 1]}), "metric string, grp string, value double")
    row = hypothesis.mann_whitney(df).first()
    assert row["z"] is None and row["cliffs_delta"] == 0
    assert hypothesis.eta_squared(df).first()["eta_squared"] == 0


def test_running_total_spreads_a_narrow_span(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), (1 + F.col("id") / 1e6).alias("v"), F.lit(1).alias("w"))
    df = df.unionByName(spark.createDataFrame([("k", None, 1)], df.schema))
    got = ranking.running_total(df, ["k"], "v", "w", "t")
    assert [r["t"] for r in got.orderBy("v").collect()] == list(range(1, 2001))


def test_running_total_over_many_buckets(spark):
    rng = random.Random(3)
    values = sorted({rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6) for _ in range(500)} | {0.0})
    rows = [("k", v, i % 7 + 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double, w long")
    got = [r["t"] for r in ranking.running_total(df, ["k"], "v", "w", "t").orderBy("v").collect()]
    want, total = [], 0
    for _, _, w in rows:
        total += w
        want.append(total)
    assert got == want


def test_consecutive_pairs_across_buckets(spark):
    rows = [(1, x) for x in (3, 3, 9, 20, 21, 70)] + [(2, 5)]
    df = spark.createDataFrame(rows, "g long, x long")
    got = sorted((r["g"], r["b"], r["x"]) for r in ranking.consecutive_pairs(df, ["g"], "x", "b", width=10).collect())
    assert got == [(1, 3, 9), (1, 9, 20), (1, 20, 21), (1, 21, 70)]


@pytest.mark.parametrize(
    "deltas,want",
    [
        ([0.05, 0.06, 0.04, 0.05, 0.055, 0.045, 0.05, 0.06, 0.04, 0.05], "PASS"),
        ([0.1, -0.1, 0.08, -0.07, 0.09, -0.1, 0.05, -0.04, 0.1, -0.08], "FAIL"),
        ([0.005, 0.006, 0.004, 0.005, 0.006, 0.004, 0.005, 0.005, 0.006, 0.004], "FAIL"),
        ([-0.05, -0.06, -0.04, -0.05, -0.055, -0.045, -0.05, -0.06, -0.04, -0.05], "FAIL"),
    ],
)
def test_verdict_rule(spark, deltas, want):
    df = spark.createDataFrame([("t", i, d) for i, d in enumerate(deltas)], "target string, seed int, delta double")
    assert evaluation.verdict(evaluation.seed_ci(df, ["target"], "delta")).first()["verdict"] == want


def test_confusion_and_macro_f1(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 1)]
    df = spark.createDataFrame([("c", y, p) for y, p in rows], "cfg string, y int, yhat int")
    cells = {(r["y"], r["yhat"]): r["n"] for r in evaluation.confusion_matrix(df, ["cfg"]).collect()}
    assert len(cells) == 9 and cells[(2, 2)] == 0 and cells[(0, 1)] == 1
    # class 0 → 2/3, class 1 → 1/2, class 2 → 0
    assert evaluation.macro_f1(df, ["cfg"]).first()["macro_f1"] == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)


def test_agreement_consensus_kappa(spark):
    schema = "transcript_id string, label string"
    a = spark.createDataFrame([("1", "low"), ("2", "med"), ("3", "high"), ("9", "low")], schema)
    b = spark.createDataFrame([("1", "low"), ("2", "med"), ("3", "med")], schema)
    row = labels.agreement(a, b).first()
    assert (row["n_common"], row["n_agree"]) == (3, 2)
    # po = 2/3, pe = (1·1 + 1·2)/9
    assert labels.cohen_kappa(a, b).first()["kappa"] == pytest.approx((2 / 3 - 1 / 3) / (1 - 1 / 3))
    none = spark.createDataFrame([], schema)
    assert labels.merge_consensus(a, b, none).count() == 2
    judged = spark.createDataFrame([("3", "high")], schema)
    got = {r["transcript_id"]: (r["label"], r["source"]) for r in labels.merge_consensus(a, b, judged).collect()}
    assert got["3"] == ("high", "adjudicated") and got["1"] == ("low", "consensus")
    same = spark.createDataFrame([("1", "low"), ("2", "low")], schema)
    assert labels.cohen_kappa(same, same).first()["kappa"] is None
    assert labels.cohen_kappa(same, none).first()["kappa"] is None


@pytest.mark.parametrize("a,b", [(1, 1), (1, 7), (2, 5), (3, 3), (4, 6), (5, 5), (8, 4)])
def test_exact_u_equals_enumeration(spark, a, b):
    """All ways to deal the ranks to both groups, and the test itself for one of them."""
    from itertools import combinations

    from conceptspark.functions import stats

    us = [sum(ranks) - a * (a + 1) // 2 for ranks in combinations(range(1, a + b + 1), a)]
    for u in range(a * b + 1):
        far = max(u, a * b - u)
        assert stats.exact_u_two_sided(u, a, b) == pytest.approx(min(1.0, 2 * sum(x >= far for x in us) / len(us)))
    rng = random.Random(a * b)
    values = rng.sample(range(100), a + b)
    df = spark.createDataFrame(long_rows({"a": values[:a], "b": values[a:]}), "metric string, grp string, value double")
    row = hypothesis.mann_whitney(df).first()
    assert row["p_value"] == pytest.approx(stats.exact_u_two_sided(row["u"], a, b))


def test_exact_u_of_a_large_partner_and_ties(spark):
    from conceptspark.functions import stats

    assert int(stats.u_tails(8, 400)[0]) == math.comb(408, 8)
    tied = spark.createDataFrame(long_rows({"a": [1, 2, 2], "b": [2, 3, 4]}), "metric string, grp string, value double")
    row = hypothesis.mann_whitney(tied).first()
    assert row["p_value"] == pytest.approx(math.erfc(row["z"] / math.sqrt(2)))
    many = spark.createDataFrame(long_rows({"a": list(range(0, 40, 2)), "b": list(range(1, 41, 2))}), "metric string, grp string, value double")
    row = hypothesis.mann_whitney(many).first()
    assert row["p_value"] == pytest.approx(min(1.0, math.erfc(row["z"] / math.sqrt(2))))


def test_exact_medians_over_many_ranges(spark):
    import statistics

    rng = random.Random(6)
    groups = {"one": [3.5], "two": [1.0, 4.0], "alike": [2.0] * 501 + [7.0] * 500, "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-5, 9) for _ in range(400)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r["g"]: r["median"] for r in ranking.exact_medians(df, ["g"], "v").collect()}
    assert found == {g: pytest.approx(statistics.median(values)) for g, values in groups.items()}
