"""Corpus reports and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.operators.evaluation import class_report
from conceptspark.operators import features, hypothesis, reports, responses, topology, transcripts
from conceptspark.plans.evaluation import SCORES, scores
from conceptspark.plans.features import rounded
from conceptspark.plans.graphs import VIOLATIONS, violations
from conceptspark.plans.registry import query
from conceptspark.plans.topology import PATHS
from conceptspark.session import cut_lineage

WORDS = "verif|systematic|evidence|empirical|analytic|rigour|rigor|precision|cross-check|cross-referenc|source check"
COHORTS = ["workforce", "creatives", "scientists"]
HYPOTHESES = {"cv_ratio": "H1", "neg_frac": "H2", "bipolarity_complete_frac": "H3", "csm_count": "H4"}
EIGHT = [
    "cv_ratio", "neg_frac", "bipolarity_complete_frac", "csm_count", "csm_verify_frac", "n_total", "n_edges", "has_conflict",
]

METRICS = {
    **VIOLATIONS,
    "fx_metrics": f"""
        SELECT g.graph_id, g.split, n_total, n_edges, n_construct, n_value, n_stance, n_csm,
            n_construct / greatest(n_value, 1) AS cv_ratio, v_n / greatest(n_stance, 1) AS neg_frac,
            v_p AS valence_positive, v_n AS valence_negative, v_m AS valence_mixed, v_a AS valence_ambivalent,
            coalesce(bip, 0) AS bipolarity_score, coalesce(whole, 0) AS bipolarity_complete_frac,
            n_csm AS csm_count, (n_csm > 0)::DOUBLE AS csm_present, n_verify / greatest(n_csm, 1) AS csm_verify_frac,
            has_conflict, coalesce(ai_adoption, 'unknown') AS ai_adoption, coalesce(career_stage, 'unknown') AS career_stage
        FROM fx_graphs g JOIN (
            SELECT graph_id, count(*) AS n_total, count(*) FILTER (type = 'Construct') AS n_construct,
                count(*) FILTER (type = 'Value') AS n_value, count(*) FILTER (type = 'Stance') AS n_stance,
                count(*) FILTER (type = 'CognitiveStyleMarker') AS n_csm,
                count(*) FILTER (valence = 'positive') AS v_p, count(*) FILTER (valence = 'negative') AS v_n,
                count(*) FILTER (valence = 'mixed') AS v_m, count(*) FILTER (valence = 'ambivalent') AS v_a,
                avg(CASE WHEN bipolarity_complete THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) FILTER (type = 'Construct') AS bip,
                avg(bipolarity_complete::INT) FILTER (type = 'Construct') AS whole,
                count(*) FILTER (type = 'CognitiveStyleMarker' AND regexp_matches(lower(label), '{WORDS}')) AS n_verify
            FROM fx_nodes GROUP BY 1) USING (graph_id)
        JOIN (SELECT graph_id, count(*) AS n_edges, max((relation = 'CONFLICTS_WITH')::DOUBLE) AS has_conflict
            FROM fx_edges GROUP BY 1) USING (graph_id)
        LEFT JOIN fx_demographics d ON d.transcript_id = g.graph_id""",
    "fx_batch": """
        SELECT g.graph_id, g.split, g.extraction_model, n_nodes, n_edges, coalesce(v, 0) AS n_violations, coalesce(u, 0) AS n_unknown
        FROM fx_graphs g
        JOIN (SELECT graph_id, count(*) AS n_nodes FROM fx_nodes GROUP BY 1) USING (graph_id)
        JOIN (SELECT graph_id, count(*) AS n_edges FROM fx_edges GROUP BY 1) USING (graph_id)
        LEFT JOIN (SELECT graph_id, count(*) AS v, count(*) FILTER (rule = 'V13') AS u FROM fx_violations GROUP BY 1)
            USING (graph_id)""",
    "fx_inferential": """
        SELECT g.graph_id, g.split, coalesce(s, 0) AS s, coalesce(i, 0) AS i, coalesce(s, 0) + coalesce(i, 0) AS k
        FROM fx_graphs g LEFT JOIN (SELECT graph_id, count(*) FILTER (relation = 'SUBSUMES') AS s,
            count(*) FILTER (relation = 'IMPLIES') AS i FROM fx_edges GROUP BY 1) USING (graph_id)""",
    "fx_long": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, split, ai_adoption, CAST({m} AS DOUBLE) AS value FROM fx_metrics" for m in EIGHT
    ),
}


def metrics(c):
    return reports.graph_metrics(c.nodes, c.edges, c.graphs, c.demographics)


def long_by(c, group: str, names: list[str], keep=None):
    """Metric rows; the per-graph table is written once because several aggregations read it."""
    return cut_lineage(hypothesis.melt(metrics(c), group, names, keep))


def sizes(c):
    return responses.batch_sizes(c.nodes, c.edges, violations(c), c.graphs)


@query(
    "n01_graph_metrics",
    """SELECT * REPLACE (round(cv_ratio, 6) AS cv_ratio, round(neg_frac, 6) AS neg_frac,
        round(bipolarity_score, 6) AS bipolarity_score, round(bipolarity_complete_frac, 6) AS bipolarity_complete_frac,
        round(csm_verify_frac, 6) AS csm_verify_frac) FROM fx_metrics""",
    METRICS,
)
def _(c):
    return rounded(metrics(c))


@query(
    "n02_cohort_summary",
    "SELECT split, count(*) AS n, "
    + ", ".join(
        f"round(avg({m}), 6) AS mean_{m}, round(median({m}), 6) AS median_{m}, round(stddev_samp({m}), 6) AS std_{m},"
        f" round(sum({m})::DOUBLE, 4) AS sum_{m}"
        for m in ("cv_ratio", "neg_frac", "n_total", "csm_count")
    )
    + " FROM fx_metrics GROUP BY 1",
    METRICS,
)
def _(c):
    out = reports.cohort_summary(metrics(c), ["cv_ratio", "neg_frac", "n_total", "csm_count"])
    return rounded(out).select(
        *[F.round(x, 4).alias(x) if x.startswith("sum_") else F.col(x) for x in out.columns]
    )


ROLLUP = """SELECT coalesce(split, 'ALL') AS split, count(*) AS n_graphs, {} FROM {} GROUP BY ROLLUP (split)"""


@query(
    "n03_corpus_overview",
    ROLLUP.format(
        """round(avg(n_nodes), 6) AS mean_nodes, round(avg(n_edges), 6) AS mean_edges,
        count(*) FILTER (n_violations > 0) AS n_with_violations""",
        "fx_batch",
    ),
    METRICS,
)
def _(c):
    return rounded(reports.corpus_overview(sizes(c), c.graphs))


@query(
    "n04_valence_distribution",
    """SELECT split, valence, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM (
        SELECT split, coalesce(valence, 'missing') AS valence, count(*) AS n FROM fx_nodes JOIN fx_graphs USING (graph_id)
        WHERE type = 'Stance' GROUP BY ALL)""",
)
def _(c):
    return rounded(reports.valence_distribution(c.nodes, c.graphs))


@query(
    "n05_bipolarity_by_cohort",
    """SELECT split, count(*) AS n_graphs, round(avg(f), 6) AS mean_complete FROM (
        SELECT graph_id, avg(bipolarity_complete::INT) AS f FROM fx_nodes WHERE type = 'Construct' GROUP BY 1)
    JOIN fx_graphs USING (graph_id) GROUP BY 1""",
)
def _(c):
    return rounded(reports.bipolarity_by_cohort(c.nodes, c.graphs))


@query(
    "n06_centrality_by_cohort",
    """SELECT split, round(avg(md), 6) AS mean_degree, round(avg(coalesce(vd, 0)), 6) AS mean_value_degree,
        round(avg(mean_betweenness), 6) AS mean_betweenness, round(avg(max_betweenness), 6) AS max_betweenness
    FROM (SELECT graph_id, avg(degree) AS md, avg(degree) FILTER (type = 'Value') AS vd
        FROM fx_degrees LEFT JOIN fx_nodes USING (graph_id, id) GROUP BY 1)
    JOIN fx_central USING (graph_id) JOIN fx_graphs USING (graph_id) GROUP BY 1""",
    PATHS,
)
def _(c):
    shape = topology.graph_topology(c.nodes, c.edges)
    return rounded(reports.centrality_by_cohort(c.nodes, features.degrees(c.nodes, c.edges), shape, c.graphs))


@query(
    "n07_relation_mix",
    """SELECT split, round(avg(a / m), 6) AS serves, round(avg(b / m), 6) AS expressed_via, round(avg(d / m), 6) AS modulated_by,
        round(avg(e / m), 6) AS conflicts_with, round(avg((e > 0)::INT), 6) AS conflict_prevalence
    FROM (SELECT graph_id, count(*) AS m, count(*) FILTER (relation = 'SERVES') AS a,
        count(*) FILTER (relation = 'EXPRESSED_VIA') AS b, count(*) FILTER (relation = 'MODULATED_BY') AS d,
        count(*) FILTER (relation = 'CONFLICTS_WITH') AS e FROM fx_edges GROUP BY 1)
    JOIN fx_graphs USING (graph_id) GROUP BY 1""",
)
def _(c):
    return rounded(reports.relation_mix(c.edges, c.graphs))


@query(
    "n08_histogram",
    """SELECT split, least(floor((n_total - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n
    FROM fx_metrics JOIN (SELECT split, min(n_total) AS lo, max(n_total) AS hi FROM fx_metrics GROUP BY 1) USING (split)
    GROUP BY ALL""",
    METRICS,
)
def _(c):
    return reports.histogram(metrics(c), "split", "n_total")


@query("n09_csm_verify_fraction", "SELECT graph_id, round(csm_verify_frac, 6) AS csm_verify_frac FROM fx_metrics", METRICS)
def _(c):
    return rounded(reports.csm_verify_fraction(c.nodes))


RANKS = {
    **METRICS,
    "fx_ranked": """
        SELECT metric, split, value, rank() OVER (PARTITION BY metric ORDER BY value)
            + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS r,
            count(*) OVER (PARTITION BY metric, value) AS t FROM fx_long""",
    "fx_kruskal": """
        SELECT metric, (12.0::DOUBLE / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h,
            exp(-h / 2) AS p_value, 2::BIGINT AS df
        FROM (SELECT metric, sum(k)::DOUBLE AS n, sum(rs * rs / k) AS s FROM (
            SELECT metric, split, count(*) AS k, sum(r) AS rs FROM fx_ranked GROUP BY ALL) GROUP BY 1)
        JOIN (SELECT metric, sum(t::DOUBLE * t - 1) AS ties FROM fx_ranked GROUP BY 1) USING (metric)""",
    "fx_eta": """
        SELECT metric, coalesce(sum((m - g) ** 2) / nullif(sum((value - g) ** 2), 0), 0) AS eta_squared FROM (
            SELECT metric, value, avg(value) OVER (PARTITION BY metric, split) AS m,
                avg(value) OVER (PARTITION BY metric) AS g FROM fx_long) GROUP BY 1""",
    # pairs of cohorts and the two adoption arms as one list of tests
    "fx_two": """
        SELECT metric, a, b, within, sum((g = a)::INT)::DOUBLE AS n1, sum((g = b)::INT)::DOUBLE AS n2,
            sum(CASE WHEN g = a THEN r END) AS r1, sum(t::DOUBLE * t - 1) AS ties
        FROM (SELECT metric, a, b, within, g, rank() OVER (PARTITION BY metric, a, b, within ORDER BY value)
                + (count(*) OVER (PARTITION BY metric, a, b, within, value) - 1) / 2.0::DOUBLE AS r,
                count(*) OVER (PARTITION BY metric, a, b, within, value) AS t
            FROM (SELECT metric, p.a, p.b, '' AS within, split AS g, value FROM fx_long JOIN (VALUES ('creatives', 'scientists'),
                    ('creatives', 'workforce'), ('scientists', 'workforce')) p(a, b) ON split IN (p.a, p.b)
                UNION ALL SELECT metric, 'integrated', 'tool_user', '', ai_adoption, value FROM fx_long
                    WHERE ai_adoption IN ('integrated', 'tool_user')
                UNION ALL SELECT metric, 'integrated', 'tool_user', split, ai_adoption, value FROM fx_long
                    WHERE ai_adoption IN ('integrated', 'tool_user'))) GROUP BY ALL""",
    "fx_mwu": """
        SELECT metric, a, b, within, n1::BIGINT AS n_a, n2::BIGINT AS n_b, r1 - n1 * (n1 + 1) / 2 AS u,
            (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * (n1 + n2 + 1
                - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z,
            2 * u / (n1 * n2) - 1 AS cliffs_delta FROM fx_two""",
    "fx_means": "SELECT metric, "
    + ", ".join(f"avg(value) FILTER (split = '{g}') AS mean_{g}" for g in COHORTS)
    + ", avg(value) FILTER (ai_adoption = 'tool_user') AS mean_tool_user,"
    " avg(value) FILTER (ai_adoption = 'integrated') AS mean_integrated FROM fx_long GROUP BY 1",
}


@query(
    "n10_kruskal_wallis",
    "SELECT metric, round(h, 6) AS h, df, round(p_value, 6) AS p_value FROM fx_kruskal",
    RANKS,
)
def _(c):
    return rounded(hypothesis.kruskal_wallis(long_by(c, "split", EIGHT)))


PAIR_SQL = """SELECT metric, a, b, n_a, n_b, round(u, 6) AS u, round(z, 6) AS z, round(cliffs_delta, 6) AS cliffs_delta
    FROM fx_mwu WHERE within = '' AND a {} 'integrated'"""


@query("n11_mann_whitney_u", PAIR_SQL.format("="), RANKS)
def _(c):
    arms = long_by(c, "ai_adoption", EIGHT).where(F.col("grp").isin("tool_user", "integrated"))
    return rounded(hypothesis.mann_whitney(arms).drop("p_value"))


@query("n12_pairwise_posthoc", PAIR_SQL.format("<>"), RANKS)
def _(c):
    tests = hypothesis.pairwise_posthoc(long_by(c, "split", EIGHT))
    return rounded(tests.drop("p_value", "p_bonferroni", "significant"))


@query("n13_cliffs_delta", "SELECT metric, a, b, round(cliffs_delta, 6) AS cliffs_delta FROM fx_mwu WHERE within = '' AND a <> 'integrated'", RANKS)
def _(c):
    return rounded(hypothesis.mann_whitney(long_by(c, "split", EIGHT)).select("metric", "a", "b", "cliffs_delta"))


@query("n14_eta_squared", "SELECT metric, round(eta_squared, 6) AS eta_squared FROM fx_eta", RANKS)
def _(c):
    return rounded(hypothesis.eta_squared(long_by(c, "split", EIGHT)))


@query(
    "n15_hypothesis_table",
    """SELECT metric, CASE metric WHEN 'cv_ratio' THEN 'H1' WHEN 'neg_frac' THEN 'H2'
            WHEN 'bipolarity_complete_frac' THEN 'H3' ELSE 'H4' END AS hypothesis,
        round(h, 6) AS h, df, round(p_value, 6) AS p_value, p_value < 0.05 AS significant,
        round(eta_squared, 6) AS eta_squared, round(mean_workforce, 6) AS mean_workforce,
        round(mean_creatives, 6) AS mean_creatives, round(mean_scientists, 6) AS mean_scientists
    FROM fx_kruskal JOIN fx_eta USING (metric) JOIN fx_means USING (metric)
    WHERE metric IN ('cv_ratio', 'neg_frac', 'bipolarity_complete_frac', 'csm_count')""",
    RANKS,
)
def _(c):
    return rounded(hypothesis.hypothesis_table(long_by(c, "split", list(HYPOTHESES)), COHORTS, HYPOTHESES))


@query(
    "n16_two_group_comparison",
    """SELECT metric, round(mean_tool_user, 6) AS mean_tool_user, round(mean_integrated, 6) AS mean_integrated,
        round(-cliffs_delta, 6) AS cliffs_delta, round(abs(cliffs_delta), 6) AS abs_delta, round(z, 6) AS z
    FROM fx_mwu JOIN fx_means USING (metric) WHERE within = '' AND a = 'integrated'""",
    RANKS,
)
def _(c):
    out = hypothesis.two_group_comparison(long_by(c, "ai_adoption", EIGHT), "tool_user", "integrated")
    return rounded(out.drop("p_value", "significant"))


@query(
    "n17_effect_size_comparison",
    """SELECT metric, round(eta_squared, 6) AS eta_squared, round(p_value, 6) AS cohort_p,
        round(abs(cliffs_delta), 6) AS abs_cliffs_delta
    FROM fx_eta JOIN fx_kruskal USING (metric) JOIN fx_mwu USING (metric) WHERE within = '' AND a = 'integrated'
        AND metric IN ('cv_ratio', 'neg_frac', 'bipolarity_complete_frac', 'csm_count')""",
    RANKS,
)
def _(c):
    table = cut_lineage(metrics(c))
    by_cohort = hypothesis.melt(table, "split", list(HYPOTHESES))
    by_arm = hypothesis.melt(table, "ai_adoption", list(HYPOTHESES))
    out = hypothesis.effect_size_comparison(by_cohort, by_arm, "tool_user", "integrated")
    return rounded(out.drop("arm_p"))


@query(
    "n18_within_group_effects",
    """SELECT m.metric, m.within AS split, n_a, n_b, round(z, 6) AS z, round(-cliffs_delta, 6) AS cliffs_delta,
        round(mean_tool_user, 6) AS mean_tool_user, round(mean_integrated, 6) AS mean_integrated
    FROM fx_mwu m JOIN (SELECT metric, split, avg(value) FILTER (ai_adoption = 'tool_user') AS mean_tool_user,
        avg(value) FILTER (ai_adoption = 'integrated') AS mean_integrated FROM fx_long GROUP BY ALL) g
        ON g.metric = m.metric AND g.split = m.within
    WHERE m.within <> '' AND m.metric = 'cv_ratio' AND n_a + n_b >= 10 AND least(n_a, n_b) >= 2""",
    RANKS,
)
def _(c):
    long = long_by(c, "ai_adoption", ["cv_ratio"], keep=["split"])
    out = hypothesis.within_group_effects(long, "split", "tool_user", "integrated")
    return rounded(out.select("metric", "split", "n_a", "n_b", "z", "cliffs_delta", "mean_tool_user", "mean_integrated"))


@query(
    "n19_quality_report",
    ROLLUP.format(
        """round(avg(n_nodes), 6) AS mean_nodes, round(stddev_pop(n_nodes), 6) AS sd_nodes, round(avg(n_edges), 6) AS mean_edges,
        round(stddev_pop(n_edges), 6) AS sd_edges, count(*) FILTER (n_violations > 0) AS n_with_violations,
        sum(n_violations)::BIGINT AS n_violations""",
        "fx_batch",
    ),
    METRICS,
)
def _(c):
    return rounded(reports.quality_report(sizes(c), c.graphs))


@query(
    "n19_relation_distribution",
    """SELECT split, 'relation' AS kind, relation AS name, count(*) AS n FROM fx_edges JOIN fx_graphs USING (graph_id) GROUP BY ALL
    UNION ALL SELECT split, 'grounding', coalesce(grounding, 'MISSING'), count(*) FROM fx_edges
        JOIN fx_graphs USING (graph_id) GROUP BY ALL
    UNION ALL SELECT split, 'inferential grounding', coalesce(grounding, 'MISSING'), count(*) FROM fx_edges
        JOIN fx_graphs USING (graph_id) WHERE relation IN ('SUBSUMES', 'IMPLIES') GROUP BY ALL""",
)
def _(c):
    return reports.relation_distribution(c.edges, c.graphs)


@query(
    "n20_inferential_profile",
    ROLLUP.format(
        """round(avg(k), 6) AS mean_inferential, round(stddev_pop(k), 6) AS sd_inferential,
        round(avg((k = 0)::INT), 6) AS zero_share, round(avg((s = 1 AND i = 1)::INT), 6) AS one_plus_one_share""",
        "fx_inferential",
    ),
    METRICS,
)
def _(c):
    return rounded(reports.inferential_profile(c.edges, c.graphs))


@query("n20_inferential_distribution", "SELECT k AS n_inferential, count(*) AS n_graphs FROM fx_inferential GROUP BY 1", METRICS)
def _(c):
    return reports.inferential_distribution(c.edges, c.graphs)


@query(
    "n21_size_confound",
    """SELECT count(*) AS n, round(corr(n_edges, h), 6) AS r, abs(corr(n_edges, h)) > 0.5 AS flag FROM fx_batch
    JOIN (SELECT transcript_id AS graph_id, count(*) FILTER (speaker = 'Human') AS h FROM fx_turns GROUP BY 1) USING (graph_id)""",
    METRICS,
)
def _(c):
    counts = transcripts.turn_counts(transcripts.parse_turns(c.transcripts))
    edge_counts = c.edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return rounded(reports.size_confound(edge_counts, counts))


@query(
    "n22_corpus_rubric",
    """SELECT extraction_model, count(*) AS n_graphs, round(avg(n_nodes), 6) AS mean_nodes,
        round(stddev_pop(n_nodes) / avg(n_nodes), 6) AS cv_nodes, count(*) FILTER (n_violations = 0) AS n_clean,
        round(avg(bip), 6) AS mean_bipolarity, sum(n_violations)::BIGINT AS n_violations,
        sum(n_unknown)::BIGINT AS n_unknown_relations, round(avg(n_edges), 6) AS mean_edges,
        concat(min(n_nodes), '-', max(n_nodes)) AS node_range, concat(min(n_edges), '-', max(n_edges)) AS edge_range
    FROM fx_batch JOIN (SELECT graph_id, avg(CASE WHEN bipolarity_complete THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)
        FILTER (type = 'Construct') AS bip FROM fx_nodes GROUP BY 1) USING (graph_id) GROUP BY 1""",
    METRICS,
)
def _(c):
    found = violations(c)
    batch = responses.batch_sizes(c.nodes, c.edges, found, c.graphs)
    return rounded(reports.corpus_rubric(c.nodes, batch, found, c.graphs))


@query(
    "n23_inspect_graph",
    """SELECT 'node' AS kind, id, type AS what, substr(label, 1, 40) AS label,
        array_to_string(list_concat(list_concat(coalesce(grounding_spans, []), coalesce(grounding_spans_positive, [])),
            coalesce(grounding_spans_negative, [])), ' | ') AS detail FROM fx_nodes WHERE graph_id = 7
    UNION ALL SELECT 'edge', concat(source, '->', target), relation, coalesce(rationale, ''), coalesce(grounding, '')
        FROM fx_edges WHERE graph_id = 7""",
)
def _(c):
    return reports.inspect_graph(c.nodes, c.edges, 7)


def route_scores(c):
    at = scores(c, [42]).where("split = 'test'")
    return at.select(F.concat_ws("/", "target", "combo", "architecture").alias("route"), "macro_f1")


@query(
    "n24_route_table",
    """SELECT concat_ws('/', target, combo, architecture) AS route, round(macro_f1, 6) AS macro_f1 FROM fx_f1
    WHERE split = 'test' AND seed = 42""",
    SCORES,
)
def _(c):
    return rounded(reports.route_table(route_scores(c)))


@query(
    "n24_per_class_long",
    """SELECT concat_ws('/', target, combo, architecture) AS route, label::VARCHAR AS label,
        round(2.0 * tp / (support + predicted), 6)::DOUBLE AS f1 FROM fx_report WHERE split = 'test' AND seed = 42""",
    SCORES,
)
def _(c):
    at = c.predictions_of([42]).where("split = 'test'")
    report = class_report(at, ["target", "combo", "architecture"])
    entry = F.struct(F.col("label").cast("string"), "f1")
    maps = report.groupBy(F.concat_ws("/", "target", "combo", "architecture").alias("route")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("per_class")
    )
    return rounded(reports.per_class_long(maps))


@query(
    "flagship_cohort_quality",
    """SELECT split, count(*) AS n_graphs, round(avg(n), 6) AS mean_nodes, round(avg(n_c / n), 6) AS mean_construct_ratio,
        round(avg(neg / greatest(n_s, 1)), 6) AS mean_negative_stance, round(avg(bip), 6) AS mean_bipolarity,
        sum(coalesce(v, 0))::BIGINT AS n_violations, count(*) FILTER (coalesce(v, 0) = 0) AS n_clean,
        sum(coalesce(fixed, 0))::BIGINT AS n_fixed
    FROM fx_graphs JOIN (SELECT graph_id, count(*) AS n, count(*) FILTER (type = 'Construct') AS n_c,
            count(*) FILTER (type = 'Stance') AS n_s, count(*) FILTER (valence = 'negative') AS neg,
            coalesce(avg(CASE WHEN bipolarity_complete AND label_negative IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)
                FILTER (type = 'Construct'), 0) AS bip FROM fx_nodes GROUP BY 1) USING (graph_id)
    LEFT JOIN (SELECT v.graph_id, count(*) AS v FROM fx_violations v
        LEFT JOIN fx_nodes n ON n.graph_id = v.graph_id AND n.id = v.subject AND v.rule IN ('V04', 'V05')
        WHERE v.rule NOT IN ('V05', 'V21') AND NOT (v.rule = 'V04' AND n.label_negative IS NULL) GROUP BY 1) USING (graph_id)
    LEFT JOIN (SELECT graph_id, count(*) AS fixed FROM fx_violations WHERE rule = 'V21' GROUP BY 1) USING (graph_id)
    GROUP BY 1""",
    VIOLATIONS,
)
def _(c):
    """Repair directions and poles, validate, and profile each cohort."""
    return reports.cohort_quality(c.nodes, c.edges, c.graphs)
