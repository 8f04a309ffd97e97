"""Iterative graph measures and the full feature vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.operators import topology
from conceptspark.operators.stats_vector import graph_stats
from conceptspark.plans.features import SIZES, rounded
from conceptspark.plans.registry import query

PATHS = {
    **SIZES,
    "fx_directed": "SELECT graph_id, source, target FROM fx_arcs WHERE source <> target",
    "fx_both": "SELECT graph_id, source, target FROM fx_directed UNION SELECT graph_id, target, source FROM fx_directed",
    # shortest distances by breadth-first rounds: a pair is kept at the first distance that reaches it
    "fx_near(graph_id, s, t, d) USING KEY (graph_id, s, t)": """
        SELECT graph_id, id, id, 0 FROM fx_topology
        UNION
        SELECT DISTINCT f.graph_id, f.s, e.target, f.d + 1 FROM fx_near f
        JOIN fx_both e ON e.graph_id = f.graph_id AND e.source = f.t
        WHERE NOT EXISTS (SELECT 1 FROM recurring.fx_near k
            WHERE k.graph_id = f.graph_id AND k.s = f.s AND k.t = e.target)""",
    "fx_paths(graph_id, s, t, d, sigma) USING KEY (graph_id, s, t)": """
        SELECT graph_id, id, id, 0, 1.0::DOUBLE FROM fx_topology
        UNION
        SELECT f.graph_id, f.s, e.target, max(f.d) + 1, sum(f.sigma) FROM fx_paths f
        JOIN fx_directed e ON e.graph_id = f.graph_id AND e.source = f.t
        WHERE NOT EXISTS (SELECT 1 FROM recurring.fx_paths k
            WHERE k.graph_id = f.graph_id AND k.s = f.s AND k.t = e.target)
        GROUP BY f.graph_id, f.s, e.target""",
    "fx_between": """
        SELECT p.graph_id, p.id, coalesce(b.raw, 0) / CASE WHEN n > 2 THEN (n - 1.0::DOUBLE) * (n - 2) ELSE 1 END AS betweenness
        FROM fx_topology p
        JOIN (SELECT graph_id, count(*) AS n FROM fx_topology GROUP BY 1) z ON z.graph_id = p.graph_id
        LEFT JOIN (
            SELECT a.graph_id, a.t AS id, sum(a.sigma * b.sigma / c.sigma) AS raw
            FROM fx_paths a
            JOIN fx_paths b ON b.graph_id = a.graph_id AND b.s = a.t AND b.d > 0
            JOIN fx_paths c ON c.graph_id = a.graph_id AND c.s = a.s AND c.t = b.t AND c.d = a.d + b.d
            WHERE a.d > 0 GROUP BY ALL) b ON b.graph_id = p.graph_id AND b.id = p.id""",
    "fx_shape": """
        SELECT graph_id, CAST(round(sum(1.0::DOUBLE / reached)) AS BIGINT) AS components,
            CASE WHEN round(sum(1.0::DOUBLE / reached)) = 1 THEN max(far) ELSE -1 END::BIGINT AS diameter
        FROM (SELECT graph_id, s, count(*) AS reached, max(d) AS far FROM fx_near GROUP BY ALL) GROUP BY 1""",
    "fx_central": """
        SELECT graph_id, max(betweenness) AS max_betweenness, avg(betweenness) AS mean_betweenness,
            coalesce(max(betweenness) FILTER (id IN (SELECT n.id FROM fx_nodes n
                WHERE n.graph_id = fx_between.graph_id AND n.type = 'Value')), 0) AS max_value_betweenness
        FROM fx_between GROUP BY 1""",
}


@query("g03_weak_components", "SELECT graph_id, components FROM fx_shape", PATHS)
def _(c):
    return topology.graph_topology(c.nodes, c.edges).select("graph_id", "components")


@query("g05_diameter", "SELECT graph_id, diameter, round((diameter + 1) / 10.0, 6) AS diameter_norm FROM fx_shape", PATHS)
def _(c):
    shape = topology.graph_topology(c.nodes, c.edges)
    return rounded(shape.select("graph_id", "diameter", ((F.col("diameter") + 1) / 10.0).alias("diameter_norm")))


@query("g10_betweenness", "SELECT graph_id, id, round(betweenness, 6) AS betweenness FROM fx_between", PATHS)
def _(c):
    return rounded(topology.node_betweenness(c.nodes, c.edges))


@query(
    "g10_betweenness_summary",
    """SELECT graph_id, round(max_betweenness, 6) AS max_betweenness, round(mean_betweenness, 6) AS mean_betweenness,
        round(max_value_betweenness, 6) AS max_value_betweenness FROM fx_central""",
    PATHS,
)
def _(c):
    shape = topology.graph_topology(c.nodes, c.edges)
    return rounded(shape.select("graph_id", "max_betweenness", "mean_betweenness", "max_value_betweenness"))


VECTOR = {
    **PATHS,
    "fx_vector": """
        SELECT g.graph_id, greatest(z.n_nodes, 1) / 15.0 AS node_count_norm, z.n_edges / 20.0 AS edge_count_norm,
            CASE WHEN z.n_topology < 2 THEN 0 ELSE z.n_edges / (z.n_topology * (z.n_topology - 1)) END AS density,
            s.components / greatest(z.n_nodes, 1) AS component_ratio,
            d.mean_degree / 5.0 AS avg_degree_norm, d.max_degree / 10.0 AS max_degree_norm,
            (s.diameter + 1) / 10.0 AS diameter_norm,
            t.n_construct / t.n AS construct_ratio, t.n_value / t.n AS value_ratio, t.n_stance / t.n AS stance_ratio,
            t.n_csm / t.n AS csm_ratio, t.n_construct / greatest(t.n_value, 1) / 5.0 AS construct_value_ratio,
            t.n_stance / greatest(t.n_construct, 1) / 3.0 AS stance_construct_ratio, coalesce(t.bip, 0) AS bipolarity_score,
            coalesce(k.mean_degree, 0) / 5.0 AS mean_construct_degree, coalesce(k.max_degree, 0) / 10.0 AS max_construct_degree,
            t.p / greatest(t.n_stance, 1) AS positive_stance_frac, t.q / greatest(t.n_stance, 1) AS negative_stance_frac,
            t.m / greatest(t.n_stance, 1) AS mixed_stance_frac, t.a / greatest(t.n_stance, 1) AS ambivalent_stance_frac,
            (t.dom = 0)::INT AS valence_positive, (t.dom = 1)::INT AS valence_negative, (t.dom = 2)::INT AS valence_mixed,
            (t.dom = 3)::INT AS valence_ambivalent, (t.dom = 4)::INT AS valence_absent,
            c.max_betweenness, c.mean_betweenness, c.max_value_betweenness,
            (t.n_csm > 0)::INT AS csm_present, least(t.n_csm, 2) / 2.0 AS csm_count_clipped
        FROM fx_graphs g JOIN fx_sizes z USING (graph_id) JOIN fx_shape s USING (graph_id)
        JOIN fx_central c USING (graph_id)
        JOIN (SELECT graph_id, avg(degree) AS mean_degree, max(degree) AS max_degree FROM fx_degrees GROUP BY 1) d
            USING (graph_id)
        LEFT JOIN (SELECT graph_id, avg(degree) AS mean_degree, max(degree) AS max_degree
            FROM fx_degrees JOIN fx_nodes USING (graph_id, id) WHERE type = 'Construct' GROUP BY 1) k USING (graph_id)
        JOIN (SELECT *, CASE WHEN n_stance = 0 THEN 4 WHEN p >= greatest(q, m, a) THEN 0 WHEN q >= greatest(m, a) THEN 1
                WHEN m >= a THEN 2 ELSE 3 END AS dom
            FROM (SELECT graph_id, count(*) AS n, count(*) FILTER (type = 'Construct') AS n_construct,
                count(*) FILTER (type = 'Value') AS n_value, count(*) FILTER (type = 'Stance') AS n_stance,
                count(*) FILTER (type = 'CognitiveStyleMarker') AS n_csm,
                avg(CASE WHEN bipolarity_complete THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) FILTER (type = 'Construct') AS bip,
                count(*) FILTER (valence = 'positive') AS p, count(*) FILTER (valence = 'negative') AS q,
                count(*) FILTER (valence = 'mixed') AS m, count(*) FILTER (valence = 'ambivalent') AS a
                FROM fx_nodes GROUP BY 1)) t USING (graph_id)""",
}


@query(
    "g12_graph_stats_vector",
    "SELECT graph_id, round(COLUMNS(* EXCLUDE graph_id)::DOUBLE, 6) FROM fx_vector",
    VECTOR,
)
def _(c):
    return rounded(graph_stats(c.nodes, c.edges, c.graphs))
