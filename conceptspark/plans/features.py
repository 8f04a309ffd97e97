"""Graph features without iteration, propagation and colour refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.operators import features, propagation
from conceptspark.plans.registry import query
from conceptspark.plans.views import h32

SIZES = {
    "fx_arcs": "SELECT DISTINCT graph_id, source, target FROM fx_edges",
    "fx_topology": """
        SELECT graph_id, id FROM fx_nodes UNION SELECT graph_id, source FROM fx_edges
        UNION SELECT graph_id, target FROM fx_edges""",
    "fx_degrees": """
        SELECT graph_id, id, (SELECT count(*) FROM fx_arcs a WHERE a.graph_id = t.graph_id AND a.source = t.id)
            + (SELECT count(*) FROM fx_arcs a WHERE a.graph_id = t.graph_id AND a.target = t.id) AS degree
        FROM fx_topology t""",
    "fx_sizes": """
        SELECT graph_id, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_topology, 0) AS n_topology,
            coalesce(n_edges, 0) AS n_edges
        FROM fx_graphs LEFT JOIN (SELECT graph_id, count(*) AS n_nodes FROM fx_nodes GROUP BY 1) USING (graph_id)
        LEFT JOIN (SELECT graph_id, count(*) AS n_topology FROM fx_topology GROUP BY 1) USING (graph_id)
        LEFT JOIN (SELECT graph_id, count(*) AS n_edges FROM fx_arcs GROUP BY 1) USING (graph_id)""",
}

TYPES = "('Construct', 'construct'), ('Value', 'value'), ('Stance', 'stance'), ('CognitiveStyleMarker', 'csm')"
ONE_HOTS = ", ".join(
    f"CAST(type = '{t}' AS DOUBLE) AS is_{s}"
    for t, s in (("Construct", "construct"), ("Value", "value"), ("Stance", "stance"), ("CognitiveStyleMarker", "csm"))
)
RELATIONS = ["SERVES", "EXPRESSED_VIA", "MODULATED_BY", "CONFLICTS_WITH", "SUBSUMES", "IMPLIES"]
INSIDE = {
    "fx_inside": "SELECT * FROM fx_typed_edges WHERE source_type IS NOT NULL AND target_type IS NOT NULL",
    "fx_node_features": f"""
        SELECT n.graph_id, n.id, {ONE_HOTS}, CAST(coalesce(d.degree, 0) AS DOUBLE) AS degree
        FROM fx_nodes n LEFT JOIN (
            SELECT graph_id, id, count(*) AS degree FROM (SELECT graph_id, source AS id FROM fx_edges
                UNION ALL SELECT graph_id, target FROM fx_edges) GROUP BY ALL) d
        ON n.graph_id = d.graph_id AND n.id = d.id""",
}


def rounded(df, digits=6):
    """Round every double column, keep the rest."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@query(
    "g01_graph_sizes",
    """SELECT *, round(greatest(n_nodes, 1) / 15.0, 6) AS node_count_norm, round(n_edges / 20.0, 6) AS edge_count_norm
    FROM fx_sizes""",
    SIZES,
)
def _(c):
    return rounded(features.graph_sizes(c.nodes, c.edges, c.graphs))


@query(
    "g02_density",
    """SELECT graph_id, CASE WHEN n_topology < 2 THEN 0.0::DOUBLE
        ELSE round(n_edges / (n_topology * (n_topology - 1)), 6) END AS density FROM fx_sizes""",
    SIZES,
)
def _(c):
    return rounded(features.density(features.graph_sizes(c.nodes, c.edges, c.graphs)))


@query("g04_degrees", "SELECT graph_id, id, degree FROM fx_degrees", SIZES)
def _(c):
    return features.degrees(c.nodes, c.edges).withColumn("degree", F.col("degree").cast("long"))


@query(
    "g04_degree_stats",
    """SELECT graph_id, round(avg(degree) / 5.0, 6) AS avg_degree_norm, round(max(degree) / 10.0, 6) AS max_degree_norm
    FROM fx_degrees GROUP BY 1""",
    SIZES,
)
def _(c):
    return rounded(features.degree_stats(features.degrees(c.nodes, c.edges)))


@query(
    "g06_type_profile",
    """SELECT graph_id, n_nodes, n_construct, n_value, n_stance, n_csm,
        round(n_construct / n_nodes, 6) AS construct_ratio, round(n_value / n_nodes, 6) AS value_ratio,
        round(n_stance / n_nodes, 6) AS stance_ratio, round(n_csm / n_nodes, 6) AS csm_ratio,
        round(n_construct / greatest(n_value, 1) / 5.0, 6) AS construct_value_ratio,
        round(n_stance / greatest(n_construct, 1) / 3.0, 6) AS stance_construct_ratio
    FROM (SELECT graph_id, count(*) AS n_nodes, count(*) FILTER (type = 'Construct') AS n_construct,
        count(*) FILTER (type = 'Value') AS n_value, count(*) FILTER (type = 'Stance') AS n_stance,
        count(*) FILTER (type = 'CognitiveStyleMarker') AS n_csm FROM fx_nodes GROUP BY 1)""",
)
def _(c):
    return rounded(features.type_profile(c.nodes))


@query(
    "g07_bipolarity_score",
    """SELECT graph_id, round(coalesce(avg(CASE WHEN bipolarity_complete THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)
        FILTER (type = 'Construct'), 0.0), 6) AS bipolarity_score FROM fx_nodes GROUP BY 1""",
)
def _(c):
    return rounded(features.bipolarity_score(c.nodes))


@query(
    "g08_construct_degree",
    """SELECT graph_id, round(coalesce(avg(degree) FILTER (type = 'Construct'), 0) / 5.0, 6) AS mean_construct_degree,
        round(coalesce(max(degree) FILTER (type = 'Construct'), 0) / 10.0, 6) AS max_construct_degree
    FROM fx_nodes JOIN fx_degrees USING (graph_id, id) GROUP BY 1""",
    SIZES,
)
def _(c):
    return rounded(features.construct_degree(c.nodes, features.degrees(c.nodes, c.edges)))


@query(
    "g09_valence_profile",
    """SELECT graph_id, n_stance, round(p / s, 6) AS positive_stance_frac, round(n / s, 6) AS negative_stance_frac,
        round(m / s, 6) AS mixed_stance_frac, round(a / s, 6) AS ambivalent_stance_frac,
        (dom = 0)::DOUBLE AS valence_positive, (dom = 1)::DOUBLE AS valence_negative, (dom = 2)::DOUBLE AS valence_mixed,
        (dom = 3)::DOUBLE AS valence_ambivalent, (dom = 4)::DOUBLE AS valence_absent
    FROM (SELECT *, greatest(n_stance, 1) AS s, CASE WHEN n_stance = 0 THEN 4
            WHEN p >= greatest(n, m, a) THEN 0 WHEN n >= greatest(m, a) THEN 1 WHEN m >= a THEN 2 ELSE 3 END AS dom
        FROM (SELECT graph_id, count(*) FILTER (type = 'Stance') AS n_stance,
            count(*) FILTER (valence = 'positive') AS p, count(*) FILTER (valence = 'negative') AS n,
            count(*) FILTER (valence = 'mixed') AS m, count(*) FILTER (valence = 'ambivalent') AS a
            FROM fx_nodes GROUP BY 1))""",
)
def _(c):
    return rounded(features.valence_profile(c.nodes))


@query(
    "g11_csm_profile",
    """SELECT graph_id, n_csm, (n_csm > 0)::DOUBLE AS csm_present, least(n_csm, 2) / 2.0::DOUBLE AS csm_count_clipped
    FROM (SELECT graph_id, count(*) FILTER (type = 'CognitiveStyleMarker') AS n_csm FROM fx_nodes GROUP BY 1)""",
)
def _(c):
    return features.csm_profile(c.nodes)


@query(
    "g13_type_histogram",
    "SELECT g.graph_id, "
    + ", ".join(
        f"round(CASE WHEN n > 0 THEN t_{s} / n ELSE 0 END, 6) AS h_{s}" for s in ("construct", "value", "stance", "csm")
    )
    + ", "
    + ", ".join(f"round(CASE WHEN coalesce(m, 0) > 0 THEN m_{r} / m ELSE 0 END, 6) AS h_{r.lower()}" for r in RELATIONS)
    + ", round(CASE WHEN n > 0 THEN 2.0 * coalesce(m, 0) / n ELSE 0 END::DOUBLE, 6) AS h_mean_degree"
    + " FROM fx_graphs g LEFT JOIN (SELECT graph_id, count(*) AS n, "
    + ", ".join(
        f"count(*) FILTER (type = '{t}') AS t_{s}"
        for t, s in (
            ("Construct", "construct"),
            ("Value", "value"),
            ("Stance", "stance"),
            ("CognitiveStyleMarker", "csm"),
        )
    )
    + " FROM fx_nodes GROUP BY 1) USING (graph_id) LEFT JOIN (SELECT graph_id, count(*) AS m, "
    + ", ".join(f"count(*) FILTER (relation = '{r}') AS m_{r}" for r in RELATIONS)
    + " FROM fx_edges GROUP BY 1) USING (graph_id)",
)
def _(c):
    return rounded(features.type_histogram(c.nodes, c.edges, c.graphs))


@query("g14_node_features", "SELECT * FROM fx_node_features", INSIDE)
def _(c):
    return features.node_features(c.nodes, c.edges)


@query(
    "g15_edge_features",
    "SELECT graph_id, source, target, "
    + ", ".join(f"CAST(relation = '{r}' AS DOUBLE) AS r_{r.lower()}" for r in RELATIONS)
    + " FROM fx_inside",
    INSIDE,
)
def _(c):
    return features.edge_features(c.nodes, c.edges)


CHANNELS = ["is_construct", "is_value", "is_stance", "is_csm", "degree"]
R_CHANNELS = [f"r_{r.lower()}" for r in RELATIONS]


def _round_sql(previous: str, typed: bool) -> str:
    own = ", ".join(f"s.{c}" for c in CHANNELS + (R_CHANNELS if typed else []))
    sent = ", ".join(f"s.{c}" for c in CHANNELS)
    if typed:
        sent += ", " + ", ".join(
            f"greatest(0, s.r_{r.lower()} + CAST(e.relation = '{r}' AS DOUBLE))" for r in RELATIONS
        )
    sums = ", ".join(f"sum({c}) AS {c}" for c in CHANNELS + (R_CHANNELS if typed else []))
    return f"""SELECT graph_id, id, {sums} FROM (
        SELECT s.graph_id, s.id, {own} FROM {previous} s
        UNION ALL SELECT e.graph_id, e.target, {sent} FROM fx_inside e
        JOIN {previous} s ON s.graph_id = e.graph_id AND s.id = e.source) GROUP BY ALL"""


ROUNDS = {
    **INSIDE,
    "fx_u1": _round_sql("fx_node_features", False),
    "fx_u2": _round_sql("fx_u1", False),
    "fx_t0": "SELECT *, " + ", ".join(f"0.0::DOUBLE AS {c}" for c in R_CHANNELS) + " FROM fx_node_features",
    "fx_t1": _round_sql("fx_t0", True),
    "fx_t2": _round_sql("fx_t1", True),
}


@query(
    "g16_propagate",
    "SELECT graph_id, " + ", ".join(f"round(avg({c}), 6) AS p_{c}" for c in CHANNELS) + " FROM fx_u2 GROUP BY 1",
    ROUNDS,
)
def _(c):
    return rounded(propagation.propagate(c.nodes, c.edges))


@query(
    "g17_propagate_typed",
    "SELECT graph_id, "
    + ", ".join(f"round(avg({c}), 6) AS p_{c}" for c in CHANNELS + R_CHANNELS)
    + " FROM fx_t2 GROUP BY 1",
    ROUNDS,
)
def _(c):
    return rounded(propagation.propagate(c.nodes, c.edges, typed=True))


def _colour_sql(previous: str, token: str) -> str:
    low = h32(token)
    high = f"CAST(concat('0x', substr(md5({token}), 9, 8)) AS BIGINT)"
    return f"""SELECT s.graph_id, s.id,
            md5(concat_ws('|', s.colour, coalesce(m.a, 0), coalesce(m.b, 0))) AS colour
        FROM {previous} s LEFT JOIN (
            SELECT e.graph_id, e.target AS id, CAST(sum({low}) AS BIGINT) AS a, CAST(sum({high}) AS BIGINT) AS b
            FROM fx_inside e JOIN {previous} p ON p.graph_id = e.graph_id AND p.id = e.source GROUP BY ALL) m
        ON m.graph_id = s.graph_id AND m.id = s.id"""


COLOURS = {
    **INSIDE,
    "fx_w0": "SELECT graph_id, id, md5(type) AS colour FROM fx_nodes",
    "fx_w1": _colour_sql("fx_w0", "p.colour"),
    "fx_w2": _colour_sql("fx_w1", "p.colour"),
    "fx_x1": _colour_sql("fx_w0", "concat_ws('|', e.relation, p.colour)"),
    "fx_x2": _colour_sql("fx_x1", "concat_ws('|', e.relation, p.colour)"),
}


@query("g18_wl_colours", "SELECT graph_id, id, colour FROM fx_w2", COLOURS)
def _(c):
    return propagation.wl_colours(c.nodes, c.edges)


@query(
    "g18_wl_histogram_typed",
    f"SELECT graph_id, {h32('colour').replace('md5(colour)', 'colour')} % 64 AS bucket, count(*) AS n"
    " FROM fx_x2 GROUP BY ALL",
    COLOURS,
)
def _(c):
    return propagation.wl_histogram(propagation.wl_colours(c.nodes, c.edges, typed=True))


@query(
    "g19_mask_node_types",
    """SELECT graph_id, id, type, rn <= k AS masked FROM (
        SELECT graph_id, id, type, row_number() OVER (PARTITION BY graph_id ORDER BY
                md5(concat('42|', graph_id, '|', id)), id) AS rn,
            greatest(1, CAST(round_even(count(*) OVER (PARTITION BY graph_id) * 0.15, 0) AS BIGINT)) AS k
        FROM fx_nodes)""",
)
def _(c):
    return propagation.mask_node_types(c.nodes).select("graph_id", "id", "type", "masked")
