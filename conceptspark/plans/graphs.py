"""Documents, validation, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.operators import documents, validation
from conceptspark.plans.registry import query

VIOLATIONS = {
    "fx_violations": """
        SELECT graph_id, 'V01' AS rule, id AS subject FROM fx_nodes
            WHERE type <> '' AND type NOT IN ('Construct', 'Value', 'Stance', 'CognitiveStyleMarker')
        UNION ALL SELECT graph_id, 'V02', id FROM fx_nodes WHERE type = 'Construct' AND grounding_span <> ''
            AND grounding_spans_positive IS NULL AND grounding_spans_negative IS NULL
        UNION ALL SELECT graph_id, 'V03', id FROM fx_nodes WHERE type = 'Construct' AND coalesce(grounding_span, '') = ''
            AND grounding_spans_positive IS NULL AND grounding_spans_negative IS NULL
        UNION ALL SELECT graph_id, 'V04', id FROM fx_nodes WHERE type = 'Construct' AND bipolarity_complete
            AND least(len(grounding_spans_positive), len(grounding_spans_negative)) = 0
        UNION ALL SELECT graph_id, 'V05', id FROM fx_nodes WHERE type = 'Construct'
            AND coalesce(label_negative, '') = '' AND bipolarity_complete IS DISTINCT FROM false
        UNION ALL SELECT graph_id, 'V06', id FROM fx_nodes WHERE type IS DISTINCT FROM 'Construct'
            AND grounding_spans IS NULL AND grounding_span <> ''
        UNION ALL SELECT graph_id, 'V07', id FROM fx_nodes WHERE type IS DISTINCT FROM 'Construct'
            AND grounding_spans IS NULL AND coalesce(grounding_span, '') = ''
        UNION ALL SELECT graph_id, 'V08', id FROM fx_nodes WHERE type = 'CognitiveStyleMarker'
            AND coalesce(len(grounding_spans), 0) < 2
        UNION ALL SELECT graph_id, 'V09', id FROM fx_nodes WHERE type = 'Stance' AND valence IS NULL
        UNION ALL SELECT graph_id, 'V10', id FROM fx_nodes WHERE type = 'Stance'
            AND valence NOT IN ('positive', 'negative', 'mixed', 'ambivalent')
        UNION ALL SELECT graph_id, rule, concat(source, '->', target) FROM (
            SELECT graph_id, source, target, unnest([
                CASE WHEN source_type IS NULL THEN 'V11' END,
                CASE WHEN target_type IS NULL THEN 'V12' END,
                CASE WHEN relation NOT IN ('SERVES', 'EXPRESSED_VIA', 'MODULATED_BY', 'CONFLICTS_WITH', 'SUBSUMES',
                    'IMPLIES') THEN 'V13' END,
                CASE WHEN coalesce(rationale, '') = '' THEN 'V14' END,
                CASE WHEN grounding IS NULL THEN 'V15' END,
                CASE WHEN grounding NOT IN ('explicit', 'inferred') THEN 'V16' END,
                CASE WHEN relation IN ('SUBSUMES', 'IMPLIES') AND grounding = 'explicit' THEN 'V17' END,
                CASE WHEN source_type = 'Stance' AND target_type = 'Value' THEN 'V18' END,
                CASE WHEN relation = 'SERVES' AND (source_type <> 'Construct' OR target_type <> 'Value') THEN 'V19' END,
                CASE WHEN relation = 'EXPRESSED_VIA' AND (source_type <> 'Stance' OR target_type <> 'Construct')
                    THEN 'V20' END,
                CASE WHEN relation = 'MODULATED_BY' AND (source_type NOT IN ('Construct', 'Stance')
                    OR target_type <> 'CognitiveStyleMarker') THEN 'V21' END,
                CASE WHEN relation = 'SUBSUMES' AND (source_type <> 'Value' OR target_type <> 'Value') THEN 'V22' END,
                CASE WHEN relation = 'IMPLIES' AND (source_type <> 'Construct' OR target_type <> 'Construct')
                    THEN 'V23' END]) AS rule
            FROM fx_typed_edges) WHERE rule IS NOT NULL
            AND NOT (rule >= 'V19' AND (source IS NULL OR target IS NULL))
        UNION ALL SELECT graph_id, 'V24', 'graph' FROM fx_graphs WHERE coalesce(domain, '') = ''""",
}


def violations(c):
    return validation.validate_graphs(c.nodes, c.edges, c.graphs)


@query("v30_validate_graphs", "SELECT graph_id, rule, subject FROM fx_violations", VIOLATIONS)
def _(c):
    return violations(c).select("graph_id", "rule", "subject")


@query(
    "v31_is_valid",
    "SELECT graph_id FROM fx_graphs WHERE graph_id NOT IN (SELECT graph_id FROM fx_violations)",
    VIOLATIONS,
)
def _(c):
    return validation.is_valid(c.graphs, violations(c)).select("graph_id")


@query(
    "v32_fix_modulated_by_direction",
    """SELECT graph_id, CASE WHEN fixed THEN target ELSE source END AS source,
        CASE WHEN fixed THEN source ELSE target END AS target, relation, fixed
    FROM (SELECT *, coalesce(relation = 'MODULATED_BY' AND source_type = 'CognitiveStyleMarker'
        AND target_type IN ('Construct', 'Stance'), false) AS fixed FROM fx_typed_edges)""",
)
def _(c):
    return validation.fix_modulated_by_direction(c.edges, c.nodes).drop("rationale", "grounding")


@query(
    "v33_repair_bipolarity",
    """SELECT graph_id, id, CASE WHEN type = 'Construct' AND label_negative IS NULL THEN false
        ELSE bipolarity_complete END AS bipolarity_complete FROM fx_nodes""",
)
def _(c):
    return validation.repair_bipolarity(c.nodes).select("graph_id", "id", "bipolarity_complete")


@query(
    "v34_violation_summary",
    """SELECT rule, count(*) AS n_violations, count(DISTINCT graph_id) AS n_graphs,
        round(count(DISTINCT graph_id) / n_all, 6) AS graph_share, round(count(*) / n_all, 6) AS mean_per_graph
    FROM (SELECT rule, graph_id FROM fx_violations UNION ALL SELECT 'ALL', graph_id FROM fx_violations)
    CROSS JOIN (SELECT count(*) AS n_all FROM fx_graphs) GROUP BY rule, n_all""",
    VIOLATIONS,
)
def _(c):
    return validation.violation_summary(c.graphs, violations(c))


@query(
    "s04_explode_nodes",
    """SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS pos, id, type, label,
        coalesce(len(grounding_spans), -1) AS n_spans FROM fx_nodes""",
)
def _(c):
    docs = documents.assemble_graphs(c.nodes, c.edges, c.graphs)
    return documents.explode_nodes(docs).select(
        "graph_id",
        F.col("pos").cast("long").alias("pos"),
        "id",
        "type",
        "label",
        F.when(F.col("grounding_spans").isNull(), -1).otherwise(F.size("grounding_spans")).cast("long").alias("n_spans"),
    )


@query(
    "s04_explode_edges",
    """SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY source, target, relation) - 1 AS pos,
        source, target, relation, grounding FROM fx_edges""",
)
def _(c):
    docs = documents.assemble_graphs(c.nodes, c.edges, c.graphs)
    return documents.explode_edges(docs).select(
        "graph_id", F.col("pos").cast("long").alias("pos"), "source", "target", "relation", "grounding"
    )


@query(
    "s05_assemble_graphs",
    """SELECT graph_id, split, domain, nodes, edges
    FROM fx_graphs
    JOIN (SELECT graph_id, string_agg(concat(id, ':', label), ',' ORDER BY id) AS nodes FROM fx_nodes GROUP BY ALL)
        USING (graph_id)
    JOIN (SELECT graph_id, string_agg(concat(source, '>', target, ':', relation), ',' ORDER BY source, target, relation)
        AS edges FROM fx_edges GROUP BY ALL) USING (graph_id)""",
)
def _(c):
    item = lambda *fields: lambda x: F.concat(*[x[f] if f[0].islower() else F.lit(f[1:]) for f in fields])
    return documents.assemble_graphs(c.nodes, c.edges, c.graphs).select(
        "graph_id",
        "split",
        "domain",
        F.array_join(F.transform("nodes", item("id", "_:", "label")), ",").alias("nodes"),
        F.array_join(F.transform("edges", item("source", "_>", "target", "_:", "relation")), ",").alias("edges"),
    )
