"""The derived views of ``fixtures.py`` once more, as SQL for the oracle, and the composer that prepends them."""

from __future__ import annotations

import re

from conceptspark.fixtures import QUALITY, SEEDS


def h32(text: str) -> str:
    """First eight md5 digits as an integer."""
    return f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT)"


VIEWS: dict[str, str] = {
    "fx_constructs": """
        SELECT DISTINCT l_orderkey AS graph_id, p_partkey, p_name, p_brand, p_type, p_size
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_values": """
        SELECT DISTINCT l_orderkey AS graph_id, s_nationkey, n_name, n_regionkey
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "fx_nodes": """
        SELECT graph_id, concat('c', p_partkey) AS id, 'Construct' AS type, p_name AS label,
            CASE WHEN p_size % 8 <> 0 THEN p_brand END AS label_negative,
            (p_size % 5 <> 0) AS bipolarity_complete, CAST(NULL AS VARCHAR) AS valence,
            CAST(NULL AS VARCHAR) AS grounding_span, CAST(NULL AS VARCHAR[]) AS grounding_spans,
            [p_name] AS grounding_spans_positive,
            CASE WHEN p_size % 8 = 0 OR p_size % 9 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_brand] END
                AS grounding_spans_negative
        FROM fx_constructs
        UNION ALL
        SELECT graph_id, concat('v', s_nationkey), 'Value', n_name, NULL, NULL, NULL, NULL, [n_name], NULL, NULL
        FROM fx_values
        UNION ALL
        SELECT graph_id, concat('s', flag), 'Stance', concat(flag, ' ', o_orderpriority), NULL, NULL,
            CASE WHEN flag = 'A' THEN 'positive' WHEN flag = 'R' THEN 'negative'
                 WHEN o_orderstatus = 'F' THEN 'mixed' WHEN o_orderstatus = 'O' THEN 'ambivalent' END,
            NULL,
            CASE WHEN lo = hi THEN [CAST(lo AS VARCHAR)] ELSE [CAST(lo AS VARCHAR), CAST(hi AS VARCHAR)] END,
            NULL, NULL
        FROM (SELECT l_orderkey AS graph_id, l_returnflag AS flag, min(l_linenumber) AS lo, max(l_linenumber) AS hi
              FROM lineitem GROUP BY ALL) JOIN orders ON graph_id = o_orderkey
        UNION ALL
        SELECT graph_id, concat('m', p_type), 'CognitiveStyleMarker', p_type, NULL, NULL, NULL, NULL,
            CASE WHEN min(p_partkey) = max(p_partkey) THEN [CAST(min(p_partkey) AS VARCHAR)]
                 ELSE [CAST(min(p_partkey) AS VARCHAR), CAST(max(p_partkey) AS VARCHAR)] END, NULL, NULL
        FROM fx_constructs GROUP BY graph_id, p_type""",
    "fx_links": """
        SELECT DISTINCT l_orderkey AS graph_id, concat('c', l_partkey) AS source, concat('v', s_nationkey) AS target,
            'SERVES' AS relation, l_partkey AS x
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        UNION ALL
        SELECT DISTINCT l_orderkey, concat('s', l_returnflag), concat('c', l_partkey), 'EXPRESSED_VIA', l_partkey
        FROM lineitem
        UNION ALL
        SELECT graph_id, CASE WHEN p_size % 7 = 0 THEN concat('m', p_type) ELSE concat('c', p_partkey) END,
            CASE WHEN p_size % 7 = 0 THEN concat('c', p_partkey) ELSE concat('m', p_type) END,
            'MODULATED_BY', p_partkey
        FROM fx_constructs
        UNION ALL
        SELECT graph_id, concat('c', prev), concat('c', p_partkey),
            CASE WHEN (prev + p_partkey) % 4 = 0 THEN 'CONFLICTS_WITH' ELSE 'IMPLIES' END, p_partkey
        FROM (SELECT graph_id, p_partkey, lag(p_partkey) OVER (PARTITION BY graph_id ORDER BY p_partkey) AS prev
              FROM fx_constructs) WHERE (prev + p_partkey) % 4 IN (0, 1)
        UNION ALL
        SELECT graph_id, concat('v', prev), concat('v', s_nationkey), 'SUBSUMES', s_nationkey
        FROM (SELECT graph_id, s_nationkey, n_regionkey,
                lag(s_nationkey) OVER (PARTITION BY graph_id ORDER BY s_nationkey) AS prev,
                lag(n_regionkey) OVER (PARTITION BY graph_id ORDER BY s_nationkey) AS prev_region
              FROM fx_values) WHERE prev_region = n_regionkey
        UNION ALL
        SELECT graph_id, concat('c', p_partkey), concat('x', p_partkey), 'SERVES', p_partkey
        FROM fx_constructs WHERE p_partkey % 97 = 0
        UNION ALL
        SELECT graph_id, concat('c', p_partkey), concat('c', p_partkey), 'RELATES', p_partkey
        FROM fx_constructs WHERE p_partkey % 101 = 0""",
    "fx_edges": """
        SELECT graph_id, source, target, relation,
            CASE WHEN x % 17 <> 0 THEN concat(relation, ' ', x) END AS rationale,
            CASE WHEN x % 11 = 0 THEN NULL WHEN x % 13 = 0 THEN 'guess' WHEN x % 3 = 0 THEN 'explicit'
                 ELSE 'inferred' END AS grounding
        FROM fx_links""",
    "fx_cohorts": """
        SELECT o_orderkey AS graph_id,
            CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'creatives' WHEN 'MACHINERY' THEN 'scientists'
                 ELSE 'workforce' END AS split
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fx_graphs": """
        SELECT graph_id, split, CASE WHEN graph_id % 50 <> 0 THEN 'orders' END AS domain,
            concat('m', graph_id % 2) AS extraction_model, 'v4' AS prompt_version
        FROM fx_cohorts WHERE graph_id IN (SELECT l_orderkey FROM lineitem)""",
    "fx_typed_edges": """
        SELECT e.*, s.type AS source_type, t.type AS target_type
        FROM fx_edges e LEFT JOIN fx_nodes s ON e.graph_id = s.graph_id AND e.source = s.id
        LEFT JOIN fx_nodes t ON e.graph_id = t.graph_id AND e.target = t.id""",
    # turns: what parsing the raw text must give back
    "fx_turns": """
        SELECT conv_id AS transcript_id, split, turn AS pos, text,
            CASE WHEN role = 'user' THEN 'Human' ELSE 'AI' END AS speaker,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index
        FROM (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'workforce' WHEN 1 THEN 'creatives' ELSE 'scientists' END AS split
              FROM conversations)""",
    "fx_formatted": r"""
        SELECT transcript_id, split,
            string_agg('[' || speaker || ']: ' || text, E'\n\n' ORDER BY pos) AS formatted,
            coalesce(string_agg('[' || speaker || ']: ' || text, E'\n\n' ORDER BY pos)
                     FILTER (speaker = 'Human'), '') AS human
        FROM fx_turns GROUP BY ALL""",
    "fx_a": """
        SELECT o_orderkey AS transcript_id, CASE WHEN o_orderkey % 41 = 0 THEN 'uncertain'
            WHEN o_totalprice < 140000 THEN 'low' WHEN o_totalprice >= 470000 THEN 'high' ELSE 'med' END AS label
        FROM orders""",
    "fx_b": """
        SELECT transcript_id, CASE WHEN transcript_id % 43 = 0 THEN 'error'
            WHEN transcript_id % 5 = 0 AND label IN ('low', 'high') THEN 'med'
            WHEN transcript_id % 5 = 0 AND label = 'med' THEN 'low' ELSE label END AS label
        FROM fx_a""",
    "fx_adjudications": """
        SELECT transcript_id, CASE WHEN transcript_id % 7 = 0 THEN 'manual_review' ELSE label END AS label
        FROM fx_a WHERE transcript_id % 3 = 0""",
    "fx_adoption": """
        SELECT o_orderkey AS transcript_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'power_user'
            WHEN '2' THEN 'integrated' WHEN '3' THEN 'tool_user' WHEN '4' THEN 'uncertain' ELSE 'novice' END AS label
        FROM orders""",
    "fx_responses": r"""
        SELECT transcript_id, label, CASE WHEN transcript_id % 29 = 0 THEN ''
            WHEN transcript_id % 31 = 0 THEN substr(body, 1, 40)
            WHEN transcript_id % 2 = 0 THEN concat(E'```json\n', body, E'\n```') ELSE body END AS content
        FROM (SELECT transcript_id, label, concat('{"stance_ambivalence": {"label": "', label,
                '", "reasoning": "price", "quotes": ["q', transcript_id % 10, '"]}}') AS body FROM fx_a)""",
    "fx_consensus": """
        SELECT a.transcript_id, CASE WHEN a.label = b.label THEN a.label ELSE j.label END AS label,
            CASE WHEN a.label = b.label THEN 'consensus' ELSE 'adjudicated' END AS source
        FROM fx_a a JOIN fx_b b USING (transcript_id) LEFT JOIN fx_adjudications j USING (transcript_id)
        WHERE a.label = b.label OR j.label IS NOT NULL""",
    "fx_label_vectors": f"""
        SELECT d.type, d.label, CAST(e.embedding AS DOUBLE[]) AS vector
        FROM (SELECT DISTINCT type, label, {h32("concat_ws('|', type, label)")} % (SELECT count(*) FROM embeddings) AS vec_id FROM fx_nodes) d
        JOIN embeddings e USING (vec_id)""",
    "fx_demographics": """
        SELECT transcript_id, label AS ai_adoption,
            CASE transcript_id % 3 WHEN 0 THEN 'early' WHEN 1 THEN 'mid' ELSE 'late' END AS career_stage
        FROM fx_adoption WHERE transcript_id % 10 <> 0""",
    # encoded targets
    "fx_target_labels": """
        SELECT 'cohort' AS target, graph_id AS transcript_id,
            CASE split WHEN 'workforce' THEN 0 WHEN 'creatives' THEN 1 ELSE 2 END AS label FROM fx_cohorts
        UNION ALL
        SELECT 'ai_adoption', transcript_id, CASE label WHEN 'tool_user' THEN 0 ELSE 1 END FROM fx_adoption
        WHERE label IN ('tool_user', 'integrated')
        UNION ALL
        SELECT 'stance_ambivalence', transcript_id, CASE label WHEN 'low' THEN 0 WHEN 'med' THEN 1 ELSE 2 END
        FROM fx_consensus WHERE label IN ('low', 'med', 'high')""",
    "fx_seeds": "SELECT unnest([" + ", ".join(map(str, SEEDS)) + "]) AS seed",
    "fx_split_quota": """
        SELECT target, label, n_k, n, n_train, n_val, train_k,
            CAST(val_floor + CASE WHEN row_number() OVER (PARTITION BY target ORDER BY val_rem DESC, label)
                <= n_val - sum(val_floor) OVER (PARTITION BY target) THEN 1 ELSE 0 END AS BIGINT) AS val_k
        FROM (
            SELECT *, (n_val * (n_k - train_k)) // (n - n_train) AS val_floor,
                (n_val * (n_k - train_k)) % (n - n_train) AS val_rem
            FROM (
                SELECT *, CAST(train_floor + CASE WHEN row_number() OVER (PARTITION BY target ORDER BY train_rem DESC, label)
                    <= n_train - sum(train_floor) OVER (PARTITION BY target) THEN 1 ELSE 0 END AS BIGINT) AS train_k
                FROM (
                    SELECT *, (n_train * n_k) // n AS train_floor, (n_train * n_k) % n AS train_rem,
                        (n - n_train) // 2 AS n_val
                    FROM (SELECT *, (7 * n) // 10 AS n_train
                          FROM (SELECT target, label, n_k, CAST(sum(n_k) OVER (PARTITION BY target) AS BIGINT) AS n
                                FROM (SELECT target, label, count(*) AS n_k FROM fx_target_labels GROUP BY ALL))))))""",
    "fx_splits": """
        SELECT target, seed, transcript_id, label,
            CASE WHEN rn <= train_k THEN 'train' WHEN rn <= train_k + val_k THEN 'val' ELSE 'test' END AS split
        FROM (SELECT l.target, s.seed, l.transcript_id, l.label, q.train_k, q.val_k,
                row_number() OVER (PARTITION BY l.target, s.seed, l.label
                    ORDER BY md5(concat(s.seed, '|', l.transcript_id)), l.transcript_id) AS rn
              FROM fx_target_labels l CROSS JOIN fx_seeds s
              JOIN fx_split_quota q ON l.target = q.target AND l.label = q.label)""",
    "fx_configs": " UNION ALL ".join(
        f"SELECT '{combo}' AS combo, '{arch}' AS architecture, {int(round((q - off) * 1000))} AS quality"
        for combo, q in QUALITY.items()
        for arch, off in (("logistic", 0.0), ("stacked", 0.02))
    ),
    "fx_predictions": f"""
        SELECT target, combo, architecture, seed, transcript_id, split, y,
            CAST(CASE WHEN h < quality THEN y WHEN target = 'ai_adoption' THEN 1 - y ELSE (y + 1 + h % 2) % 3 END AS INTEGER) AS yhat
        FROM (SELECT s.target, c.combo, c.architecture, s.seed, s.transcript_id, s.split, s.label AS y, c.quality,
                {h32("concat_ws('|', s.target, c.combo, c.architecture, s.seed, s.transcript_id)")} % 1000 AS h
              FROM fx_splits s CROSS JOIN fx_configs c
              WHERE s.split IN ('val', 'test'))""",
}


def compose(body: str, extra: dict[str, str] | None = None) -> str:
    """Prepend every view the body needs, directly or through another view.

    A key may carry a recursive head such as ``fx_near(a, b) USING KEY (a)``; its name is the leading word.
    """
    heads = {re.match(r"\w+", key).group(): (key, sql) for key, sql in {**VIEWS, **(extra or {})}.items()}
    needed: set[str] = set()
    todo = [body]
    while todo:
        for name in set(re.findall(r"\bfx_\w+", todo.pop())) - needed:
            needed.add(name)
            todo.append(heads[name][1])
    if not needed:
        return body
    ctes = []
    for name, (head, sql) in heads.items():
        if name in needed:
            keep = "AS" if "(" in head else "AS MATERIALIZED"
            ctes.append(f"{head} {keep} ({sql.strip()})")
    joined = ",\n".join(ctes)
    return f"WITH RECURSIVE {joined}\nSELECT * FROM ({body.strip()})"
