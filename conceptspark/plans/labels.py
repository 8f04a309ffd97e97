"""Responses, agreement, consensus and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.functions.text import strip_fences
from conceptspark.functions.vocabulary import (
    ADOPTION_CODES,
    AMBIVALENCE_CODES,
    AMBIVALENCE_LABELS,
    COHORT_CODES,
)
from conceptspark.operators import documents, labels, responses
from conceptspark.plans.graphs import VIOLATIONS, violations
from conceptspark.plans.registry import query

SCHEMA = responses.label_schema("stance_ambivalence")

ATTEMPTS = {
    "fx_attempts": """
        SELECT transcript_id, 1 AS attempt, CASE WHEN transcript_id % 37 <> 0 THEN content END AS content
        FROM fx_responses
        UNION ALL SELECT transcript_id, 2, CASE WHEN transcript_id % 2 = 0 THEN '' ELSE '{}' END
        FROM fx_responses WHERE transcript_id % 29 = 0 AND transcript_id % 37 <> 0 AND transcript_id % 3 <> 0
        UNION ALL SELECT transcript_id, 3, '' FROM fx_responses
        WHERE transcript_id % 58 = 0 AND transcript_id % 37 <> 0 AND transcript_id % 3 = 1""",
    "fx_outcomes": """
        SELECT transcript_id,
            CASE WHEN transcript_id % 37 = 0 OR transcript_id % 29 <> 0 OR transcript_id % 3 = 0 THEN 1
                 WHEN transcript_id % 2 = 1 THEN 2 WHEN transcript_id % 3 = 1 THEN 3 ELSE 2 END AS n_attempts,
            CASE WHEN transcript_id % 37 = 0 THEN 'no response'
                 WHEN transcript_id % 29 = 0 THEN CASE WHEN transcript_id % 3 = 0 THEN 'retry'
                    WHEN transcript_id % 2 = 1 THEN 'ok' WHEN transcript_id % 3 = 1 THEN 'empty content' ELSE 'retry' END
                 WHEN transcript_id % 31 = 0 THEN 'invalid JSON' ELSE 'ok' END AS outcome
        FROM fx_responses""",
}


def attempts(c):
    key = F.col("transcript_id")
    r = c.responses
    answered = r.where(key % 37 != 0)
    first = r.select("transcript_id", F.lit(1).alias("attempt"), F.when(key % 37 != 0, F.col("content")).alias("content"))
    second = answered.where((key % 29 == 0) & (key % 3 != 0)).select(
        "transcript_id", F.lit(2), F.when(key % 2 == 0, "").otherwise("{}")
    )
    third = answered.where((key % 58 == 0) & (key % 3 == 1)).select("transcript_id", F.lit(3), F.lit(""))
    return first.union(second).union(third)


def outcomes(c):
    return responses.classify_attempts(attempts(c), SCHEMA)


def parsed(c):
    return responses.parse_responses(c.responses, SCHEMA)


def good_labels(c):
    return (
        parsed(c)
        .where(F.col("parsed").isNotNull())
        .select("transcript_id", F.col("parsed.stance_ambivalence.label").alias("label"))
    )


@query(
    "r01_strip_fences",
    r"""SELECT transcript_id, trim(replace(replace(content, '```json', ''), '```', ''), E' \n') AS content
    FROM fx_responses""",
)
def _(c):
    return c.responses.select("transcript_id", strip_fences(F.col("content")).alias("content"))


@query(
    "r02_parse_responses",
    """SELECT transcript_id, CASE WHEN transcript_id % 29 <> 0 AND transcript_id % 31 <> 0 THEN label END AS label,
        CASE WHEN transcript_id % 29 <> 0 AND transcript_id % 31 <> 0 THEN concat('q', transcript_id % 10) END AS quote,
        CASE WHEN transcript_id % 29 = 0 THEN 'empty content' WHEN transcript_id % 31 = 0 THEN 'invalid JSON' END AS reason
    FROM fx_responses""",
)
def _(c):
    value = F.col("parsed.stance_ambivalence")
    return parsed(c).select(
        "transcript_id", value["label"].alias("label"), F.get(value["quotes"], 0).alias("quote"), "reason"
    )


def graph_responses(c):
    """Documents rendered as fenced JSON text; every 31st is cut short."""
    docs = documents.assemble_graphs(c.nodes, c.edges, c.graphs)
    body = F.to_json(F.struct(F.lit("claimed").alias("transcript_id"), "domain", "nodes", "edges"))
    cut = F.when(F.col("graph_id") % 31 == 0, F.substring(body, 1, 60)).otherwise(body)
    return docs.select(
        F.col("graph_id").alias("transcript_id"), F.concat(F.lit("```json\n"), cut, F.lit("\n```")).alias("content")
    )


@query(
    "r02_parse_graphs",
    """SELECT graph_id AS transcript_id, CASE WHEN graph_id % 31 <> 0 THEN n END AS n_nodes,
        CASE WHEN graph_id % 31 <> 0 THEN m END AS n_edges, CASE WHEN graph_id % 31 = 0 THEN 'invalid JSON' END AS reason
    FROM (SELECT graph_id, count(*) AS n FROM fx_nodes GROUP BY 1)
    JOIN (SELECT graph_id, count(*) AS m FROM fx_edges GROUP BY 1) USING (graph_id)""",
)
def _(c):
    size = lambda name: F.when(F.col("parsed").isNotNull(), F.size(f"parsed.{name}").cast("long"))
    return responses.parse_graphs(graph_responses(c)).select(
        "transcript_id", size("nodes").alias("n_nodes"), size("edges").alias("n_edges"), "reason"
    )


@query(
    "r03_classify_attempts",
    """SELECT transcript_id, n_attempts, CASE WHEN outcome IN ('ok', 'retry') THEN outcome ELSE 'failed' END AS status,
        CASE WHEN outcome NOT IN ('ok', 'retry') THEN outcome END AS reason FROM fx_outcomes""",
    ATTEMPTS,
)
def _(c):
    return outcomes(c)


@query(
    "r04_failure_log",
    "SELECT transcript_id, outcome AS reason FROM fx_outcomes WHERE outcome NOT IN ('ok', 'retry')",
    ATTEMPTS,
)
def _(c):
    return responses.failure_log(outcomes(c))


@query(
    "r05_attach_provenance",
    """SELECT graph_id AS transcript_id, split, domain, 'model_x' AS extraction_model, 'v4' AS prompt_version
    FROM fx_graphs WHERE graph_id % 31 <> 0""",
)
def _(c):
    source = c.cohorts.select(F.col("graph_id").alias("transcript_id"), "split")
    return responses.attach_provenance(responses.parse_graphs(graph_responses(c)), source, "model_x", "v4").drop(
        "nodes", "edges"
    )


@query(
    "r06_validate_label_response",
    """SELECT transcript_id, 'stance_ambivalence' AS attribute, 'invalid label' AS warning FROM fx_b
        WHERE transcript_id % 9 <> 0 AND label = 'error'
    UNION ALL SELECT transcript_id, 'stance_ambivalence', 'no quotes' FROM fx_b
        WHERE transcript_id % 9 <> 0 AND transcript_id % 4 = 0 AND label <> 'uncertain'
    UNION ALL SELECT transcript_id, 'stance_ambivalence', 'missing reasoning' FROM fx_b
        WHERE transcript_id % 9 <> 0 AND transcript_id % 6 = 0
    UNION ALL SELECT transcript_id, 'stance_ambivalence', 'missing attribute' FROM fx_b WHERE transcript_id % 9 = 0""",
)
def _(c):
    key = F.col("transcript_id")
    answer = F.struct(
        "label", F.when(key % 6 != 0, F.col("reasoning")).otherwise("").alias("reasoning"), "quotes"
    )
    content = F.to_json(F.struct(F.when(key % 9 != 0, answer).alias("stance_ambivalence")))
    raw = c.annotations("b").select("transcript_id", content.alias("content"))
    return responses.validate_label_response(
        responses.parse_responses(raw, SCHEMA), {"stance_ambivalence": AMBIVALENCE_LABELS}
    )


@query(
    "r07_error_entries",
    """SELECT transcript_id, CASE WHEN transcript_id % 29 = 0 OR transcript_id % 31 = 0 THEN 'error' ELSE label END AS label,
        CASE WHEN transcript_id % 29 = 0 THEN 'empty content' WHEN transcript_id % 31 = 0 THEN 'invalid JSON' END AS reason
    FROM fx_responses""",
)
def _(c):
    answers = parsed(c)
    return responses.error_entries(c.responses, good_labels(c), responses.failure_log(answers))


@query(
    "r08_label_distribution",
    """SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent,
        label IN ('low', 'med', 'high', 'uncertain') AS is_valid,
        CAST((SELECT count(*) FROM fx_b WHERE label = 'error') AS BIGINT) AS n_errors
    FROM fx_b GROUP BY label""",
)
def _(c):
    return responses.label_distribution(c.annotator_b, AMBIVALENCE_LABELS)


@query(
    "r09_batch_sizes",
    """SELECT graph_id, coalesce(n, 0) AS n_nodes, coalesce(m, 0) AS n_edges, coalesce(v, 0) AS n_violations FROM fx_graphs
    LEFT JOIN (SELECT graph_id, count(*) AS n FROM fx_nodes GROUP BY 1) USING (graph_id)
    LEFT JOIN (SELECT graph_id, count(*) AS m FROM fx_edges GROUP BY 1) USING (graph_id)
    LEFT JOIN (SELECT graph_id, count(*) AS v FROM fx_violations GROUP BY 1) USING (graph_id)""",
    VIOLATIONS,
)
def _(c):
    return responses.batch_sizes(c.nodes, c.edges, violations(c), c.graphs)


@query(
    "r09_batch_summary",
    """SELECT count(*) AS n_ids, count(*) FILTER (outcome = 'ok') AS n_success,
        count(*) FILTER (outcome NOT IN ('ok', 'retry')) AS n_failure, count(*) FILTER (outcome = 'retry') AS n_retry
    FROM fx_outcomes""",
    ATTEMPTS,
)
def _(c):
    return responses.batch_summary(outcomes(c))


# agreement and consensus

BOTH = {"fx_both_labels": "SELECT a.transcript_id, a.label AS la, b.label AS lb FROM fx_a a JOIN fx_b b USING (transcript_id)"}


@query(
    "l01_agreement",
    """SELECT count(*) AS n_common, count(*) FILTER (la = lb) AS n_agree,
        round(count(*) FILTER (la = lb) / count(*), 6) AS agreement_rate FROM fx_both_labels""",
    BOTH,
)
def _(c):
    out = labels.agreement(c.annotator_a, c.annotator_b)
    return out.withColumn("agreement_rate", F.round("agreement_rate", 6))


@query(
    "l02_cohen_kappa",
    """SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM (
        SELECT (SELECT avg(CASE WHEN la = lb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM fx_both_labels) AS po,
            (SELECT sum(pa * pb) FROM (SELECT la AS label, count(*) / (SELECT count(*) FROM fx_both_labels) AS pa
                FROM fx_both_labels GROUP BY 1)
             JOIN (SELECT lb AS label, count(*) / (SELECT count(*) FROM fx_both_labels) AS pb
                FROM fx_both_labels GROUP BY 1) USING (label)) AS pe)""",
    BOTH,
)
def _(c):
    return labels.cohen_kappa(c.annotator_a, c.annotator_b).select(F.round("kappa", 6).alias("kappa"))


@query(
    "l03_disagreements",
    "SELECT transcript_id, la AS label_a, lb AS label_b FROM fx_both_labels WHERE la <> lb",
    BOTH,
)
def _(c):
    return labels.disagreements(c.annotator_a, c.annotator_b)


@query("l04_merge_consensus", "SELECT transcript_id, label, source FROM fx_consensus")
def _(c):
    return labels.merge_consensus(c.annotator_a, c.annotator_b, c.adjudications)


REQUESTS = {
    **BOTH,
    "fx_request_order": """
        SELECT transcript_id, la, lb,
            CAST(concat('0x', substr(md5(concat('42|', transcript_id)), 1, 2)) AS INTEGER) % 2 = 0 AS a_first
        FROM fx_both_labels WHERE la <> lb""",
    "fx_request_text": r"""
        SELECT *,
            concat(la, ', because: reason a [evidence: ', CASE WHEN transcript_id % 4 = 0 THEN 'none' ELSE concat('a', transcript_id % 10) END, ']') AS ta,
            concat(lb, ', because: reason b [evidence: ', CASE WHEN transcript_id % 4 = 0 THEN 'none' ELSE concat('b', transcript_id % 10) END, ']') AS tb
        FROM fx_request_order""",
}


def requests(c):
    todo = labels.disagreements(c.annotator_a, c.annotator_b)
    return labels.judge_requests(todo, c.annotations("a"), c.annotations("b"))


@query(
    "l05_judge_requests",
    r"""SELECT transcript_id, CASE WHEN a_first THEN 'model_a' ELSE 'model_b' END AS model_for_a,
        CASE WHEN a_first THEN 'model_b' ELSE 'model_a' END AS model_for_b,
        concat('A = ', CASE WHEN a_first THEN ta ELSE tb END, E'\nB = ',
            CASE WHEN a_first THEN tb ELSE ta END) AS request FROM fx_request_text""",
    REQUESTS,
)
def _(c):
    return requests(c)


def judge_answers(c):
    key = F.col("transcript_id")
    pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (key % by + 1).cast("int"))
    answer = F.struct(
        pick(["low", "med", "bogus", "manual_review"], 4).alias("chosen_label"),
        pick(["A", "B", "X"], 3).alias("chosen_annotator"),
        F.lit("because").alias("reasoning"),
        F.when(key % 5 != 0, F.array(F.lit("q"))).alias("supporting_quotes"),
    )
    return requests(c).select("transcript_id", F.to_json(answer).alias("content"))


@query(
    "l06_parse_judgements",
    """SELECT transcript_id, CASE transcript_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'med' ELSE 'manual_review' END AS chosen_label,
        CASE transcript_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'none' END AS chosen_annotator,
        CASE WHEN transcript_id % 3 = 2 THEN NULL WHEN (transcript_id % 3 = 0) = a_first THEN 'model_a' ELSE 'model_b' END
            AS chosen_model,
        'because' AS reasoning, CASE WHEN transcript_id % 5 = 0 THEN 0 ELSE 1 END AS n_quotes FROM fx_request_order""",
    REQUESTS,
)
def _(c):
    return (
        labels.parse_judgements(judge_answers(c), requests(c))
        .withColumn("n_quotes", F.size("supporting_quotes"))
        .drop("supporting_quotes")
    )


@query(
    "l07_pending_adjudications",
    """SELECT transcript_id FROM fx_both_labels WHERE la <> lb AND transcript_id % 3 <> 0 AND transcript_id % 4 <> 1
    ORDER BY transcript_id LIMIT 200""",
    BOTH,
)
def _(c):
    disputed = labels.disagreements(c.annotator_a, c.annotator_b)
    details = c.annotator_a.where("transcript_id % 4 = 1")
    return labels.pending_adjudications(disputed, details, c.adjudications, limit=200)


def long_labels(c, which: str):
    """Two attributes per id; the second annotator calls every sixth adoption uncertain."""
    first = c.annotator_a if which == "a" else c.annotator_b
    key = F.col("transcript_id")
    label = F.col("label") if which == "a" else F.when(key % 6 == 0, "uncertain").otherwise(F.col("label"))
    tag = lambda df, name, value: df.select("transcript_id", F.lit(name).alias("attribute"), value.alias("label"))
    return tag(first, "stance_ambivalence", F.col("label")).unionByName(tag(c.adoption, "ai_adoption", label))


LONG = {
    "fx_long": """
        SELECT transcript_id, 'stance_ambivalence' AS attribute, a.label AS la, b.label AS lb
        FROM fx_a a JOIN fx_b b USING (transcript_id)
        UNION ALL SELECT transcript_id, 'ai_adoption', label,
            CASE WHEN transcript_id % 6 = 0 THEN 'uncertain' ELSE label END FROM fx_adoption""",
}


@query(
    "l08_compare_annotators",
    """SELECT attribute, count(*) AS n_common, round(count(*) FILTER (la = lb) / count(*), 6) AS agreement_rate,
        round(count(*) FILTER (la = 'uncertain') / count(*), 6) AS uncertain_a,
        round(count(*) FILTER (lb = 'uncertain') / count(*), 6) AS uncertain_b FROM fx_long GROUP BY 1""",
    LONG,
)
def _(c):
    out = labels.compare_annotators(long_labels(c, "a"), long_labels(c, "b"))
    return out.select(
        "attribute", "n_common", *[F.round(x, 6).alias(x) for x in ("agreement_rate", "uncertain_a", "uncertain_b")]
    )


@query(
    "l08_label_counts",
    """SELECT attribute, label, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM (
        SELECT attribute, la AS label, 1 AS a, 0 AS b FROM fx_long
        UNION ALL SELECT attribute, lb, 0, 1 FROM fx_long) GROUP BY ALL""",
    LONG,
)
def _(c):
    return labels.label_counts_side_by_side(long_labels(c, "a"), long_labels(c, "b"))


@query(
    "l09_encode_cohort",
    """SELECT graph_id, split, CASE split WHEN 'workforce' THEN 0 WHEN 'creatives' THEN 1 ELSE 2 END AS code
    FROM fx_cohorts""",
)
def _(c):
    return labels.encode(c.cohorts, COHORT_CODES, "split")


@query(
    "l10_encode_ai_adoption",
    """SELECT transcript_id, label, CASE label WHEN 'tool_user' THEN 0 ELSE 1 END AS code FROM fx_adoption
    WHERE label IN ('tool_user', 'integrated')""",
)
def _(c):
    return labels.encode(c.adoption, ADOPTION_CODES)


@query(
    "l10_excluded_ai_adoption",
    "SELECT label, count(*) AS n_excluded FROM fx_adoption WHERE label NOT IN ('tool_user', 'integrated') GROUP BY 1",
)
def _(c):
    return labels.excluded(c.adoption, ADOPTION_CODES)


@query(
    "l11_encode_ambivalence",
    """SELECT transcript_id, label, source, CASE label WHEN 'low' THEN 0 WHEN 'med' THEN 1 ELSE 2 END AS code
    FROM fx_consensus WHERE label IN ('low', 'med', 'high')""",
)
def _(c):
    return labels.encode(labels.merge_consensus(c.annotator_a, c.annotator_b, c.adjudications), AMBIVALENCE_CODES)


@query(
    "l11_excluded_ambivalence",
    "SELECT label, count(*) AS n_excluded FROM fx_consensus WHERE label NOT IN ('low', 'med', 'high') GROUP BY 1",
)
def _(c):
    merged = labels.merge_consensus(c.annotator_a, c.annotator_b, c.adjudications)
    return labels.excluded(merged, AMBIVALENCE_CODES)
