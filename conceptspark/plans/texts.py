"""Transcript and worklist queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.functions.text import truncate_text
from conceptspark.operators import transcripts
from conceptspark.plans.registry import query

RAW = {
    "fx_raw": r"""
        SELECT conv_id AS transcript_id,
            CASE conv_id % 3 WHEN 0 THEN 'workforce' WHEN 1 THEN 'creatives' ELSE 'scientists' END AS split,
            string_agg(CASE WHEN role = 'user' THEN 'User: ' WHEN role = 'assistant' AND turn = opening
                THEN 'Assistant: ' ELSE 'AI: ' END || text, E'\n' ORDER BY turn) AS text
        FROM (SELECT *, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS opening FROM conversations)
        GROUP BY ALL""",
    "fx_ids": """
        SELECT DISTINCT conv_id AS transcript_id,
            CASE conv_id % 3 WHEN 0 THEN 'workforce' WHEN 1 THEN 'creatives' ELSE 'scientists' END AS split
        FROM conversations""",
}
TEMPLATE = "Domain: {domain}\nTranscript:\n{transcript}\nEnd of {domain}."


def parsed(c):
    return transcripts.parse_turns(c.transcripts)


def ids(c):
    return c.transcripts.select("transcript_id", "split")


@query("t01_parse_turns", "SELECT transcript_id, split, turn_index, speaker, text FROM fx_turns")
def _(c):
    return transcripts.explode_turns(parsed(c)).select(
        "transcript_id", "split", F.col("turn_index").cast("long").alias("turn_index"), "speaker", "text"
    )


@query(
    "t02_turn_counts",
    """SELECT transcript_id, split, count(*) AS n_turns, count(*) FILTER (speaker = 'AI') AS n_ai_turns,
        count(*) FILTER (speaker = 'Human') AS n_human_turns FROM fx_turns GROUP BY ALL""",
)
def _(c):
    return transcripts.turn_counts(parsed(c))


@query("t03_format_transcript", "SELECT transcript_id, split, formatted FROM fx_formatted")
def _(c):
    return transcripts.format_transcript(parsed(c))


@query("t04_filter_speaker_text", "SELECT transcript_id, split, human AS formatted FROM fx_formatted")
def _(c):
    return transcripts.filter_speaker_text(parsed(c), "Human")


@query(
    "t05_truncate_text",
    """SELECT transcript_id, CASE WHEN length(formatted) > 500 THEN substr(formatted, 1, 500) || ' [cut]'
        ELSE formatted END AS formatted FROM fx_formatted""",
)
def _(c):
    text = transcripts.format_transcript(parsed(c))
    return text.select("transcript_id", truncate_text(F.col("formatted"), 500, " [cut]").alias("formatted"))


@query(
    "t06_corpus_quality_report",
    """SELECT split, count(*) AS n_rows, count(*) FILTER (n_both < 2) AS n_missing_speaker,
        count(*) FILTER (n_chars < 100) AS n_short, min(n_chars)::BIGINT AS min_chars, max(n_chars)::BIGINT AS max_chars,
        median(n_chars) AS median_chars, 0::BIGINT AS n_repeated_ids, count(*) FILTER (copies > 1) AS n_repeated_texts
    FROM (SELECT r.split, length(text) AS n_chars, count(*) OVER (PARTITION BY text) AS copies, n_both
        FROM fx_raw r JOIN (SELECT transcript_id, count(DISTINCT speaker) AS n_both FROM fx_turns GROUP BY 1)
        USING (transcript_id)) GROUP BY 1""",
    RAW,
)
def _(c):
    return transcripts.corpus_quality_report(c.transcripts)


@query(
    "t07_build_prompts",
    r"""SELECT transcript_id, concat(E'Domain: ', split, E'\nTranscript:\n', formatted, E'\nEnd of ', split, '.') AS prompt
    FROM fx_formatted""",
)
def _(c):
    texts = transcripts.format_transcript(parsed(c))
    return transcripts.build_prompts(texts, TEMPLATE).select("transcript_id", "prompt")


@query(
    "t08_order_worklist",
    """SELECT transcript_id, split, row_number() OVER (PARTITION BY split ORDER BY transcript_id) AS position
    FROM fx_ids""",
    RAW,
)
def _(c):
    return transcripts.order_worklist(ids(c), "stratified")


@query(
    "t09_pending",
    """SELECT transcript_id, split FROM fx_ids WHERE transcript_id NOT IN
        (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1) ORDER BY transcript_id LIMIT 50""",
    RAW,
)
def _(c):
    cache = c.orders.where("graph_id % 3 = 1").select(F.col("graph_id").alias("transcript_id"))
    return transcripts.pending(ids(c), cache, limit=50)


def _requested(c):
    """Lines of an id list: existing ids, unknown ids, comments and blanks."""
    key = F.col("transcript_id")
    line = F.when(key % 7 == 0, F.concat(F.lit("# "), key.cast("string"))).when(key % 7 == 1, "  ")
    line = line.when(key % 7 == 2, (key + 1_000_000).cast("string")).otherwise(F.concat(key.cast("string"), F.lit(" ")))
    wanted = transcripts.clean_id_list(ids(c).select(line.alias("value")))
    return wanted.select(F.col("transcript_id").cast("long").alias("transcript_id"))


@query("t10_select_ids", "SELECT transcript_id, split FROM fx_ids WHERE transcript_id % 7 > 2", RAW)
def _(c):
    return transcripts.select_ids(ids(c), _requested(c))


@query(
    "t10_missing_ids",
    "SELECT transcript_id + 1000000 AS transcript_id FROM fx_ids WHERE transcript_id % 7 = 2",
    RAW,
)
def _(c):
    return transcripts.missing_ids(ids(c), _requested(c))


@query("t11_filter_split", "SELECT transcript_id, split FROM fx_ids WHERE split = 'scientists'", RAW)
def _(c):
    return transcripts.filter_split(ids(c), "scientists")
