"""From raw documents to packed sequences: quality rules, language, near duplicates, packing.

Each stage works on all rows its predecessor kept and is written as Parquet before the next one reads it. All but the last return
the columns of documents, with whole rows as they came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptspark.llm import lang_hierarchy, lexical_packing, risk_rules, token_group_join
from conceptspark.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the risk-controlled cutoffs keep. Rows without text fail the base rules.

    Texts are measured once: rows and measures are written together, and choosing cutoffs reads the measures only. Null ids have no label
    and are judged like any other row; equal rows share a verdict; an empty table gives an empty table; other columns are not read.
    """
    measured = stored(risk_rules.measure(risk_rules.stratified(docs), [*COLUMNS, "stratum"]), "measures")
    cutoffs = risk_rules.select_cutoffs(measured, table(spark, sf_dir, "labels"))
    return risk_rules.verdict(measured, cutoffs).filter("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language: those predicted ``und`` go. Nothing is learned from other tables.

    Without any labelled row there is no model; the texts alone decide then, as ``und`` means a text without a letter.
    """
    model = lang_hierarchy.fit(docs)
    if model is None:
        return lang_hierarchy.has_language(docs, COLUMNS).filter("has_language").select(*COLUMNS)
    found = lang_hierarchy.predict(docs, model, COLUMNS, lang_field="predicted", score_field="certainty")
    return found.filter(F.col("predicted") != lang_hierarchy.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the smallest id stays, rows of equal id in the order of their digests.

    A null id counts as the smallest. Rows that are equal in all columns are one. Rows without words link with nothing.
    """
    digest = F.sha2(F.to_json(F.struct(*COLUMNS)), 256)
    keyed = docs.select(*COLUMNS, F.struct("doc_id", digest.alias("digest")).alias("row"))
    classes = token_group_join.jaccard_classes(keyed, id_col="row")
    kept = classes.filter("n_shingles = 0 or row = component_id").select("row").distinct()
    return keyed.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 1024 ids: null texts are one end id, equal rows are packed each, ties go by
    position in the input, an empty table gives no pieces."""
    return lexical_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Packing and language models can't be put in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
