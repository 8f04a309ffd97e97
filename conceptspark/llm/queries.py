"""Registered queries of this subpackage, each over its whole table with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptspark.llm import (
    bpe, chunk_tokens, dense_rank, entropy_mix, lang_hierarchy, lexical_packing, license_scan, manifest, merkle, ppm, risk_rules, token_group_join, warc_zstd,
)
from conceptspark.llm.common import remainder, stored, table
from conceptspark.session import scratch_path


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2).drop("n_bytes")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op3_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = risk_rules.stratified(table(spark, sf_dir, "documents"))
    measured = stored(risk_rules.measure(docs, ["doc_id", "stratum"]), "measures")
    cutoffs = risk_rules.select_cutoffs(measured, table(spark, sf_dir, "labels"))
    return risk_rules.verdict(measured, cutoffs).select("doc_id", *risk_rules.MEASURES[:5], "base_failed", "kept")


def op4_chunked_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_tokens.count_tokens(table(spark, sf_dir, "documents"))


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_packing.pack(table(spark, sf_dir, "documents"))


def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_group_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = lang_hierarchy.fit(docs, ~held_out)
    return lang_hierarchy.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc_zstd.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc_zstd.read_archives(spark, path)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_dense_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_rank.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered=manifest.lowercased_every_fifth())


def op13_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = entropy_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ppm_scores, op2_bpe_round_trip, op3_risk_controlled_rules, op4_chunked_token_counts, op5_lexical_packing, op6_token_group_join,
        op7_hierarchical_language, op8_warc_zstd, op9_merkle_fingerprints, op10_license_scan, op11_dense_ranked_search,
        op12_butterfly_manifest, op13_entropy_mix,
    )
}
ORACLES: dict[str, str] = {"op11_dense_ranked_search": dense_rank.ORACLE, "op12_butterfly_manifest": manifest.ORACLE}
