"""Each stage of the pipeline against what it promises, on a small table with awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import DOC, awkward
from test_jaccard import brute, family


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(3)
    texts = [t for _ in range(8) for t in family(rng, 6, 90, 5)] + [" ".join(f"s{rng.randrange(10**6)}" for _ in range(70)) for _ in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    rows += [rows[0], (1, texts[20], "en", "s", 1), (None, texts[3], "en", "s", 1), (None, "1 2 3 " + " ".join(map(str, range(100))), None, "s", 1)]
    rows += [(500, " ".join(map(str, range(9000, 9100))), "en", "s", 1), (501, "too short", "de", "s", 1)]
    own = spark.createDataFrame(rows, DOC)
    odd = awkward(spark)[0].select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000)
    own.union(odd).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS
    base = docs.filter(F.size(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")) >= 50)
    assert set(rows_of(kept)) <= set(rows_of(base)) and len([r for r in rows_of(kept) if "doc_id=501" in r]) == 0
    spoken = corpus_pipeline.language(spark, kept, sf_dir)
    assert rows_of(spoken) == rows_of(kept.filter(F.col("text").rlike(r"\p{L}")))
    single = corpus_pipeline.near_duplicates(spark, spoken, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in spoken.collect()]
    classes = {c for _, n, c in brute([(k, t) for k, (_, t) in enumerate(rows)])}
    assert len(single) == len(classes)
    packed = corpus_pipeline.packing(spark, spark.createDataFrame(single, DOC), sf_dir)
    assert packed.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in packed.filter("start = 0").collect())


def test_whole_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    wanted = {(r.doc_id, r.n) for r in corpus_pipeline.packing(spark, docs, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    found = {(r.doc_id, r.n) for r in corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert found == wanted and found


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_without_any_label_goes_by_the_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.language(spark, docs, sf_dir)
    assert rows_of(found) == rows_of(docs.filter(F.col("text").rlike(r"\p{L}"))) and found.count() > 0
