import json

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from conceptspark.sources import files
from conceptspark.streaming import ingest

CACHE = T.StructType([T.StructField("transcript_id", T.StringType()), T.StructField("label", T.StringType())])


def test_csv_cohorts(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "workforce.csv").write_text('transcript_id,text\nw1,"User: a ""quoted"" word\nAI: next, line"\n')
    (tmp_path / "raw" / "creatives").mkdir()
    (tmp_path / "raw" / "creatives" / "part.csv").write_text("transcript_id,text\nc1,User: x\n")
    rows = {r["transcript_id"]: r for r in files.scan_transcripts(spark, str(tmp_path / "raw")).collect()}
    assert rows["w1"]["text"] == 'User: a "quoted" word\nAI: next, line'
    assert rows["w1"]["split"] == "workforce" and rows["c1"]["split"] == "creatives"


def test_graph_documents_one_per_file(spark, tmp_path):
    folder = tmp_path / "prompt_version=v3"
    folder.mkdir()
    old = {"split": "workforce", "nodes": [{"id": "c1", "type": "Construct", "grounding_span": "old"}], "edges": []}
    (folder / "w_0001.json").write_text(json.dumps(old, indent=2))
    row = files.scan_graphs(spark, str(tmp_path), "v3").first()
    assert (row["transcript_id"], row["prompt_version"]) == ("w_0001", "v3")
    assert row["nodes"][0]["grounding_spans"] is None and row["nodes"][0]["grounding_span"] == "old"


def test_locked_corpus(spark, tmp_path):
    docs = spark.createDataFrame([("a", "w")], "transcript_id string, split string")
    files.write_corpus(docs, str(tmp_path), "v3")
    with pytest.raises(Exception):
        files.write_corpus(docs, str(tmp_path), "v3")
    with pytest.raises(PermissionError):
        files.write_corpus(docs, str(tmp_path), "v3", replace=True)


def test_corpus_is_written_compressed(spark, tmp_path):
    """Documents repeat themselves: their files take a small part of the plain JSON; a missing id still comes from the file name."""
    nodes = "array_repeat(struct('n' AS id, 'Construct' AS type, 'a label that returns' AS label), 20) AS nodes"
    docs = spark.range(2000).selectExpr("cast(id AS string) AS transcript_id", "'w' AS split", nodes)
    files.write_corpus(docs, str(tmp_path / "a"), "v4")
    plain = sum(len(line) for line in docs.toJSON().collect())
    assert sum(f.stat().st_size for f in (tmp_path / "a").rglob("part-*")) * 10 < plain
    back = files.scan_graphs(spark, str(tmp_path / "a"), "v4", one_per_file=False)
    assert back.count() == 2000 and back.where("size(nodes) = 20").count() == 2000
    files.write_corpus(spark.range(1).selectExpr("'w' AS split"), str(tmp_path / "b"), "v4")
    assert "." not in files.scan_graphs(spark, str(tmp_path / "b"), "v4", one_per_file=False).first()["transcript_id"].replace(".c000", "")


def test_cache_is_tolerant(spark, tmp_path):
    lines = ['{"transcript_id": "a", "label": "old"}', "", "not json", '{"label": "x"}', '{"transcript_id": "a", "label": "new"}', '{"transcript_id": "b"']
    (tmp_path / "cache.jsonl").write_text("\n".join(lines))
    rows = files.load_keyed_cache(spark, str(tmp_path / "cache.jsonl"), CACHE).collect()
    assert [(r["transcript_id"], r["label"]) for r in rows] == [("a", "new")]


def test_experiment_folders(spark, tmp_path):
    for name, file in (("good", "metrics.json"), ("none", "notes.json")):
        (tmp_path / "cohort" / name).mkdir(parents=True)
        (tmp_path / "cohort" / name / file).write_text('{\n "f1": 0.5\n}')
    schema = T.StructType([T.StructField("f1", T.DoubleType())])
    rows = files.scan_experiments(spark, str(tmp_path), schema).collect()
    assert [(r["target"], r["experiment"], r["f1"]) for r in rows] == [("cohort", "good", 0.5)]


def test_upsert_survives_more_files_and_a_restart(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    (tmp_path / "in").mkdir()

    def deliver(name, ids):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"transcript_id": i, "label": name}) for i in ids))

    def run():
        ingest.stream_upsert(spark, source, CACHE, store, state, files_per_batch=1).awaitTermination()
        return {r["transcript_id"]: r["label"] for r in spark.read.parquet(store).collect()}

    deliver("a.json", ["1", "2", "2"])
    assert run() == {"1": "a.json", "2": "a.json"}
    deliver("b.json", ["2", "3"])
    assert run() == {"1": "a.json", "2": "a.json", "3": "b.json"}
    assert spark.read.parquet(store).count() == 3


def test_upsert_keeps_the_first_record_of_a_batch(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.json").write_text('{"transcript_id": "1", "label": "a"}\n{"transcript_id": "2", "label": "z"}\n{"transcript_id": "2", "label": "b"}')
    (tmp_path / "in" / "a.json").write_text('{"transcript_id": "1", "label": "m"}')
    ingest.stream_upsert(spark, source, CACHE, store, state, files_per_batch=2).awaitTermination()
    rows = spark.read.parquet(store)
    assert {r["transcript_id"]: r["label"] for r in rows.collect()} == {"1": "m", "2": "z"}
    assert set(rows.columns) == {*CACHE.fieldNames(), "batch"}


def test_quality_checkpoints(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bad = {"id": "x", "type": "Stance"}
    for i in range(4):
        doc = {"transcript_id": str(i), "split": "w", "domain": "d", "nodes": [bad] if i == 0 else [], "edges": []}
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(doc))
    paths = [str(tmp_path / n) for n in ("store", "reports", "state")]
    ingest.stream_quality(spark, str(tmp_path / "in"), *paths, checkpoints=[2, 4], files_per_batch=1).awaitTermination()
    rows = spark.read.parquet(paths[1]).orderBy("checkpoint").collect()
    assert [(r["checkpoint"], r["n_graphs"]) for r in rows] == [(2, 2), (4, 4)]
    assert rows[-1]["violation_share"] == 0.25 and rows[-1]["abort"]


def test_last_folder_wins_over_many_files(spark, tmp_path):
    """Two deliveries of many files: part names of the first sort behind those of the second."""
    schema = T.StructType([T.StructField("route", T.StringType()), T.StructField("n", T.LongType())])
    for folder, start, routes in (("2024-01", 5, "abc"), ("2024-02", 0, "ab")):
        (tmp_path / folder).mkdir()
        for k, route in enumerate(routes):
            lines = [json.dumps({"route": route, "n": n}) for n in (1, 2 if folder == "2024-01" else 3)]
            (tmp_path / folder / f"part-{start + k}.json").write_text("\n".join(lines))
    found = files.scan_latest_results(spark, str(tmp_path / "*"), schema).collect()
    assert {r["route"]: r["n"] for r in found} == {"a": 3, "b": 3, "c": 2}


def test_experiment_folders_written_by_spark(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a_b", 1), ("t", "c", 2)], "target string, experiment string, n long")
    rows.write.partitionBy("target", "experiment").json(str(tmp_path / "runs"))
    found = files.scan_experiments(spark, str(tmp_path / "runs"), T.StructType([T.StructField("n", T.LongType())]), "*.json")
    assert sorted(map(tuple, found.collect())) == [("t", "a_b", 1), ("t", "c", 2)]


def test_upsert_reads_state_and_not_the_store(spark, tmp_path):
    """Stored ids are known without the store: it may be moved away between two runs."""
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    (tmp_path / "in").mkdir()

    def deliver(name, ids):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"transcript_id": i, "label": name}) for i in ids))

    deliver("a.json", ["1", "2"])
    ingest.stream_upsert(spark, source, CACHE, store, state).awaitTermination()
    deliver("b.json", ["2", "3", None])
    ingest.stream_upsert(spark, source, CACHE, str(tmp_path / "elsewhere"), state).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "elsewhere")).collect()
    assert [(r["transcript_id"], r["label"]) for r in rows] == [("3", "b.json")]
    assert spark.conf.get(ingest.PROVIDER) != ingest.ROCKSDB


def test_quality_totals_follow_the_batch_before(spark, tmp_path):
    """A batch's totals come from its own documents and the totals before, whatever became of the stored documents."""
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / n) for n in ("store", "reports", "state")]
    sizes = [0, 3, 1, 2]
    for i, n in enumerate(sizes):
        doc = {"transcript_id": str(i), "split": "w", "domain": "d", "nodes": [{"id": f"n{k}", "type": "Value"} for k in range(n)], "edges": []}
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(doc))
        ingest.stream_quality(spark, str(tmp_path / "in"), *paths, checkpoints=[4], files_per_batch=1).awaitTermination()
    sums = spark.read.parquet(f"{paths[0]}_totals/batch=3").first()
    assert (sums["n"], sums["nodes"], sums["squares"]) == (4, 6, 14)
    report = spark.read.parquet(paths[1]).first()
    assert report["mean_nodes"] == 1.5 and report["sd_nodes"] == pytest.approx((sum((n - 1.5) ** 2 for n in sizes) / 4) ** 0.5)


def test_document_metrics_equal_the_long_tables_without_shuffling_them(spark):
    """Types of edge ends are found inside a document: repeated ids, missing ends, null ids and lists, and one id in two documents."""
    from conceptspark.operators import documents, validation
    from conceptspark.schemas import GRAPH

    node = lambda i, t, **f: {"id": i, "type": t, "grounding_spans": ["a", "b"], **f}
    edge = lambda s, t, r="SERVES", **f: {"source": s, "target": t, "relation": r, "rationale": "x", "grounding": "inferred", **f}
    docs = [
        {"transcript_id": "a", "domain": "d", "nodes": [node("s", "Value"), node("s", "Stance", valence="mixed"), node("v", "Value")],
         "edges": [edge("s", "v"), edge("s", "none"), edge("v", "v", "IMPLIES", grounding="explicit"), edge(None, "v", rationale="")]},
        {"transcript_id": "b", "domain": None, "nodes": [node("v", "Stance"), node(None, "Value")], "edges": [edge("v", "s"), edge("v", None)]},
        {"transcript_id": "c", "domain": "d", "nodes": None, "edges": [edge("s", "v")]},
        {"transcript_id": "d", "domain": "d", "nodes": [node("v", None)], "edges": None},
        {"transcript_id": "e", "domain": "d", "nodes": [], "edges": []},
    ]
    table = spark.createDataFrame(docs, GRAPH).repartition(1)
    keyed = table.withColumnRenamed("transcript_id", "graph_id")
    nodes, edges = documents.explode_nodes(keyed), documents.explode_edges(keyed)
    slow = validation.validate_graphs(nodes, edges, keyed).groupBy("graph_id").count().collect()
    quick = ingest.document_metrics(table)
    assert {r.graph_id: r.n_violations for r in quick.collect()} == {**dict.fromkeys("abcde", 0), **{r[0]: r[1] for r in slow}}
    columns = ["graph_id", "source", "target", "relation", "source_type", "source_known", "target_type", "target_known"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(ingest.typed_edges(keyed)) == rows(validation.type_endpoints(edges, nodes))
    plan = quick._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(graph_id" in plan and "source" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_dataset_keeps_a_vector_once(spark, tmp_path):
    """Three targets of the same ids: every place is loaded, and the vector of an id is stored once."""
    splits = spark.createDataFrame(
        [(t, s, i, i % 2) for t in ("x", "y", "z") for i in range(30) for s in (["train", "test", "val"][(i + ord(t)) % 3],)], "target string, split string, transcript_id long, label int"
    )
    vectors = spark.range(30).selectExpr("id AS transcript_id", "array(rand(7), cast(id AS double)) AS features")
    files.write_dataset(splits, {"b": vectors, "a": vectors}, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 30
    found = {(r.target, r.split, r.transcript_id, r.label) for t in "xyz" for s in ("train", "val", "test") for r in files.load_dataset(spark, str(tmp_path / "d"), t, s).collect()}
    assert found == {(r.target, r.split, r.transcript_id, r.label) for r in splits.collect()}
    widths = files.dataset_metadata(files.read_dataset(spark, str(tmp_path / "d")), ["a", "b"]).collect()
    assert sum(r.n for r in widths) == 90 and {(r.dim_a, r.dim_b) for r in widths} == {(2, 2)}
    with pytest.raises(ValueError, match="lacks ids"):
        files.write_dataset(splits, {"a": vectors.where("transcript_id > 3")}, str(tmp_path / "e"))


def test_upsert_calls_no_function_per_id(spark, tmp_path):
    """The state is Spark's own; the first record of an id is found over many small parts of a task."""
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"transcript_id": str(i % 700), "label": f"a{i}"}) for i in range(2100)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    (tmp_path / "in" / "b.json").write_text("\n".join(line.replace('"a', '"b') for line in reversed(lines)))
    query = ingest.stream_upsert(spark, source, CACHE, store, state)
    query.awaitTermination()
    assert [op["operatorName"] for p in query.recentProgress for op in p["stateOperators"]][:1] == ["dedupe"]
    assert {r["transcript_id"]: r["label"] for r in spark.read.parquet(store).collect()} == {str(i): f"a{i}" for i in range(700)}
    row = lambda i: pa.record_batch({"transcript_id": [str(i % 3)], "n": [i], "_file": ["f"], "_block": [0], "_row": [i]})
    found = list(ingest._firsts("transcript_id", ["transcript_id", "n"], pending=2)(map(row, range(20, -1, -1))))
    assert [r for b in found for r in b.to_pylist()] == [{"transcript_id": str(i), "n": i} for i in range(3)]
    assert list(ingest._firsts("transcript_id", ["n"])(iter([]))) == []
