"""Incremental ingest: quality checkpoints over arriving graph documents and a replay-safe upsert."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from conceptspark.operators import validation
from conceptspark.operators.documents import explode_nodes
from conceptspark.schemas import EDGE, GRAPH

CHECKPOINTS = [100, 250, 500, 750, 1250]  # fixed values: graph counts at which quality is reported
MAX_VIOLATION_SHARE = 0.20  # fixed value: more graphs with violations than this asks for an abort


TYPED = [*EDGE.fields, *[T.StructField(f"{end}_{c}", t) for end in ("source", "target") for c, t in (("type", T.StringType()), ("known", T.BooleanType()))]]


def _items(lists: pa.ListArray) -> tuple[pa.Array, pa.StructArray]:
    """Place of its document for every item of a column of lists, and the items."""
    return pc.list_parent_indices(lists).cast(pa.int64()), lists.flatten()


def typed_edges(documents: DataFrame) -> DataFrame:
    """(graph_id, edge, type and presence of both ends): the rows of ``validation.type_endpoints`` for (graph_id, nodes, edges).

    A document holds all its nodes, so its edges find their ends where it is read, in Arrow tables, and no row is shuffled.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, node = _items(batch.column("nodes"))
            place = pa.array(np.arange(len(at)))
            # of nodes that repeat an id the last position counts
            nodes = pa.table({"_doc": at, "_id": node.field("id"), "_place": place})
            last = nodes.group_by(["_doc", "_id"]).aggregate([("_place", "max")])
            types = last.append_column("type", node.field("type").take(last["_place_max"].combine_chunks()))
            types = types.append_column("known", pa.array(np.ones(len(types), bool))).select(["_doc", "_id", "type", "known"])
            of, edge = _items(batch.column("edges"))
            out = pa.table({"_doc": of, **{f.name: edge.field(f.name) for f in EDGE.fields}})
            for end in ("source", "target"):
                side = types.rename_columns(["_doc", end, f"{end}_type", f"{end}_known"])
                out = out.join(side, ["_doc", end], join_type="left outer")
            out = out.append_column("graph_id", batch.column("graph_id").take(out["_doc"].combine_chunks()))
            yield from out.select(names).to_batches(10_000)

    schema = T.StructType([documents.schema["graph_id"], *TYPED])
    names = schema.fieldNames()
    return documents.select("graph_id", *[F.coalesce(c, F.array().cast(documents.schema[c].dataType)).alias(c) for c in ("nodes", "edges")]).mapInArrow(find, schema)


def document_metrics(documents: DataFrame) -> DataFrame:
    """One small row per document: sizes, violations and inferential edges.

    Violations are counted in the task that reads the document; only counts are shuffled.
    """
    keyed = documents.withColumnRenamed("transcript_id", "graph_id")
    lists = keyed.select("graph_id", F.transform("nodes", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"))).alias("nodes"), "edges")
    found = validation.node_violations(explode_nodes(keyed)).unionByName(validation.typed_violations(typed_edges(lists)))
    found = found.unionByName(validation.graph_violations(keyed.select("graph_id", "domain")))
    found = found.groupBy("graph_id").agg(F.count("*").alias("n_violations"))
    of = lambda name: F.size(F.filter("edges", lambda e: e["relation"] == name))
    sized = keyed.select(
        "graph_id",
        "split",
        F.size("nodes").alias("n_nodes"),
        F.size("edges").alias("n_edges"),
        of("SUBSUMES").alias("n_subsumes"),
        of("IMPLIES").alias("n_implies"),
    )
    return sized.join(found, "graph_id", "left").na.fill(0, ["n_violations"])


COUNTS = ["n", "nodes", "squares", "edges", "inferential", "one_plus_one", "violating"]


def totals(metrics: DataFrame) -> DataFrame:
    """One row of whole-number sums over document metrics; rows of several batches add up to those of all."""
    inferential = F.col("n_subsumes") + F.col("n_implies")
    single = (F.col("n_subsumes") == 1) & (F.col("n_implies") == 1)
    nodes = F.col("n_nodes").cast("long")
    sums = [nodes, nodes * nodes, F.col("n_edges"), inferential, single.cast("long"), (F.col("n_violations") > 0).cast("long")]
    return metrics.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(c) for x, c in zip(sums, COUNTS[1:], strict=True)])


def checkpoint_report(sums: DataFrame) -> DataFrame:
    """One row over the documents whose totals these are."""
    n, wide = F.col("n"), lambda c: F.col(c).cast("decimal(19,0)")
    spread = (wide("n") * wide("squares") - wide("nodes") * wide("nodes")).cast("double")
    return sums.select(
        n.alias("n_graphs"),
        (F.col("nodes") / n).alias("mean_nodes"),
        (F.sqrt(F.greatest(spread, F.lit(0.0))) / n).alias("sd_nodes"),
        (F.col("edges") / n).alias("mean_edges"),
        (F.col("inferential") / n).alias("mean_inferential"),
        (F.col("one_plus_one") / n).alias("one_plus_one_share"),
        (F.col("violating") / n).alias("violation_share"),
    ).withColumn("abort", F.col("violation_share") > MAX_VIOLATION_SHARE)


def stream_quality(
    spark: SparkSession, source: str, store: str, reports: str, state: str, checkpoints: list[int] | None = None,
    files_per_batch: int = 50,
) -> StreamingQuery:
    """Start the stream: metrics of new documents are stored, a report row is written whenever the total
    passes a checkpoint. A batch reads its own documents and one row of totals that the batch before left beside the store,
    so its cost does not grow with the store. All writes replace the batch's own partition, so a replay changes nothing.
    """
    marks = sorted(checkpoints or CHECKPOINTS)
    kept = f"{store.rstrip('/')}_totals"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        document_metrics(batch).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        own = totals(session.read.parquet(f"{store}/batch={batch_id}"))
        before = 0
        if batch_id > 0:
            last = session.read.parquet(f"{kept}/batch={batch_id - 1}").select(COUNTS)
            before = last.first()["n"]
            own = own.unionByName(last).agg(*[F.sum(c).alias(c) for c in COUNTS])
        own.write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
        sums = session.read.parquet(f"{kept}/batch={batch_id}")
        passed = [m for m in marks if before < m <= sums.first()["n"]]
        if passed:
            crossed = F.explode(F.array(*map(F.lit, passed)))
            checkpoint_report(sums).withColumn("checkpoint", crossed).write.mode("overwrite").parquet(
                f"{reports}/batch={batch_id}"
            )

    arriving = spark.readStream.schema(GRAPH).option("maxFilesPerTrigger", files_per_batch).json(source)
    return (
        arriving.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _numbered(batches):
    """Rows with their place in the task; a task reads the lines of a file block in order."""
    at = 0
    for batch in batches:
        places = pa.array(range(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, places], names=[*batch.schema.names, "_row"])


def _firsts(key: str, names: list[str], pending: int = 100_000):
    """Of each key the first row of a task by file and line; rows kept are those of distinct keys and at most as many again."""

    def reduced(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in (key, "_file", "_block", "_row")])
        keys = rows.column(key).combine_chunks().take(order)
        changes = pc.not_equal(keys[1:], keys[:-1])
        return rows.take(order.filter(pa.concat_arrays([pa.array([True]), changes])))

    def run(batches):
        kept, waiting, size, limit = None, [], 0, pending
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size > limit:
                kept = reduced(pa.concat_tables([*([] if kept is None else [kept]), pa.Table.from_batches(waiting)]))
                waiting, size, limit = [], 0, max(pending, kept.num_rows)
        if size:
            kept = reduced(pa.concat_tables([*([] if kept is None else [kept]), pa.Table.from_batches(waiting)]))
        if kept is not None:
            yield from kept.select(names).to_batches(10_000)

    return run


def stream_upsert(
    spark: SparkSession, source: str, schema, store: str, state: str, key: str = "transcript_id", files_per_batch: int = 50
) -> StreamingQuery:
    """Write only ids not stored before; within a batch the first record of an id by file name and line stays.

    Which ids are stored is Spark's own keyed state on disk (RocksDB), versioned with the batches: a batch looks up its own ids only, so its
    cost does not grow with the store, and a replayed batch starts from the state before it and rewrites itself. Before the lookup the rows
    of a batch meet by id, and each task sorts out the first ones in Arrow tables; no function is called per id.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    placed = arriving.select("*", *place).where(F.col(key).isNotNull())
    rows = placed.mapInArrow(_numbered, T.StructType([*placed.schema.fields, T.StructField("_row", T.LongType())]))
    wanted = T.StructType(list(arriving.schema.fields))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = rows.repartition(partitions, key).mapInArrow(_firsts(key, wanted.fieldNames()), wanted)
    fresh = firsts.dropDuplicates([key])

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    query = fresh.writeStream.foreachBatch(on_batch).option("checkpointLocation", state).trigger(availableNow=True)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings it was started with
    try:
        return query.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
