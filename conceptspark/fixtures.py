"""Concept-graph corpus, transcripts, labels and predictions derived from the driver's tables.

The rules are listed in FIXTURES.md; ``plans/views.py`` states the same views as SQL for the oracle.
"""

from __future__ import annotations

import math
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.functions.vocabulary import ADOPTION_CODES, AMBIVALENCE_CODES, COHORT_CODES
from conceptspark.operators.labels import encode, merge_consensus
from conceptspark.operators.ranking import consecutive_pairs
from conceptspark.operators.splits import repeated_splits
from conceptspark.session import scratch_path

_STORED: dict[tuple[str, str, str], str] = {}
SEEDS = list(range(42, 52))
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"  # off: tables that lie by graph are joined by (graph, node) where they are
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"  # above 0: a task writes its bucket as it comes, without sorting whole rows by bucket first
SIZE_FACTOR = "spark.sql.sources.fileCompressionFactor"  # Spark plans a broadcast by the bytes of a table's files times this
MEMORY_PER_FILE_BYTE = 40  # rows of the given and the stored tables take 10 to 38 times their bytes in files (60 x sf0.1)
ROWS_PER_BUCKET = 60_000  # order lines of a bucket; a bucket of nodes or edges has about three times as many rows
QUALITY = {
    "text": 0.80,
    "stats": 0.78,
    "graph": 0.70,
    "text-stats": 0.83,
    "text-graph": 0.81,
    "text-stats-graph": 0.83,
}


def _grounding(x: Column) -> Column:
    return (
        F.when(x % 11 == 0, F.lit(None).cast("string"))
        .when(x % 13 == 0, "guess")
        .when(x % 3 == 0, "explicit")
        .otherwise("inferred")
    )


def _edge(relation: Column, source: Column, target: Column, x: Column) -> list[Column]:
    return [
        F.col("graph_id"),
        source.alias("source"),
        target.alias("target"),
        relation.alias("relation"),
        F.when(x % 17 != 0, F.concat_ws(" ", relation, x.cast("string"))).alias("rationale"),
        _grounding(x).alias("grounding"),
    ]


class Corpus:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set(SIZE_FACTOR, str(MEMORY_PER_FILE_BYTE))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread_table(self, name: str, columns: list[str]) -> DataFrame:
        """A fact table over all cores. A scan with enough splits stays as it is; a file with one row group would
        otherwise be read, exploded and pre-aggregated by a single task."""
        df = self.table(name).select(*columns)
        wanted = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *columns)

    def _stored(self, name: str, build) -> DataFrame:
        """Corpus table written once per application and folder, then read with column pruning and pushdown."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = scratch_path(self.spark, name)
            build().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @cached_property
    def buckets(self) -> int:
        """Buckets of the graph tables; their number follows the rows, so that a bucket's size does not."""
        rows = self.table("lineitem").count()
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_BUCKET))

    def _bucketed(self, name: str, parts) -> DataFrame:
        """A table of all ``parts`` with the rows of a graph in one bucket, written once like ``_stored``.

        Groupings by ``graph_id`` and joins on it, alone or with the id of a node, read such tables without a shuffle.
        """
        self.spark.conf.set(CO_PARTITION, "false")
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = scratch_path(self.spark, name)
            table = f"conceptspark_{name}_{uuid.uuid4().hex}"
            writers = self.spark.conf.get(WRITERS)
            self.spark.conf.set(WRITERS, "2")
            try:
                # parts are appended: a union would hide that each lies by graph already, and shuffle them all again
                for part in parts():
                    rows = part.repartition(self.buckets, "graph_id")
                    rows.write.format("parquet").mode("append").option("path", path).option("compression", "zstd").bucketBy(
                        self.buckets, "graph_id"
                    ).saveAsTable(table)
            finally:
                self.spark.conf.set(WRITERS, writers)
            _STORED[key] = table
        return self.spark.table(_STORED[key])

    @cached_property
    def nodes(self) -> DataFrame:
        return self._bucketed("nodes", self.node_parts)

    @cached_property
    def edges(self) -> DataFrame:
        return self._bucketed("edges", self.edge_parts)

    @cached_property
    def splits(self) -> DataFrame:
        return self.splits_of(SEEDS)

    def splits_of(self, seeds: list[int]) -> DataFrame:
        """The splits of these seeds; a query of one seed does not rank the classes of the others."""
        name = "splits" if seeds == SEEDS else "splits-" + "-".join(map(str, seeds))
        return self._stored(name, lambda: repeated_splits(self.target_labels, seeds))

    # graph corpus: one graph per order

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with what nodes and edges take from part, supplier and nation; null where one of them is missing.

        One narrow shuffle for either key and one by graph: nodes and edges are then built bucket by bucket.
        """
        return self._bucketed("lines", lambda: [self.build_lines()])

    def build_lines(self) -> DataFrame:
        columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
        lines = self.spread_table("lineitem", columns).withColumnRenamed("l_orderkey", "graph_id")
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
        nations = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        met = suppliers.join(nations, "n_nationkey").withColumnRenamed("n_nationkey", "s_nationkey")
        parts = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size", F.lit(True).alias("known_part")
        )
        return lines.join(met, "l_suppkey", "left").drop("l_suppkey").join(parts, "l_partkey", "left")

    @cached_property
    def enriched(self) -> DataFrame:
        """Order lines with part and supplier nation."""
        return self.lines.where(F.col("known_part") & F.col("s_nationkey").isNotNull())

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("graph_id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
        )

    def node_parts(self) -> list[DataFrame]:
        none = F.lit(None).cast("string")
        no_list = F.lit(None).cast("array<string>")
        key = F.col("l_partkey")

        def candidate(prefix, of, type_, label, brand=none, size=F.lit(None).cast("int")):
            return F.struct(
                F.concat(F.lit(prefix), of.cast("string")).alias("id"),
                F.lit(type_).alias("type"),
                label.alias("label"),
                brand.alias("brand"),
                size.alias("size"),
            )

        # the three node kinds of a line go through one shuffle
        candidates = F.array(
            candidate("c", key, "Construct", F.col("p_name"), F.col("p_brand"), F.col("p_size")),
            candidate("v", F.col("s_nationkey"), "Value", F.col("n_name")),
            candidate("m", F.col("p_type"), "CognitiveStyleMarker", F.col("p_type")),
        )
        found = (
            self.enriched.select("graph_id", key, F.explode(candidates).alias("n"))
            .groupBy("graph_id", "n.id", "n.type", "n.label", "n.brand", "n.size")
            .agg(F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"))
        )
        construct = F.col("type") == "Construct"
        size = F.col("size")
        two_ends = F.array_distinct(F.array(F.col("first").cast("string"), F.col("last").cast("string")))
        negative = F.when((size % 8 == 0) | (size % 9 == 0), F.array().cast("array<string>")).otherwise(F.array("brand"))
        lined = found.select(
            "graph_id",
            "id",
            "type",
            "label",
            F.when(construct & (size % 8 != 0), F.col("brand")).alias("label_negative"),
            F.when(construct, size % 5 != 0).alias("bipolarity_complete"),
            none.alias("valence"),
            none.alias("grounding_span"),
            F.when(F.col("type") == "Value", F.array("label")).when(~construct, two_ends).alias("grounding_spans"),
            F.when(construct, F.array("label")).alias("grounding_spans_positive"),
            F.when(construct, negative).alias("grounding_spans_negative"),
        )
        flags = self.lines.groupBy("graph_id", "l_returnflag").agg(
            F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last")
        )
        flag = F.col("l_returnflag")
        status = F.col("o_orderstatus")
        stances = flags.join(self.orders, "graph_id").select(
            "graph_id",
            F.concat(F.lit("s"), flag).alias("id"),
            F.lit("Stance").alias("type"),
            F.concat_ws(" ", flag, "o_orderpriority").alias("label"),
            none.alias("label_negative"),
            F.lit(None).cast("boolean").alias("bipolarity_complete"),
            F.when(flag == "A", "positive")
            .when(flag == "R", "negative")
            .when(status == "F", "mixed")
            .when(status == "O", "ambivalent")
            .alias("valence"),
            none.alias("grounding_span"),
            two_ends.alias("grounding_spans"),
            no_list.alias("grounding_spans_positive"),
            no_list.alias("grounding_spans_negative"),
        )
        return [lined, stances]

    def edge_parts(self) -> list[DataFrame]:
        key = F.col("l_partkey")
        name = lambda prefix, of: F.concat(F.lit(prefix), of.cast("string"))
        construct = name("c", key)
        # all edges a line gives rise to, deduplicated in one shuffle of short keys; names are built afterwards
        kind = lambda code, other: F.struct(F.lit(code).cast("byte").alias("kind"), other.cast("string").alias("other"))
        candidates = F.array_compact(
            F.array(
                kind(0, F.col("s_nationkey")),
                kind(1, F.col("l_returnflag")),
                F.when(F.col("p_size") % 7 == 0, kind(3, F.col("p_type"))).otherwise(kind(2, F.col("p_type"))),
                F.when(key % 97 == 0, kind(4, F.lit(None))),
                F.when(key % 101 == 0, kind(5, F.lit(None))),
            )
        )
        found = (
            self.enriched.select("graph_id", key, F.explode(candidates).alias("e"))
            .groupBy("graph_id", "l_partkey", "e.kind", "e.other")
            .agg(F.lit(1).alias("_one"))
        )
        is_kind = lambda *codes: F.col("kind").isin(*codes)
        other = F.col("other")
        source = F.when(is_kind(1), name("s", other)).when(is_kind(3), name("m", other)).otherwise(construct)
        target = (
            F.when(is_kind(0), name("v", other))
            .when(is_kind(2), name("m", other))
            .when(is_kind(4), name("x", key))
            .otherwise(construct)
        )
        relation = (
            F.when(is_kind(0, 4), "SERVES").when(is_kind(1), "EXPRESSED_VIA").when(is_kind(2, 3), "MODULATED_BY").otherwise("RELATES")
        )
        direct = found.select(*_edge(relation, source, target, key))
        pairs = consecutive_pairs(self.lines, ["graph_id"], "l_partkey", "before").repartition(self.buckets, "graph_id")
        step = (F.col("before") + key) % 4
        links = pairs.where(step.isin(0, 1)).select(
            *_edge(
                F.when(step == 0, F.lit("CONFLICTS_WITH")).otherwise(F.lit("IMPLIES")),
                name("c", F.col("before")),
                construct,
                key,
            )
        )
        # a graph meets each nation once, so this window holds at most one row per nation
        known = self.lines.where(F.col("s_nationkey").isNotNull())
        met = known.select("graph_id", F.col("s_nationkey").alias("n_nationkey"), "n_regionkey").distinct()
        chain = W.partitionBy("graph_id").orderBy("n_nationkey")
        subsumes = (
            met.withColumns(
                {"before": F.lag("n_nationkey").over(chain), "before_region": F.lag("n_regionkey").over(chain)}
            )
            .where(F.col("before_region") == F.col("n_regionkey"))
            .select(
                *_edge(
                    F.lit("SUBSUMES"), name("v", F.col("before")), name("v", F.col("n_nationkey")), F.col("n_nationkey")
                )
            )
        )
        return [direct, links, subsumes]

    @cached_property
    def cohorts(self) -> DataFrame:
        """(graph_id, split) of every order, with or without lines."""
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        segment = F.col("c_mktsegment")
        return self.orders.join(customers, "o_custkey").select(
            "graph_id",
            F.when(segment == "HOUSEHOLD", "creatives")
            .when(segment == "MACHINERY", "scientists")
            .otherwise("workforce")
            .alias("split"),
        )

    @cached_property
    def graphs(self) -> DataFrame:
        return self._bucketed("graphs", lambda: [self.build_graphs()])

    def build_graphs(self) -> DataFrame:
        filled = self.lines.select("graph_id").distinct()
        key = F.col("graph_id")
        return self.cohorts.join(filled, "graph_id", "left_semi").select(
            "graph_id",
            "split",
            F.when(key % 50 != 0, "orders").alias("domain"),
            F.concat(F.lit("m"), (key % 2).cast("string")).alias("extraction_model"),
            F.lit("v4").alias("prompt_version"),
        )

    # transcripts

    @cached_property
    def transcripts(self) -> DataFrame:
        """Raw text per conversation."""
        c = self.table("conversations")
        # the opening assistant turn carries its own tag; every other machine turn is tagged AI
        first = (
            c.where(F.col("role") == "assistant")
            .groupBy("conv_id")
            .agg(F.min("turn").alias("opening"))
        )
        tag = (
            F.when(F.col("role") == "user", "User: ")
            .when((F.col("role") == "assistant") & (F.col("turn") == F.col("opening")), "Assistant: ")
            .otherwise("AI: ")
        )
        tagged = c.join(first, "conv_id", "left").select(
            "conv_id",
            "turn",
            F.concat(tag, "text").alias("line"),
        )
        packed = tagged.groupBy("conv_id").agg(
            F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("lines")
        )
        split = F.element_at(
            F.array(F.lit("workforce"), F.lit("creatives"), F.lit("scientists")), (F.col("conv_id") % 3 + 1).cast("int")
        )
        return packed.select(
            F.col("conv_id").alias("transcript_id"),
            split.alias("split"),
            F.array_join("lines.line", "\n").alias("text"),
        )

    # labels and annotators

    @cached_property
    def annotator_a(self) -> DataFrame:
        price = F.col("o_totalprice")
        key = F.col("graph_id")
        label = (
            F.when(key % 41 == 0, "uncertain")
            .when(price < 140000, "low")
            .when(price >= 470000, "high")
            .otherwise("med")
        )
        return self.orders.select(key.alias("transcript_id"), label.alias("label"))

    @cached_property
    def annotator_b(self) -> DataFrame:
        key = F.col("transcript_id")
        label = F.col("label")
        moved = F.when(key % 43 == 0, "error").when(
            key % 5 == 0, F.when(label.isin("low", "high"), "med").when(label == "med", "low").otherwise(label)
        )
        return self.annotator_a.select("transcript_id", F.coalesce(moved, label).alias("label"))

    @cached_property
    def adjudications(self) -> DataFrame:
        key = F.col("transcript_id")
        return self.annotator_a.where(key % 3 == 0).select(
            "transcript_id", F.when(key % 7 == 0, "manual_review").otherwise(F.col("label")).alias("label")
        )

    @cached_property
    def adoption(self) -> DataFrame:
        grade = F.substring("o_orderpriority", 1, 1)
        label = (
            F.when(grade == "1", "power_user")
            .when(grade == "2", "integrated")
            .when(grade == "3", "tool_user")
            .when(grade == "4", "uncertain")
            .otherwise("novice")
        )
        return self.orders.select(F.col("graph_id").alias("transcript_id"), label.alias("label"))

    @cached_property
    def responses(self) -> DataFrame:
        """Raw response text of annotator A: fenced, empty or cut short by key."""
        key = F.col("transcript_id")
        body = F.concat(
            F.lit('{"stance_ambivalence": {"label": "'),
            F.col("label"),
            F.lit('", "reasoning": "price", "quotes": ["q'),
            (key % 10).cast("string"),
            F.lit('"]}}'),
        )
        text = (
            F.when(key % 29 == 0, "")
            .when(key % 31 == 0, F.substring(body, 1, 40))
            .when(key % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .otherwise(body)
        )
        return self.annotator_a.select("transcript_id", text.alias("content"))

    def annotations(self, which: str) -> DataFrame:
        """Flat annotation rows with reasoning and quotes; some rows cite nothing."""
        labels = self.annotator_a if which == "a" else self.annotator_b
        key = F.col("transcript_id")
        quotes = F.when(key % 4 != 0, F.array(F.concat(F.lit(f"{which}"), (key % 10).cast("string")))).otherwise(
            F.array().cast("array<string>")
        )
        return labels.select(
            "transcript_id",
            F.lit(f"model_{which}").alias("model"),
            "label",
            F.lit(f"reason {which}").alias("reasoning"),
            quotes.alias("quotes"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.col("label").alias("type"), F.col("embedding").cast("array<double>").alias("vector")
        )

    # encoded targets, splits and predictions

    @cached_property
    def consensus(self) -> DataFrame:
        return merge_consensus(self.annotator_a, self.annotator_b, self.adjudications)

    @cached_property
    def target_labels(self) -> DataFrame:
        """(target, transcript_id, label code) of the three targets."""
        coded = lambda df, target: df.select(F.lit(target).alias("target"), "transcript_id", F.col("code").alias("label"))
        cohorts = self.cohorts.withColumnRenamed("graph_id", "transcript_id")
        return (
            coded(encode(cohorts, COHORT_CODES, "split"), "cohort")
            .unionByName(coded(encode(self.adoption, ADOPTION_CODES), "ai_adoption"))
            .unionByName(coded(encode(self.consensus, AMBIVALENCE_CODES), "stance_ambivalence"))
        )

    @cached_property
    def predictions(self) -> DataFrame:
        return self.predictions_of(SEEDS)

    def predictions_of(self, seeds: list[int]) -> DataFrame:
        """Deterministic answers of twelve configurations on val and test of all targets, for these seeds."""
        configs = F.array(
            *[
                F.struct(
                    F.lit(combo).alias("combo"),
                    F.lit(arch).alias("architecture"),
                    F.lit(int(round((q - off) * 1000))).alias("quality"),
                )
                for combo, q in QUALITY.items()
                for arch, off in (("logistic", 0.0), ("stacked", 0.02))
            ]
        )
        asked = self.splits_of(seeds).where(F.col("split").isin("val", "test")).select(
            "target", "seed", "transcript_id", "split", F.col("label").alias("y"), F.explode(configs).alias("_c")
        ).select("*", "_c.*")
        key = F.concat_ws("|", "target", "combo", "architecture", F.col("seed").cast("string"), F.col("transcript_id").cast("string"))
        h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 1000
        two = F.col("target") == "ai_adoption"
        wrong = F.when(two, 1 - F.col("y")).otherwise((F.col("y") + 1 + h % 2) % 3).cast("int")
        return asked.select(
            "target", "combo", "architecture", "seed", "transcript_id", "split", "y",
            F.when(h < F.col("quality"), F.col("y")).otherwise(wrong).alias("yhat"),
        )

    @cached_property
    def demographics(self) -> DataFrame:
        """Adoption and career stage; every tenth id has none."""
        key = F.col("transcript_id")
        career = F.element_at(F.array(F.lit("early"), F.lit("mid"), F.lit("late")), (key % 3 + 1).cast("int"))
        return self.adoption.where(key % 10 != 0).select(
            "transcript_id", F.col("label").alias("ai_adoption"), career.alias("career_stage")
        )

    # label vectors

    @cached_property
    def label_vectors(self) -> DataFrame:
        """A vector for every (type, label), picked from the embeddings by label hash."""
        labels = self.nodes.select("type", "label").distinct()
        place = F.conv(F.substring(F.md5(F.concat_ws("|", "type", "label")), 1, 8), 16, 10).cast("long") % F.lit(self.table("embeddings").count())
        vectors = self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
        return labels.withColumn("vec_id", place).join(vectors, "vec_id").select("type", "label", "vector")
