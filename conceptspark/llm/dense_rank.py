"""Ranked lexical search of a set of items over all documents by dense blocked matrix products.

Documents become integer impacts per term, items become integer term weights, and a score is their dot product. Items are
dealt to blocks of bounded size; a block's terms are its compact vocabulary. A task multiplies tiles of items by tiles of
documents in float64: every product and every partial sum over one tile of terms is an integer below 2^53, so the product
is exact in any order of summation, and the partial sums are added in 64-bit integers. Each tile keeps the rows that reach
the k-th best score so far, ties included, which are then cut by (score, document id).

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.llm.common import long, per_text, slices, stored
from conceptspark.operators.ranking import running_total

BLOCK_TERMS = 200_000  # item terms of a block (one longer item is a block of its own): what is broadcast at a time
TILE_ITEMS = 256
TILE_DOCS = 512
TILE_TERMS = 2048
CHUNK = 1 << 22  # bytes of a text that are split into terms at a time
EXACT = 1 << 53  # integers below it are exact in float64
IMPACT = 1_000_000  # impacts are below it
MERGE_PARTS = 16

_KEPT = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def _term_runs(text: str | None, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, a few megabytes at a time."""
    data = (text or "").encode().translate(_TABLE)
    start = 0
    while start < len(data):
        end = len(data) if start + chunk >= len(data) else data.find(b" ", start + chunk)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def item_terms(items: DataFrame, item_id: str, text_col: str, block_terms: int) -> DataFrame:
    """(row, item_id, terms, block): distinct sorted terms of every item that has any, dealt to blocks in a fixed order."""

    def make():
        return lambda texts: [[sorted({w.decode() for run in _term_runs(t) for w in run}) for t in texts]]

    keyed = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    found = per_text(keyed, make, [T.StructField("terms", T.ArrayType(T.StringType()))], "text", ["item_id"])
    rows = stored(found.where(F.size("terms") > 0).withColumn("row", F.monotonically_increasing_id()), "items")
    ends = running_total(rows.select("row", F.size("terms").alias("n")), [], "row", "n", "end")
    blocks = ends.select("row", F.floor((F.col("end") - F.col("n")) / block_terms).alias("block"))
    return stored(rows.join(blocks, "row"), "item_blocks")


def document_terms(docs: DataFrame, vocabulary: list[str], doc_id: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of a document with repeats, and the counts of those in the vocabulary."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        place = {w.encode(): k for k, w in enumerate(words.value)}

        def work(texts):
            sizes, terms, counts = [], [], []
            for text in texts:
                n, found = 0, Counter()
                for run in _term_runs(text):
                    n += len(run)
                    found.update(map(place.get, run))
                found.pop(None, None)
                sizes.append(n)
                terms.append(list(found.keys()))
                counts.append(list(found.values()))
            return [sizes, terms, counts]

        return work

    fields = [long("n"), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    keyed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return per_text(keyed, make, fields, "text", ["doc_id"])


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents holding each term of the vocabulary: summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["term", "df"])

    parts = counted.select("terms").mapInArrow(run, "term int, df bigint")
    out = np.zeros(size, np.int64)
    for term, df in parts.groupBy("term").agg(F.sum("df")).collect():  # bounded by the vocabulary of a block
        out[term] = df
    return out


def weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) per term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


class ItemTile:
    """Weights of a few items over their own terms (``vocabulary``: sorted term numbers of the block)."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray):
        self.vocabulary = np.unique(np.concatenate(terms))
        self.matrix = np.zeros((len(terms), len(self.vocabulary)))
        for k, mine in enumerate(terms):
            self.matrix[k, np.searchsorted(self.vocabulary, mine)] = weight[mine]
        heaviest = max(1, int(weight.max(initial=0)))
        self.width = max(1, min(TILE_TERMS, (EXACT - 1) // (heaviest * IMPACT)))

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """(items, documents) as 64-bit integers, from one row per document and term."""
        column = np.searchsorted(self.vocabulary, term)
        held = column < len(self.vocabulary)
        held[held] = self.vocabulary[column[held]] == term[held]
        doc, column, impact = doc[held], column[held], impact[held]
        present, column = np.unique(column, return_inverse=True)
        out = np.zeros((len(self.matrix), n_docs), np.int64)
        order = np.argsort(column, kind="stable")
        doc, column, impact = doc[order], column[order], impact[order]
        for first in range(0, len(present), self.width):
            last = min(first + self.width, len(present))
            a, b = np.searchsorted(column, [first, last])
            tile = np.zeros((n_docs, last - first))
            tile[doc[a:b], column[a:b] - first] = impact[a:b]
            out += (self.matrix[:, present[first:last]] @ tile.T).astype(np.int64)
        return out


class Best:
    """The k best documents of each item so far, by falling score, then rising id (null ids last)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)  # a row below it cannot enter; scores of 0 never do
        self.item, self.score, self.doc = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, place = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, place]])
        doc, null = np.concatenate([self.doc, doc[place]]), np.concatenate([self.null, null[place]])
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        start = np.searchsorted(item, np.arange(len(self.floor)))
        kept = np.arange(len(item)) - start[item] < self.k
        self.item, self.score, self.doc, self.null = item[kept], score[kept], doc[kept], null[kept]
        full = np.bincount(self.item, minlength=len(self.floor)) >= self.k
        ends = np.searchsorted(self.item, np.arange(len(self.floor)), side="right") - 1
        self.floor[full] = self.score[ends[full]]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, per row of a document of n terms."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:  # beyond 64 bits: exact integers of any size
        m = np.array([50 + 50 * int(v) * documents // length for v in n], np.int64)
    else:
        m = 50 + 50 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def block_best(counted: DataFrame, terms: list[np.ndarray], weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(place, doc_id, score): the k best documents of each item of a block within each task."""
    shared = counted.sparkSession.sparkContext.broadcast((terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = shared.value
        tiles = [ItemTile(terms[a : a + TILE_ITEMS], weight) for a in range(0, len(terms), TILE_ITEMS)]
        best = [Best(len(tile.matrix), k) for tile in tiles]
        for whole in batches:
            for batch in slices(whole, TILE_DOCS):
                ids, n, listed, counts = batch.columns
                doc = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
                term = listed.flatten().to_numpy(zero_copy_only=False)
                tf = counts.flatten().to_numpy(zero_copy_only=False)
                impact = impacts(tf, n.to_numpy(zero_copy_only=False)[doc], documents, length)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for tile, found in zip(tiles, best, strict=True):
                    found.add(tile.scores(doc, term, impact, batch.num_rows), plain, null)
        for t, found in enumerate(best):
            docs = pa.array(found.doc, pa.int64(), mask=found.null)
            yield pa.RecordBatch.from_arrays([pa.array(found.item + t * TILE_ITEMS), docs, pa.array(found.score)], ["place", "doc_id", "score"])

    rows = counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts")
    return rows.mapInArrow(run, "place bigint, doc_id bigint, score bigint")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, ranks from 1.

    Null or empty texts have no terms: such documents count nowhere and such items have no rows. Equal scores are ranked by
    rising document id, null ids last. Repeated rows are documents (or items) of their own. Empty tables give no rows. Other
    columns of either table are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    blocks = item_terms(items, item_id, text_col, block_terms)
    out = spark.createDataFrame([], f"row bigint, item_id {items.schema[item_id].dataType.simpleString()}, doc_id bigint, score bigint")
    for (number,) in blocks.select("block").distinct().orderBy("block").collect():
        block = blocks.where(F.col("block") == number).select("row", "item_id", "terms").collect()  # at most block_terms terms, or one item
        vocabulary = sorted({w for item in block for w in item.terms})
        place = {w: i for i, w in enumerate(vocabulary)}
        counted = stored(document_terms(docs, vocabulary, doc_id, text_col), "document_terms")
        documents, length = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        weight = weights(document_frequencies(counted, len(vocabulary)), documents)
        terms = [np.array([place[w] for w in item.terms], np.int64) for item in block]
        found = block_best(counted, terms, weight, documents, length, k)
        keys = spark.createDataFrame(
            [(i, item.row, item.item_id) for i, item in enumerate(block)],
            T.StructType([long("place"), long("row"), T.StructField("item_id", items.schema[item_id].dataType)]),
        )
        out = out.unionByName(found.join(keys, "place").drop("place"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = W.partitionBy("row", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))).orderBy(*order)
    final = W.partitionBy("row").orderBy(*order)
    parts = out.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= k)
    ranked = parts.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL for ``search(documents, benchmark)``.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
i AS (SELECT row_number() OVER () AS row, item_id, text FROM benchmark),
dt AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
it AS (SELECT DISTINCT row AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
size AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM size),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
impact AS (SELECT doc_id, row, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l)) AS v
    FROM tf JOIN size USING (row), total),
scored AS (SELECT item, item_id, row, doc_id, sum(w * v)::BIGINT AS score
    FROM it JOIN w USING (term) JOIN impact USING (term) GROUP BY ALL HAVING sum(w * v) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 50
"""
