"""Packing of token windows by lexical retrieval.

Documents arrive in shards of a bounded number of rows and tokens, each inside one task and without a shuffle. A shard
holds a BM25 inverted index over the token ids of its whole documents. Each seed document opens a window; its best unused neighbours by BM25
fill the window greedily, the last one is cut where the window ends, and the rest of it seeds the next window. A document
longer than a window fills windows of its own first. What is left at the end of a shard is cut into powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.llm.common import long, slices, tokenizer_file

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 1024
SHARD_DOCS = 2048
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: a term that more than one document in so many holds is a row of the dense table
DENSE_SHARE = 6
#: weights are rounded to multiples of this, small enough to tell scores apart, large enough for exact sums below 2^53 steps
STEP = 2.0**-20

PIECE = [long("start"), long("length"), long("ids_crc32"), long("doc_tokens"), long("sequence_id"), long("offset")]


def byte_encoder(json_path: str, ranks_path: str):
    """Function from a text to its ids as the vocabulary's tokenizers file gives them; special strings are their own tokens.

    The rank file holds the same vocabulary for a faster library.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


class Index:
    """BM25 inverted index over bags of token ids.

    Terms that many bags hold are kept as rows of a dense table, the others as posting lists. Weights are whole multiples of
    ``STEP``, so that their sums are exact in any order and equal bags have equal scores.
    """

    def __init__(self, bags: list[np.ndarray], query_terms: int | None = None):
        counted = [np.unique(b, return_counts=True) for b in bags]
        sizes = np.array([len(t) for t, _ in counted], np.int64)
        terms = np.concatenate([t for t, _ in counted]).astype(np.int64)
        tf = np.concatenate([c for _, c in counted]).astype(np.float64)
        owner = np.repeat(np.arange(len(bags)), sizes)
        length = np.array([len(b) for b in bags], np.float64)
        df = np.bincount(terms)
        idf = np.log1p((len(bags) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, float(length.mean())))
        weight = np.rint(idf[terms] * tf * (K1 + 1) / (tf + norm[owner]) / STEP) * STEP
        self.n = len(bags)
        frequent = np.flatnonzero(df * DENSE_SHARE > self.n)
        self.slot = np.full(len(df), -1)
        self.slot[frequent] = np.arange(len(frequent))
        in_table = self.slot[terms] >= 0
        self.table = np.zeros((len(frequent), self.n))
        self.table[self.slot[terms[in_table]], owner[in_table]] = weight[in_table]
        order = np.flatnonzero(~in_table)
        order = order[np.argsort(terms[order], kind="stable")]
        self.owner, self.weight = owner[order], weight[order]
        self.pointer = np.concatenate([[0], np.cumsum(np.where(self.slot < 0, df, 0))])
        at = np.concatenate([[0], np.cumsum(sizes)])
        # the query of a document: all its terms that others share, the most telling first, unless ``query_terms`` cuts it
        self.queries = []
        for k in range(len(bags)):
            own, weights = terms[at[k] : at[k + 1]], weight[at[k] : at[k + 1]]
            shared = df[own] > 1
            own, weights = own[shared], weights[shared]
            self.queries.append(own if query_terms is None else own[np.argsort(-weights, kind="stable")[:query_terms]])

    def scores(self, seed: int) -> np.ndarray:
        """Score of every document for the seed's query."""
        query = self.queries[seed]
        slots = self.slot[query]
        asked = np.zeros(len(self.table))
        asked[slots[slots >= 0]] = 1.0
        query = query[slots < 0]
        starts = self.pointer[query]
        sizes = self.pointer[query + 1] - starts
        where = np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return np.bincount(self.owner[where], self.weight[where], self.n) + asked @ self.table

    def ranked(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Free documents that share a query term with the seed, best first, ties by position."""
        return np.fromiter(self.nearest(seed, free), np.int64)

    def nearest(self, seed: int, free: np.ndarray, first: int = 32) -> Iterator[int]:
        """The same one by one; those beyond the ``first`` are ordered only when they are asked for."""
        scores = self.scores(seed)
        hits = np.flatnonzero((scores > 0) & free)
        found = scores[hits]
        late = found < np.partition(found, -first)[-first] if len(hits) > first else np.zeros(len(hits), bool)
        for part in (~late, late):
            own, values = hits[part], found[part]
            yield from own[np.argsort(-values, kind="stable")].tolist()


def pack_shard(lengths: list[int], bags: list[np.ndarray], window: int, query_terms: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of one shard as lists of (document, start, length); every position lies in exactly one.

    ``bags`` hold the ids of the whole documents: likeness is that of documents, whatever part of them is left to pack.
    """
    windows = []
    start = [n - n % window for n in lengths]
    for k, full in enumerate(start):
        windows += [[(k, s, window)] for s in range(0, full, window)]
    free = np.array([n % window > 0 for n in lengths])
    index = Index(bags, query_terms) if free.any() else None
    following = 0
    open_seed = None
    while open_seed is not None or free.any():
        if open_seed is None:
            following += int(free[following:].argmax())
            open_seed = following
        seed, open_seed = open_seed, None
        free[seed] = False
        now, room = [(seed, start[seed], lengths[seed] - start[seed])], window - (lengths[seed] - start[seed])
        ranked = index.nearest(seed, free) if room else iter(())
        while room and (other := next(ranked, None)) is not None or room and free.any():
            if other is None:
                # nothing alike is left: the next free document in order
                following += int(free[following:].argmax())
                other = following
            free[other] = False
            take = min(room, lengths[other] - start[other])
            now.append((other, start[other], take))
            room -= take
            start[other] += take
            if start[other] < lengths[other]:
                open_seed = other
        windows.append(now)
    if windows and sum(n for _, _, n in windows[-1]) < window:
        windows[-1:] = _powers(windows[-1])
    return windows


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of an unfilled window, cut into windows whose lengths are powers of two."""
    left = sum(n for _, _, n in pieces)
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for doc, start, n in pieces:
        while n:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                out.append([])
            take = min(n, room)
            out[-1].append((doc, start, take))
            start, n, room = start + take, n - take, room - take
    return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None,
    window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS, query_terms: int | None = None,
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a window: id, start, length, crc32 of its ids, the document's ids in all,
    the window's number and the piece's offset there. ``with_ids`` adds the ids themselves.

    A document's ids end with ``end_id``; a null text counts as empty, so it is that one id. Every row of the input is
    packed, repeated rows as documents of their own; a null id stays null. Other columns are not read. An empty table gives
    no pieces. A shard's size bounds memory: it never leaves a document out, and one huge document may exceed it alone.
    """
    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text_in"))
    schema = T.StructType([picked.schema[0], *PIECE, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = byte_encoder(json_path or tokenizer_file(VOCABULARY), ranks_path or tokenizer_file(RANKS))
        sequence = TaskContext.get().partitionId() << 40
        keys: list = []
        ids: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal sequence
            lengths = [len(i) for i in ids]
            rows: list[tuple] = []
            for pieces in pack_shard(lengths, ids, window, query_terms):
                offset = 0
                for doc, start, n in pieces:
                    part = ids[doc][start : start + n]
                    row = (keys[doc], start, n, zlib.crc32(part.tobytes()), lengths[doc], sequence, offset)
                    rows.append((*row, part.astype(np.int64)) if with_ids else row)
                    offset += n
                sequence += 1
            columns = zip(*rows, strict=True)
            first = pa.array(next(columns), type_of_key)
            rest = [pa.array(c, pa.int64()) for c in columns] if not with_ids else [*_with_ids(columns)]
            return pa.RecordBatch.from_arrays([first, *rest], names=schema.fieldNames())

        type_of_key = None
        for batch in (part for whole in batches for part in slices(whole)):
            type_of_key = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                if keys and (len(keys) >= shard_docs or size + len(own) > shard_tokens):
                    yield shard()
                    keys, ids, size = [], [], 0
                keys.append(key)
                ids.append(own)
                size += len(own)
        if keys:
            yield shard()

    return picked.mapInArrow(run, schema)


def _with_ids(columns) -> Iterator[pa.Array]:
    *plain, ids = columns
    for c in plain:
        yield pa.array(c, pa.int64())
    yield pa.array(ids, pa.list_(pa.int64()))
