"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to an order. A symbol is looked for in the longest context first; each context that lacks
it escapes with a probability estimated from the number of different symbols seen there (method C), and symbols that the
longer context offered are excluded from the shorter one. The trie is a distributed table of (context, symbol) counts over all
training texts, without a cap. Texts are scored in blocks: a block asks for the code length of each distinct gram once, so neither
the trie nor the vocabulary is ever in one place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.llm.common import boolean, double, long, slices, stored

ORDER = 3
BLOCK_BYTES = 8 << 20
PART = 1 << 19
SUBTREES = 256
#: no UTF-8 text holds this byte: it stands before and after each text
EDGE = 0xFF


def _buffer(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with edges between them, and for each text its first position and the position behind its end symbol."""
    edge = bytes([EDGE]) * order
    data = np.frombuffer(edge + b"".join([t + edge for t in texts]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = order + np.concatenate([[0], np.cumsum(sizes + order)[:-1]]).astype(np.int64)
    return data, first, first + sizes + 1


def _grams(data: np.ndarray, low: int, high: int, order: int) -> np.ndarray:
    """Codes of the grams that end at positions low..high-1: ``order`` context bytes and the symbol, the symbol lowest."""
    code = np.zeros(high - low, np.int64)
    for k in range(order, -1, -1):
        code = (code << 8) | data[low - k : high - k]
    return code


def _distinct_grams(data: np.ndarray, spans: list[tuple[int, int]], order: int) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for group in _groups(spans):
        found, n = np.unique(np.concatenate([_grams(data, a, b, order) for a, b in group]), return_counts=True)
        both = np.concatenate([codes, found])
        codes, at = np.unique(both, return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
    return codes, counts


def _groups(spans: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The spans in groups of at most ``PART`` positions; longer spans are cut."""
    now, size = [], 0
    for low, high in spans:
        for a in range(low, high, PART):
            b = min(high, a + PART)
            if now and size + b - a > PART:
                yield now
                now, size = [], 0
            now.append((a, b))
            size += b - a
    if now:
        yield now


def blocks_of(docs: DataFrame, held_out: Column, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored rows block, keys, held, lengths, data: whole texts side by side and compressed, about ``block_bytes`` in each row."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType()),
    ])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        keys, held, texts, size, kind = [], [], [], 0, None
        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3)

        def close():
            nonlocal number
            number += 1
            columns = [
                pa.array([number]), pa.array([keys], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for batch in (part for whole in batches for part in slices(whole)):
            kind = batch.schema.field(0).type
            for key, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if texts and size + len(text) > block_bytes:
                    yield close()
                    keys, held, texts, size = [], [], [], 0
                keys.append(key)
                held.append(own)
                texts.append(text)
                size += len(text)
        if texts:
            yield close()

    return stored(rows.mapInArrow(gather, schema), "blocks")


def _texts(lengths, data: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.asarray(lengths, np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _block_keys(order: int):
    """Of each block its distinct words and grams in a fixed order, with their counts in the training texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, held, lengths, data = (batch.column(c)[row].as_py() for c in ("block", "held", "lengths", "data"))
                texts = _texts(lengths, data)
                words, counts = _block_words(texts, held)
                yield _key_rows(block, None, words, counts)
                codes, counts = _block_grams(texts, held, order)
                yield _key_rows(block, codes, None, counts)

    return find


def _word_places(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in the order in which they first stand, the place of each word of the texts there, and where each text's words end.

    Words of one text at a time become objects: those of a whole block are many times its bytes.
    """
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    found, ends = [np.empty(0, np.int32)], []
    for text in texts:
        own = text.lower().split()
        found.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
        ends.append(len(own))
    return list(known), np.concatenate(found), np.cumsum(ends, dtype=np.int64)


def _block_words(texts: list[bytes], held: list[bool]) -> tuple[list[bytes], np.ndarray]:
    words, places, ends = _word_places(texts)
    trained = np.repeat(~np.array(held, bool), np.diff(ends, prepend=0))
    return words, np.bincount(places[trained], minlength=len(words))


def _block_grams(texts: list[bytes], held: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    data, first, behind = _buffer(texts, order)
    spans = list(zip(first.tolist(), behind.tolist()))
    codes, counts = _distinct_grams(data, [s for s, out in zip(spans, held, strict=True) if not out], order)
    others, _ = _distinct_grams(data, [s for s, out in zip(spans, held, strict=True) if out], order)
    every = np.union1d(codes, others)
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, codes)] = counts
    return every, n


KEYS = "block long, place int, code long, word binary, n long"


def _key_rows(block: int, codes, words, counts) -> pa.RecordBatch:
    n = len(counts)
    columns = [
        pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
        pa.nulls(n, pa.int64()) if codes is None else pa.array(codes, pa.int64()),
        pa.nulls(n, pa.binary()) if words is None else pa.array(words, pa.binary()), pa.array(counts, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "place", "code", "word", "n"])


def code_lengths(codes: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's symbol in its context.

    ``codes`` are all grams, trained or only asked for, whose last two context bytes are among those of this subtree; ``pairs`` has the training
    counts of all 256 x 256 (context byte, symbol) pairs, from which orders 1 and 0 follow.
    """
    levels = {}
    for k in range(order, 1, -1):
        mask = (1 << (8 * (k + 1))) - 1
        own, at = np.unique(codes & mask, return_inverse=True)
        levels[k] = own, at, np.bincount(at, counts, len(own))
    singles = pairs.sum(axis=0)

    def count(k: int, grams: np.ndarray) -> np.ndarray:
        if k == 0:
            return singles[grams & 0xFF]
        if k == 1:
            return pairs[(grams >> 8) & 0xFF, grams & 0xFF]
        own, _, c = levels[k]
        return c[np.searchsorted(own, grams & ((1 << (8 * (k + 1))) - 1))]

    result = np.zeros(len(codes))
    open_ = np.ones(len(codes), bool)
    gone_sum, gone_kinds = np.zeros(len(codes)), np.zeros(len(codes))
    for k in range(order, -1, -1):
        if k > 1:
            own, at, c = levels[k]
            contexts, of = np.unique(own >> 8, return_inverse=True)
            total, kinds = np.bincount(of, c, len(contexts))[of][at], np.bincount(of, c > 0, len(contexts))[of][at]
            # what the symbols of this context weigh in the next shorter one
            shorter = np.bincount(of, np.where(c > 0, count(k - 1, own), 0), len(contexts))[of][at]
        elif k == 1:
            rows = pairs[(codes >> 8) & 0xFF]
            total, kinds, shorter = rows.sum(axis=1), (rows > 0).sum(axis=1), ((rows > 0) * singles).sum(axis=1)
        else:
            total, kinds, shorter = np.full(len(codes), singles.sum()), np.full(len(codes), (singles > 0).sum()), np.zeros(len(codes))
        own_count = count(k, codes)
        seen = open_ & (total > 0)
        rest, fresh = total - gone_sum, kinds - gone_kinds
        hit = seen & (own_count > 0)
        result[hit] += np.log10(own_count[hit] / (rest[hit] + fresh[hit]))
        escapes = seen & ~hit & (fresh > 0)
        result[escapes] += np.log10(fresh[escapes] / (rest[escapes] + fresh[escapes]))
        open_ &= ~hit
        gone_sum, gone_kinds = np.where(total > 0, shorter, gone_sum * 0), np.where(total > 0, kinds, gone_kinds * 0)
    result[open_] -= np.log10(256 - gone_kinds[open_])
    return result


def gram_table(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """Columns code and value (log10 probability) of all grams, from columns code and n (counts in training texts, 0 if only asked for).

    The trie is split into subtrees by the two bytes before the symbol; orders 1 and 0 are 65,536 counts, sent to every task.
    """
    pairs = np.zeros((256, 256))
    for row in grams.groupBy(F.expr("code & 65535").alias("pair")).agg(F.sum("n").alias("n")).collect():
        pairs[row["pair"] >> 8, row["pair"] & 0xFF] = row["n"]
    pairs = grams.sparkSession.sparkContext.broadcast(pairs)

    def subtree(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"code": part["code"], "value": code_lengths(part["code"].to_numpy(), part["n"].to_numpy(), order, pairs.value)})

    by = F.pmod(F.xxhash64(F.expr("(code >> 8) & 65535")), F.lit(SUBTREES)).alias("subtree")
    return grams.select("code", "n", by).groupBy("subtree").applyInPandas(subtree, "code long, value double")


def _score_block(order: int, total: int, kinds: int, ends: int, key_type: T.DataType):
    """Scores of a block's texts from the values of its distinct words and grams."""
    log_all, log_end = float(np.log10(total + kinds + 1)), float(np.log10(ends + 1))

    def score(blocks: pa.Table, values: pa.Table) -> pa.Table:
        key_kind = blocks.schema.field("keys").type.value_type
        columns: list[list] = [[] for _ in range(7)]
        for row in range(blocks.num_rows):
            held, lengths, data = (blocks.column(c)[row].as_py() for c in ("held", "lengths", "data"))
            texts = _texts(lengths, data)
            place, value = values.column("place").to_numpy(), values.column("value").to_numpy()
            is_word = values.column("is_word").to_numpy()
            of_word, of_gram = np.zeros(int(is_word.sum())), np.zeros(int((~is_word).sum()))
            of_word[place[is_word]], of_gram[place[~is_word]] = value[is_word], value[~is_word]
            _, places, stops = _word_places(texts)
            counts = of_word[places]
            logs = np.log10(counts + 1)
            for a, b in zip([0, *stops.tolist()], stops.tolist()):
                columns[2].append(b - a + 1)
                columns[3].append(int((counts[a:b] > 0).sum()) + (ends > 0))
                columns[4].append(float(logs[a:b].sum()) + log_end - (b - a + 1) * log_all)
            del places, counts, logs
            buffer, first, behind = _buffer(texts, order)
            columns[5] += _gram_sums(buffer, list(zip(first.tolist(), behind.tolist(), strict=True)), of_gram, order)
            columns[0] += blocks.column("keys")[row].as_py()
            columns[1] += held
            columns[6] += list(lengths)
        kinds_ = [key_kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = ["key", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds_, strict=True)], names=names)

    return score


def _gram_sums(data: np.ndarray, spans: list[tuple[int, int]], values: np.ndarray, order: int) -> list[float]:
    """Per span the sum of its grams' values; ``values`` are those of all distinct grams by ascending code."""
    codes, _ = _distinct_grams(data, spans, order)
    sums, span, left = np.zeros(len(spans)), 0, spans[0][1] - spans[0][0]
    for group in _groups(spans):
        # equal grams are numbered by hashing; only the distinct ones of a group are searched for
        place, own = pd.factorize(np.concatenate([_grams(data, a, b, order) for a, b in group]))
        each, at = values[np.searchsorted(codes, own)][place], 0
        for a, b in group:
            sums[span] += each[at : at + b - a].sum()
            at, left = at + b - a, left - (b - a)
            if not left and span + 1 < len(spans):
                span += 1
                left = spans[span][1] - spans[span][0]
    return sums.tolist()


def score(
    docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per input row: held_out, tokens, known tokens, training tokens, unigram base score, model score (log10), bytes, bits per byte.

    The model and the base learn from all rows for which ``held_out`` is not true and score all rows. A null text counts as empty: one end
    token, and the model's score of an empty text. A null id stays null and, unless ``held_out`` says otherwise, is learned from. Repeated rows
    count each time. Without any training text every symbol is equally likely. Other columns are not read; an empty table gives an empty
    table. ``order`` may be 2 to 6.
    """
    blocks = blocks_of(docs, F.lit(False) if held_out is None else held_out, id_col, text_col, block_bytes)
    keys = stored(blocks.select("block", "held", "lengths", "data").mapInArrow(_block_keys(order), KEYS), "keys")
    words = keys.filter("word is not null").select("block", "place", "word", "n")
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).first()["n"] or 0
    grams = keys.filter("code is not null").select("block", "place", "code", "n")
    table = gram_table(stored(grams.groupBy("code").agg(F.sum("n").alias("n")), "grams"), order)
    # a word stands once in each block: its training count, and whether this block is the first that has it
    once = words.groupBy("word").agg(F.sum("n").alias("c"), F.min("block").alias("head"))
    counted = words.select("block", "place", "word").join(once, "word").select("block", "place", "c", (F.col("head") == F.col("block")).alias("first"))
    looked_up = grams.join(table, "code").select("block", "place", F.lit(False).alias("is_word"), "value", F.lit(False).alias("first"))
    values = stored(
        counted.select("block", "place", F.lit(True).alias("is_word"), F.col("c").cast("double").alias("value"), "first").unionByName(looked_up), "values"
    )
    total = ends + (words.agg(F.sum("n")).first()[0] or 0)
    kinds = values.filter("is_word and first and value > 0").count() + (ends > 0)
    values = values.drop("first")
    kind = blocks.schema["keys"].dataType.elementType
    fields = [T.StructField("key", kind), boolean("held_out"), long("n_tokens"), long("n_known"), double("base_score"), double("score"), long("n_bytes")]
    scored = blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_score_block(order, total, kinds, ends, kind), T.StructType(fields))
    return scored.select(
        F.col("key").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") / F.lit(np.log10(2).item()) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
