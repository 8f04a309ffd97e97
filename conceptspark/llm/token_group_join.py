"""N-gram Jaccard self-join by a token-group matrix, down to connected classes of documents.

Documents with the same shingle set are one entity. By the prefix principle two sets that reach the threshold share several of their
rarest shingles, so entities that share too few of these with others are done. The rest is partitioned into groups of similar sets. The
matrix says which group holds which rare shingle; a query looks only at groups that hold enough of its own, a group's token union
bounds the overlap any member can have with the query, and only groups that can reach the threshold are opened and compared member by
member. Inside a class that is already connected nothing is compared again, which keeps huge families of copies cheap: groups are
first connected inside, then by one query per class, and only what is still apart is searched by every member.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptspark.llm.common import slices, stored

WIDTH = 5
PERCENT = 80
#: one more rare shingle in the prefix, and one more that partners must share, for so many shingles of a set
PER_EXTRA = 10
SKETCH_BITS = 24
#: bits of a shingle's hash that postings carry: two shingles that agree in them only make more candidates
TOKEN_BITS = 48
#: slots of the filter of wanted entities: so many for each, up to a bitmap of 16 MB
SLOTS_EACH = 64
MIN_FILTER_BITS, MAX_FILTER_BITS = 16, 27
GROUP_SIZE = 256
QUERY_CHUNK = 256
SEEN_ENTRIES = 200_000
PART = 1 << 19

MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_random = np.random.default_rng(20240101)
#: a random number for each byte; A-Z count as a-z, white space as nothing
LETTERS = _random.integers(0, 2**64, 256, np.uint64)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0xD6E8FEB86659FD95
INVERSE = pow(BASE, -1, 2**64)


class Shingler:
    """Sets of hashed word shingles: sorted unsigned 64-bit hashes of ``width`` words, A-Z in lower case.

    A text of fewer words is one shingle; a text without words or a null one has the empty set. Words are hashed for many texts at once: a sum
    of random numbers of their bytes times powers of an odd base, taken as differences of one running sum.
    """

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE))

    def _words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of ``raw``, which starts and ends with white space."""
        data = np.frombuffer(raw, np.uint8)
        self._powers(len(data))
        space = IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        first, behind = edge[::2], edge[1::2]
        running = np.cumsum(LETTERS[data] * self.power[: len(data)], dtype=np.uint64)
        total = (running[behind - 1] - running[first - 1]) * self.inverse[first]
        total = (total ^ (total >> np.uint64(32))) * MIX[1]
        return total ^ (total >> np.uint64(29)), first

    def all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The set of each text, in order."""
        now: list[bytes] = []
        size = 0
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            if now and size + len(raw) > PART:
                yield from self._sets(now)
                now, size = [], 0
            now.append(raw)
            size += len(raw) + 1
        if now:
            yield from self._sets(now)

    def _sets(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        numbers, first = self._words(b" " + b" ".join(raws) + b" ")
        behind = 1 + np.cumsum([len(r) + 1 for r in raws])
        cuts = np.searchsorted(first, behind).tolist()
        for a, b in zip([0, *cuts], cuts):
            yield self._shingles(numbers[a:b])

    def _shingles(self, numbers: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return numbers
        width = min(self.width, len(numbers))
        n = len(numbers) - width + 1
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total = (total ^ (total >> np.uint64(29))) * MIX[0] + numbers[k : n + k]
        total = (total ^ (total >> np.uint64(30))) * MIX[1]
        total = (total ^ (total >> np.uint64(27))) * MIX[2]
        return np.unique(total ^ (total >> np.uint64(31)))


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """Shingles that the prefix of a set of ``n`` holds beyond the shortest one, plus one: as many are shared by partners as large."""
    return max(1, n // PER_EXTRA)


def _must_share(n: Column, percent: int) -> Column:
    """Rare shingles that an entity of ``n`` shares with any partner: :func:`extra` of the smallest partner's size."""
    return F.greatest(F.lit(1), F.floor(F.ceil(percent * n / 100) / PER_EXTRA)).cast("long")


def linked(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether the sets (sorted, distinct) reach the threshold."""
    a, b = len(own), len(other)
    if 100 * min(a, b) < percent * max(a, b):
        return False
    at = np.searchsorted(other, own)
    common = int((other[np.minimum(at, b - 1)] == own).sum())
    return 100 * common >= percent * (a + b - common)


def _entity(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _texts(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(*more, F.col(f"`{text_col}`").cast("string").alias("text_in"))


#: counts in one byte: exact below 16, then three bits after the leading one; larger counts never get smaller codes
EXACT, STEP_BITS = 16, 3
DECODED = np.array([*range(EXACT), *(((1 << STEP_BITS) + m) << (e - STEP_BITS) for e in range(4, 34) for m in range(1 << STEP_BITS))], np.int64)


def encoded(counts: np.ndarray) -> np.ndarray:
    """The byte of the largest decoded count that is not above each count."""
    codes = np.minimum(counts, EXACT - 1).astype(np.uint8)
    large = np.flatnonzero(counts >= EXACT)
    codes[large] = np.searchsorted(DECODED, counts[large], side="right") - 1
    return codes


def _sketch(docs: DataFrame, text_col: str, width: int, bits: int) -> np.ndarray:
    """How many documents hold a shingle of each hash bucket: ``2 ** bits`` counts as :func:`encoded` bytes, whatever the input's size.

    Any total order of shingles keeps the join exact; these counts only put the frequent ones last.
    """
    parts = 64
    step = (1 << bits) // parts

    def packed(counts: np.ndarray) -> bytes:
        return zlib.compress(encoded(counts).tobytes(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(width), np.zeros(1 << bits, np.uint32)
        for batch in (part for whole in batches for part in slices(whole)):
            for hashes in shingles.all(batch.column(0).to_pylist()):
                np.add.at(counts, (hashes >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        pieces = [packed(counts[k * step : (k + 1) * step]) for k in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(pieces, pa.binary())], names=["part", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.int64)
        for piece in part["counts"]:
            total += DECODED[np.frombuffer(zlib.decompress(piece), np.uint8)]
        return pd.DataFrame({"part": part["part"].iloc[:1], "counts": [packed(total)]})

    schema = "part int, counts binary"
    added = _texts(docs, text_col).mapInArrow(count, schema).groupBy("part").applyInPandas(add, schema)
    rows = {r["part"]: zlib.decompress(r["counts"]) for r in added.collect()}
    empty = bytes(step)
    return np.frombuffer(b"".join(rows.get(k, empty) for k in range(parts)), np.uint8)


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, order, sketch_bits: int) -> DataFrame:
    """Per row: number, id, set size, entity, and the rarest shingles of the set, ``TOKEN_BITS`` of each (null where the task has given
    the entity's before)."""
    bits, cut = np.uint64(64 - sketch_bits), np.uint64(64 - TOKEN_BITS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, counts, seen = Shingler(width), order.value, set()
        number = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, entities, prefixes = [], [], []
            for hashes in shingles.all(batch.column(1).to_pylist()):
                n, entity = len(hashes), _entity(hashes)
                sizes.append(n)
                entities.append(entity)
                if entity in seen or not n:
                    prefixes.append(None)
                    continue
                if len(seen) > SEEN_ENTRIES:
                    seen.clear()
                seen.add(entity)
                frequency = counts[(hashes >> bits).astype(np.int64)]
                rare = np.argsort(frequency, kind="stable")[: n - needed(n, percent) + extra(n)]
                prefixes.append((hashes[rare] >> cut).view(np.int64))
            numbers = pa.array(range(number, number + len(sizes)), pa.int64())
            number += len(sizes)
            columns = [numbers, batch.column(0), pa.array(sizes, pa.int64()), pa.array(entities, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "key", "n", "entity", "prefix"])

    picked = _texts(docs, text_col, F.col(f"`{id_col}`").alias("key"))
    return picked.mapInArrow(sign, f"number long, key {picked.schema['key'].dataType.simpleString()}, n long, entity binary, prefix array<long>")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of shingles that at least two entities hold, with the number of holders."""
    holders = F.count("*").over(Window.partitionBy("token"))
    return postings.withColumn("holders", holders).filter("holders > 1")


def _postings(signed: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Columns token, id, n, holders: rare shingles that entities share, of entities that share enough of them to have a partner.

    Copies of an entity from other tasks go after the first count, when few postings are left: the long lists of rare shingles are
    shuffled once, by shingle.
    """
    rare = signed.select(F.explode("prefix").alias("token"), F.col("number").alias("id"))
    owned = _shared(rare).drop("holders").join(owners.select("id", "n"), "id")
    share = F.count("*").over(Window.partitionBy("id"))
    enough = owned.withColumn("share", share).filter(F.col("share") >= _must_share(F.col("n"), percent)).drop("share")
    return stored(_shared(enough), "postings")


def _filter(active: DataFrame) -> tuple[np.ndarray, int]:
    """Bitmap over slots of the first four bytes of ``entity``, sized by the number of rows, and the mask that gives a slot.

    Bits are set byte by byte in Spark; what reaches the driver is at most ``2 ** MAX_FILTER_BITS`` bits.
    """
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, (SLOTS_EACH * active.count()).bit_length()))
    mask, parts = (1 << bits) - 1, 64
    step = (1 << bits) // 8 // parts
    slot = F.conv(F.hex(F.substring("entity", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(mask))
    bytes_ = active.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 8).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("byte")
    )

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        piece = np.zeros(step, np.uint8)
        piece[part["at"].to_numpy() % step] = part["byte"].to_numpy()
        return pd.DataFrame({"part": [int(part["at"].iloc[0]) // step], "piece": [zlib.compress(piece.tobytes(), 1)]})

    packed = bytes_.groupBy(F.floor(F.col("at") / step)).applyInPandas(pack, "part int, piece binary")
    rows = {r["part"]: zlib.decompress(r["piece"]) for r in packed.collect()}
    return np.frombuffer(b"".join(rows.get(k, bytes(step)) for k in range(parts)), np.uint8), mask


def _sets(docs: DataFrame, text_col: str, width: int, active: DataFrame) -> DataFrame:
    """Columns id, grp and shingles: the whole set of the ``active`` entities (entity, id, grp), once each.

    A filter of bounded size holds back most others before anything is shuffled; the join after it is exact.
    """
    flags, mask = _filter(active)
    flags = docs.sparkSession.sparkContext.broadcast(flags)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = flags.value
        shingles, seen = Shingler(width), set()
        for batch in (part for whole in batches for part in slices(whole)):
            entities, sets = [], []
            for hashes in shingles.all(batch.column(0).to_pylist()):
                entity = _entity(hashes)
                slot = int.from_bytes(entity[:4], "big") & mask
                if allowed[slot >> 3] >> (slot & 7) & 1 and entity not in seen:
                    if len(seen) > SEEN_ENTRIES:
                        seen.clear()
                    seen.add(entity)
                    entities.append(entity)
                    sets.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["entity", "shingles"])

    rows = _texts(docs, text_col).mapInArrow(emit, "entity binary, shingles array<long>")
    return rows.join(active, "entity").groupBy("entity", "id", "grp").agg(F.first("shingles").alias("shingles")).drop("entity")


class _Classes:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _connect_group(percent: int):
    """Classes inside one group of bounded size."""

    def connect(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id").reset_index(drop=True)
        sets = [s.view(np.uint64) for s in part["shingles"]]
        classes = _Classes(len(sets))
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                if classes.find(a) != classes.find(b) and linked(sets[a], sets[b], percent):
                    classes.join(a, b)
        ids = part["id"].to_numpy()
        part["class"] = ids[[classes.find(k) for k in range(len(sets))]]
        return part[["id", "grp", "class", "shingles"]]

    return connect


def _open_groups(percent: int):
    """Links between classes of queries and classes of members of one group."""

    def compare(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        if len(members) and len(queries):
            sets = [s.view(np.uint64) for s in members["shingles"]]
            union = np.unique(np.concatenate(sets))
            sizes, classes = np.array([len(s) for s in sets]), members["class"].to_numpy()
            for own, mine in zip(queries["asked"], queries["asked_class"], strict=True):
                own = own.view(np.uint64)
                n = len(own)
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                if 100 * int((union[at] == own).sum()) < percent * n:
                    continue
                for k in np.flatnonzero((100 * sizes >= percent * n) & (percent * sizes <= 100 * n)).tolist():
                    pair = (min(mine, classes[k]), max(mine, classes[k]))
                    if pair[0] != pair[1] and pair not in found and linked(own, sets[k], percent):
                        found.add(pair)
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return compare


def components(links: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node reachable) of undirected ``links`` a, b; min-label rounds with pointer jumping."""
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        lowered = labels.join(heard, "node").select("node", F.least("root", "heard").alias("low"), F.col("root").alias("old"))
        up = lowered.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        moved = lowered.join(up, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("root"), "old")
        moved = stored(moved, "labels")
        labels = moved.select("node", "root")
        if moved.filter("root != old").limit(1).count() == 0:
            return labels


def _apart(entries: DataFrame, asks: Column) -> DataFrame:
    """Entries of shingles that several classes hold and that some query holds."""
    holders = Window.partitionBy("token")
    bounds = {"low": F.min("class").over(holders), "high": F.max("class").over(holders), "asked": F.max(asks).over(holders)}
    return stored(entries.withColumns(bounds).filter("low != high and asked").drop(*bounds), "matrix")


def _cross_links(entries: DataFrame, asks: Column, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes: entries where ``asks`` is true against every group that holds enough of their shingles in another class.

    ``entries`` has token, id, n, grp, class and rank, ``sets`` has id, grp, class and shingles. Of two ranks the smaller one asks.
    """
    matrix = entries.groupBy("token", "grp").agg(
        F.max("rank").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.min("class").alias("first"), F.max("class").alias("last"),
    )
    asked = entries.filter(asks).select("token", "id", F.col("n").alias("own"), "rank", "class")
    meets = asked.join(matrix, "token").filter(
        (F.col("rank") < F.col("high")) & (100 * F.col("most") >= percent * F.col("own")) & (percent * F.col("least") <= 100 * F.col("own"))
        & ((F.col("first") != F.col("class")) | (F.col("last") != F.col("class")))
    )
    enough = F.col("share") >= _must_share(F.col("own"), percent)
    pairs = meets.groupBy("id", "grp", "own", "class").agg(F.count("*").alias("share")).filter(enough)
    pairs = stored(pairs.select("id", F.col("grp").alias("asked_grp"), F.col("class").alias("asked_class")), "candidates")
    chunks = pairs.groupBy("asked_grp").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks"))
    asking = pairs.join(chunks, "asked_grp").withColumn("asked_chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    asking = asking.join(sets.select("id", F.col("shingles").alias("asked")), "id").select("asked_grp", "asked_chunk", "asked", "asked_class")
    members = sets.join(chunks.withColumnRenamed("asked_grp", "grp"), "grp")
    members = members.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("grp", "chunk", "shingles", "class")
    opened = members.groupBy("grp", "chunk").cogroup(asking.groupBy("asked_grp", "asked_chunk"))
    return opened.applyInPandas(_open_groups(percent), "a long, b long").distinct()


def _relabel(table: DataFrame, roots: DataFrame) -> DataFrame:
    """``table`` with its class replaced by the root of it; classes without links stay."""
    roots = roots.withColumnRenamed("node", "class")
    return table.join(roots, "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
    group_size: int = GROUP_SIZE, sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id.

    Two documents link when ``100 * intersection >= percent * union`` of their shingle sets; component_id is the smallest id reachable by links.
    Null texts and texts without words have the empty set and link with nothing, so they keep their own id. Repeated rows and
    repeated ids are documents of their own with one class. A null id stays null and takes part; a class of null ids only has a null
    component. Other columns are not read; an empty table gives an empty table.
    """
    context = docs.sparkSession.sparkContext
    order = context.broadcast(_sketch(docs, text_col, width, sketch_bits))
    signed = stored(_signatures(docs, id_col, text_col, width, percent, order, sketch_bits), "signatures")
    owners = stored(signed.filter("n > 0").groupBy("entity").agg(F.min("number").alias("id"), F.first("n").alias("n")), "owners")
    postings = _postings(signed, owners, percent)
    # members of a family share its most held shingle, so they fall into as few groups as their number allows
    core = F.max(F.struct("holders", "token"))["token"].alias("core")
    active = stored(postings.groupBy("id").agg(core), "active")
    sizes = active.groupBy("core").agg(F.ceil(F.count("*") / group_size).alias("splits"))
    split = F.pmod(F.xxhash64("id"), F.col("splits"))
    grp = F.shiftrightunsigned(F.xxhash64("core", split), 64 - TOKEN_BITS).alias("grp")
    placed = stored(active.join(sizes, "core").select("id", grp), "placed")
    sets = _sets(docs, text_col, width, stored(owners.select("entity", "id").join(placed, "id"), "wanted"))
    sets = stored(sets.groupBy("grp").applyInPandas(_connect_group(percent), "id long, grp long, class long, shingles array<long>"), "sets")
    classes = sets.select("id", "class")
    # the smaller of two first classes asks, so a huge family is searched but never asks itself; the order holds for both rounds
    members = classes.groupBy("class").agg(F.count("*").alias("size"))
    ranked = sets.select("id", "grp", "class").join(members, "class").select("id", "grp", "class", F.struct("size", "class").alias("rank"))
    entries = _apart(postings.drop("holders").join(ranked, "id"), F.lit(True))
    # one query per class connects what is alike, then its other members ask the groups that still hold other classes
    leads = F.col("id") == F.col("rank.class")
    roots = components(_cross_links(entries, leads, sets, percent))
    later = components(_cross_links(_apart(_relabel(entries, roots), ~leads), ~leads, _relabel(sets, roots), percent))
    classes = _relabel(_relabel(classes, roots), later)
    known = signed.select("key", "n", "entity").join(owners.select("entity", "id"), "entity", "left").join(classes, "id", "left")
    known = stored(known.select("key", "n", F.coalesce("class", "id").alias("class")), "classed")
    lowest = known.filter("n > 0").groupBy("class").agg(F.min("key").alias("lowest"))
    result = known.join(lowest, "class", "left")
    return result.select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("key")).alias("component_id"))
