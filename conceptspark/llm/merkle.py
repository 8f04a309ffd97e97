"""Document fingerprints: a Merkle tree over sections, paragraphs, sentences and pieces, with DataFrame functions only.

Sections end at blank lines, paragraphs at line ends, sentences at a full stop and a space. A sentence longer than ``PIECE_CHARS`` is cut into
pieces at places that its own words choose, any other is one piece, so that long texts without sentence ends can be compared and located too.
The pieces are the leaves. A node's hash is the SHA-256 of its children's hashes: equal roots mean equal texts, and where two trees
differ the differing branches say which sections, paragraphs and pieces were edited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF_HEX = 8
#: a sentence up to this length is one piece, and no piece is longer
PIECE_CHARS = 128
#: one word in so many ends a piece
PIECE_WORDS = 8
#: a run of letters and digits of bounded length with the sign after it, or one other sign
PIECE_TOKEN = r"(?s)[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]]{1,32}[^\p{L}\p{N}]?|."
ROWS_PER_BUCKET = 1000
MAX_BUCKETS = 100_000
#: a range with so many times the rows of an even one is cut again
UNEVEN = 8


def _escaped(text: Column) -> Column:
    """The text without the sign 0, which marks cuts. Different texts stay different."""
    return F.replace(F.replace(text, F.lit("\1"), F.lit("\1a")), F.lit("\0"), F.lit("\1b"))


def _cut(sentence: Column) -> Column:
    """The pieces of an escaped sentence. A word whose hash fits ends a piece; where none fits for long, the piece ends at its full length."""
    words = F.regexp_extract_all(sentence, F.lit(PIECE_TOKEN), F.lit(0))
    marked = F.transform(words, lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(PIECE_WORDS)) == 0, F.concat(w, F.lit("\0"))).otherwise(w))
    bounded = F.transform(F.split(F.array_join(marked, ""), "\0"), lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0)))
    return F.when(F.length(sentence) > PIECE_CHARS, F.flatten(bounded)).otherwise(F.array(sentence))


def tree(text: Column) -> Column:
    """Piece hashes as an array of sections of paragraphs of sentences of pieces. Null counts as empty: one piece."""
    pieces_of = lambda q: F.transform(_cut(q), lambda x: F.sha2(x, 256))
    sentences = lambda p: F.transform(F.split(p, r"\. "), pieces_of)
    paragraphs = lambda s: F.transform(F.split(s, "\n"), sentences)
    return F.transform(F.split(_escaped(F.coalesce(text, F.lit(""))), "\n\n"), paragraphs)


def _above(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def _paragraph(sentences: Column) -> Column:
    return _above(F.transform(sentences, _above))


def _short(piece: Column) -> Column:
    return F.left(piece, F.lit(LEAF_HEX))


def fingerprint(nodes: Column) -> Column:
    """Root, then the short piece hashes: sections apart by ``/``, paragraphs by ``,``, sentences by ``.``, pieces side by side."""
    root = _above(F.transform(nodes, lambda s: _above(F.transform(s, _paragraph))))
    sentence = lambda q: F.array_join(F.transform(q, _short), "")
    paragraph = lambda p: F.array_join(F.transform(p, sentence), ".")
    short = F.array_join(F.transform(nodes, lambda s: F.array_join(F.transform(s, paragraph), ",")), "/")
    return F.concat(root, F.lit(":"), short)


def pieces(nodes: Column) -> Column:
    """Distinct short piece hashes."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(F.flatten(nodes))), _short))


def edited_pieces(own: Column, other: Column) -> Column:
    """Indexes (section, paragraph, sentence, piece) of pieces of the tree ``own`` that the tree ``other`` does not have."""
    known = F.array_distinct(F.flatten(F.flatten(F.flatten(other))))
    found = F.transform(own, lambda s, i: F.flatten(F.transform(s, lambda p, k: F.flatten(F.transform(p, lambda q, m: F.filter(
        F.transform(q, lambda x, n: F.when(~F.array_contains(known, x), F.struct(
            i.alias("section"), k.alias("paragraph"), m.alias("sentence"), n.alias("piece"),
        ))),
        lambda x: x.isNotNull(),
    ))))))
    return F.flatten(found)


def likeness(own: Column, other: Column) -> Column:
    """Share of distinct pieces that two trees have in common, from their :func:`pieces`."""
    common = F.size(F.array_intersect(own, other))
    return common / (F.size(own) + F.size(other) - common)


def edited_branches(own: Column, other: Column) -> Column:
    """Indexes (section, paragraph) of paragraphs of ``own`` whose hash the other tree does not have."""
    known = F.flatten(F.transform(other, lambda s: F.transform(s, _paragraph)))
    return F.flatten(
        F.transform(own, lambda s, i: F.filter(
            F.transform(s, lambda p, k: F.when(~F.array_contains(known, _paragraph(p)), F.struct(i.alias("section"), k.alias("paragraph")))),
            lambda x: x.isNotNull(),
        ))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row the id, the code points, the root and pieces as one string, and the tree itself. Null text is empty."""
    picked = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text_in"))
    return picked.select(f"`{id_col}`", F.length("text_in").cast("long").alias("n_chars"), tree(F.col("text_in")).alias("tree")).select(
        f"`{id_col}`", "n_chars", fingerprint(F.col("tree")).alias("fingerprint"), "tree"
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, text_in and next_text: the text of the next row by ascending id (ties by text, nulls first), cyclic.

    Rows go to ranges of ids taken from the data and are ordered inside their range; the first row of a range is sent to the range before it
    as well. The ranges' first ids, a few times ``MAX_BUCKETS`` rows at most, are what is broadcast. Rows of one and the same id
    (also null) share a range, since only their texts order them.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text_in"))
    placed = _in_ranges(rows)
    firsts = placed.groupBy("bucket").agg(F.min("key").alias("first_key"))
    # few rows, in one order
    order = F.row_number().over(_window(None, "bucket"))
    ordered = firsts.withColumn("place", order)
    before = ordered.select((F.col("place") + 1).alias("place"), F.col("bucket").alias("before"))
    last = ordered.agg(F.max("bucket").alias("last"))
    bounds = ordered.join(before, "place", "left").join(last, F.lit(True)).select("bucket", "first_key", F.coalesce("before", "last").alias("before"))
    joined = placed.join(F.broadcast(bounds), "bucket")
    is_first = F.col("key").eqNullSafe(F.col("first_key"))
    own = F.struct(F.col("bucket").alias("home"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("before").alias("home"), F.lit(1).alias("guest"))
    sent = joined.withColumn("at", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own)))).select("key", "text_in", "at.home", "at.guest")
    following = F.lead("text_in").over(_window("home", "guest", "key", "text_in"))
    return sent.withColumn("next_text", following).filter("guest = 0").select(F.col("key").alias(id_col), "text_in", "next_text")


def _in_ranges(rows: DataFrame) -> DataFrame:
    """Adds ``bucket``: ranges of ``key`` in ascending order, each with few rows unless they have one id.

    The span of ids is cut evenly; a range that is still too full is cut again over the span of its own ids, until none is, so outlying ids
    cost one more pass over the ids and no uneven task. A bucket is the path of its cuts. Only full ranges reach the driver.
    """
    n, low, high = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    per_bucket = max(ROWS_PER_BUCKET, -(-n // MAX_BUCKETS))
    place = lambda start, width: F.floor((F.col("key").cast("decimal(20,0)") - start) / width).cast("long")
    cut = lambda count, first, last: (last - first) // max(1, count // per_bucket) + 1
    if low is None:
        return rows.withColumn("bucket", F.array(F.lit(-1).cast("long")))
    placed = rows.withColumn("bucket", F.array(F.coalesce(place(F.lit(low), F.lit(cut(n, low, high))), F.lit(-1).cast("long"))))
    depth = 1
    while True:
        sizes = placed.filter(F.size("bucket") == depth).groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        full = sizes.filter(f"n > {UNEVEN * per_bucket} and low < high").collect()
        if not full:
            return placed
        again = rows.sparkSession.createDataFrame(
            [(r.bucket, r.low, cut(r.n, r.low, r.high)) for r in full], "bucket array<bigint>, start bigint, width bigint"
        )
        deeper = F.concat("bucket", F.array(place(F.col("start"), F.col("width"))))
        placed = placed.join(F.broadcast(again), "bucket", "left").select(
            "key", "text_in", F.when(F.col("start").isNull(), F.col("bucket")).otherwise(deeper).alias("bucket")
        )
        depth += 1


def _window(by: str | None, *order: str):
    from pyspark.sql import Window

    keys = [F.col(c).asc_nulls_first() for c in order]
    return Window.partitionBy(by).orderBy(*keys) if by else Window.orderBy(*keys)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, the text with its last half replaced from the next document's start, and compare.

    ``near_edited`` and ``near_next`` are shares of common pieces.
    One row per input row. Null texts are empty (0 code points, an edited text that is empty too). Repeated rows and ids are rows of their
    own; ties by text. A single row is its own next. Other columns are not read; an empty table gives an empty table.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text_in").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text_in"), 1, F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), 1, half))
    trees = rows.withColumn("edited", edited).select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text_in")).alias("own"),
        tree(F.col("edited")).alias("changed"), tree(F.col("next_text")).alias("following"),
    )
    marked = trees.select(
        id_col, "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        pieces(F.col("own")).alias("own"), pieces(F.col("changed")).alias("changed"), pieces(F.col("following")).alias("following"),
    )
    return marked.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
