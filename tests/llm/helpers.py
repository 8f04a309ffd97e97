"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHING = ["text_in", "key", "n_tokens", "kept", "entity", "n", "block", "bucket", "value", "score", "stratum", "ids"]


def words(rng, n, vocabulary=200):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward_texts():
    rng = random.Random(5)
    long_text = " ".join(words(rng, 6000, 3000))
    return [
        None, "", " ", "\n", "a", "one two", "same words here for all of us", "same words here for all of us", "ÀÉß ñandú 中文 \U0001f600 é́",
        "A\tb\x0bc\x0cd\re\n\nf. g. h", "x" * 3000, " " * 500, "tab\t\t<|endoftext|> end <|startoftext|>", long_text, long_text + " tail",
        "The MIT License and the GNU General Public License; CC-BY, Apache License\n" * 3, "İΣ \x1c\x85  z", "#$% |<>& *** ###",
    ]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOC)


def awkward(spark):
    """Every awkward text, a repeated row, a null id, and columns whose names operators use inside."""
    texts = awkward_texts()
    rows = [*enumerate(texts), (13, texts[13]), (None, "no id here"), (None, None)]
    docs = docs_of(spark, rows)
    for name in CLASHING:
        docs = docs.withColumn(name, docs["source"])
    return docs, rows


def empty(spark):
    return spark.createDataFrame([], DOC)
