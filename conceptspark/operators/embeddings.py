"""Vectors per graph or transcript, and the alignment of modalities."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.functions.vectors import normalised
from conceptspark.operators.joins import join_counted


WORD = r"\p{IsIdeographic}|[\p{L}\p{M}\p{N}&&[^\p{IsIdeographic}]]+"


def text_features(texts: DataFrame, column: str = "formatted", dim: int = 256) -> DataFrame:
    """(transcript_id, features): hashed TF-IDF of the text, unit length; words are runs of letters, marks and digits of any script,
    and every ideograph is a word of its own.

    The hashing stage needs no vocabulary; fitting is one pass that counts documents per bucket.
    """
    stages = Pipeline(
        stages=[
            RegexTokenizer(inputCol=column, outputCol="_tokens", pattern=WORD, gaps=False),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
            IDF(inputCol="_tf", outputCol="_tfidf"),
        ]
    )
    fitted = stages.fit(texts).transform(texts)
    return fitted.select("transcript_id", normalised(vector_to_array("_tfidf")).alias("features"))


def label_bag(nodes: DataFrame, label_vectors: DataFrame, graphs: DataFrame, dim: int) -> DataFrame:
    """(graph_id, features): mean of the unit label vectors of all nodes; no nodes gives the zero vector.

    ``label_vectors`` has one vector per (type, label); a NULL label is the empty one on both sides. A node whose label has no
    vector is an error. Vectors are added up map-side, and the nodes of a graph lie together as they were read: a counted vocabulary
    small enough goes to the nodes, so that only sums can cross a shuffle, and a graph of any size is a few rows of them.
    """
    label = F.coalesce("label", F.lit("")).alias("label")
    unit = label_vectors.select("type", label, normalised(F.col("vector")).alias("_u"))
    named = join_counted(nodes.select("graph_id", "type", label), unit, ["type", "label"], "left")
    lacking = F.raise_error(F.concat_ws(" ", F.lit("no vector for label"), "type", "label"))
    known = named.select("graph_id", F.coalesce("_u", lacking).alias("_u"))
    sums = known.groupBy("graph_id").agg(
        F.count("*").alias("_all"), *[F.sum(F.get("_u", F.lit(i))).alias(f"_s{i}") for i in range(dim)]
    )
    zero = F.array_repeat(F.lit(0.0), dim)
    mean = F.array(*[F.col(f"_s{i}") / F.col("_all") for i in range(dim)])
    return graphs.select("graph_id").join(sums, "graph_id", "left").select(
        "graph_id", F.when(F.col("_all").isNull(), zero).otherwise(mean).alias("features")
    )


def assert_complete(ids: DataFrame, table: DataFrame, name: str, shown: int = 10) -> None:
    """Raise with the first missing ids when ``table`` lacks some of ``ids``."""
    gaps = ids.select("transcript_id").join(table.select("transcript_id"), "transcript_id", "left_anti")
    found = [r[0] for r in gaps.orderBy("transcript_id").limit(shown).collect()]
    if found:
        raise ValueError(f"{name} lacks ids: {found}")


def missing_from(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, transcript_id) of every id a table lacks."""
    out = None
    for name, table in sorted(tables.items()):
        gaps = ids.select("transcript_id").join(table.select("transcript_id"), "transcript_id", "left_anti")
        gaps = gaps.select(F.lit(name).alias("name"), "transcript_id")
        out = gaps if out is None else out.unionByName(gaps)
    return out


def align_modalities(modalities: dict[str, DataFrame]) -> DataFrame:
    """Inner join of (transcript_id, features) tables; vectors concatenated in sorted modality order."""
    names = sorted(modalities)
    joined = None
    for name in names:
        one = modalities[name].select("transcript_id", F.col("features").alias(f"_{name}"))
        joined = one if joined is None else joined.join(one, "transcript_id")
    return joined.select("transcript_id", F.concat(*[F.col(f"_{n}") for n in names]).alias("features"))


def swap_modality(modalities: dict[str, DataFrame], name: str, other: DataFrame) -> dict[str, DataFrame]:
    """Replace one modality by another source for the same ids; gaps are an error."""
    if name not in modalities:
        raise KeyError(name)
    ids = modalities[name].select("transcript_id")
    assert_complete(ids, other, name)
    return {**modalities, name: other.join(ids, "transcript_id", "left_semi")}


def select_modalities(modalities: dict[str, DataFrame], keep: list[str]) -> dict[str, DataFrame]:
    unknown = [k for k in keep if k not in modalities]
    if unknown:
        raise KeyError(f"unknown modalities: {unknown}")
    return {k: modalities[k] for k in keep}


def labelled_slice(splits: DataFrame, modalities: dict[str, DataFrame], target: str, seed: int, split: str) -> DataFrame:
    """(transcript_id, features, label) of one split, ordered by id; every id must have all modalities."""
    mine = splits.where((F.col("target") == target) & (F.col("seed") == seed) & (F.col("split") == split))
    for name, table in modalities.items():
        assert_complete(mine, table, name)
    return (
        mine.select("transcript_id", "label")
        .join(align_modalities(modalities), "transcript_id")
        .select("transcript_id", "features", "label")
        .orderBy("transcript_id")
    )
