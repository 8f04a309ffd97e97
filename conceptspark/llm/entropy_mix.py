"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Document rates are as close as possible to one in the sense of
sum(r ln r - r + 1), subject to the target of their source and to a ceiling. The convex dual has one unknown per source, and its
solution tilts the rates exponentially: r = min(ceiling, exp(lambda * size / scale)). All sources take guarded Newton steps at
the same time: a step is one distributed pass over the (source, size, count) table, in which every document of a size shares
a rate. Rates become whole copies per (source, size), the words left over by one size handed on to the next smaller one, so that a
source misses its target by a few words at most; within a size the copies go to documents in the order of a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.llm.common import long, per_text, stored
from conceptspark.operators.joins import join_counted
from conceptspark.operators.ranking import rank_by_hash, rank_by_range
from conceptspark.session import cut_lineage

CEILING = 3
WEIGHTS = (1.0, 2.0, 3.0)
TOLERANCE = 1e-9  # of a source's target
MAX_STEPS = 200  # Newton needs about ten; bisection from any bracket ends earlier

# sums of decimals are the same in any order, so that reruns agree to the last digit
EXACT = "decimal(38,10)"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def count_words(text: str | None) -> int:
    """Maximal runs of characters other than space and ``\\t``-``\\r``."""
    if not text:
        return 0
    space = _SPACE[np.frombuffer(text.encode(), np.uint8)]
    return int(not space[0]) + int(np.count_nonzero(space[:-1] & ~space[1:]))


def measure(docs: DataFrame, doc_id: str, source: str, text_col: str) -> DataFrame:
    """(doc_id, tree, size): ids, a source key that is never null and keeps the order of code points, null last, and word counts."""
    key = F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`").cast("string")), F.lit("1")).alias("mix")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key, F.col(f"`{text_col}`").alias("text"))
    return per_text(keyed, lambda: lambda texts: [[count_words(t) for t in texts]], [long("size")], "text", ["doc_id", "mix"])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """(mix, source_size, target) from (mix, source_size).

    All words are shared by weight; a source stops at ``ceiling`` times its size and the rest goes to the others, again by weight.
    Only sums reach the driver. Each round stops at least one source or is the last.
    """
    placed = rank_by_range(sizes, [], ["mix"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    state = stored(placed.select("mix", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(ceiling)).alias("most")), "mix_sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1  # a source gets level * weight, or its most
    while True:
        over = F.col("most") < F.col("weight") * level
        full, n, rest = state.agg(
            F.sum(F.when(over, F.col("most").cast(EXACT))), F.count_if(over), F.sum(F.when(~over, F.col("weight").cast(EXACT)))
        ).first()
        if n == stopped or not rest:
            break
        level, stopped = float((total - (full or 0)) / rest), n
    return state.select("mix", "source_size", "weight", F.least(F.col("most").cast("double"), F.col("weight") * level).alias("target"))


def dual(classes: DataFrame, wanted: DataFrame, ceiling: float = CEILING, tolerance: float = TOLERANCE) -> DataFrame:
    """(mix, source_size, target, scale, tilt): the solution of the dual of every source.

    A source's words grow with its tilt, so that each pass also narrows the bracket (low, high) around the root; a Newton step that
    leaves the bracket is replaced by its middle. The brackets are exact from the start: they hold for the smallest document.
    """
    facts = classes.where("size > 0").groupBy("mix").agg(
        F.min("size").alias("least"),
        (F.sum(F.col("n").cast("decimal(19,0)") * F.col("size") * F.col("size")).cast("double") / F.sum(F.col("n") * F.col("size"))).alias("scale"),
    )
    ratio = F.log(F.col("target") / F.col("source_size")) * F.col("scale") / F.col("least")
    limit = F.lit(math.log(ceiling)) * F.col("scale") / F.col("least")
    grows = F.col("target") > F.col("source_size")
    state = cut_lineage(
        wanted.join(facts, "mix")
        .withColumns({"low": F.when(grows, 0.0).otherwise(ratio), "high": F.when(grows, limit).otherwise(0.0)})
        .withColumn("tilt", F.when(F.col("target") >= ceiling * F.col("source_size"), F.col("high")).otherwise(F.least(F.greatest(F.log(F.col("target") / F.col("source_size")), "low"), "high")))
    )
    for _ in range(MAX_STEPS):
        power = F.col("tilt") * F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(ceiling)), F.exp(F.least(power, F.lit(math.log(ceiling)))))
        words = F.col("n") * F.col("size")
        passed = (
            join_counted(classes.where("size > 0"), state, ["mix"])
            .groupBy("mix", "source_size", "target", "scale", "low", "high", "tilt")
            .agg(
                (F.sum((words * rate).cast(EXACT)).cast("double") - F.col("target")).alias("gap"),
                F.sum(F.when(power < math.log(ceiling), (words * F.col("size") / F.col("scale") * rate).cast(EXACT)).otherwise(0)).cast("double").alias("slope"),
            )
        )
        low = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("gap") / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        settled = (F.abs("gap") <= tolerance * F.col("target")) | (F.col("high") - F.col("low") <= 1e-15 * (1 + F.abs("tilt")))
        moved = (
            passed.withColumns({"low": low, "high": high, "settled": settled})
            .withColumn("tilt", F.when(settled, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), newton).otherwise((F.col("low") + F.col("high")) / 2))
        )
        checked = cut_lineage(moved)
        state = checked.drop("gap", "slope", "settled")
        if checked.where(~F.col("settled")).isEmpty():
            break
    return state.select("mix", "source_size", "target", "scale", "tilt")


def _whole(key: tuple, rows: pd.DataFrame, ceiling: int) -> pd.DataFrame:
    """Copies per size of one source, from the largest size down; what one size misses the next one takes over.

    A source of S words has at most sqrt(2 S) distinct sizes, which bounds these rows.
    """
    rows = rows.sort_values("size", ascending=False)
    copies, missing = [], 0.0
    for size, n, rate in zip(rows["size"], rows["n"], rows["rate"], strict=True):
        wished = n * rate + missing / size
        taken = int(min(max(math.floor(wished + 0.5), 0), ceiling * n))
        missing += (n * rate - taken) * size
        copies.append(taken)
    return pd.DataFrame({"mix": key[0], "size": rows["size"], "rate": rows["rate"], "each": [c // n for c, n in zip(copies, rows["n"], strict=True)],
                         "extra": [c % n for c, n in zip(copies, rows["n"], strict=True)]})


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS,
    ceiling: int = CEILING,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row.

    ``weights`` go round over the sources in the order of code points, the null source last. Rows with a null or empty text have
    size 0, rate and copies 0. Rows of equal source and size share a rate; those with an extra copy are the first by the md5 of the id, null
    ids last, so that reruns agree and repeated rows differ in copies only where the rates demand it. An empty table gives no rows. Other
    columns are not read, so their names cannot clash.
    """
    rows = stored(measure(docs, doc_id, source, text_col), "mix_sizes")
    classes = stored(rows.groupBy("mix", "size").agg(F.count("*").alias("n")), "mix_classes")
    sizes = classes.groupBy("mix").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = cut_lineage(targets(sizes, weights, ceiling))
    tilts = dual(classes, wanted.drop("weight"), ceiling)
    power = F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(math.log(ceiling)))
    rated = join_counted(classes.where("size > 0"), tilts.select("mix", "scale", "tilt"), ["mix"]).withColumn("rate", F.least(F.lit(float(ceiling)), F.exp(power)))
    counted = rated.select("mix", "size", "n", "rate").groupBy("mix").applyInPandas(
        lambda key, part: _whole(key, part, ceiling), "mix string, size bigint, rate double, each bigint, extra bigint"
    )
    counted = stored(counted, "mix_copies")
    ordered = rows.withColumn("_order", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("g")))
    ranked = rank_by_hash(ordered, ["mix", "size"], "_order", "_place").drop("_order")
    copied = join_counted(ranked, wanted.drop("weight"), ["mix"]).join(counted, ["mix", "size"], "left")
    copies = F.coalesce(F.col("each") + (F.col("_place") <= F.col("extra")).cast("long"), F.lit(0).cast("long"))
    return copied.select(
        "doc_id", F.when(F.col("mix") != "1", F.substring("mix", 2, 1 << 30)).alias("source"), "size", "source_size", "target",
        F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )
