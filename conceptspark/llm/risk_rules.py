"""Quality rules whose cutoffs come with a guarantee.

Each rule rejects a text whose measure lies above a cutoff. Cutoffs are chosen per stratum on labelled documents: going down from
the mildest, a cutoff is accepted as long as an exact binomial test shows that the share of good documents above it is below the
rule's part of the allowed false rejection. The sequence stops at its first failure, which needs no further correction; over rules and
strata the error level is divided (Bonferroni). So with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good
documents to the rules. A stratum with too few labels to prove anything takes the cutoffs of the pool of all strata, one more stratum
in the correction: for these the promise holds for the pool, and a cutoff is raised until at most the rule's part of ``alpha`` of the
stratum's own labelled good documents lies above. A stratum without labelled good documents has no cutoff, and the rules keep its documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.llm.common import long, per_text
from conceptspark.operators.joins import join_counted

ALPHA = 0.01
DELTA = 0.05
STEPS = 1000
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: rule: its measure between 0 and ``STEPS``; a higher one is worse
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def measures(text: str) -> list[int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows, and lines with a word."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    spaces = len(raw) - len(raw.translate(None, SPACES))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        numbers: dict = {}
        number = np.array([numbers.setdefault(w, len(numbers)) for w in windows])
        again = np.bincount(number)[number] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(windows)] |= again
        repeated = int(covered.sum())
    return [len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines)]


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with the measures of each whole text and whether the base rules fail it; null is empty."""

    def make():
        return lambda texts: [*zip(*[measures(t or "") for t in texts], strict=True)]

    measured = per_text(docs, make, [long(m) for m in MEASURES], text_col, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def _level(rule: str) -> Column:
    top, below = RULES[rule]
    return F.when(F.col(below) > 0, F.least(F.floor(STEPS * F.col(top) / F.col(below)), F.lit(STEPS))).otherwise(0).cast("long")


def below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with ``n`` trials of probability ``p``; terms are added from ``k`` downwards until they vanish."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, i = 0.0, 1.0, k
    while i >= 0 and term > 1e-18 * total:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return min(1.0, math.exp(min(0.0, log + math.log(total))))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound of the probability after ``k`` of ``n``, at level ``1 - delta``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if middle < 1 and below(k, n, middle) <= delta else (middle, high)
    return high


def pick_cutoff(levels: np.ndarray, counts: np.ndarray, alpha: float, delta: float) -> tuple[int, int, int]:
    """Lowest cutoff that the fixed sequence accepts (``STEPS`` if none), good documents above it, good documents in all."""
    hist = np.bincount(levels, counts, STEPS + 1).astype(np.int64)
    n, above, cutoff = int(hist.sum()), 0, STEPS
    for c in range(STEPS - 1, -1, -1):
        more = above + int(hist[c + 1])
        if below(more, n, alpha) > delta:
            break
        cutoff, above = c, more
    return cutoff, above, n


def borrow_cutoff(levels: np.ndarray, counts: np.ndarray, pooled: int, alpha: float) -> tuple[int, int, int]:
    """The pool's cutoff, raised until no more than the share ``alpha`` of these good documents lies above it; as :func:`pick_cutoff`."""
    hist = np.bincount(levels, counts, STEPS + 1).astype(np.int64)
    n, cutoff = int(hist.sum()), pooled
    while hist[cutoff + 1 :].sum() > alpha * n:
        cutoff += 1
    return cutoff, int(hist[cutoff + 1 :].sum()), n


def select_cutoffs(
    measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "stratum", alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """One row per stratum with labelled good documents: the cutoff of each rule, the good documents and those above.

    ``labels`` has ``id_col`` and quality (1: good). An id labelled more than once is good if any label says so; null labels and ids are
    left out. Only rows that the base rules keep are counted, as only those meet the other rules. All labels are used.
    """
    good = (
        labels.filter(f"`{id_col}` is not null and quality is not null").groupBy(F.col(f"`{id_col}`").alias("labelled_id"))
        .agg(F.max("quality").alias("best")).filter("best = 1")
    )
    held = measured.filter(~F.col("base_failed")).select(id_col, stratum, *[_level(r).alias(r) for r in RULES])
    held = held.join(good, F.col(f"`{id_col}`") == F.col("labelled_id"), "left_semi")
    parts = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES]))
    counted = held.select(stratum, parts.alias("part")).groupBy(stratum, "part.rule", "part.level").agg(F.count("*").alias("n"))
    strata = counted.select(stratum).distinct().agg(F.count("*").alias("n_strata"))
    pool = counted.groupBy("rule", "level").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)).join(strata.withColumn("one", F.lit(1)), "one")
    n_rules = len(RULES)

    def level_of(part: pd.DataFrame) -> float:
        # every stratum and, besides more than one, their pool
        n_strata = int(part["n_strata"].iloc[0])
        return delta / (n_rules * (n_strata + (n_strata > 1)))

    def choose_pooled(part: pd.DataFrame) -> pd.DataFrame:
        cutoff, _, _ = pick_cutoff(part["level"].to_numpy(), part["n"].to_numpy(), alpha / n_rules, level_of(part))
        return pd.DataFrame({"rule": [part["rule"].iloc[0]], "pooled": [cutoff], "n_strata": [part["n_strata"].iloc[0]]})

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        levels, counts, error = part["level"].to_numpy(), part["n"].to_numpy(), level_of(part)
        if below(0, int(counts.sum()), alpha / n_rules) <= error:
            cutoff, above, n = pick_cutoff(levels, counts, alpha / n_rules, error)
        else:
            cutoff, above, n = borrow_cutoff(levels, counts, int(part["pooled"].iloc[0]), alpha / n_rules)
        return pd.DataFrame({"stratum": [part[stratum].iloc[0]], "rule": [part["rule"].iloc[0]], "cutoff": [cutoff], "above": [above], "n_good": [n]})

    pooled = pool.groupBy("rule").applyInPandas(choose_pooled, "rule string, pooled long, n_strata long")
    chosen = counted.join(pooled, "rule").groupBy(stratum, "rule").applyInPandas(choose, "stratum string, rule string, cutoff long, above long, n_good long")
    return chosen.groupBy("stratum").agg(
        F.max("n_good").alias("n_good"),
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES],
        *[F.max(F.when(F.col("rule") == r, F.col("above"))).alias(f"above_{r}") for r in RULES],
    )


def verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str = "stratum", kept: str = "kept") -> DataFrame:
    """``measured`` with the decision: rows that fail the base rules go, then those above a cutoff of their stratum."""
    cuts = cutoffs.select(F.col("stratum").alias(stratum), *[f"cut_{r}" for r in RULES])
    joined = join_counted(measured, cuts, [stratum], "left")
    above = F.lit(False)
    for r in RULES:
        above = above | (_level(r) > F.coalesce(F.col(f"cut_{r}"), F.lit(STEPS)))
    return joined.withColumn(kept, ~F.col("base_failed") & ~above).drop(*[f"cut_{r}" for r in RULES])


def stratified(docs: DataFrame, column: str = "lang", name: str = "stratum") -> DataFrame:
    """``docs`` with the stratum of each row as text; rows without one share the empty stratum."""
    return docs.withColumn(name, F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))
