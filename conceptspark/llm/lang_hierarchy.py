"""Hierarchical language identification.

The family of a text is predicted first, by one linear model per family against the rest; then linear support vector
machines, one for each pair of languages of that family, vote. Features are hashed byte n-grams of the whole lower-cased
text. Training uses a bounded sample of labelled rows per language; prediction covers every row. Few languages are trained on the
driver, more as one grouped task for each family and each pair, from the same sample to the same machines.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptspark.llm.common import boolean, double, per_text, stored, string
from conceptspark.operators.joins import join_counted

#: Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "sk", "bg", "sr", "hr"),
}
BITS = 11
ROWS_PER_LANGUAGE = 300
MAX_LANGUAGES = 64
EPOCHS = 30
UNKNOWN = "und"
PART = 1 << 20


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed byte bigrams, trigrams and quadrigrams of the whole text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    size = 1 << bits
    counts = np.zeros(size)
    # in parts that overlap by three bytes, so that memory does not follow the longest text
    for k in range(0, max(1, len(raw) - 1), PART):
        part = raw[k : k + PART + 3].astype(np.uint32)
        own = min(PART, len(raw) - k)
        code = part[:-1] * np.uint32(257) + part[1:]
        for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35)):
            if n > 2:
                code = code[:-1] * np.uint32(257) + part[n - 1 :]
            mixed = (code[:own] ^ (code[:own] >> np.uint32(15))) * np.uint32(salt)
            counts += np.bincount(mixed >> np.uint32(32 - bits), minlength=size)
    root = np.sqrt(counts)
    return (root / max(1e-12, float(np.linalg.norm(root)))).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, c: float = 10.0, seed: int = 7) -> np.ndarray:
    """Weights, the last one the bias, of an L2-regularised hinge-loss machine by dual coordinate descent; y is -1 or 1.

    Rows weigh by the inverse share of their side, so a rare side counts as much as a frequent one.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    bound = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, weights, square = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(axis=1)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (weights @ x[i]) - 1) / square[i], 0.0), bound[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights.astype(np.float32)


class Hierarchy:
    """Families against the rest, and a machine for each pair of languages inside a family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]], epochs: int = EPOCHS):
        lang = np.array(langs, object)
        home = self._lay_out(sorted(set(langs)), families)
        family = np.array([home[code] for code in langs], object)
        rests = [train_svm(x, np.where(family == f, 1, -1), epochs) for f in self.names] if len(self.names) > 1 else []
        self.family_weights = np.array(rests, np.float32)
        for f, codes in self.members.items():
            rows = []
            for a, b in self.pairs[f]:
                of_pair = (lang == codes[a]) | (lang == codes[b])
                rows.append(train_svm(x[of_pair], np.where(lang[of_pair] == codes[a], 1, -1), epochs))
            self.pair_weights[f] = np.array(rows, np.float32)

    def _lay_out(self, codes: list[str], families: dict[str, tuple[str, ...]]) -> dict[str, str]:
        """Members of each family and their pairs; returns the family of each language."""
        home = {code: name for name, listed in families.items() for code in listed}
        self.members: dict[str, list[str]] = {}
        for code in codes:
            self.members.setdefault(home.get(code, code), []).append(code)
        self.names = sorted(self.members)
        self.pairs = {f: list(combinations(range(len(listed)), 2)) for f, listed in self.members.items()}
        self.pair_weights: dict[str, np.ndarray] = {}
        return {code: home.get(code, code) for code in codes}

    @classmethod
    def from_tasks(cls, sample: DataFrame, codes: list[str], families: dict[str, tuple[str, ...]], epochs: int = EPOCHS) -> Hierarchy:
        """The same machines from rows (lang, draw, vector), each trained in a task of its own; only weights reach the driver."""
        own = cls.__new__(cls)
        home = own._lay_out(codes, families)
        spark = sample.sparkSession
        machines = [(f, -1, -1, c, 1 if home[c] == f else -1) for f in own.names for c in codes] if len(own.names) > 1 else []
        machines += [(f, a, b, listed[k], 1 if k == a else -1) for f, listed in own.members.items() for a, b in own.pairs[f] for k in (a, b)]
        sides = spark.createDataFrame(machines, "family string, a long, b long, lang string, side long")

        def train(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["lang", "draw", "vector"])
            x = np.array([np.frombuffer(v, np.float32) for v in part["vector"]])
            weights = train_svm(x, part["side"].to_numpy(), epochs).tobytes()
            return pd.DataFrame({"family": [part["family"].iloc[0]], "a": [part["a"].iloc[0]], "b": [part["b"].iloc[0]], "weights": [weights]})

        rows = join_counted(sample, sides, ["lang"]).groupBy("family", "a", "b").applyInPandas(train, "family string, a long, b long, weights binary")
        found = {(r["family"], r["a"], r["b"]): np.frombuffer(r["weights"], np.float32) for r in rows.collect()}
        own.family_weights = np.array([found[f, -1, -1] for f in own.names] if len(own.names) > 1 else [], np.float32)
        own.pair_weights = {f: np.array([found[f, a, b] for a, b in own.pairs[f]], np.float32) for f in own.members}
        return own

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and a confidence between 0 and 1: how clear the family and the language's duels were."""
        x = np.append(x, np.float32(1))
        name, sure = self.names[0], 1.0
        if len(self.names) > 1:
            margins = self.family_weights @ x
            best = int(margins.argmax())
            name, sure = self.names[best], _logistic(margins[best] - np.delete(margins, best).max())
        codes = self.members[name]
        if len(codes) == 1:
            return codes[0], sure
        duels = self.pair_weights[name] @ x
        votes, clear = np.zeros(len(codes)), np.zeros(len(codes))
        for (a, b), margin in zip(self.pairs[name], duels, strict=True):
            votes[a if margin >= 0 else b] += 1
            clear[a] += margin
            clear[b] -= margin
        winner = max(range(len(codes)), key=lambda k: (votes[k], clear[k]))
        return codes[winner], float(sure * _logistic(2 * clear[winner] / (len(codes) - 1)))


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-min(60.0, max(-60.0, float(z))))))


def fit(
    docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    families: dict[str, tuple[str, ...]] | None = None, rows_per_language: int = ROWS_PER_LANGUAGE, bits: int = BITS,
    max_languages: int = MAX_LANGUAGES,
) -> Hierarchy | None:
    """Train on rows with text and language for which ``usable`` holds; None if there are none.

    Per language the ``rows_per_language`` rows with the smallest hash of id and length are taken, ties by their vectors. Up to
    ``max_languages`` languages these rows' feature vectors reach the driver, with more only the counts and the trained weights.
    """
    docs = docs.select(
        F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang"),
        (F.lit(True) if usable is None else usable).alias("usable"),
    )
    known = docs.filter("usable and text is not null and lang is not null").withColumn("draw", F.xxhash64("key", F.length("text")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    # somewhat more than the wanted share by hash, cut to the exact number per language afterwards
    share = {r["lang"]: (1.3 * rows_per_language + 50) / r["n"] for r in counts}
    limits = [F.lit(x) for code, part in share.items() if part < 1 for x in (code, int((2 * part - 1) * 2**63))]
    pick = F.col("draw") <= F.coalesce(F.create_map(*limits)[F.col("lang")], F.lit(2**63 - 1)) if limits else F.lit(True)
    sample = per_text(
        known.filter(pick), lambda: lambda texts: [[features(t or "", bits).tobytes() for t in texts]], [_vector()], "text", ["lang", "draw"]
    )
    listed = FAMILIES if families is None else families
    if len(counts) > max_languages:
        place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "vector"))
        exact = sample.withColumn("place", place).filter(F.col("place") <= rows_per_language).drop("place")
        return Hierarchy.from_tasks(stored(exact, "language_sample"), sorted(share), listed)
    rows = sorted(((r["lang"], r["draw"], r["vector"]) for r in sample.collect()))
    kept, seen = [], {}
    for code, _, vector in rows:
        seen[code] = seen.get(code, 0) + 1
        if seen[code] <= rows_per_language:
            kept.append((code, np.frombuffer(vector, np.float32)))
    return Hierarchy(np.array([v for _, v in kept]), [c for c, _ in kept], listed)


def _vector():
    from pyspark.sql import types as T

    return T.StructField("vector", T.BinaryType())


def has_language(docs: DataFrame, keep: list[str], text_col: str = "text", field: str = "has_language") -> DataFrame:
    """The columns ``keep`` of ``docs`` and whether the text has a letter: by the text alone, just when any model would not say ``und``."""
    return per_text(docs, lambda: lambda texts: [[bool(t) and any(map(str.isalpha, t)) for t in texts]], [boolean(field)], text_col, keep)


def predict(
    docs: DataFrame, model: Hierarchy | None, keep: list[str], text_col: str = "text", bits: int = BITS,
    lang_field: str = "lang_pred", score_field: str = "score",
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the predicted language of each whole text and its score.

    A null text, a text without a letter, or a missing model (nothing to learn from; see :func:`has_language`) gives ``und`` with score 0. Texts of one word and
    very long texts are predicted like any other, equal texts alike. An empty table gives an empty table.
    """

    def make():
        def work(texts):
            found = [
                model.predict(features(t, bits)) if model is not None and t and any(map(str.isalpha, t)) else (UNKNOWN, 0.0) for t in texts
            ]
            return list(zip(*found, strict=True))

        return work

    return per_text(docs, make, [string(lang_field), double(score_field)], text_col, keep)
