"""License scan as an exact set-similarity join of text blocks and templates.

A block is any run of at most ``STRETCH`` times a template's length in words. It matches if it holds at least the threshold's share
of the template's distinct tokens. Tokens are ordered by how many documents hold them, rarest first. A block that reaches the
threshold must hold one of the template's first ``|T| - need + 1`` tokens (prefix), at least ``need`` words (length), and
while tokens are looked for in that order, the ones still to come must be able to make up what is missing (position).
So only the surroundings of prefix tokens are looked at, and no matching block is lost.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.llm.common import double, long, per_text, string

THRESHOLD = 0.8
STRETCH = 2
MAX_TEMPLATE_WORDS = 200_000

#: fixed values: phrases that name a licence by themselves
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: fixed values: notices by which a licence is granted
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files to deal in the software without restriction",
    "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "unless required by applicable law or agreed to in writing",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms as published by the "
    "free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by": "this work is licensed under a creative commons attribution international license",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "public-domain": "this is free and unencumbered software released into the public domain",
}

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; A-Z become lower case."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


class Matcher:
    """Templates with their tokens rarest first and an index of their prefixes."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float, stretch: int):
        self.templates = []
        self.index: dict[bytes, list[int]] = {}
        for label, text in templates.items():
            words = words_of(text)
            tokens = sorted(set(words), key=lambda t: (frequency.get(t, 0), t))
            need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
            for token in tokens[: len(tokens) - need + 1]:
                self.index.setdefault(token, []).append(len(self.templates))
            self.templates.append((label, tokens, need, stretch * len(words)))
        self.prefixes = set(self.index)

    def blocks(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Label, first and last word, and best containment of every place where blocks match; overlapping blocks are one place."""
        if self.prefixes.isdisjoint(words):
            return []
        at: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if word in self.index:
                for t in self.index[word]:
                    at.setdefault(t, []).append(k)
        found = []
        for t, hits in at.items():
            label, tokens, need, span = self.templates[t]
            if len(words) < need:
                continue
            areas: list[list[int]] = []
            for k in hits:
                low, high = max(0, k - span + 1), min(len(words), k + span)
                if areas and low <= areas[-1][1]:
                    areas[-1][1] = high
                else:
                    areas.append([low, high])
            for low, high in areas:
                part = words[low:high]
                if _enough(tokens, need, set(part)):
                    found += [(label, low + a, low + b, share) for a, b, share in _places(part, tokens, need, span)]
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def _enough(tokens: list[bytes], need: int, held: set[bytes]) -> bool:
    """Whether ``held`` has ``need`` of the tokens; gives up once the tokens still to come cannot suffice."""
    missing = 0
    for token in tokens:
        missing += token not in held
        if missing > len(tokens) - need:
            return False
    return True


def _places(words: list[bytes], tokens: list[bytes], need: int, span: int) -> list[tuple[int, int, float]]:
    """Merged first and last words of all runs of at most ``span`` words with ``need`` of the tokens, and their best share."""
    wanted = set(tokens)
    hits = [(k, w) for k, w in enumerate(words) if w in wanted]
    inside: Counter = Counter()
    low = 0
    out: list[list] = []
    for k, word in hits:
        inside[word] += 1
        while hits[low][0] <= k - span:
            _drop(inside, hits[low][1])
            low += 1
        if len(inside) < need:
            continue
        # the shortest run that ends here and still has as many tokens
        while inside[hits[low][1]] > 1:
            _drop(inside, hits[low][1])
            low += 1
        first, share = hits[low][0], len(inside) / len(tokens)
        if out and first <= out[-1][1]:
            out[-1][1], out[-1][2] = k, max(out[-1][2], share)
        else:
            out.append([first, k, share])
    return [tuple(x) for x in out]


def _drop(inside: Counter, word: bytes) -> None:
    inside[word] -= 1
    if not inside[word]:
        del inside[word]


def token_frequency(docs: DataFrame, tokens: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Documents that hold each of ``tokens``; the result is as small as the templates' vocabulary."""
    counted = per_text(
        docs, lambda: lambda texts: [[sorted(t.decode() for t in tokens.intersection(words_of(x or ""))) for x in texts]],
        [T.StructField("tokens", T.ArrayType(T.StringType()))], text_col, [],
    )
    rows = counted.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    return {r["token"].encode(): r["n"] for r in rows}


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """First word and label of every place where a phrase's words stand one after the other."""
    flat = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        wanted = b" " + b" ".join(words_of(phrase)) + b" "
        at, k, before = flat.find(wanted), 0, 0
        while at >= 0:
            k += flat.count(b" ", before, at)
            before = at
            found.append((k, label))
            at = flat.find(wanted, at + 1)
    return found


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, stretch: int = STRETCH, with_blocks: bool = False,
) -> DataFrame:
    """Per input row: words, places of phrases, their labels, the labels of phrases and templates together, and a score.

    The score is the best containment of a template (at least the threshold) or 1 where a phrase stands, else 0. ``with_blocks`` adds
    the matching blocks. A null text counts as empty: 0 words, no label. Equal rows give equal rows, a null id stays null, other
    columns are not read, an empty table gives an empty table. Templates are a parameter of bounded size, checked here.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = {w for t in templates.values() for w in words_of(t)}
    if sum(len(words_of(t)) for t in templates.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    frequency = token_frequency(docs, vocabulary, text_col)
    fields = [long("n_words"), long("n_base"), long("first_word"), long("last_word"), string("base_labels"), string("labels"), double("score")]
    if with_blocks:
        fields.append(T.StructField("blocks", T.ArrayType(T.StringType())))

    def make():
        matcher = Matcher({k: v for k, v in templates.items() if words_of(v)}, frequency, threshold, stretch)

        def one(text):
            words = words_of(text or "")
            places = phrase_places(words, phrases)
            blocks = matcher.blocks(words)
            base, starts = {label for _, label in places}, [k for k, _ in places]
            labels = base | {b[0] for b in blocks}
            score = 1.0 if places else max((b[3] for b in blocks), default=0.0)
            row = [
                len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), score,
            ]
            return [*row, [f"{label}:{a}-{b}:{share:.4f}" for label, a, b, share in blocks]] if with_blocks else row

        return lambda texts: list(zip(*map(one, texts), strict=True))

    return per_text(docs, make, fields, text_col, [id_col])
