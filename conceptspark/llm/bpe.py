"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be joined by a merge, so the place
between them is a certain cut: the fragments on both sides are encoded on their own and their ids concatenated. White
space, which this kind of vocabulary drops, is the coarsest such cut. Fragments repeat far more often than texts, so each
task encodes a fragment once and looks it up afterwards.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from operator import add

import numpy as np
import regex
from pyspark.sql import DataFrame

from conceptspark.llm.common import long, per_text, string, tokenizer_file

VOCABULARY = "word_bpe_49k.json"
CACHE_ENTRIES = 700_000
#: bytes that the remembered spans, and the fragments inside words, may take each, by an estimate of their size in memory
CACHE_BYTES = 128 << 20
ENTRY_BYTES = 200
#: longer runs without a space or forced boundary are encoded anew each time
LONG_SPAN = 256

# fixed values: the rule that splits words, and the characters that stand for bytes in byte-level vocabularies
WORDS = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\u00A1-\u024F]*")
SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN) if b not in b" \n"}


class FragmentCodec:
    """Encoder and decoder of a tokenizers file whose model is BPE with word ends and whose decoder is empty.

    ``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``, ``decode(ids)`` the text of
    ``Tokenizer.decode(ids, skip_special_tokens=False)``. Special strings in a text are their own tokens, as is the library's
    default.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        # word ends: one fragment a line, so that a whole list of fragments is one call
        self.last = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, end_of_word_suffix=self.suffix))
        self.last.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.inner = models.BPE(vocab=vocabulary, merges=merges)
        self.inner_ids: dict[str, bytes] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = [""] * (1 + max(max(vocabulary.values()), *self.special.values()))
        for token, i in [*vocabulary.items(), *self.special.items()]:
            self.tokens[i] = token
        inside = (t.removesuffix(self.suffix) if self.suffix else t for t in vocabulary if t not in self.special)
        self.pairs = {t[k : k + 2] for t in inside for k in range(len(t) - 1)}
        self.ends = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.tokens])
        self.cache: dict[str, bytes] = {}
        self.cache_held = self.inner_bytes = 0
        self.cache_entries, self.cache_bytes = cache_entries, cache_bytes

    def words(self, spans: list[str]) -> list[list[str]]:
        """The words of each span (no spaces inside), one character per byte, by the library's own rules.

        Latin letters without combining marks are normal already, and Python and the library agree on their lower case;
        such spans are split all at once. The others go through the library one by one.
        """
        joined = " ".join(spans)
        if not PLAIN.fullmatch(joined):
            plain = [s for s in spans if PLAIN.fullmatch(s)]
            known = dict(zip(plain, self.words(plain), strict=True))
            return [known[s] if s in known else [w for w, _ in self.split(self.normalize(s))] for s in spans]
        if not spans:
            return []
        tokens = WORDS.findall(joined.lower())
        if not joined.isascii():
            tokens = "\n".join(tokens).encode().decode("latin-1").translate(BYTES).split("\n")
        words: list[list[str]] = []
        now: list[str] = []
        for token in tokens:
            if token == " ":
                words.append(now)
                now = []
            else:
                now.append(token)
        return [*words, now]

    def fragments(self, word: str) -> list[str]:
        """``word`` (one character per byte) cut wherever its two neighbours are together in no token."""
        if self.pairs.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def _inner(self, fragment: str) -> bytes:
        ids = self.inner_ids.get(fragment)
        if ids is None:
            ids = array("I", [t.id for t in self.inner.tokenize(fragment)]).tobytes()
            if len(fragment) > LONG_SPAN:
                return ids
            self.inner_bytes += _weight(fragment, ids)
            if len(self.inner_ids) >= self.cache_entries or self.inner_bytes > self.cache_bytes:
                self.inner_ids.clear()
                self.inner_bytes = _weight(fragment, ids)
            self.inner_ids[fragment] = ids
        return ids

    def _ends_of_words(self, fragments: list[str]) -> dict[str, bytes]:
        """Ids of fragments that end a word; the token that carries the word's end closes each of them."""
        ids = np.array(self.last.encode("\n".join(fragments), add_special_tokens=False).ids, np.uint32)
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        flat = ids.tobytes()
        return {f: flat[a:b] for f, a, b in zip(fragments, [0, *stops[:-1].tolist()], stops.tolist(), strict=True)}

    def _encoded(self, spans: list[str]) -> dict[str, bytes]:
        """Encode spans fragment by fragment."""
        words = self.words(spans)
        cut = {w: f for w in {w for own in words for w in own} if len(f := self.fragments(w)) > 1}
        ends = list({cut[w][-1] if w in cut else w for own in words for w in own})
        known: dict[str, bytes] = {}
        for k in range(0, len(ends), 10_000):
            known |= self._ends_of_words(ends[k : k + 10_000])
        known |= {w: b"".join([*map(self._inner, f[:-1]), known[f[-1]]]) for w, f in cut.items()}
        return dict(zip(spans, [b"".join(map(known.__getitem__, own)) for own in words], strict=True))

    def _encode_plain(self, text: str) -> bytes:
        spans = text.split(" ")
        try:
            return b"".join(map(self.cache.__getitem__, spans))
        except KeyError:
            wanted = set(spans)
            self._make_known({x for x in wanted if len(x) <= LONG_SPAN})
            long_ones = self._encoded([x for x in wanted if len(x) > LONG_SPAN])
            return b"".join([long_ones[x] if len(x) > LONG_SPAN else self.cache[x] for x in spans])

    def _make_known(self, spans: set[str]) -> None:
        """Remember spans. A full cache starts anew with these, so it never holds more than its bound and one batch."""
        new = self._encoded(list(spans.difference(self.cache)))
        weight = sum(map(_weight, new, new.values()))
        if len(self.cache) + len(new) > self.cache_entries or self.cache_held + weight > self.cache_bytes:
            old = {x: self.cache[x] for x in spans if x not in new}
            weight += sum(map(_weight, old, old.values()))
            self.cache, self.cache_held = old, 0
        self.cache.update(new)
        self.cache_held += weight

    def prepare(self, texts: list[str]) -> None:
        """Learn the spans of many texts in one go."""
        spans = set()
        for text in texts:
            if "<|" not in text:
                spans.update(text.split(" "))
        self._make_known({x for x in spans if len(x) <= LONG_SPAN})

    def encode(self, text: str) -> array:
        parts = self.at_special.split(text) if self.at_special and "<|" in text else [text]
        ids = array("I")
        for part in parts:
            if (special := self.special.get(part)) is not None:
                ids.append(special)
            elif part:
                ids.frombytes(self._encode_plain(part))
        return ids

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def _weight(text: str, ids: bytes) -> int:
    return ENTRY_BYTES + 4 * len(text) + len(ids)


def _little_endian(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = ids[:]
        ids.byteswap()
    return ids.tobytes()


def encode_decode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_values: bool = False
) -> DataFrame:
    """Ids and decoded text of every whole text, as digests and, ``with_values``, as columns ids and decoded.

    One row per input row, equal rows included. A null text counts as empty: no ids, empty decoded text. A null id
    stays null. Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    from pyspark.sql import types as T

    fields = [long("n_tokens"), string("ids_sha256"), string("decoded_sha256")]
    if with_values:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), string("decoded")]

    def make():
        codec = FragmentCodec(path or tokenizer_file(VOCABULARY))

        def work(texts):
            rows = []
            texts = [t or "" for t in texts]
            codec.prepare(texts)
            for text in texts:
                ids = codec.encode(text)
                decoded = codec.decode(ids)
                row = [len(ids), hashlib.sha256(_little_endian(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append([*row, list(ids), decoded] if with_values else row)
            return list(zip(*rows, strict=True))

        return work

    return per_text(docs, make, fields, text_col, [id_col])
