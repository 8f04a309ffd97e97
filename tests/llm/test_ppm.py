"""The scores against a plain trie of Python dictionaries, and the unigram base against its formula."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptspark.llm import ppm
from conceptspark.llm.common import remainder
from helpers import awkward, docs_of, empty

ORDER = 3


def brute_score(trained, text, order):
    edge = bytes([ppm.EDGE])
    trie = {}
    for t in trained:
        data = edge * order + t + edge
        for i in range(order, len(data)):
            for k in range(order + 1):
                trie.setdefault(data[i - k : i], Counter())[data[i]] += 1
    data, total = edge * order + text + edge, 0.0
    for i in range(order, len(data)):
        excluded, found = set(), False
        for k in range(order, -1, -1):
            offered = {s: c for s, c in trie.get(data[i - k : i], {}).items() if s not in excluded}
            if not trie.get(data[i - k : i]):
                continue
            weight = sum(offered.values()) + len(offered)
            if data[i] in offered:
                total += math.log10(offered[data[i]] / weight)
                found = True
                break
            if offered:
                total += math.log10(len(offered) / weight)
            excluded |= set(offered)
        if not found:
            total -= math.log10(256 - len(excluded))
    return total


def is_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_the_trie(spark, order):
    rows = [(k, t) for k, t in awkward(spark)[1] if t is None or len(t) < 5000]
    rows += [(100 + k, f"the cat {'sat ' * (k % 4)}on mat {k}") for k in range(30)]
    docs = docs_of(spark, rows).withColumn("block", F.lit("clash")).repartition(3)
    assert any(is_out(k) for k, _ in rows)
    for block_bytes in (400, 1 << 20):
        found = ppm.score(docs, remainder("doc_id", 7) == 2, order=order, block_bytes=block_bytes).collect()
        assert len(found) == len(rows)
        raw = [(k, (t or "").encode()) for k, t in rows]
        trained = [t for k, t in raw if not is_out(k)]
        counts = Counter(w for t in trained for w in t.lower().split())
        counts["end"] = len(trained)
        total, kinds = sum(counts.values()), len(counts)
        wanted = []
        for k, t in raw:
            own = [*t.lower().split(), "end"]
            base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
            wanted.append((k, is_out(k), len(own), sum(counts[w] > 0 for w in own), total, base, brute_score(trained, t, order)))
        order_by = lambda r: (r[0] is None, r[0] or 0, r[6])
        for r, w in zip(sorted(found, key=order_by), sorted(wanted, key=order_by), strict=True):
            assert tuple(r)[:5] == w[:5]
            assert r.base_score == pytest.approx(w[5], rel=1e-9) and r.score == pytest.approx(w[6], rel=1e-9)


def test_nothing_to_learn_from(spark):
    docs = docs_of(spark, [(1, "ab"), (2, None)])
    found = {r.doc_id: r for r in ppm.score(docs, F.lit(True)).collect()}
    assert found[1].train_tokens == 0 and found[1].n_known == 0
    assert found[1].score == pytest.approx(-3 * math.log10(256)) and found[2].score == pytest.approx(-math.log10(256))
    assert ppm.score(empty(spark)).count() == 0


def test_gram_sums_search_distinct_grams_only(monkeypatch):
    """Long and short texts, cut into parts: sums as position by position, but no search per position."""
    texts = [b"", b"a b " * 300, b"x", bytes(range(97, 123)) * 7, b"a b " * 300]
    data, first, behind = ppm._buffer(texts, ORDER)
    spans = list(zip(first.tolist(), behind.tolist()))
    codes, _ = ppm._distinct_grams(data, spans, ORDER)
    values = -np.arange(1.0, len(codes) + 1)
    wanted = [values[np.searchsorted(codes, ppm._grams(data, a, b, ORDER))].sum() for a, b in spans]
    searched, plain = [], np.searchsorted
    monkeypatch.setattr(ppm, "PART", 512)
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: (searched.append(len(v)), plain(a, v, *more))[1])
    assert ppm._gram_sums(data, spans, values, ORDER) == pytest.approx(wanted)
    assert sum(searched) < len(data) / 4
    words, places, ends = ppm._word_places([b"B a", b"", b"a\tc"])
    assert (words, places.tolist(), ends.tolist()) == ([b"b", b"a", b"c"], [0, 1, 1, 2], [2, 2, 4])
