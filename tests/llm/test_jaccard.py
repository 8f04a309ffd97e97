"""Classes of the token-group join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptspark.llm import token_group_join as join
from helpers import awkward, docs_of, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[find(b)] = find(a)
    lowest = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            lowest[find(k)] = min(key, lowest.get(find(k), key))
    return [(key, len(sets[k]), lowest.get(find(k)) if sets[k] else key) for k, (key, _) in enumerate(rows)]


def family(rng, n, length, edits):
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def same(found, rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in found), key=order) == sorted(brute(rows), key=order)


@pytest.mark.parametrize("group_size", [4, 128])
def test_classes_equal_all_pairs(spark, group_size):
    rng = random.Random(9)
    texts = [t for k in range(12) for t in family(rng, rng.randrange(1, 14), rng.choice([4, 6, 40, 120]), 4)]
    # a chain: neighbours link, the ends do not
    long_text = [f"c{k}" for k in range(200)]
    texts += [" ".join(long_text[k : k + 150]) for k in range(0, 50, 5)]
    # passages that many documents share without being alike
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} {' '.join(f'u{rng.randrange(10**7)}' for _ in range(60))}" for _ in range(40)]
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += texts[:30]
    rng.shuffle(texts)
    rows = [*enumerate(texts), *[(10_000 + (k or 0), t) for k, t in awkward(spark)[1]], (None, texts[0]), (None, "only null ids here"), (7, texts[9])]
    docs = docs_of(spark, rows).withColumn("entity", F.lit("clash")).repartition(5)
    same(join.jaccard_classes(docs, group_size=group_size, sketch_bits=10).collect(), rows)


def test_empty_table(spark):
    assert join.jaccard_classes(empty(spark)).count() == 0


def test_linked_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert join.linked(a[:80], a, 80) and not join.linked(a[:79], a, 80)
    assert join.linked(a[:90], a[10:], 80) == (100 * 80 >= 80 * 100)


def test_counts_in_a_byte():
    counts = np.array([0, 1, 15, 16, 17, 255, 65_535, 2**31])
    codes = join.encoded(counts)
    back = join.DECODED[codes]
    assert len(join.DECODED) == 256 and (np.diff(join.DECODED) > 0).all()
    assert (back <= counts).all() and (back * 9 >= counts * 8).all() and (np.diff(codes.astype(int)) >= 0).all()


def test_filter_holds_every_wanted_entity(spark):
    import os

    names = [os.urandom(16) for _ in range(500)]
    active = spark.createDataFrame([(bytearray(x),) for x in names], "entity binary")
    flags, mask = join._filter(active)
    found = lambda x: flags[(k := int.from_bytes(x[:4], "big") & mask) >> 3] >> (k & 7) & 1
    assert len(flags) * 8 == mask + 1 and all(found(x) for x in names)
    assert sum(int(found(os.urandom(16))) for _ in range(2000)) < 100
    assert not join._filter(active.limit(0))[0].any()
