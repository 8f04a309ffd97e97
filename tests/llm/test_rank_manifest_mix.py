"""Ranked search, dataset manifest and source mixing against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptspark.llm import dense_rank, entropy_mix, manifest
from conceptspark.llm.queries import ORACLES, QUERIES
from helpers import DOC, awkward, docs_of, empty, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ranked search


def brute_search(docs, items, k):
    terms = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in terms:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
                for w in set(TERM.findall(lower(text))) if c[w]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


ITEM = "item_id bigint, text string, score string, terms string, row string"


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], ITEM)


@pytest.mark.parametrize("block_terms", [7, 200_000])
def test_search_equals_brute_force(spark, block_terms):
    rng = random.Random(3)
    docs, rows = awkward(spark)
    more = [(100 + k, " ".join(words(rng, rng.randrange(40), 30))) for k in range(120)]
    more += [(400 + k, "same words here for all of us") for k in range(60)]  # more ties than places
    rows = rows + more
    docs = docs.unionByName(docs_of(spark, more), allowMissingColumns=True).repartition(5)
    items = [(1, "w1 W2 w3 w3 w4 w5 w6 w7 w8"), (2, "Same WORDS"), (3, None), (4, ""), (5, "nowhere"), (6, "中文 ÀÉß mit"), (2, "Same WORDS"), (None, "the license"), (9, " ".join(words(rng, 50)))]
    found = dense_rank.search(docs, items_of(spark, items), 10, block_terms=block_terms).collect()
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, found), key=order) == sorted(brute_search(rows, items, 10), key=order)


def test_search_of_empty_tables(spark):
    docs, _ = awkward(spark)
    assert dense_rank.search(docs, items_of(spark, [])).count() == 0
    assert dense_rank.search(empty(spark), items_of(spark, [(1, "a")])).count() == 0
    assert dense_rank.search(docs_of(spark, [(1, None), (2, " ")]), items_of(spark, [(1, "a")])).count() == 0


def test_tiles_are_exact_beyond_one_product():
    """Scores above 2^53 stay exact: the terms are cut so that no partial sum reaches it."""
    rng = np.random.default_rng(1)
    size, weight = 3000, np.full(3000, 2**30 - 1, np.int64)
    tile = dense_rank.ItemTile([np.arange(size), np.arange(0, size, 2)], weight)
    assert tile.width * int(weight.max()) * dense_rank.IMPACT < 2**53
    impact = rng.integers(1, dense_rank.IMPACT, size)
    found = tile.scores(np.zeros(size, np.int64), np.arange(size), impact, 1)
    assert found[:, 0].tolist() == [int(weight[0]) * int(impact.sum()), int(weight[0]) * int(impact[::2].sum())]
    assert found.max() > 2**53


def test_long_texts_are_split_between_terms():
    text = "Ab1-中文  x" * 500
    whole = [w.encode() for w in TERM.findall(lower(text))]
    assert [w for run in dense_rank._term_runs(text, 16) for w in run] == whole


def test_impacts_beyond_64_bits():
    n = np.array([10, 3 * 10**15], np.int64)
    assert dense_rank.impacts(np.array([1, 2], np.int64), n, 10**6, 10**16).tolist() == [
        10**9 // (1000 + 20 * (50 + 50 * 10 * 10**6 // 10**16)), 2 * 10**9 // (2000 + 20 * (50 + 50 * 3 * 10**15 * 10**6 // 10**16))
    ]


# manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """(top, siblings of every node as [(left, right)…])."""
    paths, level, owners = [[] for _ in nodes], nodes, [[k] for k in range(len(nodes))]
    while len(level) > 1:
        above, mine = [], []
        for a in range(0, len(level), fanout):
            run = level[a : a + fanout]
            for k in range(len(run)):
                for leaf in owners[a + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h(*run))
            mine.append([x for o in owners[a : a + fanout] for x in o])
        level, owners = above, mine
    return level[0], paths


def brute_manifest(rows, fanout):
    def leaf(row, text):
        return h(*map(field, (*row[:1], row[3], row[2], row[4], text)))  # rows are doc_id, text, lang, source, n_chars

    groups = defaultdict(list)
    for row in rows:
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        now = None if row[1] is None else lower(row[1]) if hit else row[1]
        groups[row[3]].append((row[0], leaf(row, row[1]), leaf(row, now)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in groups[s]], fanout)
    root, upper = tree([trees[s][0] for s in names], fanout) if names else (None, [])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (doc, own, now), path in zip(groups[s], trees[s][1], strict=True):
            digest = now
            for left, right in path + above:
                digest = h(left, digest, right)
            out.append((doc, own, trees[s][0], root, h(*[x for step in path + above for x in step]), digest, digest == root))
    return out


@pytest.mark.parametrize(("fanout", "block", "sizes"), [(2, 2, [45, 1, 8, 9, 3]), (2, 4, [37, 5, 4, 1]), (3, 3, [82, 27, 28, 2]), (16, 16, [300, 16, 17]), (16, 4096, [300, 1])])
def test_manifest_equals_recursion(spark, fanout, block, sizes):
    rng = random.Random(fanout * block)
    rows = [(10 * k + s, "Text " * rng.randrange(4), rng.choice([None, "en"]), f"s{s}" if s else None, k) for s, n in enumerate(sizes) for k in range(n)]
    rows += [rows[3], (None, "No Id", None, "é", None), (None, None, "x", "Z", 0), (5, "A", None, "", 1), (10**12, "far Away", "en", "s1", 2)]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in ("leaf", "tree", "b", "n", "position", "node", "place")}).repartition(4)
    found = manifest.manifest(docs, tampered=manifest.lowercased_every_fifth(), fanout=fanout, block=block).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_manifest(rows, fanout), key=repr)


def test_manifest_of_awkward_and_few_rows(spark):
    docs, rows = awkward(spark)
    whole = [(i, t, "en", "s", len(t) if t else None) for i, t in rows]
    found = manifest.manifest(docs, tampered=manifest.lowercased_every_fifth()).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_manifest(whole, 16), key=repr)
    assert manifest.manifest(empty(spark)).count() == 0
    (one,) = manifest.manifest(docs_of(spark, [(1, "a")])).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == h("")
    with pytest.raises(ValueError):
        manifest.manifest(docs, block=100)


def test_every_round_meets_at_most_the_fanout(spark):
    nodes = spark.createDataFrame([("t", b, 11, h(str(b))) for b in range(11)], "tree string, b bigint, n bigint, node string")
    found = {r.b: r for r in manifest.butterfly(nodes, 2).collect()}
    top, paths = tree([h(str(b)) for b in range(11)], 2)
    assert {r.top for r in found.values()} == {top}
    assert [[(s.left, s.right) for s in found[b].steps] for b in range(11)] == paths


# mixing


def brute_targets(sizes, weights, ceiling):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > ceiling * sizes[s]]
        if not over:
            return {**share, **stopped}
        stopped.update({s: ceiling * sizes[s] for s in over})


def brute_tilt(sizes, target, ceiling):
    """Bisection on the words a source gets at a tilt per word."""
    low, high = -50.0, 50.0
    words_at = lambda t: sum(s * min(ceiling, math.exp(min(t * s, 5))) for s in sizes)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words_at(mid) < target else (low, mid)
    return high


def check_mix(rows, found, weights=(1, 2, 3), ceiling=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    wanted = brute_targets(sizes, weights, ceiling)
    assert sorted(((r.doc_id, r.source, r.size) for r in found), key=repr) == sorted(((d, s, size(t)) for d, s, t in rows), key=repr)
    for s in sizes:
        mine = [r for r in found if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(r.target == pytest.approx(wanted[s], rel=1e-9) for r in mine)
        tilt = brute_tilt([r.size for r in mine if r.size], wanted[s], ceiling) if sizes[s] else 0
        for r in mine:
            assert r.rate == pytest.approx(min(ceiling, math.exp(min(tilt * r.size, 5))) if r.size else 0, rel=1e-6)
            assert r.taken == r.copies * r.size and 0 <= r.copies <= ceiling
        for n in {r.size for r in mine}:
            assert len({r.copies for r in mine if r.size == n}) <= 2
        # what is missed is at most half of the smallest size, unless the ceiling or zero ends it earlier
        missed = abs(sum(r.taken for r in mine) - wanted[s])
        assert missed <= max((r.size for r in mine), default=0)
    return wanted


def test_mix_equals_bisection(spark):
    rng = random.Random(11)
    rows = [(k, f"s{rng.choice([0, 0, 0, 0, 1, 2, 3])}", " ".join(words(rng, int(rng.lognormvariate(3, 1))))) for k in range(600)]
    rows += [(700 + k, None, "few words") for k in range(3)] + [(800, "é", None), (801, "é", ""), (None, "s1", "no id"), (None, None, None), (3, "s0", "one"), (3, "s0", "one"), (900, "", " ")]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, s, t in rows], DOC).withColumns({c: F.lit("clash") for c in ("size", "mix", "target", "rate", "n", "each")}).repartition(4)
    found = entropy_mix.mix(docs).collect()
    wanted = check_mix(rows, found)
    for s in ("s0", "s1", "s2", "s3", None):  # many small documents: the targets are met to a few words
        assert abs(sum(r.taken for r in found if r.source == s) - wanted[s]) <= 2
    again = entropy_mix.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_mix_of_few_and_awkward_rows(spark):
    assert entropy_mix.mix(empty(spark)).count() == 0
    (only,) = entropy_mix.mix(docs_of(spark, [(1, "two words")])).collect()
    assert (only.target, only.taken, only.copies) == (2, 2, 1)
    assert [r.taken for r in entropy_mix.mix(docs_of(spark, [(1, None), (2, "")])).collect()] == [0, 0]
    docs, rows = awkward(spark)
    check_mix([(d, "s", t) for d, t in rows], entropy_mix.mix(docs).collect())


def test_word_counts():
    for text in (None, "", " ", "a", " a", "a ", "a\x0bb\x1cc\x85 d\r\n中 文"):
        assert entropy_mix.count_words(text) == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("name", ["op11_dense_ranked_search", "op12_butterfly_manifest", "op13_entropy_mix"])
def test_registered_queries(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    if name in ORACLES:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, con.sql(ORACLES[name]).fetchall()))
    else:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text").collect()
        source = {r.doc_id: r.source for r in docs}
        sizes, taken = Counter(), Counter()
        for r in found:
            sizes[source[r.doc_id]] += r.size
            taken[source[r.doc_id]] += r.taken
            assert r.taken <= 3 * r.size
        wanted = brute_targets(sizes, (1, 2, 3), 3)
        assert len(found) == len(docs) and all(abs(taken[s] - wanted[s]) <= 0.05 * wanted[s] for s in sizes)
