"""BPE round trips, chunked token counts and packing against the libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conceptspark.llm import bpe, chunk_tokens, lexical_packing
from helpers import awkward, awkward_texts, docs_of, empty


def test_bpe_equals_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    docs, rows = awkward(spark)
    found = bpe.encode_decode(docs, with_values=True).collect()
    wanted = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        wanted.append((key, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    assert [tuple(r) for r in found] == wanted
    assert bpe.encode_decode(empty(spark)).count() == 0


def test_bpe_random_texts_and_full_cache():
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    codec = bpe.FragmentCodec(public_tokenizers.path(bpe.VOCABULARY), cache_entries=50)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(chr(rng.choice([rng.randrange(32, 0x250), 0x300 + rng.randrange(40), 32, 10])) for _ in range(60))
        assert list(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_cache_is_bounded_in_bytes():
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    codec = bpe.FragmentCodec(public_tokenizers.path(bpe.VOCABULARY), cache_bytes=200_000)
    rng = random.Random(6)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    for k in range(60):
        base64 = "".join(rng.choices("ABCDabcd0123+/", k=3000))
        text = [han(5000), base64, "a" * 5000, " ".join(han(rng.randrange(1, 400)) for _ in range(20)), f"short words {k} " * 30][k % 5]
        codec.prepare([text])
        assert list(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids
        for held in (codec.cache, codec.inner_ids):
            assert max(map(len, held), default=0) <= bpe.LONG_SPAN
            assert sum(map(bpe._weight, held, held.values())) <= 200_000
        assert codec.cache_held == sum(map(bpe._weight, codec.cache, codec.cache.values()))


def test_forced_boundaries_cut_only_where_no_token_spans():
    codec = bpe.FragmentCodec(public_tokenizers.path(bpe.VOCABULARY))
    assert codec.fragments("ing") == ["ing"]
    a, b = next((x, y) for x in map(chr, range(0x21, 0x7F)) for y in map(chr, range(0x21, 0x7F)) if x + y not in codec.pairs)
    pieces = codec.fragments("th" + a + b + "he")
    assert "".join(pieces) == "th" + a + b + "he" and 3 in np.cumsum([len(p) for p in pieces])


def test_chunked_counts_equal_whole_encoding(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(chunk_tokens.MODEL))
    docs, rows = awkward(spark)
    for chunk, overlap in ((64, 8), (16_384, 256)):
        found = chunk_tokens.count_tokens(docs, limit=100, chunk=chunk, overlap=overlap).collect()
        wanted = [(k, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for k, t in rows]
        assert [tuple(r) for r in found] == wanted
    assert chunk_tokens.count_tokens(empty(spark)).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (200, 4), (40, 20)])
def test_resynchronisation_widens(chunk, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(chunk_tokens.MODEL))
    counter = chunk_tokens.ChunkCounter(public_tokenizers.path(chunk_tokens.MODEL), chunk, overlap)
    assert counter.keeps_length
    rng, letters = random.Random(1), "ab e\n\t th<>|'s é́ΑΣσ\x00▁😀 ﬁＡ中  12."
    for k in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(900)))
        text = "a" * rng.randrange(900) if k % 5 == 0 else " " * rng.randrange(900) + "x" if k % 7 == 0 else text
        assert counter.count(text) == len(model.encode(text))


def test_packing_is_a_partition_of_all_ids(spark):
    library = Tokenizer.from_file(public_tokenizers.path(lexical_packing.VOCABULARY))
    texts = [*awkward_texts(), *(f"doc number {k} " * (k % 40) for k in range(60))]
    docs = docs_of(spark, enumerate(texts)).withColumn("start", docs_lit())
    rows = lexical_packing.pack(docs, window=64, shard_docs=16, with_ids=True).collect()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    covered = {k: [] for k in ids}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r.doc_id] += range(r.start, r.start + r.length)
    assert all(sorted(covered[k]) == list(range(len(ids[k]))) for k in ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 64 or end & (end - 1) == 0
    assert lexical_packing.pack(empty(spark)).count() == 0


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_packing_takes_the_nearest_by_bm25():
    bags = [np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([1, 2, 4]), np.array([7, 8, 1]), np.array([5, 6])]
    index = lexical_packing.Index(bags, 64)
    free = np.ones(5, bool)
    free[0] = False
    assert index.ranked(0, free).tolist()[0] == 2
    n, mean = len(bags), np.mean([len(b) for b in bags])
    def brute(q, d):
        total = 0.0
        for t in set(bags[q].tolist()):
            df = sum(t in b for b in bags)
            tf = bags[d].tolist().count(t)
            idf = np.log1p((n - df + 0.5) / (df + 0.5))
            total += idf * tf * (lexical_packing.K1 + 1) / (tf + lexical_packing.K1 * (1 - lexical_packing.B + lexical_packing.B * len(bags[d]) / mean))
        return total
    scores = {d: brute(1, d) for d in range(5) if d != 1}
    free[:] = True
    free[1] = False
    assert index.ranked(1, free).tolist() == sorted((d for d in scores if scores[d] > 0), key=lambda d: (-scores[d], d))


def test_packing_scores_with_all_shared_terms(spark):
    rng = np.random.default_rng(2)
    bags = [rng.choice(600, 300) for _ in range(40)]
    found = []
    n, mean = len(bags), np.mean([len(b) for b in bags])
    df = np.bincount(np.concatenate([np.unique(b) for b in bags]), minlength=600)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    tf = np.array([np.bincount(b, minlength=600) for b in bags])
    weight = idf * tf * (lexical_packing.K1 + 1) / (tf + lexical_packing.K1 * (1 - lexical_packing.B + lexical_packing.B * 300 / mean))
    full = (tf > 0).astype(float) @ weight.T
    index = lexical_packing.Index(bags)
    for seed in range(n):
        free = np.arange(n) != seed
        ranked = index.ranked(seed, free)
        found.append(len(ranked) == n - 1 and np.all(np.diff(full[seed, ranked]) <= 1e-4))
    assert all(found)
    # production runs cut nothing either
    docs = docs_of(spark, [(k, " ".join(f"t{t}" for t in b)) for k, b in enumerate(bags)])
    plain, whole = (sorted(map(tuple, lexical_packing.pack(docs.coalesce(1), **options).collect())) for options in ({}, {"query_terms": 10**9}))
    assert plain == whole


def brute_windows(lengths, bags, window):
    """Greedy retrieval packing with plain dictionaries: full windows first, then each seed with its best unused neighbours."""
    n, mean = len(bags), sum(map(len, bags)) / len(bags)
    counts = [Counter(b.tolist()) for b in bags]
    holders = Counter(t for c in counts for t in c)

    def weight(t, d):
        idf = math.log1p((n - holders[t] + 0.5) / (holders[t] + 0.5))
        k1, b = lexical_packing.K1, lexical_packing.B
        return round(idf * counts[d][t] * (k1 + 1) / (counts[d][t] + k1 * (1 - b + b * len(bags[d]) / mean)) / lexical_packing.STEP)

    def likeness(q, d):
        return sum(weight(t, d) for t in counts[q] if holders[t] > 1 and t in counts[d])

    out = [[(d, s, window)] for d in range(n) for s in range(0, lengths[d] - lengths[d] % window, window)]
    left = {d: lengths[d] % window for d in range(n) if lengths[d] % window}
    seed = None
    while left:
        seed = min(left) if seed is None else seed
        now, room = [(seed, lengths[seed] - left[seed], left[seed])], window - left[seed]
        order = sorted(((-likeness(seed, d), d) for d in left if d != seed))
        alike, others = [d for x, d in order if x], sorted(d for x, d in order if not x)
        del left[seed]
        seed = None
        for d in alike + others:
            if not room:
                break
            take = min(room, left[d])
            now.append((d, lengths[d] - left[d], take))
            room, left[d] = room - take, left[d] - take
            if left[d]:
                seed = d
            else:
                del left[d]
        out.append(now)
    return out


@pytest.mark.parametrize("kind", ["short", "long", "alike"])
def test_windows_equal_brute_force_over_whole_documents(kind):
    rng = np.random.default_rng(11)
    window = 32
    for trial in range(25):
        sizes = {"short": (1, 40), "long": (1, 200), "alike": (60, 70)}[kind]
        topics = [rng.choice(400, 60) for _ in range(6)]
        bags = [rng.choice(topics[rng.integers(6)] if kind != "alike" else topics[0], rng.integers(*sizes)) for _ in range(45)]
        bags[3], bags[9] = rng.choice(topics[0], window), rng.choice(topics[0], 2 * window)  # nothing of these is left to pack
        bags[20] = bags[5]
        lengths = [len(b) for b in bags]
        found = lexical_packing.pack_shard(lengths, bags, window)
        wanted = brute_windows(lengths, bags, window)
        if sum(n for _, _, n in wanted[-1]) < window:
            wanted[-1:] = lexical_packing._powers(wanted[-1])
        assert found == wanted


def test_likeness_is_that_of_whole_documents():
    """Documents whose last ids have nothing in common are neighbours by what comes before."""
    first, second = np.arange(100, 132), np.arange(200, 232)
    bags = [np.append(first, [1, 2]), np.append(second, [1, 3]), np.append(second, [4, 5]), np.append(first, [6, 7])]
    windows = lexical_packing.pack_shard([34] * 4, bags, 32)
    assert [d for d, _, _ in windows[4]][:2] == [0, 3]
