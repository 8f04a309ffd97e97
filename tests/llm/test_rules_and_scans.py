"""Quality rules, language identification, WARC archives, fingerprints and license scans."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from conceptspark.llm import lang_hierarchy, license_scan, merkle, risk_rules, warc_zstd
from conceptspark.llm.common import remainder
from helpers import awkward, docs_of, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    found = WORD.findall(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(len(re.findall(r"[#*$%&|<>]", w)) for w in found)
    return [len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)]


def test_measures(spark):
    docs, rows = awkward(spark)
    found = risk_rules.measure(docs, ["doc_id"]).collect()
    assert [list(r)[1:7] for r in found] == [brute_measures(t or "") for _, t in rows]
    assert [r.base_failed for r in found] == [r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words for r in found]
    assert risk_rules.measure(empty(spark), ["doc_id"]).count() == 0


def test_exact_binomial():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.1), (200, 7, 0.05), (5, 5, 0.5)):
        direct = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert risk_rules.below(k, n, p) == pytest.approx(direct, rel=1e-9)
    assert risk_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-6)


def test_cutoff_keeps_its_promise():
    rng = np.random.default_rng(1)
    broken = 0
    for _ in range(200):
        # the true share above level c is (1000 - c) / 1000
        levels = rng.integers(0, 1001, 2000)
        cutoff, above, n = risk_rules.pick_cutoff(levels, np.ones(2000), 0.02, 0.05)
        assert above == (levels > cutoff).sum() and n == 2000
        broken += (1000 - cutoff) / 1001 > 0.02
    assert broken <= 20
    assert risk_rules.pick_cutoff(np.zeros(5, int), np.ones(5), 0.01, 0.01)[0] == risk_rules.STEPS


def test_rules_end_to_end(spark):
    rng = random.Random(2)
    clean = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(60)) for _ in range(1500)]
    junk = [" ".join(f"### wo$rd{rng.randrange(10**6)} &&&" for _ in range(60)) for _ in range(60)]
    texts = clean + junk + [None, ""]
    docs = docs_of(spark, enumerate(texts)).withColumn("cut_symbols", F.lit(0))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1500)] + [(None, 1, 0), (3, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    measured = risk_rules.measure(risk_rules.stratified(docs), ["doc_id", "stratum"])
    cutoffs = risk_rules.select_cutoffs(measured, labels, alpha=0.02)
    assert [r.n_good for r in cutoffs.collect()] == [1500]
    kept = {r.doc_id: r.kept for r in risk_rules.verdict(measured, cutoffs).collect()}
    assert all(kept[k] for k in range(1500)) and not any(kept[k] for k in range(1500, 1562))
    none = risk_rules.select_cutoffs(measured, labels.limit(0))
    kept = {r.doc_id: r.kept for r in risk_rules.verdict(measured, none).collect()}
    assert all(kept[k] for k in range(1560))
    assert risk_rules.verdict(risk_rules.measure(risk_rules.stratified(empty(spark)), ["doc_id", "stratum"]), none).count() == 0


def test_small_strata_take_the_cutoff_of_the_pool(spark):
    rng = random.Random(3)
    text = lambda form: " ".join(form.format(rng.randrange(10**6)) for _ in range(60))
    # 1,800 good documents in all, in no language enough; one language uses symbols in its good documents too
    rows = [(k, text("word{}"), ["de", "fr", "es"][k % 3]) for k in range(1770)] + [(k, text("#{}#"), "xx") for k in range(1770, 1800)]
    rows += [(2000 + k, text("### {} &&&"), lang) for k, lang in enumerate(["de", "fr", "es", "xx", "zz"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1800)], "doc_id long, quality int, toxic int")
    measured = risk_rules.measure(risk_rules.stratified(docs), ["doc_id", "stratum"])
    cutoffs = risk_rules.select_cutoffs(measured, labels, alpha=0.02)
    assert {r.stratum: r.n_good for r in cutoffs.collect()} == {"de": 590, "fr": 590, "es": 590, "xx": 30}
    kept = {r.doc_id: r.kept for r in risk_rules.verdict(measured, cutoffs).collect()}
    assert all(kept[k] for k in range(1800)) and not any(kept[k] for k in range(2000, 2004)) and kept[2004]
    assert risk_rules.borrow_cutoff(np.array([0, 300]), np.array([5, 5]), 100, 0.01) == (300, 0, 10)
    assert risk_rules.borrow_cutoff(np.array([0, 300]), np.array([199, 1]), 100, 0.01) == (100, 1, 200)


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "tion", "wh", "ly"], "de": ["sch", "ein", "ung", "ich", "ü"], "fr": ["eau", "que", "é", "oi", "ment"], "xx": ["qq", "zz", "kk"]}
    rows = []
    for k in range(800):
        lang = list(parts)[k % 4]
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), lang, "s", 1))
    return docs_of(spark, []).sparkSession.createDataFrame(rows, docs_of(spark, []).schema)


def test_languages_of_held_out_rows(spark, languages):
    held = remainder("doc_id", 4) == 2
    model = lang_hierarchy.fit(languages, ~held)
    assert model.members == {"germanic": ["de", "en"], "romance": ["fr"], "xx": ["xx"]}
    found = lang_hierarchy.predict(languages, model, ["doc_id", "lang"]).collect()
    right = [r.lang == r.lang_pred for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark, languages):
    model = lang_hierarchy.fit(languages)
    docs, rows = awkward(spark)
    found = lang_hierarchy.predict(docs, model, ["doc_id", "score"]).collect()
    for (key, text), r in zip(rows, found, strict=True):
        assert r.doc_id == key and (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    assert lang_hierarchy.fit(empty(spark)) is None
    assert {r.lang_pred for r in lang_hierarchy.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    assert lang_hierarchy.predict(empty(spark), model, ["doc_id"]).count() == 0
    one = lang_hierarchy.fit(languages.filter("lang = 'de'"))
    assert one.predict(lang_hierarchy.features("hallo")) == ("de", 1.0)


def test_many_languages_train_the_same_machines(spark, languages):
    driver = lang_hierarchy.fit(languages, rows_per_language=40)
    tasks = lang_hierarchy.fit(languages, rows_per_language=40, max_languages=1)
    assert tasks.members == driver.members and tasks.pairs == driver.pairs and tasks.names == driver.names
    assert np.allclose(tasks.family_weights, driver.family_weights, atol=1e-6)
    assert all(np.allclose(tasks.pair_weights[f], driver.pair_weights[f], atol=1e-6) for f in driver.members)
    rows = [(10_000 + k, f"{chr(0x100 + 2 * (k % 70)) * 3} noise", f"n{k % 70}", "s", 1) for k in range(140)]
    noisy = languages.union(spark.createDataFrame(rows, languages.schema))
    model = lang_hierarchy.fit(noisy, rows_per_language=20)
    assert len(model.names) == 73
    found = lang_hierarchy.predict(noisy, model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in found if r.doc_id < 10_000]) > 0.9 and len(found) == 940


def test_features_of_long_texts_do_not_depend_on_parts(monkeypatch):
    text = "abc déf " * 900
    whole = lang_hierarchy.features(text)
    monkeypatch.setattr(lang_hierarchy, "PART", 1000)
    assert np.allclose(whole, lang_hierarchy.features(text), atol=1e-6)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, page string, sha1 string")


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, f"http://h/{k}", f"<p>{rng.random()} text {'x' * (k % 50)}</p>", "clash", "clash") for k in range(300)]
    rows += [(1000 + k, None, "<p>copy</p>", None, None) for k in range(20)] + [(7000, "u\r\nv", None, None, None), (7001, "u", "", None, None)]
    rows += [(1005, None, "<p>copy</p>", None, None), (1000, None, "<p>copy</p>", None, None), (None, "n", "<p>copy</p>", None, None), (None, "n", "alone é", None, None)]
    for min_bytes, archive_bytes in ((0, 2000), (5, 1 << 20)):
        path = str(tmp_path / f"w{min_bytes}")
        warc_zstd.write_archives(pages_of(spark, rows).repartition(3), path, min_bytes, archive_bytes=archive_bytes)
        found = warc_zstd.read_archives(spark, path, with_block=True).collect()
        first = {}
        for key, _, html, *_ in rows:
            if key is not None and len((html or "").encode()) >= min_bytes:
                first[html or ""] = min(key, first.get(html or "", key))
        wanted = Counter()
        for key, _, html, *_ in rows:
            payload = (html or "").encode()
            original = first.get(html or "")
            revisit = original is not None and original != key
            kind = "revisit" if revisit else "response"
            wanted[key, kind, warc_zstd.digest(payload), len(payload), original if revisit else None, b"" if revisit else payload] += 1
        assert Counter((r.page, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, bytes(r.block)) for r in found) == wanted
    path = str(tmp_path / "none")
    warc_zstd.write_archives(pages_of(spark, []), path)
    assert warc_zstd.read_archives(spark, path).count() == 0


def test_archive_has_a_leading_dictionary_and_is_validated():
    import zstandard

    records = [warc_zstd.build_record(k, f"http://a/{k}", f"<html><body>{k * 7919} some common text of pages</body></html>".encode() * 5, "", None) for k in range(300)]
    content = warc_zstd.build_archive(records, dictionary_bytes=2000)
    magic, size = struct.unpack("<II", content[:8])
    assert magic == warc_zstd.DICTIONARY_FRAME and size > 0
    assert list(warc_zstd.read_archive(content)) == records
    assert list(warc_zstd.read_archive(content + warc_zstd.SEPARATOR.encode())) == records
    packed = zstandard.ZstdCompressor().compress(content[8 : 8 + size])
    again = struct.pack("<II", warc_zstd.DICTIONARY_FRAME, len(packed)) + packed + content[8 + size :]
    assert list(warc_zstd.read_archive(again)) == records
    for broken in (content[:-3], content[8 + size :], content[: 8 + size - 1], b"junk" + content, content[8 + size :] + content[: 8 + size]):
        with pytest.raises(warc_zstd.BadArchive):
            list(warc_zstd.read_archive(broken))
    good = warc_zstd.build_record(1, "u", b"abc", warc_zstd.digest(b"abc"), None)
    assert warc_zstd.parse_record(good)[1] == b"abc"
    for broken in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"Content-Length: 3", b"Content-Length: 2"), b"x" + good, good.replace(b"WARC-Date", b"Other")):
        with pytest.raises(warc_zstd.BadArchive):
            warc_zstd.parse_record(broken)


PIECE_TOKEN = regex.compile(
    r"(?V1s)[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]]{1,32}[^\p{L}\p{N}]?|."
)


def brute_pieces(sentence):
    if len(sentence) <= merkle.PIECE_CHARS:
        return [sentence]
    runs, now = [], ""
    for word in PIECE_TOKEN.findall(sentence):
        now += word
        if xxhash.xxh64_intdigest(word.encode(), seed=42) % merkle.PIECE_WORDS == 0:
            runs.append(now)
            now = ""
    return [r[k : k + merkle.PIECE_CHARS] for r in [*runs, now] for k in range(0, len(r), merkle.PIECE_CHARS)]


def brute_fingerprint(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text = text.replace("\1", "\1a").replace("\0", "\1b")
    nodes = [[[[sha(x) for x in brute_pieces(q)] for q in p.split(". ")] for p in s.split("\n")] for s in text.split("\n\n")]
    above = lambda x: x if isinstance(x, str) else sha("".join(map(above, x)))
    short = "/".join(",".join(".".join("".join(x[:8] for x in q) for q in p) for p in s) for s in nodes)
    return above(nodes) + ":" + short, {x[:8] for s in nodes for p in s for q in p for x in q}


def test_fingerprints(spark):
    docs, rows = awkward(spark)
    rows = rows + [(k, f"Sentence {k % 7}. Next {k}. End\nline {k % 3}\n\nsection {k}") for k in range(100, 4000, 13)]
    docs = docs_of(spark, rows).withColumn("bucket", F.lit(1))
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    wanted = Counter()
    for (key, own), (_, other) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        (a, x), (b, y), (_, z) = brute_fingerprint(own), brute_fingerprint(edited), brute_fingerprint(other)
        wanted[key, len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(len(x & y) / len(x | y), 9), round(len(x & z) / len(x | z), 9)] += 1
    found = merkle.compare_edited(docs).collect()
    assert Counter((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == wanted
    assert merkle.compare_edited(empty(spark)).count() == 0
    assert [r.near_next for r in merkle.compare_edited(docs_of(spark, [(5, "a b")])).collect()] == [1.0]
    roots = {r.doc_id: r.fingerprint for r in merkle.fingerprints(docs_of(spark, [(1, "a\nb"), (2, "a\nb"), (3, "a\n\nb")])).collect()}
    assert roots[1] == roots[2] != roots[3]


def test_edited_branches_locate_the_edit(spark):
    pair = spark.createDataFrame([("a\nb. c\n\nd\ne", "a\nb. x\n\nd\ne")], "own string, other string")
    found = pair.select(merkle.edited_branches(merkle.tree(F.col("own")), merkle.tree(F.col("other"))).alias("x")).first().x
    assert [tuple(b) for b in found] == [(0, 1)]


def test_long_texts_without_sentence_ends_have_pieces(spark):
    rng = random.Random(9)
    texts = [
        " ".join(f"w{rng.randrange(3000)}" for _ in range(400)), "again " * 400, "x" * 3000, "#$%&|<> " * 200, "!".join(f"so it is {k}" for k in range(200)),
        "。".join("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(30)) for _ in range(40)), "a\0b \U0001f600" * 100,
    ]
    rows = [(2 * k, t) for k, t in enumerate(texts)] + [(2 * k + 1, f"other text {k} " + "unlike " * 500) for k in range(len(texts))]
    found = {r.doc_id: r for r in merkle.compare_edited(docs_of(spark, rows)).collect()}
    assert all(found[2 * k].near_edited > 0 and found[2 * k].near_next == 0 for k in range(len(texts)))
    cut = spark.createDataFrame([(t,) for t in texts], "t string").select("t", merkle._cut(merkle._escaped(F.col("t"))).alias("x")).collect()
    assert all("".join(r.x).replace("\1b", "\0") == r.t and max(map(len, r.x)) <= merkle.PIECE_CHARS for r in cut)
    assert [r.x for r in cut] == [brute_pieces(r.t.replace("\0", "\1b")) for r in cut]
    # an edit shows in few pieces, and inserted words do not move the cuts after them
    own = texts[0]
    pair = spark.createDataFrame([(own[:900] + "inserted words " + own[900:], own)], "own string, other string")
    trees = [merkle.tree(F.col(c)) for c in ("own", "other")]
    found = pair.select(merkle.edited_pieces(*trees).alias("x"), F.size(merkle.pieces(trees[0])).alias("n")).first()
    assert 1 <= len(found.x) <= 4 and found.n > 20 and all(tuple(b)[:3] == (0, 0, 0) for b in found.x)


def test_texts_that_differ_in_control_signs_have_different_roots(spark):
    texts = ["a" * 200, "a" * 100 + "\0" + "a" * 100, "a" * 100 + "\1" + "a" * 100, "a" * 100 + "\1b" + "a" * 100, "a" * 100 + "\1a" + "a" * 100]
    assert len({r.fingerprint for r in merkle.fingerprints(docs_of(spark, enumerate(texts))).collect()}) == len(texts)


def test_next_rows_with_outlying_null_and_repeated_ids(spark):
    rng = random.Random(4)
    ids = [*range(30_000), 10**15, -(2**63), 2**63 - 1, *[2**40 + 7 * k for k in range(12_000)], *[None] * 40, *[77] * 50]
    rows = [(k, f"t{rng.randrange(10**6)}") for k in ids]
    found = merkle.with_next(docs_of(spark, rows)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted = Counter((*own, other) for own, (_, other) in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert Counter(map(tuple, found)) == wanted
    keyed = docs_of(spark, rows).select(F.col("doc_id").alias("key"), F.col("text").alias("text_in"))
    sizes = [r["count"] for r in merkle._in_ranges(keyed).groupBy("bucket").count().collect()]
    assert max(sizes) <= merkle.UNEVEN * merkle.ROWS_PER_BUCKET and len(sizes) < len(rows) / 100


def test_fingerprint_plan_is_native(spark, capsys):
    merkle.compare_edited(docs_of(spark, [(1, "a"), (2, "b")])).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_license_base_places(spark):
    docs, rows = awkward(spark)
    rows = rows + [(500, "mit license mit LICENSE cc by cc by"), (501, "cc-by apache\nlicense gnu general public licenses")]
    found = license_scan.scan(docs_of(spark, rows).withColumn("tokens", F.lit(1)), templates={}).collect()
    for (key, text), r in zip(rows, found, strict=True):
        own = LICENSE_WORD.findall(ascii_lower(text or ""))
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
        starts, labels = [i for i, _ in places], ",".join(sorted({x for _, x in places}))
        assert tuple(r) == (key, len(own), len(places), min(starts, default=None), max(starts, default=None), labels, labels, float(bool(places)))
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_blocks_equal_brute_force():
    rng = random.Random(8)
    templates = {"x": "a b c d e f g h i j", "y": "k l m n k o p"}
    for trial in range(200):
        frequency = {t: rng.randrange(5) for t in map(lambda c: c.encode(), "abcdefghijklmnop")}
        matcher = license_scan.Matcher(templates, frequency, 0.8, 2)
        own = [rng.choice("abcdefghijklmnopqrstuvwxyz" if trial % 2 else "abcdefghijklmnop").encode() for _ in range(rng.randrange(120))]
        if trial % 3 == 0:
            own[10:10] = [w.encode() for w in "a b c q d e f g h".split()]
        wanted = set()
        for label, text in templates.items():
            tokens = {w.encode() for w in text.split()}
            need, span = math.ceil(0.8 * len(tokens)), 2 * len(text.split())
            wanted |= {label for i in range(len(own)) if len(tokens & set(own[i : i + span])) >= need}
        blocks = matcher.blocks(own)
        assert {b[0] for b in blocks} == wanted
        for label, a, b, share in blocks:
            tokens = {w.encode() for w in templates[label].split()}
            assert 0.8 <= share <= len(tokens & set(own[a : b + 1])) / len(tokens) + 1e-9


def test_license_templates_match_their_notices(spark):
    rows = [(k, f"some words before {t} and after") for k, t in enumerate(license_scan.TEMPLATES.values())]
    found = license_scan.scan(docs_of(spark, rows), with_blocks=True).collect()
    for r, label in zip(found, license_scan.TEMPLATES, strict=True):
        assert label in r.labels.split(",") and r.score == 1.0
