from pyspark.sql import functions as F

from conceptspark.functions.text import strip_fences, truncate_text
from conceptspark.operators import responses, transcripts


def turns_of(spark, text):
    df = spark.createDataFrame([("t", "workforce", text)], "transcript_id string, split string, text string")
    return [tuple(t) for t in transcripts.parse_turns(df).first()["turns"]]


def test_parse_turns_edge_cases(spark):
    assert turns_of(spark, "Assistant: Hi.\nUser: I work as an assistant: yes.\nAI: Good.") == [
        ("AI", "Hi.", 0),
        ("Human", "I work as an assistant: yes.", 1),
        ("AI", "Good.", 2),
    ]
    assert turns_of(spark, "User:   \nAI: x") == [("Human", "", 0), ("AI", "x", 1)]
    assert turns_of(spark, "AI: a\nAI: b") == [("AI", "a", 0), ("AI", "b", 1)]
    assert turns_of(spark, "preamble\nUser: late") == [("Human", "late", 0)]
    assert turns_of(spark, "") == []
    assert turns_of(spark, "User: two\n\nparagraphs\nAI: ok")[0][1] == "two\n\nparagraphs"


def test_speaker_filter_and_format(spark):
    df = spark.createDataFrame([("t", "w", "AI: q\nUser: a\nAI: r")], "transcript_id string, split string, text string")
    parsed = transcripts.parse_turns(df)
    assert transcripts.format_transcript(parsed).first()["formatted"] == "[AI]: q\n\n[Human]: a\n\n[AI]: r"
    assert transcripts.filter_speaker_text(parsed, "Human").first()["formatted"] == "[Human]: a"


def test_strip_fences(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        '  {"a": 1} ': '{"a": 1}',
        "```\nx\n```\n\n": "x",
        "```json": "```json",
        "```": "",
        "x ```": "x ```",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for row in df.select("want", strip_fences(F.col("raw")).alias("got")).collect():
        assert row["got"] == row["want"]


def test_truncate_only_when_longer(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",)], "t string")
    got = [r[0] for r in df.select(truncate_text(F.col("t"), 4, "!")).collect()]
    assert got == ["abcd", "abcd!"]


def test_stratified_order(spark):
    ids = spark.createDataFrame(
        [("b1", "x"), ("b2", "x"), ("a1", "y"), ("c1", "z"), ("a2", "y")], "transcript_id string, split string"
    )
    order = [r["transcript_id"] for r in transcripts.order_worklist(ids, "stratified").collect()]
    assert order == ["a1", "b1", "c1", "a2", "b2"]


def test_attempt_outcomes(spark):
    good = '{"stance_ambivalence": {"label": "low"}}'
    rows = [
        ("ok", 1, good), ("late", 1, ""), ("late", 2, good), ("bad", 1, "{oops"), ("bad", 2, good),
        ("none", 1, None), ("again", 1, " "), ("empty", 1, ""), ("empty", 2, ""), ("empty", 3, ""),
    ]
    df = spark.createDataFrame(rows, "transcript_id string, attempt int, content string")
    out = responses.classify_attempts(df, responses.label_schema("stance_ambivalence"))
    got = {r["transcript_id"]: (r["status"], r["reason"]) for r in out.collect()}
    assert got == {
        "ok": ("ok", None),
        "late": ("ok", None),
        "bad": ("failed", "invalid JSON"),
        "none": ("failed", "no response"),
        "again": ("retry", None),
        "empty": ("failed", "empty content"),
    }


def test_label_response_warnings(spark):
    rows = [
        ("missing", "{}"),
        ("fine", '{"a": {"label": "low", "reasoning": "r", "quotes": ["q"]}}'),
        ("unsure", '{"a": {"label": "uncertain", "reasoning": "r", "quotes": []}}'),
        ("wrong", '{"a": {"label": "huge", "reasoning": "", "quotes": null}}'),
    ]
    df = spark.createDataFrame(rows, "transcript_id string, content string")
    parsed = responses.parse_responses(df, responses.label_schema("a"))
    out = responses.validate_label_response(parsed, {"a": ["low", "uncertain"]}).collect()
    got = sorted((r["transcript_id"], r["warning"]) for r in out)
    assert got == [
        ("missing", "missing attribute"),
        ("wrong", "invalid label"),
        ("wrong", "missing reasoning"),
        ("wrong", "no quotes"),
    ]


def test_text_features_of_every_script(spark):
    from conceptspark.operators import embeddings

    texts = {1: "Die Straße ist schön", 2: "Die Strasse ist schon", 3: "学习机器学习", 4: "学习机器", 5: "привет мир", 6: "für über", 7: "f r ber", 8: " .,"}
    table = spark.createDataFrame(list(texts.items()), "transcript_id long, formatted string")
    found = {r.transcript_id: r.features for r in embeddings.text_features(table).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(found[a], found[b]))
    assert all(abs(dot(k, k) - 1) < 1e-9 for k in texts if k != 8) and dot(8, 8) == 0
    assert dot(3, 4) > dot(3, 1) + 0.3 and dot(1, 2) < 0.9 and dot(6, 7) < 0.5
