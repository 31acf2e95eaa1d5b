import re

from causeway.operators import gates as B
from causeway.operators import relations as R
from causeway.sources import readers as S

TRACK, FAILED = "id string, name string, content string", "id string, message string"


def caption(words):
    return f"WEBVTT\nKind: captions\n\n1\n00:00.000 --> 00:01.000\n{words}\n"


def test_outcomes(spark):
    long = "fish " * 100
    tracks = [
        ("hand", "hand.en.vtt", caption("by hand " + long)), ("hand", "hand.auto.vtt", caption("by machine " + long)), ("machine", "machine.auto.vtt", caption(long)),
        ("order", "order.en-US.vtt", caption("second " + long)), ("order", "order.en.vtt", caption("")), ("short", "short.en.vtt", caption("few")),
        ("empty", "empty.en.vtt", caption("")), ("empty", "empty.en-auto.vtt", caption(long)), ("none", "none.en.vtt", None), (None, "x.vtt", caption(long)), ("unlisted", "u.vtt", caption(long)),
    ]
    failures = [("bot", "Sign in to confirm"), ("gone", "This is PRIVATE"), ("off", "captions disabled"), ("odd", "HTTP 500"), ("odd", None), ("hand", "unavailable"), (None, "private")]
    ids = ["hand", "machine", "order", "short", "empty", "none", "bot", "gone", "off", "odd", "lost", None, "hand"]
    videos = spark.createDataFrame([(i, "clash") for i in ids], "id string, words string")
    got = {r.id: (r.outcome, r.text.split(" ")[0]) for r in B.transcripts(videos, spark.createDataFrame(tracks, TRACK), spark.createDataFrame(failures, FAILED)).collect()}
    want = {"hand": ("ok", "by"), "machine": ("ok", "fish"), "order": ("ok", "second"), "short": ("too_short", "few"), "empty": ("not_found", ""), "none": ("not_found", ""), "lost": ("not_found", "")}
    want |= {"bot": ("ip_blocked", ""), "gone": ("video_na", ""), "off": ("disabled", ""), "odd": ("error", "")}
    assert got == want
    none = B.transcripts(videos.limit(0), spark.createDataFrame([], TRACK), spark.createDataFrame([], FAILED))
    assert none.count() == 0


def test_landed_tracks(spark, tmp_path):
    (tmp_path / "v1.en.vtt").write_text(caption("red fish"))
    (tmp_path / "v1.en.json").write_text("{}")
    assert [(r.id, r.name) for r in S.caption_tracks(spark, str(tmp_path)).collect()] == [("v1", "v1.en.vtt")]


def test_fallback_concepts(spark):
    rows = [("a", "d", 1, "Later words here"), ("a", "d", 0, "The coastal habitat of red fish. " * 5), ("b", "d", 0, "Coastal habitat"), ("c", "d", 0, None), (None, "d", 0, "Coastal habitat"), ("e", "d", 0, "fish " * 5000)]
    chunks = spark.createDataFrame(rows, "map_key string, doc_id string, chunk_no int, text string")
    edges = spark.createDataFrame([("b", 1)], "map_key string, phrase int")
    got = R.fallback_phrases(chunks, edges).collect()
    mine = [r.phrase for r in sorted(got, key=lambda r: r.nth) if r.map_key == "a"]
    assert mine == ["coastal habitat", "fish"] * 5 + ["Later words here"]
    assert {r.map_key for r in got} == {"a", "e"} and sum(r.map_key == "e" for r in got) == 12
    named = {r.concept for r in R.fallback_concepts(chunks, edges).collect() if r.map_key == "a"}
    assert "Coastal Habitat" in named and "Fish" in named


def test_phrases_by_regular_expression(spark):
    """Word boundaries count letters of every script, hyphens and slashes as they come."""
    texts = ["Größe gives naïvetz ügetz getz", "well-known and/or -edge abc-defg 4four five5 six/seven", "«mot» caféine, eau  douce verte", "日本 word 日本word", "", "a bc def"]
    pattern = re.compile(r"\b[A-Za-z][A-Za-z\-/]{3,}\b(?:\s+[A-Za-z][A-Za-z\-/]{3,}\b){0,2}")
    chunks = spark.createDataFrame([(str(i), "d", 0, t) for i, t in enumerate(texts)], "map_key string, doc_id string, chunk_no int, text string")
    got = sorted((r.map_key, r.nth, r.phrase) for r in R.fallback_phrases(chunks, chunks.limit(0)).collect())
    assert got == sorted((str(i), n, p) for i, t in enumerate(texts) for n, p in enumerate(pattern.findall(t)[:12], 1))
