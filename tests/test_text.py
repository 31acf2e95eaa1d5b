from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.functions.lexicons import DEFAULT

NAMES = [
    ("the very high fish stock", "Fish Stock", True), ("fish stock high", "Fish Stock", True), ("How fish increase", "Fish Increase", False), ("fish how grow", "Fish How Grow", False),
    ("it is overfishing", "Overfishing", True), ("very high", "High", False), ("fish fish stock", "Fish Stock", True), ("CPUE", "CPUE", True), ("water quality", "Water Quality", True),
    ("thing", "Thing", False), ("climate change", "Climate Change", True), ("amount of bycatch", "Bycatch", True), ("of", "", False), ("", "", False), (None, "", False),
    ("data availability after", "Data Availability", False), ("3.5", "", False),
]


def test_names(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(NAMES)], "i int, t string").withColumn("n", T.normalized_concept("t")).withColumn("c", T.clean_concept("n"))
    got = [(r.n, r.c) for r in df.orderBy("i").collect()]
    assert got == [x[1:] for x in NAMES]


def test_word_lists():
    assert {"increases", "caused", "how", "controlled", "curbing", "means"} <= DEFAULT.verb_first and not {"mean", "affected", "led", "drove"} & DEFAULT.verb_first
    assert {"increases", "design"} <= DEFAULT.anywhere and not {"use", "report", "assess"} & DEFAULT.anywhere
    assert {"levels", "ratios"} <= DEFAULT.vague and "stuffs" not in DEFAULT.vague
    assert (len(DEFAULT.verb_first), len(DEFAULT.vague), len(DEFAULT.anywhere)) == (645, 322, 357)


def test_probed_names(spark):
    names = [("Mean Temperature", True), ("Affected Area", True), ("Controlled Fishing", False), ("Curbed Fishing", False)]
    df = spark.createDataFrame([(n,) for n, _ in names], "n string")
    assert [(r.n, r.c) for r in df.select("n", T.clean_concept("n").alias("c")).collect()] == names


def test_questions(spark):
    asked = {"hello please": False, "what about it": False, "": False, "the levels": False, "red tide": True, "asdf": True, "ok okay testing": False}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r.ok for r in df.select("q", T.meaningful_query("q").alias("ok")).collect()} == asked


def test_rounding(spark):
    assert spark.range(1).select(T.rounded(F.lit(0.3125), 3), T.rounded(F.lit(-0.0625), 3), T.rounded(F.lit(0.30000000000000004), 3)).first()[:] == (0.312, -0.062, 0.3)


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_weights(spark):
    f = lambda span: one(spark, span, T.modulated(F.lit(0.75), "t"))[0]
    assert f("may significantly increase") == round(0.75 * 1.18 * 0.62, 3) and f("increases") == 0.75
    assert one(spark, "strongly", T.modulated(F.lit(0.9), "t"))[0] == 0.98


def test_lemmas_and_polarity(spark):
    assert one(spark, "Fisheries Stocks CPUE glass boxes", T.lemma_key("t"))[0] == "CPUE boxes fishery glass stock".replace("boxes", "boxe")
    assert one(spark, "Reef Fishes", T.lemma_key("t"))[0] == "fishe reef"
    assert one(spark, "a loss and a crash despite growth", T.sentence_polarity("t"))[0] == -1 and one(spark, "a loss and growth", T.sentence_polarity("t"))[0] == 1


def test_keywords(spark):
    hits = lambda t, *a: one(spark, t, T.keyword_hits("t", ["bag-limit", "quota", "gulf council"], *a))[0]
    assert hits("the handbag limits of a Gulf-Council quota") == ["bag-limit", "gulf council", "quota"]
    assert hits("quotas") == [] and hits(None) == [] and hits("quota, sold", ["sold"]) == []
    assert one(spark, "the the", T.meaningful_query("t"))[0] is False and one(spark, "red snapper?", T.meaningful_query("t"))[0] is True


def test_dates_and_names(spark):
    assert one(spark, "07-04-2021 12:05 AM", T.forum_date("t"))[0] == "2021-07-04T00:05:00" and one(spark, "soon", T.forum_date("t"))[0] == "soon"
    assert one(spark, "Tue, 5 Mar 2024 10:00:00 GMT", T.feed_date("t"))[0] == "2024-03-05" and one(spark, "20240305", T.upload_date("t"))[0] == "2024-03-05" and one(spark, "x", T.upload_date("t"))[0] == ""
    assert one(spark, "gulf-coast-31", T.location_of("t"))[0] == "Gulf Coast"
    assert one(spark, "", T.date_in_window("t", 2026))[0] is True and one(spark, "in 2003", T.date_in_window("t", 2026))[0] is False


def test_lines_and_captions(spark):
    page = "Home\n#971\n05/22/26\nclick here to win\nA line that says something about the reef and its fish.\nok\n#12 next"
    assert one(spark, page, T.clean_lines("t"))[0] == "A line that says something about the reef and its fish."
    assert one(spark, "\n".join(["short"] * 9), T.clean_lines("t"))[0] == ""
    assert one(spark, "WEBVTT\n\n1\n00:00 --> 00:01\n<b>hello</b>\nhello\nthere", T.transcript_text("t"))[0] == "hello there"
    html = "<head><title>Reefs | News</title><meta name='date' content='2020-01-02'></head><h1>x</h1>"
    assert one(spark, html, T.html_title("t"), T.html_date("t")) == ("Reefs", "2020-01-02")


def test_tokens_of_texts_without_any_and_of_odd_capitals(spark, tmp_path):
    import duckdb

    from causeway.plans import queries, registry

    texts = ["Éé. çè!", "", None, "...", "İstanbul \u212aelvin \u017fee", "B a B 7"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES["tokens"](spark, str(tmp_path)).collect())
    assert got == sorted(duck.sql(registry.ORACLES["tokens"]).fetchall())
    assert [r[1:] for r in got[:4]] == [(0, None)] * 4
