import random

from pyspark.sql import functions as F

from causeway.operators import relations as R
from causeway.operators import segments


def test_numbers_run_through_groups_of_any_size(spark):
    """One key has nine tenths of the rows; numbers equal those of a plain window, over however many blocks."""
    r = random.Random(1)
    rows = [(r.choice([*["big"] * 18, "small", None]), r.randrange(300), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.col("v").desc(), F.col("i")]
        got = segments.numbered(df, ["k"], order, "n")
        assert got.columns == ["k", "v", "i", "n"]
        blocks = df.repartitionByRange("k", *order).groupBy(F.spark_partition_id()).count().collect()
        assert len(blocks) == 40 and max(b["count"] for b in blocks) < 0.06 * len(rows)
        want = {i: n for n, (_, i) in enumerate(sorted((-v, i) for k, v, i in rows if k == "big"))}
        assert {x.i: x.n for x in got.where("k = 'big'").collect()} == want
        assert sorted(x.n for x in got.where("k is null").collect()) == list(range(sum(k is None for k, _, _ in rows)))
        assert all("_block" in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in line)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert segments.numbered(df.limit(0), ["k"], [F.col("i")], "n").count() == 0


def test_small_scans_are_spread_and_others_left(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    small = spark.read.parquet(f"{tmp_path}/t").coalesce(1)
    assert segments.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    unknown = spark.createDataFrame([(1,)], "a int").coalesce(1)
    assert segments.spread(unknown).rdd.getNumPartitions() == 1


def test_windows_in_blocks_equal_one_window(spark):
    r = random.Random(2)
    rows = [(m, p, f"s{p}", r.choice([1, 1, -1]), [w for w in ("Aaaa", "Bbbb", "Cccc") if r.random() < 0.3]) for m in ("x", "y") for p in range(90)]
    df = spark.createDataFrame(rows, "map_key string, pos long, sentence string, polarity int, keywords array<string>")
    at = {(m, p): (pol, k) for m, p, _, pol, k in rows}
    for window in (1, 3, 4):
        want = []
        for m, p, sentence, _, keys in rows:
            for o in range(window):
                if (m, p + o) in at:
                    negative = min(at[m, p + i][0] for i in range(o + 1)) < 0
                    want += [(m, a, b, p, o, negative, 1 / (1 + o), sentence) for a in keys for b in at[m, p + o][1] if a != b and (o or a < b)]
        for span in (window, 7, 4096):
            assert sorted(map(tuple, R.window_pairs(df, window, span).collect())) == sorted(want)


EDGE = "map_key string, source string, target string, weight double, confidence double, edge_type string"


def some_edges(spark, n=300):
    r = random.Random(3)
    rows = {(r.choice("ab"), f"S{r.randrange(30)}", f"T{r.randrange(30)}"): (r.choice([0.05, 0.15, 0.3, -0.3, -0.7]), r.choice([0.4, 0.9]), r.choice(["pattern", "cooccurrence"])) for _ in range(n)}
    rows |= {("c", "S", "T"): (0.05, 0.5, "pattern"), ("c", "S", "U"): (0.4, 0.5, "pattern"), ("d", "S", "U"): (-0.4, 0.5, "pattern")}
    rows |= {("e", f"S{i}", "T"): (0.06 + i / 1000, 0.5, "pattern") for i in range(9)}
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], EDGE)


def test_ranks_in_blocks_equal_plain_ranks(spark):
    edges = some_edges(spark)
    for interleaved in (False, True):
        got, want = (R.ranked(edges, interleaved, segmented=s) for s in (True, False))
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_tiers(spark):
    edges = some_edges(spark)
    by_map = {}
    for e in edges.collect():
        by_map.setdefault(e.map_key, []).append(e)
    for limit in (None, 3, 60):
        want = []
        for m, es in by_map.items():
            es.sort(key=lambda e: (e.edge_type != "pattern", -e.confidence * abs(e.weight), e.source, e.target))
            good = [e for e in es if abs(e.weight) >= 0.2]
            chosen = good if len(good) >= min(5, len(es)) else es[: max(5, len(good))]
            want += [(m, i + 1, e.source, e.target) for i, e in enumerate(chosen[:limit])]
        assert sorted(map(tuple, R.tiered(edges, limit).select("map_key", "rank", "source", "target").collect())) == sorted(want)


def test_operands_meet_by_shuffle_as_by_broadcast(spark):
    text = "Overfishing reduces fish biomass. Strong storms cause a decline in coral reefs. Reef habitat is damaged by runoff."
    chunks = spark.createDataFrame([("m", "d", 0, text, 1.0), ("m", "e", 1, text, 0.5)], "map_key string, doc_id string, chunk_no int, text string, score double")
    few, many = (sorted(map(str, R.mentions(chunks, broadcast_bytes=b).collect())) for b in (1 << 24, 0))
    assert few == many and len(few) >= 4


def test_word_edges_of_the_corpus_are_those_of_its_sql(spark, tmp_path):
    """An accented letter beside a keyword or a marker is no part of the word: all is counted as SQL counts it."""
    import duckdb

    from causeway.plans import queries, registry

    texts = ["Éeauouch èment de antioné thtion. La éretion antion éwas fromé.", "Un attionè hehely éwith. Orantioné antion beé!", "retion éthanea antion. inoran be was", None, "_antion retion", "antion_ ertion é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(registry.ORACLES["corpus_cooccurrence"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["corpus_cooccurrence"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 8
