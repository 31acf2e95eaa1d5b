import math
import random

from pyspark.sql import functions as F

from causeway.operators import graph as G
from causeway.operators import relations as R
from causeway.operators import resolve as E
from causeway.operators import simulate as Z
from causeway.plans import maps as M

V6 = (
    "Overfishing reduces fish biomass. Habitat loss threatens marine biodiversity. Climate change increases ocean temperature. "
    "Rising ocean temperature influences and causes coral bleaching. Coral bleaching damages reef habitat. Strong fishery management restores fish biomass."
)
CHUNK = "map_key string, doc_id string, chunk_no int, text string, score double"
EDGE = "map_key string, source string, target string, weight double, polarity string, confidence double, evidence string, evidence_doc_id string, edge_type string, hops int, seen string"


def edges(spark, *rows):
    return spark.createDataFrame([("m", s, t, float(w), "", c, f"{s}-{t}", None, "pattern", 1, f"{i:03d}") for i, (s, t, w, c) in enumerate(rows)], EDGE)


def test_vignette(spark):
    got = {(r.source, r.target): (r.weight, r.confidence) for r in R.merge_mentions(R.mentions(spark.createDataFrame([("v", "d", 0, V6, 1.0)], CHUNK))).collect()}
    assert got[("Overfishing", "Fish Biomass")] == (-0.75, 0.95) and got[("Habitat Loss", "Marine Biodiversity")] == (-0.75, 0.95)
    assert got[("Climate Change", "Ocean Temperature")] == (0.75, 0.95) and got[("Coral Bleaching", "Reef Habitat")] == (-0.75, 0.95)
    assert not any("Management" in a for a, _ in got)


def test_passive_and_due_to(spark):
    text = "Reef habitat was degraded by nutrient runoff. Fish mortality due to red tide."
    got = {(r.source, r.target, r.weight) for r in R.mentions(spark.createDataFrame([("v", "d", 0, text, 0.1)], CHUNK)).collect()}
    assert ("Nutrient Runoff", "Reef Habitat", -0.65) in got and ("Red Tide", "Fish Mortality", 0.6) in got


def test_empty_texts(spark):
    none = spark.createDataFrame([("v", "d", 0, None, None), ("w", "d", 0, "", 1.0)], CHUNK)
    assert R.mentions(none).count() == 0 and R.cooccurrence(none).count() == 0 and M.extract(none.limit(0)).count() == 0


def test_cooccurrence(spark):
    text = "Coral reef decline and overfishing. Red tide kills. Nothing here. Coral reef and red tide recover."
    got = {(r.source, r.target): r for r in R.cooccurrence(spark.createDataFrame([("v", "d", 0, text, 1.0)], CHUNK)).collect()}
    assert got[("Overfishing", "Red Tide")].polarity == "negative" and all(r.confidence == 0.4 for r in got.values())


def test_closure(spark):
    e = edges(spark, ("Fish Stock", "Reef Habitat", 0.9, 0.9), ("Reef Habitat", "Shrimp Price", -0.8, 0.5), ("Shrimp Price", "Fish Stock", 0.9, 0.9), ("Oyster Demand", "Fish Stock", 0.2, 0.9))
    got = {(r.source, r.target): (r.weight, r.confidence) for r in R.two_hops(e).collect()}
    assert got == {("Fish Stock", "Shrimp Price"): (-0.504, 0.35), ("Reef Habitat", "Fish Stock"): (-0.504, 0.35), ("Shrimp Price", "Reef Habitat"): (0.567, 0.63)}


def test_resolution(spark):
    e = edges(spark, ("Fish Stock", "Reef Habitat", 0.5, 0.9), ("Fish Stocks", "Reef Habitat", 0.7, 0.9), ("Pollution", "Fish Stock", -0.5, 0.5), ("Coastal Pollution", "Fish Stock", 0.5, 0.5), ("Red Snapper Landings", "Red Snaper Landings", 0.5, 0.5))
    names = {r.concept: r.canonical for r in E.canonical_names(e).collect()}
    assert names["Fish Stock"] == "Fish Stocks" and names["Pollution"] == "Coastal Pollution" and names["Red Snaper Landings"] == "Red Snapper Landings"
    got = {(r.source, r.target): r for r in E.remap(e, E.canonical_names(e)).collect()}
    assert set(got) == {("Fish Stocks", "Reef Habitat"), ("Coastal Pollution", "Fish Stocks")}
    assert got[("Fish Stocks", "Reef Habitat")].weight == 0.6 and got[("Fish Stocks", "Reef Habitat")].confidence == 0.93


def test_reverse_pairs(spark):
    e = edges(spark, ("A", "B", 0.5, 0.9), ("B", "A", 0.6, 0.9), ("A", "C", 0.5, 0.9), ("C", "A", -0.5, 0.9), ("D", "E", 0.5, 0.5), ("E", "D", 0.5, 0.5))
    assert {(r.source, r.target) for r in E.one_direction(e).collect()} == {("B", "A"), ("A", "C"), ("C", "A"), ("D", "E")}


def test_ranks(spark):
    e = edges(spark, *((f"P{i}", "X", 0.9 - i / 10, 0.9) for i in range(4)), ("N0", "X", -0.95, 0.9), ("N1", "X", -0.1, 0.9))
    assert [r.source for r in R.ranked(e, interleaved=True).orderBy("rank").collect()] == ["P0", "P1", "N0", "P2", "P3", "N1"]
    assert [r.source for r in R.ranked(e).orderBy("rank").collect()][:2] == ["N0", "P0"]
    weak = edges(spark, *((f"P{i}", "X", 0.05, 0.5 + i / 100) for i in range(7)))
    assert R.tiered(weak, 0, 0.2).count() == 5


def test_matrix_with_repeats_and_roles(spark):
    e = edges(spark, ("A", "B", 0.5, 0.9), ("A", "B", 0.7, 0.9), ("B", "C", 0.1, 0.9))
    m = G.dense_matrix(e).first()
    assert m.concepts == ["A", "B", "C"] and m.matrix[0][1] == 0.7 and m.matrix[1][0] == 0.0
    assert {r.concept: r.role for r in G.node_strength(edges(spark, ("A", "B", 0.5, 0.9), ("B", "C", 0.5, 0.9))).collect()} == {"A": "Transmitter", "B": "Ordinary", "C": "Receiver"}


def test_simulation(spark):
    run = spark.createDataFrame([("m", ["x", "y"], [[0.0, 0.5], [-0.3, 0.0]], {"x": 1.0, "zzz": 1.0}), ("e", ["x"], [[0.0]], None)], "map_key string, concepts array<string>, matrix array<array<double>>, activation map<string,double>")
    got = {r.map_key: r for r in Z.simulate(run, squash="tanh").collect()}
    y, steps = 0.0, 0
    while True:
        after, steps = math.tanh(y + 0.5), steps + 1
        y, gap = after, abs(after - y)
        if gap < 1e-4:
            break
    assert math.isclose(got["m"].final[1], y) and got["m"].iterations == steps and got["m"].converged and len(got["m"].history) == steps + 1 and got["m"].final[0] == 1.0
    assert got["e"].final == [0.0] and got["e"].iterations == 1
    free = Z.simulate(run.where("map_key = 'm'"), steps=3, squash="none", clamp_drivers=False).first()
    assert free.iterations == 3 and not free.converged
    assert Z.run_scenario(run.where("map_key = 'm'"), 1).first().state == [1.0, 0.5]
    try:
        Z.simulate(run, squash="relu")
        raise AssertionError
    except ValueError:
        pass


def test_themes_take_the_first_rule(spark):
    got = {r.concept: (r.category, r.theme, r.colour) for r in G.node_lookup(spark.createDataFrame([("Attempt",), ("Reef Fish",), ("Zzz",), ("",)], "concept string")).collect()}
    assert got["Attempt"][0] == "Environmental" and got["Reef Fish"][0] == "Reef Fish" and got["Zzz"] == ("Other", "Zzz", "#D3D3D3") and got[""] == ("Other", "", "#D3D3D3")


def test_whole_map(spark):
    e = M.build_maps(spark.createDataFrame([("v", "d", 0, V6, 1.0)], CHUNK), limit=4)
    rows = e.orderBy("rank").collect()
    assert len(rows) == 4 and all(r.edge_type == "pattern" for r in rows) and e.where(F.col("rank") > 4).count() == 0


def test_all_evidence_is_kept(spark):
    """An edge of 90 distinct sentences, each said twice, carries all of them; a limit is for display and changes no number."""
    said = [f"In year {i} climate change increases ocean temperature." for i in range(1000, 1090)]
    rows = R.mentions(spark.createDataFrame([("m", str(n), n, t, 0.1) for n, t in enumerate(said + said)], CHUNK)).where("target = 'Ocean Temperature'").cache()
    assert rows.select("source").distinct().count() == 1
    whole, short = R.merge_mentions(rows).collect(), R.merge_mentions(rows, 64).collect()
    assert [r.evidence.split(" | ") for r in whole] == [said] and [r.evidence.split(" | ") for r in short] == [said[:64]]
    assert [r.confidence for r in whole] == [r.confidence for r in short] == [0.8]
    assert [(r.nth, r.evidence) for r in R.evidence_rows(rows).orderBy("nth").collect()] == [*enumerate(said, 1)]


def test_equal_texts_are_searched_once_and_count_as_often_as_they_stand(spark, monkeypatch):
    r = random.Random(7)
    pool = ["Fishing pressure reduces snapper abundance.", "Fishing pressure strongly limits snapper abundance. Habitat loss reduces oyster growth!", "Water quality increases oyster growth.", "Oyster growth is reduced by habitat loss.", None, ""]
    chunks = [(r.choice("ab"), i, r.randrange(4), r.choice(pool), r.choice([0.1, 0.15, None])) for i in range(300)]
    df = spark.createDataFrame(chunks, "map_key string, doc_id long, chunk_no int, text string, score double").repartition(3)
    searched, matches = [], R.cue_matches
    monkeypatch.setattr(R, "cue_matches", lambda c, *more: searched.append(c.count()) or matches(c, *more))
    for limit in (None, 1):
        shown = lambda edges: sorted(map(tuple, edges.collect()), key=str)
        assert shown(R.merged_texts(df, evidence_limit=limit)) == shown(R.merge_mentions(R.mentions(df), limit)) != []
    assert searched == [len({(m, t, s) for m, _, _, t, s in chunks}), 300] * 2
