import math
import random
from itertools import combinations

from paths import SMALL

from causeway.operators import central
from causeway.plans import queries


def frame(spark, rows):
    return spark.createDataFrame(rows, "map_key string, source string, target string")


def paths_between(s, t, out):
    """All shortest paths from s to t, by trying every walk a step longer until one arrives."""
    walks = [[s]]
    while walks:
        arrived = [w for w in walks if w[-1] == t]
        if arrived:
            return arrived
        walks = [[*w, x] for w in walks for x in out.get(w[-1], ()) if x not in w]
    return []


def brute(arcs):
    nodes = sorted({v for a in arcs for v in a})
    out = {}
    for s, t in sorted(set(arcs)):
        out.setdefault(s, []).append(t)
    found = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            ways = paths_between(s, t, out) if s != t else []
            for v in nodes:
                if ways and v not in (s, t):
                    found[v] += sum(v in w for w in ways) / len(ways)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in found.items()}


def random_arcs(rng, n, m):
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


def test_betweenness_equals_brute_force(spark):
    """Random maps with self loops and repeated arcs, a chain, a ring, two nodes; rows with nulls take no part; in one round and many."""
    rng = random.Random(5)
    maps = {f"m{i}": random_arcs(rng, rng.randint(3, 8), rng.randint(2, 16)) for i in range(25)}
    maps["chain"] = [(f"c{i}", f"c{i + 1}") for i in range(6)]
    maps["ring"] = [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)]
    maps["two"], maps["loop"] = [("a", "b")], [("a", "a")]
    rows = [(k, *a) for k, arcs in maps.items() for a in arcs] + [("m0", None, "x"), (None, "x", "y")]
    df = frame(spark, rows)
    for volume in (1 << 30, 400):
        got = {(r.map_key, r.concept): r.betweenness for r in central.betweenness(df, volume).collect()}
        want = {(k, v): x for k, arcs in maps.items() for v, x in brute(arcs).items()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_importance_of_a_known_graph(spark):
    arcs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e"), ("b", "e"), ("f", "a"), ("e", "a")]
    got = {r.concept: r for r in central.importance(frame(spark, [("m", *a) for a in arcs])).collect()}
    want = brute(arcs)
    assert all(math.isclose(got[v].betweenness, want[v], abs_tol=1e-12) for v in want)
    assert got["a"].degree == 4 / 5 and max(r.importance for r in got.values()) == 1.0


def test_empty_tables(spark):
    empty = frame(spark, [])
    for f in (central.betweenness, central.degree, central.importance, central.communities, central.greedy_modules):
        assert f(empty).count() == 0


def test_one_large_map_is_dealt_to_all_tasks(spark):
    """A single map of 150 nodes: no partition of the sums has more than half of the rows."""
    rng = random.Random(1)
    df = frame(spark, [("m", *a) for a in random_arcs(rng, 150, 600)])
    sizes = central.betweenness(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    arcs = central._arcs(df)
    starts = central._ends(arcs).distinct().withColumnRenamed("concept", "start")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        spread = [g.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() for g in central._levels(starts, arcs)[1:3]]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == len({v for r in df.collect() for v in (r.source, r.target)})
    assert all(max(x) <= sum(x) / 2 for x in spread)


def test_greedy_modules(spark):
    arcs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("a", "x")]
    want = {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1}
    assert central.merged_greedily("abcxyz", arcs) == want and central.merged_greedily("ab", []) == {"a": 0, "b": 1}
    df = frame(spark, [("m", *a) for a in arcs])
    for f in (central.greedy_modules, central.communities):
        assert {r.concept: r.module for r in f(df).collect()} == want


def known_graphs():
    rng = random.Random(9)
    graphs = {"star": [("hub", f"leaf{i}") for i in range(40)], "path": [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)], "loops": [("a", "a"), ("b", "b")]}
    graphs["cliques"] = [(f"{c}{i}", f"{c}{j}") for c in "uvwx" for i, j in combinations(range(6), 2)] + [("u0", "v0"), ("v1", "w1"), ("w2", "x2"), ("x3", "u3")]
    for k in range(12):
        groups = rng.randint(2, 5)
        graphs[f"planted{k}"] = [(f"g{a}.{rng.randrange(8)}", f"g{a if rng.random() < 0.8 else rng.randrange(groups)}.{rng.randrange(8)}") for a in (rng.randrange(groups) for _ in range(90))]
    return graphs


def test_communities_against_the_greedy_rule(spark):
    df = frame(spark, [(k, *a) for k, arcs in known_graphs().items() for a in arcs])
    mine = {r.map_key: r.modularity for r in central.modularity(df, central.communities(df)).collect()}
    greedy = {r.map_key: r.modularity for r in central.modularity(df, central.greedy_modules(df)).collect()}
    assert mine.keys() == greedy.keys() == known_graphs().keys() - {"loops"}
    assert all(mine[k] >= greedy[k] - 0.005 for k in mine) and sum(mine.values()) >= sum(greedy.values())


def test_communities_do_not_depend_on_partitions(spark):
    df = frame(spark, [(k, *a) for k, arcs in known_graphs().items() if k in ("loops", "planted2") for a in arcs])
    assert len({tuple(sorted(map(tuple, central.communities(df.repartition(n)).collect()))) for n in (1, 7)}) == 1


def test_no_python_in_the_plan(spark):
    plan = central.importance(queries.graph(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
