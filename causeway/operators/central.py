"""Centrality and communities of graphs of any size, as joins and sums over all tasks.

Every operator takes edges with map_key, source and target and works on all maps at once. Repeated edges count once; a row
with a null in one of the three takes no part; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .segments import numbered

#: pairs of a start and a node reached that one round of betweenness may hold, unless one start alone reaches more
VOLUME = 1 << 30


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select("map_key", "source", "target").dropna().distinct()


def _ends(arcs: DataFrame) -> DataFrame:
    """map_key, concept: a row an end of an arc."""
    return arcs.select("map_key", F.explode(F.array("source", "target")).alias("concept"))


def _levels(starts: DataFrame, arcs: DataFrame) -> list[DataFrame]:
    """map_key, start, v, paths of the nodes at distance 0, 1, 2, ... of each start, with the number of shortest paths there."""
    forward = arcs.select("map_key", F.col("source").alias("v"), F.col("target").alias("w"))
    levels = [written(starts.select("map_key", "start", F.col("start").alias("v"), F.lit(1.0).alias("paths")), "level")]
    while True:
        seen = reduce(DataFrame.unionAll, levels).select("map_key", "start", "v")
        reached = levels[-1].join(forward, ["map_key", "v"]).groupBy("map_key", "start", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        further = written(reached.join(seen, ["map_key", "start", "v"], "left_anti"), "level")
        if further.isEmpty():
            return levels
        levels.append(further)


def _shares(levels: list[DataFrame], arcs: DataFrame) -> DataFrame | None:
    """map_key, concept, between: over the starts of ``levels``, the shares of shortest paths that pass each node."""
    backward = arcs.select("map_key", F.col("target").alias("v"), F.col("source").alias("u"))
    state = levels[-1].withColumn("share", F.lit(0.0))
    passed = []
    for nearer in reversed(levels[1:-1]):
        rate = state.select("map_key", "start", "v", ((1 + F.col("share")) / F.col("paths")).alias("rate"))
        handed = rate.join(backward, ["map_key", "v"]).groupBy("map_key", "start", F.col("u").alias("v")).agg(F.sum("rate").alias("rate"))
        state = nearer.join(handed, ["map_key", "start", "v"], "left").select("map_key", "start", "v", "paths", (F.col("paths") * F.coalesce("rate", F.lit(0.0))).alias("share"))
        state = written(state, "shares")
        passed.append(state)
    if not passed:
        return None
    return written(reduce(DataFrame.unionAll, passed).groupBy("map_key", F.col("v").alias("concept")).agg(F.sum("share").alias("between")), "between")


def betweenness(edges: DataFrame, volume: int = VOLUME) -> DataFrame:
    """map_key, concept, betweenness: of the shortest directed paths between other nodes, the share through a node, over (n-1)(n-2).

    A search from every start steps through the graph a level at a time, all starts and maps together: a frontier joins the
    arcs, paths are summed, nodes met before go. Back from the last level, every node hands its share to the nodes before it.
    Starts are dealt by hash to as many rounds as keep the pairs of one within ``volume``; the rounds' sums add up. The
    number of jobs grows with the longest shortest path, the rows of a level with starts times nodes, over all tasks. Self
    loops lie on no shortest path; a map of one or two nodes has 0.
    """
    arcs = written(_arcs(edges), "arcs")
    nodes = written(_ends(arcs).distinct(), "nodes")
    sizes = nodes.groupBy("map_key").agg(F.count("*").cast("double").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    rounds = max(1, math.ceil(pairs / volume))
    sums = []
    for r in range(rounds):
        starts = nodes.where(F.pmod(F.xxhash64("map_key", "concept"), F.lit(rounds)) == r).withColumnRenamed("concept", "start")
        found = _shares(_levels(starts, arcs), arcs)
        if found is not None:
            sums.append(found)
    scaled = nodes.join(sizes, "map_key")
    if not sums:
        return scaled.select("map_key", "concept", F.lit(0.0).alias("betweenness"))
    total = reduce(DataFrame.unionAll, sums).groupBy("map_key", "concept").agg(F.sum("between").alias("between"))
    out_of = (F.col("n") - 1) * (F.col("n") - 2)
    return scaled.join(total, ["map_key", "concept"], "left").select("map_key", "concept", F.when(out_of > 0, F.coalesce("between", F.lit(0.0)) / out_of).otherwise(0.0).alias("betweenness"))


def degree(edges: DataFrame) -> DataFrame:
    """map_key, concept, degree: arcs in and out over n - 1 (a self loop is both)."""
    counts = _ends(_arcs(edges)).groupBy("map_key", "concept").agg(F.count("*").alias("ends"))
    sizes = counts.groupBy("map_key").agg(F.count("*").alias("n"))
    return counts.join(sizes, "map_key").select("map_key", "concept", (F.col("ends") / F.greatest(F.lit(1), F.col("n") - 1)).alias("degree"))


def importance(edges: DataFrame) -> DataFrame:
    """map_key, concept, betweenness, degree, importance (0.55 b + 0.45 d over the largest of the map)."""
    raw = betweenness(edges).join(degree(edges), ["map_key", "concept"]).withColumn("raw", 0.55 * F.col("betweenness") + 0.45 * F.col("degree"))
    raw = written(raw, "importance")
    top = raw.groupBy("map_key").agg(F.max("raw").alias("top"))
    return raw.join(top, "map_key").select("map_key", "concept", "betweenness", "degree", (F.col("raw") / F.col("top")).alias("importance"))


def _links(edges: DataFrame) -> DataFrame:
    """map_key, a, b with a < b: the undirected links, self loops left out."""
    return edges.select("map_key", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") == F.col("target")).alias("loop")).dropna().where("not loop").select("map_key", "a", "b").distinct()


def _ends_of(base: DataFrame) -> DataFrame:
    """map_key, v, u: every link from both of its ends."""
    return base.select("map_key", F.col("a").alias("v"), F.col("b").alias("u")).unionAll(base.select("map_key", F.col("b").alias("v"), F.col("a").alias("u")))


def _moved(df: DataFrame, at: str, moves: DataFrame) -> DataFrame:
    """``df`` with the communities of column ``at`` replaced as ``moves`` (map_key, c, into) say."""
    return df.join(moves.select("map_key", F.col("c").alias(at), "into"), ["map_key", at], "left").withColumn(at, F.coalesce("into", at)).drop("into")


def _joins(links: DataFrame, degrees: DataFrame, totals: DataFrame) -> DataFrame:
    """map_key, c, into: the communities that join another in one round; their gains hold together."""
    end = lambda x: degrees.select("map_key", F.col("c").alias(x), F.col("d").alias(f"d{x}"))
    m = F.col("m")
    gains = links.join(end("a"), ["map_key", "a"]).join(end("b"), ["map_key", "b"]).join(totals, "map_key")
    gains = gains.withColumn("gain", F.round(F.col("n") / m - F.col("da") * F.col("db") / (2 * m * m), 12))
    # one order over a map's links, the same seen from both ends; hashes part ties, so that long rows of ties pair up at once
    order = F.struct((-F.col("gain")).alias("g"), F.xxhash64("a", "b").alias("h"), "a", "b")
    sided = lambda x, y: gains.select("map_key", F.col(x).alias("c"), "gain", F.struct(order.alias("o"), F.col(y).alias("to"), F.col("n").alias("n"), F.col(f"d{x}").alias("d"), F.col(f"d{y}").alias("dto"), "m").alias("e"))
    best = sided("a", "b").unionAll(sided("b", "a")).groupBy("map_key", "c").agg(F.min(F.when(F.col("gain") > 0, F.col("e"))).alias("e"), F.count("*").alias("near"))
    best = written(best.where("e is not null").select("map_key", "c", "near", "e.to", "e.n", "e.d", "e.dto", "e.m"), "best")
    mutual = best.join(best.select("map_key", F.col("c").alias("to"), F.col("to").alias("c")), ["map_key", "c", "to"])
    # of a pair that choose each other, the one of more ends is the centre
    pairs = mutual.where((F.col("dto") > F.col("d")) | (F.col("dto") == F.col("d")) & (F.col("to") < F.col("c"))).select("map_key", F.col("to"), F.col("c").alias("partner"))
    suitors = best.join(pairs, ["map_key", "to"]).where((F.col("c") == F.col("partner")) | (F.col("near") == 1))
    wanted = suitors.groupBy("map_key", "to").agg(F.sum("d").alias("all"))
    still = F.col("n") / m - (F.col("dto") + F.col("all") - F.col("d")) * F.col("d") / (2 * m * m)
    return suitors.join(wanted, ["map_key", "to"]).where((F.col("c") == F.col("partner")) | (still > 1e-12)).select("map_key", "c", F.col("to").alias("into"))


def _joined(home: DataFrame, base: DataFrame, totals: DataFrame) -> tuple[DataFrame, bool]:
    """``home`` after joining communities until no two gain, and whether any joined."""
    place = lambda x: home.select("map_key", F.col("concept").alias(x), F.col("c").alias(f"c{x}"))
    placed = written(base.join(place("a"), ["map_key", "a"]).join(place("b"), ["map_key", "b"]).select("map_key", "ca", "cb"), "links")
    degrees = written(placed.select("map_key", F.explode(F.array("ca", "cb")).alias("c")).groupBy("map_key", "c").agg(F.count("*").cast("double").alias("d")), "degrees")
    links = placed.where("ca <> cb").groupBy("map_key", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n"))
    links, changed = written(links, "links"), False
    while not (moves := written(_joins(links, degrees, totals), "moves")).isEmpty():
        changed = True
        home = written(_moved(home, "c", moves), "home")
        between = _moved(_moved(links, "a", moves), "b", moves).where("a <> b")
        links = written(between.groupBy("map_key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n")), "links")
        degrees = written(_moved(degrees, "c", moves).groupBy("map_key", "c").agg(F.sum("d").alias("d")), "degrees")
    return home, changed


def _settled(home: DataFrame, base: DataFrame, totals: DataFrame) -> tuple[DataFrame, bool]:
    """``home`` after moving single nodes until none gains, and whether any moved.

    Of linked nodes that would move, the first decides. Nodes that gain even if all others of their two communities move as
    they wish go together; a map that has none moves those that are the first of both communities that they touch.
    """
    both = written(_ends_of(base), "both")
    own = written(both.groupBy("map_key", "v").agg(F.count("*").cast("double").alias("dv")), "degrees")
    m, changed = F.col("m"), False
    while True:
        here = home.select("map_key", F.col("concept").alias("v"), F.col("c").alias("cv"))
        weights = written(own.join(here, ["map_key", "v"]).groupBy("map_key", F.col("cv").alias("c")).agg(F.sum("dv").alias("d")), "weights")
        near = both.join(home.select("map_key", F.col("concept").alias("u"), "c"), ["map_key", "u"]).groupBy("map_key", "v", "c").agg(F.count("*").alias("k"))
        near = near.join(weights, ["map_key", "c"]).join(here, ["map_key", "v"])
        inside = near.where("c = cv").select("map_key", "v", F.col("k").alias("kin"))
        left = weights.select("map_key", F.col("c").alias("cv"), F.col("d").alias("din"))
        could = near.where("c <> cv").join(inside, ["map_key", "v"], "left").join(left, ["map_key", "cv"]).join(own, ["map_key", "v"]).join(totals, "map_key")
        links = (F.col("k") - F.coalesce("kin", F.lit(0))) / m
        gain = F.round(links - (F.col("d") - F.col("din") + F.col("dv")) * F.col("dv") / (2 * m * m), 12)
        order = F.struct((-gain).alias("g"), F.xxhash64("v", "c").alias("h"), "v", "c")
        wish = could.where(gain > 0).groupBy("map_key", "v").agg(F.min(F.struct(order.alias("o"), F.col("cv").alias("out"), F.col("c").alias("into"), links.alias("links"), "d", "din", "dv", "m")).alias("w"))
        wish = written(wish.select("map_key", "v", "w.*"), "wishes")
        if wish.isEmpty():
            return home, changed
        changed = True
        rivals = both.join(wish.select("map_key", F.col("v").alias("u"), F.col("o").alias("rival")), ["map_key", "u"]).groupBy("map_key", "v").agg(F.min("rival").alias("rival"))
        free = written(wish.join(rivals, ["map_key", "v"], "left").where("rival is null or o < rival").drop("rival"), "free")
        sums = free.groupBy("map_key", F.col("into").alias("into")).agg(F.sum("dv").alias("enter"))
        gone = free.groupBy("map_key", F.col("out").alias("out")).agg(F.sum("dv").alias("leave"))
        worst = F.col("links") - (F.col("d") + F.col("enter") - (F.col("din") - F.col("leave")) - F.col("dv")) * F.col("dv") / (2 * m * m)
        sure = written(free.join(sums, ["map_key", "into"]).join(gone, ["map_key", "out"]).where(worst > 1e-12).select("map_key", "v", "into"), "sure")
        touched = free.select("map_key", F.explode(F.array("out", "into")).alias("c"), "o").groupBy("map_key", "c").agg(F.min("o").alias("o"))
        first = lambda x: touched.select("map_key", F.col("c").alias(x), "o")
        lone = free.join(first("out"), ["map_key", "out", "o"]).join(first("into"), ["map_key", "into", "o"]).join(sure.select("map_key").distinct(), "map_key", "left_anti").select("map_key", "v", "into")
        moves = sure.unionAll(lone).withColumnRenamed("v", "concept")
        home = written(home.join(moves, ["map_key", "concept"], "left").select("map_key", "concept", F.coalesce("into", "c").alias("c")), "home")


def communities(edges: DataFrame) -> DataFrame:
    """J15 for graphs of any size: map_key, concept, module, by rounds of joins that each raise the modularity.

    Communities join: each chooses the neighbour that it would gain most with; where two choose each other they join, and
    with them those that chose the one of more ends and have no other neighbour, if they gain even after all who ask have
    joined. When no two gain, single nodes move to the linked community where they gain most, then communities join again,
    until neither changes anything. All choices follow total orders, so the layout of rows changes nothing. The undirected
    links count once, without weights. Modules are numbered by size, then by their first name.
    """
    arcs = written(_arcs(edges), "arcs")
    base = written(_links(arcs), "base")
    totals = written(base.groupBy("map_key").agg(F.count("*").cast("double").alias("m")), "totals")
    home, changed = _joined(written(_ends(arcs).distinct().withColumn("c", F.col("concept")), "home"), base, totals)
    while changed:
        home, changed = _settled(home, base, totals)
        if changed:
            home, changed = _joined(home, base, totals)
    sizes = home.groupBy("map_key", "c").agg(F.count("*").alias("size"), F.min("concept").alias("first"))
    modules = numbered(sizes, ["map_key"], [F.col("size").desc(), F.col("first")], "module").select("map_key", "c", F.col("module").cast("int").alias("module"))
    return home.join(modules, ["map_key", "c"]).select("map_key", "concept", "module")


def modularity(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """map_key, modularity of the modules (map_key, concept, module) on the undirected links; maps without links have no row."""
    links = _links(edges)
    end = lambda x: modules.select("map_key", F.col("concept").alias(x), F.col("module").alias(f"m{x}"))
    placed = links.join(end("a"), ["map_key", "a"]).join(end("b"), ["map_key", "b"])
    sided = placed.select("map_key", F.explode(F.array("ma", "mb")).alias("module"), F.when(F.col("ma") == F.col("mb"), 0.5).otherwise(0.0).alias("inner"))
    sums = sided.groupBy("map_key", "module").agg(F.sum("inner").alias("inner"), F.count("*").alias("d"))
    m = F.sum("d") / 2
    return sums.groupBy("map_key").agg((F.sum("inner") / m - F.sum(F.col("d") * F.col("d")) / (4 * m * m)).alias("modularity"))


def greedy_modules(edges: DataFrame) -> DataFrame:
    """map_key, concept, module by the greedy rule, a step a merge (:func:`merged_greedily`).

    One task a map: for maps of the few edges that ranking leaves. :func:`communities` has no such bound.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        arcs = sorted(set(zip(group["source"], group["target"])))
        found = merged_greedily(sorted({v for a in arcs for v in a}), arcs)
        return pd.DataFrame({"map_key": group["map_key"].iloc[0], "concept": list(found), "module": list(found.values())})

    kind = edges.schema["map_key"].dataType.simpleString()
    return _arcs(edges).groupBy("map_key").applyInPandas(run, f"map_key {kind}, concept string, module int")


def merged_greedily(nodes: list, arcs: list) -> dict:
    """Greedy modularity on the undirected unweighted graph: repeatedly join the two communities that gain most.

    Communities are numbered by size, then by their first name; equal gains are taken in lexical order.
    """
    links = {tuple(sorted(a)) for a in arcs if a[0] != a[1]}
    m = len(links)
    group = {v: [v] for v in sorted(nodes)}
    if m:
        home, degree, between = {v: v for v in nodes}, dict.fromkeys(nodes, 0), {}
        for a, b in links:
            degree[a] += 1
            degree[b] += 1
            between[a, b] = between.get((a, b), 0) + 1
        while between:
            gain, pair = max(((n / m - degree[a] * degree[b] / (2 * m * m), (a, b)) for (a, b), n in between.items()), key=lambda x: (round(x[0], 12), [-ord(c) for c in x[1][0] + "\0" + x[1][1]]))
            if gain <= 0:
                break
            a, b = pair
            group[a] += group.pop(b)
            degree[a] += degree.pop(b)
            joined = {}
            for (x, y), n in between.items():
                x, y = sorted((a if x == b else x, a if y == b else y))
                if x != y:
                    joined[x, y] = joined.get((x, y), 0) + n
            between = joined
            home.update((v, a) for v in group[a])
    ordered = sorted(group.values(), key=lambda g: (-len(g), min(g)))
    return {v: i for i, g in enumerate(ordered) for v in g}
