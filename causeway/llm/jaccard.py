"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word shingles. A set of a features and one of similarity g or
more differ in at most k = floor(a (1 - g)/g) features. The feature domain is partitioned by hash, as finely as the size
band asks, and a signature is a band, a subset of partitions and the hash of the set's features in it. A set signs for
its own band, and for the next if a partner may lie there; two sets meet in the band of the larger.

In bands of small sets all subsets are enumerated: of k + 2 partitions, k at most of which a difference touches, every
two. In larger bands a subset is a single partition (the enumeration's setting with the fewest signatures), and not all
are needed: partitions are ordered by what they hold, those with most rare features first. An equal partition has the
same place in the order of both sets' equal partitions, and at most k others can stand before the first, so every set
signs its first k + 1. Subsets without features are not signed. Two similar sets whose equal subsets are all without
features have both such subsets (or at most k partitions with features): sets of that kind sign single features, the
rarest k + 1, for each other, of which one is equal. So similar sets of a band always share a signature.

Partitions that hold frequent shingles alone would gather unrelated documents. Frequent shingles are found over all
documents; a set with more than k partitions that hold a rarer shingle signs the first k + 1 of those. Two sets without
(mostly copies of one another) sign their first k + 1 partitions for each other. Either way no pair is lost.

In a group of equal signatures every set is first compared with one other, the one that stands in most and largest
groups, so that copies meet their original and become components. Only pairs of different components are looked at
further, in tiles of bounded size, by sketches: the parities of the numbers of features in some buckets, whose distance
is never more than that of the sets. What the sketches leave is verified on the sets.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, fresh_names, materialize, sliced, whole_text

WORDS = 5
#: Similarity as a fraction.
SIMILAR = (3, 4)
#: Shingles count in a batch if so many sets of it hold them, and are frequent from so many in all batches. The list has a
#: bound, and any list gives the same pairs.
FREQUENT_BATCH, FREQUENT, FREQUENT_MOST = 2, 8, 300_000
BATCH_FEATURES = 4_000_000
#: Bands (by powers of two) in which every two partitions are a subset: sets of at most 15 features.
ENUMERATED = 4
#: Sets of a signature group that are compared in one tile.
TILE = 512
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: A-Z in lower case, words between ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if len(ids) < words:
        return mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64))
    total = ids[: len(ids) - words + 1] * _MULTIPLIERS[0]
    for i in range(1, words):
        total += ids[i : len(ids) - words + 1 + i] * (_MULTIPLIERS[i % len(_MULTIPLIERS)] + np.uint64(i << 1))
    return np.unique(mixed(total))


def allowed(size: int, similar=SIMILAR) -> int:
    """The most features in which a set of ``size`` can differ from a similar one (of at most size/g features)."""
    p, q = similar
    return size * (q - p) // p


class Frequent:
    """A sorted list of hashes with a quick test."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.bits = hashes, np.zeros(1 << 20, bool)
        self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def rare(self, features: np.ndarray) -> np.ndarray:
        """Which features are not in the list."""
        maybe = np.flatnonzero(self.bits[(features & np.uint64((1 << 20) - 1)).astype(np.int64)])
        out = np.ones(len(features), bool)
        if len(maybe):
            some = features[maybe]
            at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
            out[maybe] = self.hashes[at] != some
        return out


def bands(size: int, similar=SIMILAR) -> set[int]:
    """The size bands (by powers of two) in which a set may meet a partner: its own, and that of the largest partner."""
    p, q = similar
    return {size.bit_length(), (size * q // p).bit_length()}


@lru_cache(maxsize=16)
def _pairs(level: int, similar) -> np.ndarray:
    """Every two of the partitions of a band of small sets, as rows of booleans."""
    n = allowed((1 << level) - 1, similar) + 2
    return np.array([[i in pair for i in range(n)] for pair in combinations(range(n), 2)])


def signatures(features: np.ndarray, frequent: Frequent, similar=SIMILAR) -> list[np.ndarray]:
    """Signatures of a set (its sorted hashes): for each band those for all sets, then those that sets of a kind sign for each other.

    Beyond the enumerated bands the partition of a feature is its leading bits: half as many partitions as the band's
    largest size.
    """
    k, out = allowed(len(features), similar), []
    rare = frequent.rare(features).astype(np.int64)
    for level in bands(len(features), similar):
        if level <= ENUMERATED:
            pairs = _pairs(level, similar)
            part = (features >> np.uint64(33)).astype(np.int64) % pairs.shape[1]
            inside = pairs[:, part]
            content = (inside * features).sum(1, dtype=np.uint64)
            held = inside.any(1)
            number = np.arange(len(pairs), dtype=np.uint64)
            out.append(mixed(content + (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))[held])
            single = not held.all()
        else:
            part = features >> np.uint64(65 - level)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            part, content, count, held = part[first], np.add.reduceat(features, first), np.add.reduceat(rare, first), np.diff(first, append=len(features))
            sign = mixed(content + part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
            order = np.argsort(-count, kind="stable")
            strong = int((count > 0).sum())
            out.append(sign[order[: min(strong, k + 1)]])
            if strong <= k:
                out.append(mixed(sign[np.argsort(-held, kind="stable")[: k + 1]] ^ np.uint64(0xD6E8FEB86659FD93)))
            single = len(first) <= k
        if single:
            out.append(mixed(features[np.argsort(-rare, kind="stable")[: k + 1]] ^ np.uint64(0xC2B2AE3D27D4EB00 + level)))
    return out


def sketch_of(features: np.ndarray) -> np.ndarray:
    """Parities of the numbers of features by their low bits, in two to four times as many buckets as features; as 64-bit words."""
    buckets = 1 << max(6, len(features).bit_length() + 1)
    return np.packbits(np.bincount((features & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def halved(sketch: np.ndarray) -> np.ndarray:
    """The sketch, or sketches as rows, of half as many buckets."""
    n = sketch.shape[-1] // 2
    return sketch[..., :n] ^ sketch[..., n:]


def close(x: np.ndarray, y: np.ndarray, m: int, n: int, similar=SIMILAR) -> bool:
    """May sets of m and n features with these sketches be similar?"""
    p, q = similar
    while len(x) < len(y):
        y = halved(y)
    while len(y) < len(x):
        x = halved(x)
    return int(np.bitwise_count(x ^ y).sum()) * (q + p) <= (m + n) * (q - p)


def node_of(features: np.ndarray) -> int:
    """The identity of a set, a signed 64-bit hash of all its features."""
    return int(mixed(np.array([features.sum(dtype=np.uint64) + np.uint64(len(features))], np.uint64)).view(np.int64)[0])


SURVEY = ["doc_id", "node", "n", "sketch", "shingle", "count"]


def _surveyed(batches):
    """Rows (doc_id, node, n, sketch) of every document, and rows (shingle, count) of shingles that are frequent in a batch."""
    held, size = {}, 0

    def frequent():
        every, n = np.unique(np.concatenate([*held.values(), np.empty(0, np.uint64)]), return_counts=True)
        keep = n >= FREQUENT_BATCH
        return every[keep].view(np.int64), n[keep]

    kind = None
    for batch in sliced(batches):
        kind = batch.schema.field(0).type
        nodes, sizes, sketches = [], [], []
        for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            features = shingles(body)
            node = node_of(features) if len(features) and doc is not None else None
            nodes.append(node)
            sizes.append(len(features))
            sketches.append(sketch_of(features).tobytes() if node is not None else None)
            if node is not None and node not in held:
                held[node] = features
                size += len(features)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.int64())], names=SURVEY)
        if size > BATCH_FEATURES:
            values, n = frequent()
            held, size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.nulls(len(values), kind), pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.binary()), pa.array(values), pa.array(n)], names=SURVEY)
    if held:
        values, n = frequent()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(values), kind), pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.binary()), pa.array(values), pa.array(n)], names=SURVEY)


def _sign(shared, similar):
    def run(batches):
        frequent, done = Frequent(shared.value), set()
        for batch in sliced(batches):
            sigs, nodes, sizes = [], [], []
            for body in batch.column(0).to_pylist():
                features = shingles(body)
                if not len(features) or (node := node_of(features)) in done:
                    continue
                if len(done) < 200_000:
                    done.add(node)
                for sign in signatures(features, frequent, similar):
                    sigs.append(sign)
                    nodes.append(np.full(len(sign), node, np.int64))
                    sizes.append(np.full(len(sign), len(features), np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["sig", "node", "n"])

    return run


def _features(batches):
    """(node, features) of texts, one row a distinct set of a batch."""
    for batch in sliced(batches, 500):
        found = {}
        for body in batch.column(0).to_pylist():
            features = shingles(body)
            if len(features):
                found[node_of(features)] = features.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["node", "features"])


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, comp): the least node that the edges (a, b), and those that gave ``known``, reach from each of their nodes.

    Labels spread to neighbours and then jump to their labels' labels, so long chains shorten by halves; every round is
    written in the shared folder, and only the number of changes reaches the driver. Of the components ``known`` from
    earlier edges only those that the new edges join are labelled anew.
    """
    if known is not None:
        of = lambda name: known.select(F.col("node").alias(name), F.col("comp").alias(f"_{name}"))
        edges = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    both, n = counted(edges.where("a <> b").selectExpr("inline(array(struct(a, b), struct(b as a, a as b)))").distinct(), "links")
    if known is not None and not n:
        return known
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    changed = n
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after, changed = counted(lower.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"), "labels", F.col("comp") != F.col("old"))
        labels = after.select("node", "comp")
    if known is None:
        return labels
    moved = known.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return materialize(moved.unionByName(labels.join(known, "node", "left_anti")), "labels")


def _verify(pairs: DataFrame, features: DataFrame, similar) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; a set travels once for each pair it is compared in."""
    p, q = similar

    def run(batches):
        for batch in sliced(batches, 200):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(q * same >= p * (len(x) + len(y) - same))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = features.select(F.col("node").alias("a"), F.col("features").alias("fa"))
    right = features.select(F.col("node").alias("b"), F.col("features").alias("fb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def _sketched(pairs: DataFrame, sketches: DataFrame, similar) -> DataFrame:
    """The pairs (a, b) whose sketches allow similarity."""

    def run(batches):
        for batch in sliced(batches):
            good = [close(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), m, n, similar) for x, y, m, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("m"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), "n")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "m", "n").mapInArrow(run, "a long, b long")


def _resolve(similar):
    """Over rows (sig, tile, other, mine, node, n, comp, sketch) sorted by the first three: pairs of different components whose sketches allow similarity.

    A tile holds at most twice TILE rows; of two tiles only pairs across them are compared.
    """
    p, q = similar

    def compare(rows, seen):
        if len({r[3] for r in rows}) < 2:
            return
        rows.sort(key=lambda r: r[2])
        mine, node, n, comp = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        raw = [np.frombuffer(r[4], np.uint64) for r in rows]
        ends = np.searchsorted(n, q * n // p, "right")  # the first row that is too large for each
        across = len(set(mine.tolist())) > 1
        words = np.array([len(x) for x in raw])
        for length in sorted(set(words.tolist())):
            start, stop, beyond = (int(np.searchsorted(words, w)) for w in (length, length + 1, 2 * length + 1))
            level = np.stack([*raw[start:stop], *map(halved, raw[stop:beyond])])
            for i in range(start, min(stop, len(rows) - 1)):
                end = min(int(ends[i]), beyond)
                if end <= i + 1:
                    continue
                far = np.bitwise_count(level[i + 1 - start : end - start] ^ level[i - start]).sum(1, dtype=np.int64)
                good = (far * (q + p) <= (n[i] + n[i + 1 : end]) * (q - p)) & (comp[i + 1 : end] != comp[i]) & (node[i + 1 : end] != node[i])
                if across:
                    good &= mine[i + 1 : end] != mine[i]
                for j in (np.flatnonzero(good) + i + 1).tolist():
                    pair = (int(node[i]), int(node[j])) if node[i] < node[j] else (int(node[j]), int(node[i]))
                    if pair not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(pair)
                        yield pair

    def run(batches):
        seen, held, key = set(), [], None
        for batch in sliced(batches, 5000):
            out = []
            for sig, tile, other, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (sig, tile, other) != key:
                    out += compare(held, seen)
                    held, key = [], (sig, tile, other)
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = list(compare(held, seen))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", similar=SIMILAR, broadcast_ids: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that similarity links reach) of every row of ``df``.

    Texts without words, null ones included, have no shingles and are linked with nothing. Rows with equal sets are one
    node; so many copies cost no more than one. Every link between different sets is either verified or lies within a
    component that other verified links join. A row without an id is linked with nothing and has no component. The columns
    of ``df`` beside key and text are not read, so their names may clash with anything. An empty table gives no rows.
    """
    spark = df.sparkSession
    p, q = similar
    texts = df.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    survey = materialize(texts.mapInArrow(_surveyed, f"doc_id {kind}, node long, n long, sketch binary, shingle long, count long"), "survey")
    docs = survey.where("shingle is null").select("doc_id", "node", "n")
    often = survey.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST).collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64)))
    texts = texts.where("doc_id is not null")
    signed = texts.select("text").mapInArrow(_sign(frequent, similar), "sig long, node long, n int")
    # sets of a group that have another of fitting size beside them, when ordered by size
    near = signed.selectExpr("sig", "node", "n", "lag(struct(n, node)) over (partition by sig order by n, node) as before", "lead(struct(n, node)) over (partition by sig order by n, node) as after")
    near = near.where(f"({q} * before.n >= {p} * n and before.node <> node) or ({q} * n >= {p} * after.n and after.node <> node)").select("sig", "node", "n")
    members = materialize(near, "signature-groups")

    first = docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sketches = survey.where("node is not null").select("node", "n", "sketch").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sketches = materialize(sketches, "sketches")

    fits = lambda m, n: q * F.least(m, n) >= p * F.greatest(m, n)

    def verified(pairs: DataFrame, n: int) -> DataFrame:
        """Of ``n`` pairs those whose sets are similar; the sets of their nodes alone are made again."""
        if not n:
            return pairs
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        needed, n = counted(nodes.join(first, "node").select("doc_id"), "needed")
        needed = F.broadcast(needed) if n <= broadcast_ids else needed
        features = materialize(texts.join(needed, "doc_id", "left_semi").select("text").mapInArrow(_features, "node long, features binary"), "features").dropDuplicates(["node"])
        return materialize(_verify(pairs, features, similar), "verified")

    # hubs: nodes by how many others their groups hold
    sized = members.distinct().selectExpr("*", "count(*) over (partition by sig) as size")
    score = sized.groupBy("node").agg(F.sum("size").alias("score"))
    hubs = sized.join(score, "node").selectExpr("sig", "node", "n", "size", "score", "first_value(struct(score, node, n)) over (partition by sig order by score desc, node) as hub")
    hubs = materialize(hubs.selectExpr("sig", "node", "n", "size", "score", "hub.node as hub", "hub.n as m", "hub.score as hub_score"), "hubs")
    met = hubs.where((F.col("node") != F.col("hub")) & fits(F.col("n"), F.col("m")))
    pairs = met.groupBy(F.col("node").alias("b")).agg(F.max_by("hub", F.struct("hub_score", "hub")).alias("a")).select("a", "b")
    pairs, n = counted(_sketched(pairs, sketches, similar), "pairs")
    labels = components(verified(pairs, n))
    of = lambda name, comp: labels.select(F.col("node").alias(name), F.col("comp").alias(comp))
    apart = met.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct().join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    second, n = counted(_sketched(apart.join(pairs, ["a", "b"], "left_anti"), sketches, similar), "pairs")
    tried = pairs.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    labels = components(verified(second, n), labels)
    # every fitting pair with a hub has been looked at: a group needs two other nodes of different components
    grouped = hubs.where((F.col("size") > 2) & (F.col("node") != F.col("hub"))).select("sig", "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    grouped = grouped.selectExpr("*", "min(comp) over (partition by sig) as lo", "max(comp) over (partition by sig) as hi", "count(*) over (partition by sig) as size", "row_number() over (partition by sig order by n, node) as nth").where("lo <> hi")
    tiles = grouped.selectExpr("sig", "node", "comp", f"cast((nth - 1) div {TILE} as int) as mine", f"cast((size - 1) div {TILE} as int) as most").withColumn("with", F.explode(F.expr("sequence(0, most)")))
    tiles = tiles.selectExpr("sig", "least(mine, with) as tile", "greatest(mine, with) as other", "mine", "node", "comp").join(sketches, "node").select("sig", "tile", "other", "mine", "node", "n", "comp", "sketch")
    left = tiles.repartition("sig", "tile", "other").sortWithinPartitions("sig", "tile", "other").mapInArrow(_resolve(similar), "a long, b long").distinct()
    more = verified(*counted(left.join(tried, ["a", "b"], "left_anti"), "pairs"))
    labels = components(more, labels)

    comp = first.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "doc_id")
    least = comp.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = comp.join(least, "comp").select("node", "component_id")
    return docs.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", broadcast_ids: int = 2_000_000) -> DataFrame:
    """The rows of ``df``, with all their columns, that have the least id of their component.

    Rows with equal ids and texts count as one. Rows without an id stay. Up to ``broadcast_ids`` ids that go are sent to
    the tasks; beyond that the rows are shuffled by id.
    """
    found = materialize(classes(df, key, text), "classes")
    (name,) = fresh_names(df, "_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name))
    (gone, n), (twice, m) = counted(gone, "gone"), counted(twice, "twice")
    few = lambda ids, n: F.broadcast(ids) if n <= broadcast_ids else ids
    kept = df.join(few(gone, n), F.col(key) == F.col(name), "left_anti")
    if not m:
        return kept
    twice = few(twice, m)
    alone = kept.join(twice, F.col(key) == F.col(name), "left_anti")
    return alone.unionByName(kept.join(twice, F.col(key) == F.col(name), "left_semi").dropDuplicates([key, text]))
