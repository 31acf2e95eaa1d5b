"""Causal relations from text: patterns (J6), co-occurrence (J7) and two-hop inference.

All functions work on many maps at once, keyed by ``map_key``. Edges have the columns of EDGE; ``seen`` orders edges by
their first mention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import DEFAULT, Lexicon
from ..shared import written
from .segments import numbered, spread

EDGE = ["map_key", "source", "target", "weight", "polarity", "confidence", "evidence", "evidence_doc_id", "edge_type", "hops", "seen"]


def sentence_rows(chunks: DataFrame, also: tuple = ()) -> DataFrame:
    """map_key, doc_id, chunk_no, sent_no, score, sentence (I1) of chunks (map_key, doc_id, chunk_no, text, score), and the columns ``also``."""
    return chunks.select("map_key", "doc_id", "chunk_no", *also, F.coalesce(F.col("score"), F.lit(0.0)).alias("score"), F.posexplode(T.sentences("text")).alias("sent_no", "sentence"))


MATCH = "array<struct<cue:int,nth:int,base:double,span:string,cause:string,effect:string>>"


def _match(cue: int, weight: float, cause: str, effect: str):
    return lambda z, i: F.struct(F.lit(cue).alias("cue"), i.alias("nth"), F.lit(weight).alias("base"), z["span"].alias("span"), z[cause].alias("cause"), z[effect].alias("effect"))


def cue_matches(chunks: DataFrame, lexicon: Lexicon = DEFAULT, also: tuple = ()) -> DataFrame:
    """Every match of every cue (I2): sentence columns, cue, nth, base, span and the operands' texts, over all cores."""
    found = []
    for n, (cue, weight, reversed_) in enumerate(lexicon.cues):
        pattern = F.lit(rf"(?i){T.FIRST}\s+{cue}\s+{T.LAST}")
        parts = F.arrays_zip(*(F.regexp_extract_all("sentence", pattern, F.lit(g)).alias(name) for g, name in enumerate(("span", "one", "two"))))
        cause, effect = ("two", "one") if reversed_ else ("one", "two")
        # operands are sought only where the cue stands: the patterns backtrack over every word
        found.append(F.when(F.col("sentence").rlike(rf"(?i)\s{cue}\s"), F.transform(parts, _match(n, float(weight), cause, effect))).otherwise(F.array().cast(MATCH)))
    return sentence_rows(spread(chunks), also).withColumn("m", F.explode(F.concat(*found))).select("*", "m.*").drop("m")


def operands(matches: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """phrase, concept, lemma, words of every distinct operand that is a clean concept (I3, I5, I6): each is judged once."""
    phrases = spread(matches.select(F.explode(F.array("cause", "effect")).alias("phrase")).distinct())
    named = T.with_concepts(phrases, lexicon, concept="phrase").where((F.col("concept") != "") & T.clean_concept("concept", lexicon))
    return named.select("phrase", "concept", T.lemma_key("concept", lexicon).alias("lemma"), F.split(F.lower("concept"), " ").alias("words"))


#: Bytes of operands that are sent to every task; more are joined in a shuffle.
BROADCAST_BYTES = 16 << 20


def mentions(chunks: DataFrame, lexicon: Lexicon = DEFAULT, broadcast_bytes: int = BROADCAST_BYTES, also: tuple = ()) -> DataFrame:
    """Every valid match of every cue (I2, I7, I8, B14): one row a mention, with its weight and confidence and the chunks' columns ``also``.

    Matches are written once and their operands judged once each, however many mentions they have.
    """
    matches = written(cue_matches(chunks, lexicon, also), "cue-matches")
    names = written(operands(matches, lexicon), "operands")
    size = names.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("concept") * 3 + 64), F.lit(0))).first()[0]
    names = F.broadcast(names) if size <= broadcast_bytes else names
    of = lambda side, name: names.select(F.col("phrase").alias(side), F.col("concept").alias(name), F.col("lemma").alias(f"{name}_lemma"), F.col("words").alias(f"{name}_words"))
    rows = matches.join(of("cause", "source"), "cause").join(of("effect", "target"), "effect")
    apart = (F.size(F.array_except("source_words", "target_words")) > 0) & (F.size(F.array_except("target_words", "source_words")) > 0)
    rows = rows.where((F.col("source_lemma") != F.col("target_lemma")) & apart)
    rows = rows.withColumn("weight", T.modulated("base", "span", lexicon)).where(F.abs("weight") >= 0.10)
    return rows.select(
        "map_key", "source", "target", "weight", F.least(F.lit(0.95), F.col("score") + 0.55).alias("confidence"), F.trim("sentence").alias("evidence"),
        F.col("doc_id").cast("string").alias("evidence_doc_id"), F.struct("chunk_no", "sent_no", "cue", "nth").alias("at"), *also,
    )


def boost(distinct):
    """0.03 for each further distinct sentence, 0.15 at most."""
    return F.least(F.lit(0.15), 0.03 * F.greatest(F.lit(0), distinct - 1))


def said_rows(rows: DataFrame) -> DataFrame:
    """map_key, source, target, evidence, at: every distinct sentence of every edge and its first place."""
    return rows.groupBy("map_key", "source", "target", "evidence").agg(F.min("at").alias("at"))


def evidence_rows(rows: DataFrame) -> DataFrame:
    """map_key, source, target, nth, evidence: every distinct sentence of every edge, the earliest first (from 1), ties by text."""
    return said_rows(rows).selectExpr("map_key", "source", "target", "row_number() over (partition by map_key, source, target order by at, evidence) as nth", "evidence")


def partial_sums(rows: DataFrame, times: str | None = None) -> DataFrame:
    """map_key, source, target, wc, c, n, first of mentions: sums that add up, in twelve places, and the earliest mention.

    ``times`` names the column that says how many mentions a row stands for: the places of each are cut before they are added.
    """
    each = lambda c: c.cast("decimal(28,12)")
    place = lambda c: (each(c) * F.col(times).cast("decimal(10,0)")).cast("decimal(28,12)") if times else each(c)
    return rows.groupBy("map_key", "source", "target").agg(F.sum(place(F.col("weight") * F.col("confidence"))).alias("wc"), F.sum(place(F.col("confidence"))).alias("c"), (F.sum(times) if times else F.count("*")).alias("n"), F.min(F.struct("at", "evidence_doc_id")).alias("first"))


def added_sums(sums: DataFrame) -> DataFrame:
    """The sums of several parts of :func:`partial_sums` as one."""
    return sums.groupBy("map_key", "source", "target").agg(*(F.sum(c).alias(c) for c in ("wc", "c", "n")), F.min("first").alias("first"))


def edges_of(numbers: DataFrame, said: DataFrame, evidence_limit: int | None = None) -> DataFrame:
    """Edges from the sums of their mentions and their distinct sentences (:func:`said_rows`)."""
    keys = ["map_key", "source", "target"]
    said = said.withColumn("distinct_n", F.lit(1))
    if evidence_limit is not None:
        window = "partition by map_key, source, target"
        said = said.selectExpr("* except (distinct_n)", f"row_number() over ({window} order by at, evidence) as nth", f"count(*) over ({window}) as every").where(F.col("nth") <= evidence_limit).withColumn("distinct_n", F.when(F.col("nth") == 1, F.col("every")).otherwise(0))
    said = said.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence"))), lambda x: x["evidence"]), " | ").alias("evidence"), F.sum("distinct_n").alias("distinct_n"))
    wc, c, at = F.col("wc").cast("double"), F.col("c").cast("double"), F.col("first.at")
    mean = wc / c
    return numbers.join(said, keys).select(
        *keys, T.rounded(mean, 3).alias("weight"), F.when(mean >= 0, "positive").otherwise("negative").alias("polarity"),
        T.rounded(F.least(F.lit(0.98), c / F.col("n") + boost(F.col("distinct_n"))), 3).alias("confidence"), "evidence", F.col("first.evidence_doc_id").alias("evidence_doc_id"),
        F.lit("pattern").alias("edge_type"), F.lit(1).alias("hops"), F.concat_ws(".", F.lit("p"), F.format_string("%09d.%06d.%02d.%04d", at["chunk_no"], at["sent_no"], at["cue"], at["nth"])).alias("seen"),
    )


def merge_mentions(rows: DataFrame, evidence_limit: int | None = None) -> DataFrame:
    """One edge for each (source, target) of a map; weights by confidence, distinct sentences raise confidence.

    ``evidence`` joins all distinct sentences; for display, ``evidence_limit`` keeps the earliest. :func:`evidence_rows` has
    them a row each.
    """
    return edges_of(partial_sums(rows), said_rows(rows), evidence_limit)


def same_texts(chunks: DataFrame) -> DataFrame:
    """map_key, text, score, times, chunk_no, doc_id: the different texts of a map, how often they stand there and where first."""
    place = F.min(F.struct("chunk_no", F.col("doc_id").cast("string").alias("doc_id"))).alias("p")
    return chunks.groupBy("map_key", "text", "score").agg(F.count("*").alias("times"), place).select("map_key", "text", "score", "times", "p.*")


def merged_texts(chunks: DataFrame, lexicon: Lexicon = DEFAULT, evidence_limit: int | None = None) -> DataFrame:
    """The edges that :func:`merge_mentions` makes of :func:`mentions`, with the cues of equal texts of a map sought once.

    Texts are added up where they are read before they meet, so it pays where texts come again; else they travel once more.
    """
    rows = mentions(same_texts(chunks), lexicon, also=("times",))
    return edges_of(partial_sums(rows, "times"), said_rows(rows), evidence_limit)


def keyword_rows(chunks: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """map_key, pos, sentence, polarity, keywords of every sentence that is not blank; ``pos`` counts through a map.

    Sentences are in order of chunk, document and place, and numbered in blocks, so one map may be the whole corpus. Only
    sentences with keywords carry their text; others are there for their place and polarity, and have null.
    """
    rows = sentence_rows(spread(chunks)).where(F.trim("sentence") != "").select("map_key", "chunk_no", "doc_id", "sent_no", "sentence")
    raw = F.array_distinct(F.transform(F.regexp_extract_all("sentence", F.lit("(?i)" + lexicon.domain), F.lit(0)), lambda x: T.normalized_concept(x, lexicon)))
    good = F.filter(F.filter(raw, lambda k: (k != "") & (k.contains(" ") | (F.length(k) >= 6))), lambda k: T.clean_concept(k, lexicon))
    rows = rows.withColumns({"polarity": T.sentence_polarity("sentence", lexicon).cast("byte"), "keywords": good})
    rows = rows.withColumn("sentence", F.when(F.size("keywords") > 0, F.trim("sentence")))
    return numbered(rows, ["map_key"], [F.col("chunk_no"), F.col("doc_id"), F.col("sent_no")], "pos").select("map_key", "pos", "sentence", "polarity", "keywords")


#: Sentences of a map that one window covers; the next block's first ones come as a halo.
SPAN = 4096


def window_pairs(rows: DataFrame, window: int = 3, span: int = SPAN) -> DataFrame:
    """Hits (map_key, source, target, pos, offset, negative, proximity, evidence) within ``window`` sentences.

    A band join as an equi-join on the sentence number. Polarity is sticky: negative if any sentence from the anchor on is.
    Windows run over blocks of ``span`` numbers of a map, each with the ``window - 1`` sentences that follow it.
    """
    block = F.floor(F.col("pos") / span)
    blocks = F.when((F.col("pos") % span < window - 1) & (window > 1), F.array(block - 1, block)).otherwise(F.array(block))
    dealt = rows.withColumn("_block", F.explode(blocks))
    frame = "min(polarity) over (partition by map_key, _block order by pos range between current row and {} following)"
    ahead = ", ".join(["polarity", *(frame.format(o) for o in range(1, window))])
    anchors = dealt.selectExpr("map_key", "pos", "sentence", "keywords", "_block", f"array({ahead}) as ahead").where((F.size("keywords") > 0) & (F.col("_block") == block)).drop("_block")
    anchors = anchors.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("at", F.col("pos") + F.col("offset"))
    near = rows.where("size(keywords) > 0").select("map_key", F.col("pos").alias("at"), F.col("keywords").alias("others"))
    hits = anchors.join(near, ["map_key", "at"]).withColumn("source", F.explode("keywords")).withColumn("target", F.explode("others"))
    hits = hits.where((F.col("source") != F.col("target")) & ((F.col("offset") > 0) | (F.col("source") < F.col("target"))))
    return hits.select("map_key", "source", "target", "pos", "offset", (F.get("ahead", F.col("offset")) < 0).alias("negative"), (1.0 / (1 + F.col("offset"))).alias("proximity"), F.col("sentence").alias("evidence"))


def cooccurrence(chunks: DataFrame, lexicon: Lexicon = DEFAULT, window: int = 3, cap: int = 25) -> DataFrame:
    """Edges between domain keywords near each other (E4 to E6, G4, I10); ties of the cap by name.

    The first two sentences of a pair and the first ``cap`` pairs of a map are chosen where they are before they meet.
    """
    keys = ["map_key", "source", "target"]
    hits = written(window_pairs(keyword_rows(chunks, lexicon), window), "keyword-pairs")
    sums = hits.groupBy(*keys).agg(T.exact_sum(F.when(F.col("negative"), F.col("proximity")).otherwise(0.0)).alias("neg"), T.exact_sum(F.when(F.col("negative"), 0.0).otherwise(F.col("proximity"))).alias("pos"), F.min(F.struct("pos", "offset")).alias("at"))
    sums = sums.withColumn("count", F.col("pos") + F.col("neg"))
    first = sums.selectExpr("*", "row_number() over (partition by map_key order by count desc, source, target) as nth").where(F.col("nth") <= cap)
    ranked = first.selectExpr("*", "max(count) over (partition by map_key) as top")  # the greatest count is among the first
    kept = ranked.where((F.col("count") >= 0.5) | (F.col("top") < 0.5) & (F.col("nth") <= 8))
    size = 0.3 + 0.4 * F.col("count") / F.col("top")
    kept = kept.withColumn("weight", T.rounded(F.when(F.col("neg") > F.col("pos"), -size).otherwise(size), 3)).where((F.abs("weight") >= 0.10) & T.valid_pair("source", "target", lexicon))
    said = hits.join(kept.select(*keys), keys, "left_semi").selectExpr(*keys, "pos", "offset", "evidence", "row_number() over (partition by map_key, source, target order by pos, offset) as nth").where("nth <= 2")
    said = said.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "offset", "evidence"))), lambda x: x["evidence"]), " || ").alias("evidence"))
    return kept.join(said, keys).select(
        *keys, "weight", F.when(F.col("neg") > F.col("pos"), "negative").otherwise("positive").alias("polarity"), F.lit(0.40).alias("confidence"), "evidence", F.lit(None).cast("string").alias("evidence_doc_id"),
        F.lit("cooccurrence").alias("edge_type"), F.lit(1).alias("hops"), F.format_string("q.%09d.%d.%s", F.col("at.pos"), F.col("at.offset"), F.col("source")).alias("seen"),
    )


def append_absent(edges: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` without the pairs that ``edges`` has, below ``edges``."""
    return edges.unionByName(more.join(edges.select("map_key", "source", "target"), ["map_key", "source", "target"], "left_anti"))


def two_hops(edges: DataFrame, lexicon: Lexicon = DEFAULT, damping: float = 0.7, floor: float = 0.20, cap: int = 20, valid: bool = True) -> DataFrame:
    """A->c from a->b and b->c where no edge a->c is; the strongest chain, the first on ties."""
    one = edges.select("map_key", F.col("source"), F.col("target").alias("via"), F.col("weight").alias("w1"), F.col("confidence").alias("c1"), F.col("evidence").alias("e1"), F.col("seen").alias("s1"))
    two = edges.select("map_key", F.col("source").alias("via"), F.col("target"), F.col("weight").alias("w2"), F.col("confidence").alias("c2"), F.col("evidence").alias("e2"), F.col("seen").alias("s2"))
    chains = one.join(two, ["map_key", "via"]).where("source <> target").withColumn("w", damping * F.col("w1") * F.col("w2")).where(F.abs("w") >= floor)
    chains = chains.withColumn("c", damping * F.least("c1", "c2")).join(edges.select("map_key", "source", "target"), ["map_key", "source", "target"], "left_anti")
    if valid:
        chains = chains.where(T.valid_pair("source", "target", lexicon))
    best = chains.selectExpr("*", "row_number() over (partition by map_key, source, target order by abs(w) desc, s1, s2, via) as nth").where("nth = 1").drop("nth")
    best = best.selectExpr("*", "row_number() over (partition by map_key order by abs(w) * c desc, source, target) as nth").where(F.col("nth") <= cap)
    return best.select(
        "map_key", "source", "target", T.rounded("w", 3).alias("weight"), F.when(F.col("w") >= 0, "positive").otherwise("negative").alias("polarity"), T.rounded("c", 3).alias("confidence"),
        F.concat(F.lit("inferred via "), "via", F.lit(" :: "), "e1", F.lit(" → "), "e2").alias("evidence"), F.lit(None).cast("string").alias("evidence_doc_id"), F.lit("transitive").alias("edge_type"), F.lit(2).alias("hops"), F.format_string("t.%04d", "nth").alias("seen"),
    )


def ranked(edges: DataFrame, interleaved: bool = False, segmented: bool = False) -> DataFrame:
    """G1, F1 and, if asked for, G3: ``rank`` within each map by confidence x |weight|; ties by name.

    Interleaved, two positive edges alternate with one negative where a map has both signs. ``segmented`` numbers the edges in
    blocks, for maps too large for one task; a filter on the first ranks needs none, as each task keeps its first ones.
    """
    score = F.expr("confidence * abs(weight)")
    if segmented:
        order = [score.desc(), F.col("source"), F.col("target")]
        if not interleaved:
            return numbered(edges, ["map_key"], order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
        by_sign = numbered(edges.withColumn("sign", F.col("weight") >= 0), ["map_key", "sign"], order, "r")
        every = edges.groupBy("map_key").agg(F.count_if(F.col("weight") >= 0).alias("ups"), F.count_if(F.col("weight") < 0).alias("downs"))
        # before the r-th of a sign stand all of the other sign whose slots are less: two up, one down, in turn
        found = by_sign.join(every.withColumnRenamed("map_key", "_m"), F.col("map_key").eqNullSafe(F.col("_m"))).drop("_m")
        return found.withColumn("rank", F.expr("cast(1 + r + case when sign then least(downs, r div 2) else least(ups, 2 * r + 2) end as int)")).drop("sign", "r", "ups", "downs")
    order = "partition by map_key{} order by confidence * abs(weight) desc, source, target"
    if not interleaved:
        return edges.selectExpr("*", f"row_number() over ({order.format('')}) as rank")
    by_sign = edges.selectExpr("*", f"row_number() over ({order.format(', weight >= 0')}) - 1 as r")
    spread_out = by_sign.selectExpr("* except (r)", "case when weight >= 0 then (r div 2) * 3 + r % 2 else r * 3 + 2 end as slot")
    return spread_out.selectExpr("* except (slot)", "row_number() over (partition by map_key order by slot) as rank")


def tiered(edges: DataFrame, limit: int = 6, threshold: float = 0.20, least: int = 5) -> DataFrame:
    """Pattern edges first, then by score; edges under the threshold go unless fewer than ``least`` stay.

    With a ``limit`` each task keeps its first edges of a map before they meet.
    """
    sizes = edges.groupBy("map_key").agg(F.count_if(F.abs("weight") >= threshold).alias("_good"), F.count("*").alias("_every")).select(F.col("map_key").alias("_m"), (F.col("_good") < F.least(F.lit(least), F.col("_every"))).alias("_few"))
    met = edges.join(sizes, F.col("map_key").eqNullSafe(F.col("_m"))).where((F.abs("weight") >= threshold) | F.col("_few"))
    order = "partition by map_key order by case when edge_type = 'pattern' then 0 else 1 end, confidence * abs(weight) desc, source, target"
    r = met.selectExpr("*", f"row_number() over ({order}) as rank")
    r = r.where(F.col("rank") <= limit) if limit else r
    return r.where(~F.col("_few") | (F.col("rank") <= least)).drop("_m", "_few")


#: fixed value: one to three plain words of four letters or more
PHRASE = r"(?U)\b[A-Za-z][A-Za-z\-/]{3,}\b(?:\s+[A-Za-z][A-Za-z\-/]{3,}\b){0,2}"


def fallback_phrases(chunks: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """map_key, nth, phrase: the first ``most`` phrases of each map of ``chunks`` that has no row in ``edges``.

    Chunks follow by chunk_no, then doc_id; a phrase ends with its chunk. Null texts have none; null maps take no part. Each
    chunk offers its own first ones, and tasks keep the first of a map before they meet.
    """
    bare = chunks.where("map_key is not null").join(edges.select("map_key").distinct(), "map_key", "left_anti")
    found = bare.select("map_key", "chunk_no", "doc_id", F.posexplode(F.slice(F.regexp_extract_all("text", F.lit(PHRASE), F.lit(0)), 1, most)).alias("at", "phrase"))
    return found.selectExpr("map_key", "row_number() over (partition by map_key order by chunk_no, doc_id, at, phrase) as nth", "phrase").where(F.col("nth") <= most)


def fallback_concepts(chunks: DataFrame, edges: DataFrame, lexicon: Lexicon = DEFAULT, most: int = 12) -> DataFrame:
    """map_key, concept: the named phrases of :func:`fallback_phrases`, nodes of maps that no relation was found in."""
    return T.with_concepts(fallback_phrases(chunks, edges, most), lexicon, concept="phrase").where("concept <> ''").select("map_key", "concept").distinct()
