"""Document gates: relevance, policy and region, dates, lengths, states, outcomes and first-wins selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import lexicons as L
from ..functions import text as T


def relevant(df: DataFrame, include=L.RELEVANCE, exclude=L.EXCLUDE, text: str = "text") -> DataFrame:
    """Rows whose text has an included keyword and no excluded one; both lists in one pass."""
    found = df.withColumn("_hits", K.hits(text, {"include": include, "exclude": exclude or ()}))
    return found.where((F.size("_hits.include") > 0) & (F.size("_hits.exclude") == 0)).drop("_hits")


def with_hits(df: DataFrame, policy=L.POLICY, gulf=L.GULF, exclude=L.EXCLUDE, text: str = "text") -> DataFrame:
    """policy_hits and gulf_hits in lexical order, from one pass; an excluded keyword empties the policy hits."""
    found = df.withColumn("_hits", K.hits(text, {"policy": policy, "gulf": gulf, "exclude": exclude or ()}))
    kept = F.when(F.size("_hits.exclude") == 0, F.col("_hits.policy")).otherwise(F.array().cast("array<string>"))
    return found.withColumns({"policy_hits": kept, "gulf_hits": F.col("_hits.gulf")}).drop("_hits")


def strong(df: DataFrame, weak_policy=L.WEAK_POLICY, weak_gulf=L.WEAK_GULF) -> DataFrame:
    """Rows with a policy hit and a region hit that are not weak."""
    left = lambda hits, weak: F.size(F.array_except(hits, F.array(*map(F.lit, weak)))) > 0
    return df.where(left("policy_hits", weak_policy) & left("gulf_hits", weak_gulf))


def outcome(df: DataFrame, reference_year: int, min_chars: int = 400, years: int = 10, text: str = "text", date: str = "published") -> DataFrame:
    """``outcome`` of each row: the first gate that rejects it, else 'saved'. Needs policy_hits and gulf_hits."""
    return df.withColumn(
        "outcome",
        F.when(F.length(F.coalesce(text, F.lit(""))) < min_chars, "short").when(~T.date_in_window(date, reference_year, years), "old").when(F.size("policy_hits") == 0, "no_policy").when(F.size("gulf_hits") == 0, "no_region").otherwise("saved"),
    )


def funnel(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by outcome."""
    return df.groupBy(*keys, "outcome").agg(F.count("*").alias("n"))


def dominant_state(df: DataFrame, states=L.STATES, default: str = "Gulf Council", text: str = "text") -> DataFrame:
    """``state`` with most distinct signals; ties to the one that is named first; ``default`` for none."""
    return df.withColumn("state", K.leading(text, states, default))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.selectExpr("*", f"row_number() over (partition by {key} order by {', '.join(order)}) as nth").where("nth = 1").drop("nth")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def allowed(df: DataFrame, names, column: str) -> DataFrame:
    """Rows whose name is listed, whose stem is, or that extend a listed name by '-...'."""
    if not names:
        return df
    c, listed = F.col(column), F.array(*map(F.lit, names))
    return df.where(c.isin([*names]) | F.regexp_replace(c, "-[^-]*$", "").isin([*names]) | F.exists(listed, lambda n: c.startswith(F.concat(n, F.lit("-")))))


#: fixed values: what a failed fetch says, and its outcome; anything else is an error
FAILURES = ((r"sign in|not a bot", "ip_blocked"), (r"unavailable|private", "video_na"), (r"disabled", "disabled"))


def transcripts(videos: DataFrame, tracks: DataFrame, failures: DataFrame, min_chars: int = 400) -> DataFrame:
    """Id, text, outcome of every distinct id of ``videos``, from landed tracks (id, name, content) and failures (id, message).

    Tracks made by hand go before automatic ones (``auto`` in the name), which count only where there are none by hand; the
    first by name that has words is the text. Outcomes: ok, too_short (the text is kept), or for an id without words the
    outcome of its first message by code, or not_found. Null ids, and tracks and failures of no listed id, take no part.
    """
    auto = F.coalesce(F.lower("name").contains("auto"), F.lit(False))
    read = tracks.where("id is not null").select("id", "name", auto.alias("auto"), T.transcript_text("content").alias("words"))
    first = lambda which: F.min(F.when((F.col("words") != "") & which, F.struct(F.coalesce("name", F.lit("")).alias("name"), "words")))
    best = read.groupBy("id").agg(F.bool_or(~F.col("auto")).alias("manual"), first(~F.col("auto")).alias("m"), first(F.col("auto")).alias("a"))
    best = best.select("id", F.when(F.col("manual"), F.col("m.words")).otherwise(F.col("a.words")).alias("words"))
    said, code = F.lower(F.coalesce("message", F.lit(""))), F.lit("error")
    for pattern, outcome in reversed(FAILURES):
        code = F.when(said.rlike(pattern), outcome).otherwise(code)
    failed = failures.where("id is not null").groupBy("id").agg(F.min(code).alias("failed"))
    rows = videos.select("id").dropna().distinct().join(best, "id", "left").join(failed, "id", "left")
    found = F.when(F.length("words") >= min_chars, "ok").when(F.col("words").isNotNull(), "too_short").otherwise(F.coalesce("failed", F.lit("not_found")))
    return rows.select("id", F.coalesce("words", F.lit("")).alias("text"), found.alias("outcome"))


def parse_address(df: DataFrame, url: str = "url") -> DataFrame:
    """Host, path and query of an address, lower-cased host."""
    return df.withColumns({"host": F.lower(F.try_parse_url(url, F.lit("HOST"))), "path": F.try_parse_url(url, F.lit("PATH")), "query": F.try_parse_url(url, F.lit("QUERY"))})


def confident(edges: DataFrame, min_confidence: float = 0.0, min_abs_weight: float = 0.0, max_relations: int | None = None) -> DataFrame:
    """Optional floors and a limit, clamped to 1..60, on ranked edges."""
    kept = edges.where((F.col("confidence") >= min_confidence) & (F.abs("weight") >= min_abs_weight))
    if max_relations is None:
        return kept
    n = max(1, min(60, max_relations))
    return kept.selectExpr("*", "row_number() over (partition by map_key order by confidence * abs(weight) desc, source, target) as place").where(F.col("place") <= n).drop("place")


def clean_documents(metadata: DataFrame, bodies: DataFrame) -> DataFrame:
    """Metadata with bodies, by folder and Document_ID, where the body is not blank."""
    return metadata.join(bodies.where(T.blank_to_null("text").isNotNull()), ["source_folder", "Document_ID"])


def orphan_bodies(metadata: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies without metadata."""
    return bodies.join(metadata.select("source_folder", "Document_ID").distinct(), ["source_folder", "Document_ID"], "left_anti")
