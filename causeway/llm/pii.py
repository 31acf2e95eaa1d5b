"""Personal data by bootstrapped contextual extraction.

Seeds are the spans of four fixed patterns, and secrets of two known forms. The words and marks around a span are lexical
patterns. Candidates are all other strings with the broad shape of a kind: runs of digits in any grouping, dotted and
colon-separated addresses, spelled-out e-mail addresses, strings of letters and figures. Patterns and instances form a
bipartite graph that Spark scores in rounds: a pattern by a lower bound of the share of its instances that are trusted
(so support counts against a pattern's own number of instances), an instance by its best trusted pattern, which makes
further patterns trusted in the next round. Candidates in the slot of a trusted pattern become spans.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, materialize, sliced, whole_text

#: The kinds in their order at equal starts, and the fixed patterns of their parts.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+")
#: The kind that has no base spans, only seeds: hexadecimal strings of both letters and figures, and access key ids.
SECRET = 4
SECRET_SEED = re.compile(r"(?=[0-9]*[a-f])[0-9a-f]{16,}|AKIA[0-9A-Z]{16}")
#: Broad shapes of the kinds.
NUMBER = re.compile(r"\(?[0-9](?:[ ()./-]{0,2}[0-9])+")
COLONS = re.compile(r"(?:[0-9A-Fa-f]{1,4}:{1,2}){3,7}[0-9A-Fa-f]{1,4}")
LOOSE_EMAIL = re.compile(r"@[A-Za-z0-9][A-Za-z0-9-]+")
SPELLED_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:[\[(]at[\])]|(?<= )at(?= )|@) ?[A-Za-z0-9-]+(?: ?(?:[\[(]dot[\])]|(?<= )dot(?= )) ?[A-Za-z0-9-]+)+", re.I)
STRING = re.compile(r"[A-Za-z0-9_~/+.-]+")
HEX = frozenset("0123456789abcdefABCDEF")
IN_STRING = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_~/+.-")
#: Context tokens, and how the kinds are named in results.
TOKEN = re.compile(r"\w+|[^\w\s]")
NAMES = (*KINDS, "secret")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of the four kinds, and the candidates beside them, each in order.

    A scan from '@', digit runs and '+' finds exactly the leftmost non-overlapping matches of the fixed patterns: no
    match can begin inside a run of digits, or of characters before an '@', whose beginning gives none. Candidates never
    overlap a span; those of one kind never overlap each other, those of several kinds may.
    """
    spans, loose = [], []
    at = text.find("@")
    free = 0  # end of the last e-mail match
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            spans.append((start, 0, free))
        elif start < at and (m := LOOSE_EMAIL.match(text, at)):
            loose.append((start, 0, m.end()))
        at = text.find("@", max(at + 1, free))
    low = text.lower() if "dot" in text or "DOT" in text or "Dot" in text else ""
    if " dot " in low or "(dot)" in low or "[dot]" in low:
        loose.extend((m.start(), 0, m.end()) for m in SPELLED_EMAIL.finditer(text))
    runs = [m.start() for m in RUN.finditer(text)]
    if runs:
        ip_free = card_free = number_free = colons_free = string_free = 0
        for start in runs:
            if start >= ip_free and (m := IP.match(text, start)):
                ip_free = m.end()
                good = all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m.group().split(".")))
                (spans if good else loose).append((start, 1, ip_free))
            if start >= card_free and (m := CARD.match(text, start)):
                card_free = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((start, 2, card_free))
                elif 12 <= len(digits) <= 19:
                    loose.append((start, 2, card_free))
            if start >= number_free and (m := NUMBER.match(text, start - (start > 0 and text[start - 1] == "("))):
                number_free = m.end()
                if not (m.start() and text[m.start() - 1].isalnum()) and not text[number_free : number_free + 1].isalnum() and 6 <= sum(map(str.isdigit, m.group())) <= 15:
                    loose.append((m.start(), 3, number_free))
            if start >= colons_free and ":" in text[start : start + 5]:
                first = start
                while first > colons_free and text[first - 1] in HEX:
                    first -= 1
                if m := COLONS.match(text, first):
                    colons_free = m.end()
                    loose.append((first, 1, colons_free))
            if start >= string_free:
                first = start
                while first > string_free and text[first - 1] in IN_STRING:
                    first -= 1
                string_free = STRING.match(text, start).end()
                whole = text[first:string_free].strip("/+.-~")
                if len(whole) >= 8 and not whole.isdigit() and any(map(str.isalpha, whole)):
                    first = text.index(whole, first)
                    loose.append((first, SECRET, first + len(whole)))
        at = text.find("+")
        while at >= 0:
            m = PHONE.match(text, at)
            if m and 10 <= sum(map(str.isdigit, m.group())) <= 15:
                spans.append((at, 3, m.end()))
            at = text.find("+", m.end() if m else at + 1)
    spans.sort()
    if loose:
        loose.sort()
        kept, ends = [], [0] * len(NAMES)
        for s in loose:
            if s[0] >= ends[s[1]] and not any(s[0] < e and b < s[2] for b, _, e in spans):
                kept.append(s)
                ends[s[1]] = s[2]
        loose = kept
    return spans, loose


def is_seed(kind: int, value: str) -> bool:
    """Is a candidate a seed of a kind without base spans?"""
    return kind == SECRET and SECRET_SEED.fullmatch(value) is not None


def shown(spans) -> str:
    return ",".join([f"{NAMES[k]}:{s}:{e}" for s, k, e in spans])


def instance(kind: int, value: str) -> int:
    """The identity of an identifier: without grouping marks, but for e-mail addresses and secrets, and in lower case."""
    return xxhash.xxh3_64_intdigest((value if kind in (0, SECRET) else re.sub(r"[ ()./-]", "", value)).lower()) - (1 << 63)


def _around(text: str, at: int, n: int, before: bool) -> list[str]:
    """The ``n`` tokens next to a place, whole, in lower case; runs of digits are 0, long tokens their hash."""
    size = 64
    while True:
        window = text[max(0, at - size) : at] if before else text[at : at + size]
        tokens = TOKEN.findall(window)
        if len(tokens) > n or size >= (at if before else len(text) - at):  # no token that counts is cut by the window
            break
        size *= 4
    tokens = [RUN.sub("0", w.lower()) for w in (tokens[-n:] if before else tokens[:n])]
    return [w if len(w) <= 32 else f"#{xxhash.xxh3_64_hexdigest(w)}" for w in tokens]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: two and three tokens before it; one and two before with the one after."""
    before, after = _around(text, start, 3, True), _around(text, end, 1, False)
    found = []
    if len(before) >= 2:
        found.append(" ".join(before[-2:]))
    if len(before) == 3:
        found.append(" ".join(before))
    if before and after:
        found.append(f"{before[-1]} _ {after[0]}")
        if len(before) >= 2:
            found.append(f"{' '.join(before[-2:])} _ {after[0]}")
    return found


def chosen(spans, found) -> list[tuple[int, int, int]]:
    """``spans`` and of the candidates (confidence, start, kind, end) the most confident (then first) that overlap nothing; in order."""
    out = list(spans)
    for _, s, k, e in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if not any(s < f and b < e for b, _, f in out[len(spans) :]):
            out.append((s, k, e))
    return sorted(out)


BASE = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, text_key long, found array<struct<start:int,kind:int,end:int,seed:boolean,instance:long,patterns:array<string>>>"


def extract(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts and digest of the base spans, and every base span or candidate with its patterns."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    held = pa.struct([*span, pa.field("seed", pa.bool_()), pa.field("instance", pa.int64()), pa.field("patterns", pa.list_(pa.string()))])

    def run(batches):
        for batch in sliced(batches):
            counts, sha, base, found = ([], [], [], []), [], [], []
            for body in batch.column(1).to_pylist():
                spans, loose = matches(body)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                sha.append(hashlib.sha256(shown(spans).encode()).hexdigest())
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                rows = []
                for base_span, these in ((True, spans), (False, loose)):
                    for s, k, e in these:
                        value = body[s:e]
                        rows.append({"start": s, "kind": k, "end": e, "seed": base_span or is_seed(k, value), "instance": instance(k, value), "patterns": contexts(body, s, e)})
                found.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(base, pa.list_(span)), batch.column(2), pa.array(found, pa.list_(held))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "text_key", "found"])

    return df.select(F.col(key), whole_text(text).alias("text"), F.xxhash64(whole_text(text)).alias("text_key")).mapInArrow(run, f"doc_id {df.schema[key].dataType.simpleString()}, {BASE}")


#: A pattern is trusted if the lower bound, at Z deviations, of the share of its instances that are trusted is a quarter of
#: the way from the share of seeds among all instances of its kind to 1, but at least LEAST and TRUST at most.
LEAST, TRUST, Z, ROUNDS = 0.4, 0.6, 1.64, 3


def lower_bound(s, n, z: float = Z):
    """The Wilson bound of a share s/n from below, of columns."""
    p, zz = s / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + zz / (4 * n * n)))) / (1 + zz / n)


def score_graph(edges: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, least: float = LEAST) -> DataFrame:
    """Trusted patterns (kind, pattern, confidence) of edges (kind, pattern, instance, seed).

    confidence(pattern) = the lower bound of the share that its instances' confidences are of their number; what is no
    seed need not be wrong, so trust is measured against the kind's own share of seeds, which is what a context that says
    nothing gives. confidence(instance) = 1 for seeds, else that of its best trusted pattern, else 0. An identifier counts
    once for a pattern however often copies repeat it. All rounds are grouped sums, partly summed before any shuffle, so
    frequent patterns are no bottleneck.
    """
    edges = materialize(edges.groupBy("kind", "pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")), "pii-edges")
    base = edges.groupBy("kind", "instance").agg(F.max("seed").alias("seed")).groupBy("kind").agg(F.avg("seed").alias("p0"))
    asked = F.broadcast(base.select("kind", F.least(F.lit(trust), F.greatest(F.lit(least), F.col("p0") + (1 - F.col("p0")) / 4)).alias("asked")))  # a row a kind
    confident = edges.withColumn("c", F.col("seed"))
    for n in range(rounds):
        patterns = confident.groupBy("kind", "pattern").agg(F.sum("c").alias("s"), F.count("*").cast("double").alias("n")).select("kind", "pattern", F.round(lower_bound(F.col("s"), F.col("n")), 9).alias("confidence"))
        patterns = materialize(patterns.join(asked, "kind").where("confidence >= asked").drop("asked"), "pii-patterns")
        if n < rounds - 1:
            unseen = edges.where("seed = 0").join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("confidence").alias("gained"))
            confident = edges.join(unseen, ["kind", "instance"], "left").withColumn("c", F.when(F.col("seed") > 0, 1.0).otherwise(F.coalesce("gained", F.lit(0.0))))
    return patterns


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, trust: float = TRUST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extracted rows, their spans and candidates one a row, and the trusted patterns."""
    rows = materialize(extract(df, key, text), "pii-rows")
    held = rows.where(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("x")).select("doc_id", "text_key", "x.*")
    edges = held.select("kind", "seed", "instance", F.explode("patterns").alias("pattern"))
    return rows, held, score_graph(edges, rounds, trust)


MORE = "array<struct<c:double,start:int,kind:int,end:int>>"


def _with_spans(rows: DataFrame, held: DataFrame, trusted: DataFrame) -> DataFrame:
    """``rows`` with ``more``: per row the seeds without base spans, and the candidates in slots of trusted patterns, with their confidence."""
    loose = held.where(~F.col("seed") | (F.col("kind") == SECRET)).distinct()
    slots = loose.where("not seed").select("doc_id", "text_key", "start", "kind", "end", F.explode("patterns").alias("pattern"))
    gained = slots.join(trusted, ["kind", "pattern"]).groupBy("doc_id", "text_key", "start", "kind", "end").agg(F.max("confidence").alias("c"))
    gained = gained.unionByName(loose.where("seed").select("doc_id", "text_key", "start", "kind", "end", F.lit(1.0).alias("c")))
    per_doc = gained.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("c", "start", "kind", "end")).alias("more"))
    both = rows.drop("found").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").drop("_id", "_key")
    return both.withColumn("more", F.coalesce("more", F.array().cast(MORE)))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, secrets, n_found, n_secret of every row.

    ``spans`` has the base spans, which always stay, and those that contexts add; ``secrets`` has the spans of secrets, by
    seed or context; n_found counts the spans that contexts alone have added to either. Null and empty texts have none.
    Rows with equal ids and texts get equal results. Other columns are not read.
    """
    both = _with_spans(*learn(df, key, text, rounds, trust))

    def run(batches):
        for batch in sliced(batches):
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            spans, secrets, n_found = [], [], []
            for base, more in zip(columns["base"].to_pylist(), columns["more"].to_pylist()):
                base = [(x["start"], x["kind"], x["end"]) for x in base]
                more = [(x["c"], x["start"], x["kind"], x["end"]) for x in more]
                every = chosen(base, more)
                spans.append(shown([x for x in every if x[1] != SECRET]))
                secrets.append(shown([x for x in every if x[1] == SECRET]))
                sure = {x[1:] for x in more if x[0] == 1.0}
                n_found.append(len(every) - len(base) - sum(x in sure for x in every if x[1] == SECRET))
            new = [pa.array(spans, pa.string()), pa.array(secrets, pa.string()), pa.array(n_found, pa.int64()), pa.array([x.count(",") + 1 if x else 0 for x in secrets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(columns[n] for n in kept), *new], names=[*kept, "spans", "secrets", "n_found", "n_secret"])

    kept = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    kind = df.schema[key].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, secrets string, n_found long, n_secret long")


def _cut(body: str, spans) -> str:
    parts, last = [], 0
    for s, k, e in spans:
        if s >= last:
            parts += [body[last:s], f"<{NAMES[k]}>"]
            last = e
    return "".join([*parts, body[last:]])


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, trust: float = TRUST, broadcast_patterns: int = 100_000) -> DataFrame:
    """``df`` with every span and secret that :func:`find` gives replaced by ``<kind>`` in ``text``; all other columns stay as they are.

    Null texts stay null. Up to ``broadcast_patterns`` trusted patterns are sent to the tasks, which look at each text
    once more; beyond that the texts meet their spans by id and content in a shuffle.
    """
    learnt = learn(df, key, text, rounds, trust)
    patterns = learnt[2].limit(broadcast_patterns + 1).collect()
    names, schema = df.columns, df.schema
    at = names.index(text)

    def replaced(batch, spans_of):
        columns = [batch.column(i) for i in range(len(names))]
        bodies = columns[at].to_pylist()
        columns[at] = pa.array([b if b is None else _cut(b, spans_of(i, b)) for i, b in enumerate(bodies)], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    if len(patterns) <= broadcast_patterns:
        known = df.sparkSession.sparkContext.broadcast({(r["kind"], r["pattern"]): r["confidence"] for r in patterns})

        def spans_of(_, body):
            spans, loose = matches(body)
            found = []
            for s, k, e in loose:
                c = 1.0 if is_seed(k, body[s:e]) else max((known.value.get((k, p), 0.0) for p in contexts(body, s, e)), default=0.0)
                if c > 0:
                    found.append((c, s, k, e))
            return chosen(spans, found)

        return df.mapInArrow(lambda batches: (replaced(b, spans_of) for b in sliced(batches)), schema)

    own, mark, every = fresh_names(df, "_id", "_key", "_all")
    found = _with_spans(*learnt).where(F.size("base") + F.size("more") > 0).select(F.col("doc_id").alias(own), F.col("text_key").alias(mark), F.struct("base", "more").alias(every)).dropDuplicates([own, mark])

    def by_join(batches):
        for batch in sliced(batches):
            spans = [chosen([(x["start"], x["kind"], x["end"]) for x in row["base"]], [(x["c"], x["start"], x["kind"], x["end"]) for x in row["more"]]) if row and row["base"] is not None else [] for row in batch.column(len(names)).to_pylist()]
            yield replaced(batch, lambda i, _: spans[i])

    return df.join(found, F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(whole_text(text)) == F.col(mark)), "left").drop(own, mark).mapInArrow(by_join, schema)
