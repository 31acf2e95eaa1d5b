"""Column builders for texts, concepts and keywords. Everything here stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicons import DEFAULT, STOP_AFTER, TRAILING, Lexicon

WORD = r"[A-Za-z][A-Za-z0-9\-/]*"
FIRST = rf"({WORD}(?:\s+{WORD}){{0,3}}?)"
LAST = rf"({WORD}(?:\s+(?!\b(?:{'|'.join(STOP_AFTER)})\b){WORD}){{0,3}})"
EDGE = r"[ .,:;\n\t'\"()\[\]]+"
QUANTITY = (
    r"(?i)^(?:percentage|percent|share|fraction|proportion|ratio|amount|number|count|total|sum|average|mean|level|rate|quantity|measure|size|set|group|kind|sort|type|range)s?\s+of\s+"
)


def ascii_words(pattern: str) -> str:
    """A pattern ``\\b...\\b`` of whole words with edges between ASCII words, as RE2 reads it: an accented letter is none of a word's."""
    if not re.fullmatch(r"\\b(?:[^\\]|\\[^bB])*\\b", pattern):
        raise ValueError(f"not of the form \\b...\\b: {pattern}")
    return f"(?<![A-Za-z0-9_])(?:{pattern[2:-2]})(?![A-Za-z0-9_])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c) -> Column:
    """Empty and blank strings as null, others without white space at their ends."""
    return F.nullif(F.trim(_col(c), F.lit(" \t\n\r\f\x0b")), F.lit(""))


def first_truthy(*columns, default: str = "unknown") -> Column:
    """The first non-blank of several columns."""
    return F.coalesce(*map(blank_to_null, columns), F.lit(default))


def rounded(c, places: int) -> Column:
    """A number of nine places at most, to ``places``; halves go to the even digit."""
    return F.bround(F.round(_col(c), 9), places)


def exact_sum(c) -> Column:
    """A sum in twelve places, the same in whatever order rows come."""
    return F.sum(_col(c).cast("decimal(28,12)")).cast("double")


def sentences(c) -> Column:
    """The sentences of a text; a boundary is white space after '.', '!' or '?'."""
    return F.split(F.coalesce(_col(c), F.lit("")), r"(?<=[.!?])\s+")


def tokens(c) -> Column:
    """Lower-case runs of a-z and 0-9; a dotted capital I is an i, as SQL lowers it by single letters."""
    return F.filter(F.split(F.lower(F.translate(F.coalesce(_col(c), F.lit("")), "\u0130", "i")), "[^a-z0-9]+"), lambda x: x != "")


def _key_tokens(keyword: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", keyword.lower()) if t]


def matches_keyword(keyword: str, words: Column, joined: Column) -> Column:
    """B2: a one-word keyword is a whole token, a longer one a substring of the tokens joined by '-'."""
    parts = _key_tokens(keyword)
    if not parts:
        return F.lit(False)
    return F.array_contains(words, parts[0]) if len(parts) == 1 else F.contains(joined, F.lit("-".join(parts)))


def _keyword_arrays(keywords) -> tuple[Column, Column]:
    """One-word keywords by themselves, longer ones joined by '-': arrays of (form, keyword)."""
    forms = sorted({("-".join(_key_tokens(k)), k) for k in keywords if _key_tokens(k)})
    pick = lambda many: [F.struct(F.lit(f).alias("form"), F.lit(k).alias("keyword")) for f, k in forms if ("-" in f) == many]
    return tuple(F.array(*pick(many)).cast("array<struct<form:string,keyword:string>>") for many in (False, True))


def _found(words: Column, joined: Column, keywords) -> Column:
    single, several = _keyword_arrays(keywords)
    return F.concat(F.filter(single, lambda k: F.array_contains(words, k["form"])), F.filter(several, lambda k: F.contains(joined, k["form"])))


def keyword_hits(c, keywords, exclude=()) -> Column:
    """The sorted keywords that match a text; none if an excluded one does."""

    def hits(words: Column, joined: Column) -> Column:
        found = F.array_sort(F.transform(_found(words, joined, keywords), lambda k: k["keyword"]))
        return F.when(F.size(_found(words, joined, exclude)) > 0, F.array().cast("array<string>")).otherwise(found) if exclude else found

    return let(tokens(c), lambda words: let(F.array_join(words, "-"), lambda joined: hits(words, joined)))


def any_keyword(c, keywords) -> Column:
    """Does any keyword match?"""
    return let(tokens(c), lambda words: let(F.array_join(words, "-"), lambda joined: F.size(_found(words, joined, keywords)) > 0))


def meaningful_query(c, lexicon: Lexicon = DEFAULT) -> Column:
    """B1: is there a word of three letters or more that is no filler?"""
    fill = sorted(lexicon.filler)
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"([a-z][a-z'\-]+)"), F.lit(1))
    return F.exists(words, lambda w: (F.length(w) >= 3) & ~w.isin(fill))


def smart_title(words: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """I4: words with a capital first, known acronyms in capitals."""
    return F.array_join(F.transform(words, lambda w: F.when(F.upper(w).isin([*lexicon.acronyms]), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))), " ")


def normalized_concept(c, lexicon: Lexicon = DEFAULT) -> Column:
    """A captured phrase as a concept name; '' if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"^{EDGE}", ""), f"{EDGE}$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"(?i)^(?:the|a|an)\s+", "")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, QUANTITY, ""), rf"(?i)(?:\s+(?:{'|'.join(TRAILING)})\b\.?)+$", ""))
    stop, useless = sorted(lexicon.stopwords), sorted(lexicon.modifiers)
    either = sorted(lexicon.stopwords | lexicon.modifiers)
    def led(w: Column) -> Column:  # from the first word that carries meaning, or the last word
        return let(F.array_position(F.transform(w, lambda v: ~F.lower(v).isin(either)), True), lambda at: F.slice(w, F.greatest(F.when(at == 0, F.size(w)).otherwise(at), F.lit(1)), F.greatest(F.size(w), F.lit(1))))

    def trailed(w: Column) -> Column:
        return let(F.array_position(F.transform(F.reverse(w), lambda v: ~F.lower(v).isin(useless)), True), lambda at: F.slice(w, 1, F.when(at == 0, 1).otherwise(F.size(w) - at + 1)))

    def titled(w: Column) -> Column:
        once = F.filter(w, lambda v, i: (i == 0) | (F.lower(v) != F.lower(F.get(w, i - 1))))
        return let(smart_title(once, lexicon), lambda title: F.when(F.length(title) < 4, "").otherwise(title))

    def named(w: Column) -> Column:
        alone = (F.size(w) == 1) & F.lower(F.get(w, F.lit(0))).isin(stop)
        return F.when(alone | (F.size(w) == 0), F.lit("")).otherwise(let(led(w), lambda a: let(trailed(a), titled)))

    return let(F.filter(F.split(x, " "), lambda w: w != ""), named)


def lemma_key(c, lexicon: Lexicon = DEFAULT) -> Column:
    """Plural endings off, tokens sorted."""
    def lemma(w: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(F.upper(w).isin([*lexicon.acronyms]), F.upper(w))
            .when((F.length(w) > 4) & low.endswith("ies"), F.concat(F.expr("''"), F.regexp_replace(low, "ies$", "y")))
            .when((F.length(w) > 4) & low.endswith("es") & ~low.rlike("(?:ses|ches|shes|xes|zes)$"), F.regexp_replace(low, "es$", ""))
            .when((F.length(w) > 3) & low.endswith("s") & ~low.endswith("ss"), F.regexp_replace(low, "s$", ""))
            .otherwise(low)
        )

    return F.array_join(F.array_sort(F.transform(F.split(_col(c), " "), lemma)), " ")


def clean_concept(c, lexicon: Lexicon = DEFAULT) -> Column:
    """Is a concept name a noun phrase that says something?"""
    name, stop = _col(c), sorted(lexicon.stopwords)

    def tested(words: Column) -> Column:
        first, last, n = F.get(words, F.lit(0)), F.element_at(words, -1), F.size(words)
        bad = [
            n > 4,
            first.isin(sorted(lexicon.verb_first)),
            last.isin(sorted(lexicon.dangling)),
            (n == 1) & first.rlike("(?:ed|ing|ise|ize)$") & ~first.rlike("(?i)" + lexicon.domain),
            (n == 1) & first.isin(sorted(lexicon.vague)),
            F.exists(words, lambda w: w.isin(sorted(lexicon.clause_verbs | lexicon.anywhere)) | (F.length(w) < 2)),
            F.forall(words, lambda w: w.isin(sorted(lexicon.modifiers | lexicon.stopwords))),
            (n >= 2) & (F.size(F.filter(words, lambda w: w.isin(stop))) * 2 > n),
            (n >= 2) & (F.size(F.array_distinct(words)) == 1),
            ~F.exists(words, lambda w: ((F.length(w) >= 4) & ~w.isin(sorted(lexicon.weak))) | w.rlike("(?i)" + lexicon.domain)),
        ]
        good = ~bad[0]
        for test in bad[1:]:
            good = good & ~test
        return good

    long_enough = (F.length(name) >= 4) & ~F.regexp_replace(name, " ", "").rlike(r"^[\d.,\-/]+$")
    return F.coalesce(F.when(long_enough, let(F.split(F.lower(name), " "), tested)).otherwise(False), F.lit(False))


def valid_pair(source, target, lexicon: Lexicon = DEFAULT) -> Column:
    """B14 without the weight: both clean, different lemmas, neither word set within the other."""
    s, t = _col(source), _col(target)
    apart = let(F.split(F.lower(s), " "), lambda a: let(F.split(F.lower(t), " "), lambda b: (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)))
    return (s != "") & (t != "") & (s != t) & apart & (lemma_key(s, lexicon) != lemma_key(t, lexicon)) & clean_concept(s, lexicon) & clean_concept(t, lexicon)


def sentence_polarity(c, lexicon: Lexicon = DEFAULT) -> Column:
    """-1 if negative markers outnumber positive ones."""
    count = lambda p: F.regexp_count(_col(c), F.lit("(?i)" + p))
    return F.when(count(lexicon.negative) > count(lexicon.positive), -1).otherwise(1)


def modulated(weight, span, lexicon: Lexicon = DEFAULT) -> Column:
    """X 1.18 for intensifiers, x 0.62 for hedges, within +-0.98, rounded only if changed."""
    w = _col(weight)
    strong, weak = _col(span).rlike("(?i)" + lexicon.intensifiers), _col(span).rlike("(?i)" + lexicon.hedges)
    factor = F.when(strong, 1.18).otherwise(1.0) * F.when(weak, 0.62).otherwise(1.0)
    return F.when(strong | weak, rounded(F.greatest(F.lit(-0.98), F.least(F.lit(0.98), w * factor)), 3)).otherwise(w)


def first_rule(c, rules, default) -> Column:
    """The label of the first rule whose pattern occurs in a name."""
    chain = None
    for label, pattern in rules:
        test = _col(c).rlike("(?i)" + pattern)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(default)


def date_in_window(c, reference_year: int, years: int = 10) -> Column:
    """The first year of 1900 to 2099 in a text is recent, or there is none."""
    year = F.nullif(F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    return F.coalesce(year >= reference_year - years, F.lit(True))


def forum_date(c) -> Column:
    """MM-DD-YYYY hh:mm AM/PM as ISO 8601; other texts as they are."""
    found = F.regexp_extract(_col(c), r"(\d{1,2}-\d{1,2}-\d{4},? +\d{1,2}:\d{2} *[AaPp][Mm])", 1)
    at = F.try_to_timestamp(F.upper(F.regexp_replace(F.regexp_replace(found, ",", ""), r" *([AaPp][Mm])", " $1")), F.lit("M-d-yyyy h:mm a"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.trim(_col(c)))


def feed_date(c) -> Column:
    """An RFC 822 date as YYYY-MM-DD; other texts as they are."""
    bare = F.regexp_extract(_col(c), r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    return F.coalesce(F.date_format(F.try_to_timestamp(bare, F.lit("d MMM yyyy")), "yyyy-MM-dd"), F.trim(_col(c)))


def upload_date(c) -> Column:
    """YYYYMMDD as YYYY-MM-DD, else ''."""
    return F.when(_col(c).rlike(r"^\d{8}$"), F.regexp_replace(_col(c), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise("")


def location_of(c) -> Column:
    """I20: 'gulf-coast-31' as 'Gulf Coast'."""
    return F.initcap(F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"-\d+$", ""), "-+", " "))


def stable_id(slug, url, length: int = 10, prefix: str = "") -> Column:
    """I16: slug_ + the first digits of the address's md5."""
    return F.concat(F.lit(prefix), _col(slug), F.lit("_"), F.substring(F.md5(_col(url)), 1, length))


def topic_label(c) -> Column:
    """The text before the first full stop, at most 50 characters and then '...'."""
    head = F.trim(F.substring_index(_col(c), ".", 1))
    return F.when(F.length(head) > 50, F.concat(F.substring(head, 1, 50), F.lit("..."))).otherwise(head)


def clean_lines(c) -> Column:
    """A page's text without navigation, metadata and short lines; '' for a list of links."""
    from . import lexicons as lex

    lines = F.filter(
        F.transform(F.split(F.coalesce(_col(c), F.lit("")), "\n"), lambda x: F.trim(x)),
        lambda x: (F.length(x) >= 3) & ~x.rlike(lex.BOILERPLATE) & ~x.rlike(lex.METADATA_LINE) & ~x.rlike(lex.DROP_LINE) & ~x.rlike(lex.EPISODE_LINE) & ~((F.length(x) < 70) & x.rlike(lex.DATE_FRAGMENT)),
    )
    short = F.size(F.filter(lines, lambda x: F.length(x) < 25))
    return F.when((F.size(lines) >= 8) & (short / F.size(lines) > 0.5), "").otherwise(F.array_join(lines, "\n"))


def transcript_text(c) -> Column:
    """The words of WebVTT captions: no headers, cue times, numbers or tags; a repeated line once."""
    lines = F.transform(F.split(F.coalesce(_col(c), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(?:WEBVTT|Kind:|Language:|NOTE)") & ~x.contains("-->") & ~x.rlike(r"^\d+$"))
    return F.array_join(F.array_distinct(kept), " ")


def html_title(c) -> Column:
    """Og:title, else <title> up to a separator, else <h1>; at most 300 characters."""
    get = lambda p: blank_to_null(F.regexp_replace(F.regexp_extract(_col(c), p, 1), "<[^>]+>", ""))
    og = get(r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)[\"']")
    title = F.get(F.split(get(r"(?is)<title[^>]*>(.*?)</title>"), r"\s+[|·\-–—]\s+"), F.lit(0))
    return F.coalesce(og, F.substring(title, 1, 300), F.substring(get(r"(?is)<h1[^>]*>(.*?)</h1>"), 1, 300), F.lit(""))


def html_date(c) -> Column:
    """The first publication date in meta tags, else <time>."""
    meta = lambda attr, value: blank_to_null(F.regexp_extract(_col(c), rf"(?is)<meta[^>]+{attr}=[\"']{value}[\"'][^>]+content=[\"']([^\"']*)[\"']", 1))
    time = blank_to_null(F.regexp_extract(_col(c), r"(?is)<time[^>]*datetime=[\"']([^\"']*)[\"']", 1))
    body = blank_to_null(F.regexp_extract(_col(c), r"(?is)<time[^>]*>([^<]*)</time>", 1))
    return F.coalesce(meta("property", "article:published_time"), *(meta("name", n) for n in ("pubdate", "publishdate", "date")), meta("itemprop", "datePublished"), time, body, F.lit(""))


def with_concepts(df: DataFrame, lexicon: Lexicon = DEFAULT, **columns: str) -> DataFrame:
    """``df`` with normalized concepts: name=source column. A one-row generator keeps later filters from repeating the work."""
    made = F.array(F.struct(*(normalized_concept(c, lexicon).alias(name) for name, c in columns.items())))
    return df.withColumn("_made", F.explode(made)).select("*", "_made.*").drop("_made")
