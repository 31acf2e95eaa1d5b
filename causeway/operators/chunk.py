"""Chunks with overlap (I14, C2, F3) and page text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

SEPARATORS = ("\n\n", "\n", ". ", " ")


def split_text(text: str, size: int = 800, separators=SEPARATORS) -> list[str]:
    """Parts of at most ``size`` characters: cut at the coarsest separator, packed greedily; oversize parts at the next one."""
    text = re.sub(r"[ \t]+", " ", text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    work, done = [(text, 0)], []
    while work:
        part, level = work.pop()
        if len(part) <= size or level == len(separators):
            done.append(part.strip())
            continue
        mark, held, found = separators[level], "", []
        for piece in part.split(mark):
            if len(held) + len(piece) + len(mark) <= size:
                held += piece + mark
                continue
            if held:
                found.append((held.strip(), len(separators)))
            held = piece + mark
            if len(held) > size:
                found.append((piece, level + 1))
                held = ""
        if held.strip():
            found.append((held.strip(), len(separators)))
        work.extend(reversed(found))
    return [p for p in done if p]


def raw_chunks(df: DataFrame, size: int = 800, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk (without overlap)."""

    @F.pandas_udf("array<string>")
    def parts(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t or "", size))

    return df.select(F.col(key).alias("doc_id"), F.posexplode(parts(F.coalesce(text, F.lit("")))).alias("chunk_index", "chunk"))


def stitched(chunks: DataFrame, overlap: int = 120) -> DataFrame:
    """Each chunk after the last ``overlap`` characters of the raw chunk before it; chunk_id is doc_id#index."""
    w = "lag(chunk) over (partition by doc_id order by chunk_index)"
    text = F.when(F.lit(overlap <= 0) | (F.col("chunk_index") == 0), F.col("chunk")).otherwise(F.trim(F.concat(F.expr(f"right(before, {max(1, overlap)})"), F.lit(" "), "chunk")))
    return chunks.selectExpr("*", f"{w} as before").select(F.concat_ws("#", F.col("doc_id").cast("string"), "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", text.alias("text"))


def chunks(df: DataFrame, size: int = 800, overlap: int = 120, key: str = "doc_id", text: str = "text") -> DataFrame:
    return stitched(raw_chunks(df, size, key, text), overlap)


class _Tree(HTMLParser):
    """A light tree of a page: nodes with tag, class and children; void and unclosed tags are closed leniently."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    DROP = frozenset("script style noscript nav footer header aside form iframe svg button".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", "", []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class") or "", []]
        if tag == "p" and self.stack[-1][0] == "p":
            self.stack.pop()
        self.stack[-1][2].append(node)
        if tag not in self.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def _texts(node) -> list[str]:
    out, work = [], [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            if x.strip():
                out.append(x.strip())
        elif x[0] not in _Tree.DROP:
            work.extend(reversed(x[2]))
    return out


def _all(node, tag: str) -> list:
    found, work = [], [node]
    while work:
        x = work.pop()
        if not isinstance(x, str) and x[0] not in _Tree.DROP:
            if x[0] == tag:
                found.append(x)
            work.extend(reversed(x[2]))
    return found


def main_text(page: str) -> str:
    """The lines of an <article>, a <main>, post bodies, the densest <div>, or the body, before line cleaning."""
    tree = _Tree()
    tree.feed(page or "")
    for tag in ("article", "main"):
        for node in _all(tree.root, tag)[:1]:
            if sum(map(len, _texts(node))) > 400:
                return "\n".join(_texts(node))
    divs = _all(tree.root, "div")
    posts = [d for d in divs if "bbWrapper" in d[1].split()]
    if posts:
        return "\n\n".join("\n".join(_texts(p)) for p in posts if _texts(p))
    best = max(((len(t) + 200 * len(_all(d, "p")), -i, d) for i, d in enumerate(divs) if len(t := " ".join(_texts(d))) > 400), default=None, key=lambda x: x[:2])
    body = _all(tree.root, "body")
    return "\n".join(_texts(best[2] if best else body[0] if body else tree.root))


def thread_posts(page: str) -> list[tuple[str, str, str, str]]:
    """(post id, author, date, body) of a thread page: articles with data-author, their <time> and post bodies."""
    found = []
    for m in re.finditer(r"(?is)<article\b([^>]*data-author[^>]*)>(.*?)</article>", page or ""):
        attr = lambda name, where=m[1]: (re.search(rf"{name}=[\"']([^\"']*)", where) or [None, ""])[1]
        when = re.search(r"(?is)<time[^>]*datetime=[\"']([^\"']*)", m[2])
        found.append((attr("data-content") or attr("id"), attr("data-author"), when[1] if when else "", main_text(m[2])))
    return found


def page_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with title, published and text of each page."""

    @F.pandas_udf("string")
    def body(s: pd.Series) -> pd.Series:
        return s.map(main_text)

    return df.withColumns({"title": T.html_title(html), "published": T.html_date(html), "text": T.clean_lines(body(html))})


def links(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, link: distinct same-host links of each page without fragments, assets and account or listing paths."""
    href = F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref=[\"']([^\"'#]*)"), F.lit(1)))).alias("href")
    rows = df.select(F.col(key), F.col(url).alias("base"), href).where((F.col("href") != "") & ~F.col("href").rlike("(?i)^(?:mailto|tel|javascript):"))
    origin = F.regexp_extract("base", r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.concat(origin, F.regexp_replace(F.regexp_extract("base", r"(?i)^https?://[^/?#]+([^?#]*)", 1), "[^/]*$", ""))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    full = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.regexp_extract("base", r"(?i)^(https?:)", 1), "href")).when(F.col("href").startswith("/"), F.concat(origin, "href")).otherwise(F.concat(folder, "href"))
    host, path = lambda c: F.lower(F.regexp_extract(c, r"(?i)^https?://([^/?#]+)", 1)), F.regexp_extract("link", r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    return rows.select(F.col(key), "base", full.alias("link")).where((host("link") == host("base")) & ~path.rlike(L.BAD_EXTENSION) & ~path.rlike(L.BAD_PATH)).select(key, "link").distinct()


def reachable(links_: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Page, depth over a landed link table (source, target): level-wise frontier joins with an anti-join on what was met."""
    from ..shared import written

    met = written(seeds.select(F.col("page")).distinct().withColumn("depth", F.lit(0)), "reach")
    front = met
    for d in range(1, depth + 1):
        after = links_.join(front.select(F.col("page").alias("source")), "source").select(F.col("target").alias("page")).distinct()
        front = written(after.join(met.select("page"), "page", "left_anti").withColumn("depth", F.lit(d)), "reach")
        met = met.unionByName(front)
    return met
