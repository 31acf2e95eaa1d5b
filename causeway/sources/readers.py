"""Readers for landed files. Paths are resolved by Spark alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

FIELDS = ("Document_ID", "Source_Type", "Source_Name", "URL", "Title", "Published_Date", "Location")
METADATA = S.StructType([S.StructField(f, S.StringType()) for f in FIELDS])
BODY_KEYS = ("text", "content", "body", "transcript", "clean_text", "raw_text")
EXTENSIONS = ("txt", "md", "markdown", "pdf", "docx", "csv", "xlsx")
MAX_BYTES = 12 << 20


def _stem(path):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def metadata(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """The seven fields of JSON files (an object or a list each), missing ones ''; of an id the last file counts.

    The id falls back on the file's name; files that are no JSON give no rows.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("file"), "value")
    # an object is read as a list of one
    listed = F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))), S.ArrayType(METADATA))
    rows = raw.select("file", F.posexplode(listed).alias("nth", "m")).where(F.col("m").isNotNull())
    rows = rows.select("file", "nth", *(F.coalesce(F.col(f"m.{f}"), F.lit("")).alias(f) for f in FIELDS)).withColumn("Document_ID", F.coalesce(T.blank_to_null("Document_ID"), _stem(F.col("file"))))
    last = rows.selectExpr("*", "row_number() over (partition by Document_ID order by file desc, nth desc) as place").where("place = 1")
    return last.select(*FIELDS, F.lit(folder).alias("source_folder"))


def bodies(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """A2: Document_ID, text of text and markdown files (whole), and of JSON objects, lists and lines (the first filled body key)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").where(~F.regexp_extract("file", r"([^/]+)$", 1).startswith("."))
    schema = S.StructType([S.StructField("Document_ID", S.StringType()), *(S.StructField(k, S.StringType()) for k in BODY_KEYS)])
    as_json = F.lower("file").rlike(r"\.jsonl?$")
    head = F.substring(F.ltrim("value"), 1, 1)
    whole = F.from_json(F.when(head == "[", F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))), S.ArrayType(schema))
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    good = F.size(F.filter(whole, lambda x: x.isNotNull())) > 0
    parsed = raw.where(as_json).select("file", F.explode(F.when(F.coalesce(good, F.lit(False)), whole).otherwise(lines)).alias("b")).where(F.col("b").isNotNull())
    from_json = parsed.select(F.coalesce(T.blank_to_null("b.Document_ID"), _stem(F.col("file"))).alias("Document_ID"), F.coalesce(*(T.blank_to_null(f"b.{k}") for k in BODY_KEYS), F.lit("")).alias("text"))
    plain = raw.where(~as_json).select(_stem(F.col("file")).alias("Document_ID"), F.col("value").alias("text"))
    return plain.unionByName(from_json).withColumn("source_folder", F.lit(folder))


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with their vectors in one table; ``source`` is the first filled of title, name, type and id."""
    df = spark.read.parquet(path)
    present = [c for c in ("Title", "Source_Name", "Source_Type", "Document_ID") if c in df.columns]
    return df.withColumn("source", T.first_truthy(*present))


def build_config(spark: SparkSession, path: str, default: str = "") -> str:
    """The model name of a build configuration, or the default."""
    try:
        row = spark.read.option("multiLine", True).json(path).select("model").first()
    except Exception as missing:  # no such file, or no such field
        if "PATH_NOT_FOUND" in str(missing) or "UNRESOLVED_COLUMN" in str(missing):
            return default
        raise
    return row[0] if row and row[0] else default


def docx_text(content: bytes) -> str:
    """The non-blank paragraphs of a DOCX file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n".join(x for x in lines if x.strip())


def xlsx_rows(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet, as texts; labels may hold commas."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")] if "xl/sharedStrings.xml" in names else []
        sheet = ElementTree.fromstring(z.read(sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]))
    rows = []
    for r in sheet.iter(f"{space}row"):
        cells: list[str] = []
        for c in r.iter(f"{space}c"):
            letters = re.match("[A-Z]*", c.get("r") or "")[0]
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            cells += [""] * (column - 1 - len(cells))
            value = c.find(f"{space}v")
            if c.get("t") == "s":
                cells.append(shared[int(value.text)])
            elif c.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{space}t")))
            else:
                cells.append(value.text if value is not None else "")
        rows.append(cells)
    return rows


def uploads(spark: SparkSession, path: str, limit: int = 20, max_bytes: int = MAX_BYTES, pdf_text=None) -> DataFrame:
    """Name, text, error of uploaded files, the first ``limit`` by path.

    Errors: an unknown ending, a too large file, a file that cannot be read, or a blank text; Spark lists no row for a file
    of no bytes. ``pdf_text`` is a
    function from bytes to text; without one, PDF files give an error.
    """
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content").orderBy("path").limit(limit).withColumn("ending", ending)

    def read(content: bytes, kind: str) -> str:
        if kind == "docx":
            return docx_text(content)
        if kind == "pdf":
            return pdf_text(content)
        for code in ("utf-8", "utf-16"):
            try:
                return content.decode(code)
            except UnicodeError:
                pass
        return content.decode("latin-1")

    @F.pandas_udf("text string, error string")
    def text_of(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for c, k in zip(content, kind):
            try:
                out.append((read(c, k), None) if k != "pdf" or pdf_text else (None, "no PDF reader"))
            except Exception as e:  # any broken file is an error of its own row
                out.append((None, f"unreadable: {type(e).__name__}"))
        return pd.DataFrame(out, columns=["text", "error"])

    early = F.when(~F.col("ending").isin(*EXTENSIONS), "unsupported type").when(F.col("length") > max_bytes, "too large")
    rows = files.withColumn("early", early).withColumn("r", F.when(F.col("early").isNull() & ~F.col("ending").isin("csv", "xlsx"), text_of("content", "ending")))
    late = F.when(T.blank_to_null("r.text").isNull() & F.col("r.error").isNull() & F.col("early").isNull() & ~F.col("ending").isin("csv", "xlsx"), "no text")
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "ending", F.col("r.text").alias("text"), F.coalesce("early", "r.error", late).alias("error"))


def matrices(spark: SparkSession, path: str, ending: str = r"\.(?:csv|xlsx)$") -> DataFrame:
    """map_key, source, target, weight of adjacency CSV and XLSX files, those whose lower-case path meets ``ending``.

    ``map_key`` is the file's name, or the value of its folder where folders are named map_key=value, as the writer names them.
    A file counts if its first cell is blank and it has a row for each named column. Rows stand for the columns' names in
    order, whatever their own labels; cells that are no numbers, and missing ones, are 0.
    """
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(ending))
    key = F.col("map_key") if "map_key" in files.columns else F.regexp_extract("path", r"([^/]+)$", 1)

    @F.pandas_udf("array<struct<source:string,target:string,weight:double>>")
    def cells(content: pd.Series, name: pd.Series) -> pd.Series:
        import csv

        def parse(c: bytes, path: str):
            rows = xlsx_rows(c) if path.lower().endswith("xlsx") else list(csv.reader(io.StringIO(c.decode("utf-8-sig", "replace"))))
            rows = [r for r in rows if any(x.strip() for x in r)]
            if len(rows) < 2 or rows[0][0].strip():
                return None
            names = [h.strip() for h in rows[0][1:] if h.strip()]
            body = rows[1 : len(names) + 1]
            if not names or len(body) != len(names):
                return None

            def number(x: str) -> float:
                try:
                    return float(x)
                except ValueError:
                    return 0.0

            return [{"source": s, "target": t, "weight": number(r[j + 1]) if j + 1 < len(r) else 0.0} for s, r in zip(names, body) for j, t in enumerate(names)]

        return pd.Series([parse(c, p) for c, p in zip(content, name)])

    return files.select(key.alias("map_key"), F.explode(cells("content", "path")).alias("c")).select("map_key", "c.*")


def feeds(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The entries with audio of landed RSS files, in feed order."""
    item = "array<struct<title:string,description:string,link:string,pubDate:string,guid:string,enclosure:struct<_url:string,_type:string>>>"
    parsed = F.from_xml("value", f"channel struct<title:string,item:{item}>", {"ignoreNamespace": "true"})
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("feed"), parsed.alias("x")).select("feed", F.posexplode("x.channel.item").alias("nth", "e"))
    rows = rows.where(T.blank_to_null("e.enclosure._url").isNotNull())
    rows = rows.where(F.col("nth") < limit) if limit else rows
    return rows.select("feed", "nth", "e.title", "e.description", F.col("e.enclosure._url").alias("audio_url"), F.col("e.link").alias("episode_url"), T.feed_date("e.pubDate").alias("published"), F.coalesce(T.blank_to_null("e.guid"), F.col("e.enclosure._url")).alias("guid"))


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Landed video listings: id, title, upload_date (ISO), channel, url; the first row of an id."""
    df = spark.read.schema("id string, title string, upload_date string, channel string, url string").json(path)
    return df.withColumn("upload_date", T.upload_date("upload_date")).dropDuplicates(["id"])


def caption_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Id, name, content of landed caption files, named id.language.vtt or .srt, for :func:`gates.transcripts`."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    return files.where(F.lower("name").rlike(r"\.(?:vtt|srt)$")).select(F.regexp_extract("name", r"^([^.]*)", 1).alias("id"), "name", "content")


def ready(spark: SparkSession, path: str, min_rows: int = 1) -> bool:
    """Is there a readable store of at least so many rows?"""
    try:
        return spark.read.parquet(path).limit(min_rows).count() >= min_rows
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return False
        raise


def state(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """A crawl state's fields merged onto defaults; a missing or broken file gives the defaults."""
    try:
        row = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).first()
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return dict(defaults)
        raise
    return defaults | {k: v for k, v in ((row and row["m"]) or {}).items() if v is not None}
