"""Tables whose further columns have the names that the operators use for their own."""

import re
from pathlib import Path

import pytest

from causeway.llm import common, jaccard, periods, pii, sharding

FOLDER = Path(jaccard.__file__).parent


def own_names():
    """Every column that a module names, each also with one and two underscores before it."""
    found = {"_id", "_key", "_all", "new", "work"}
    for module in ("jaccard", "pii", "sharding", "periods", "common"):
        text = (FOLDER / f"{module}.py").read_text()
        found |= set(re.findall(r'(?:alias|withColumn)\("(\w+)"', text)) | set(re.findall(r"\bas (\w+)", text))
    return sorted(found - {"doc_id", "text", "shard_id", "import"} | {f"_{n}" for n in ("_id", "_key", "_all")})


@pytest.fixture
def crowded(spark):
    names = own_names()
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, *names), (2, words + " end", *names), (3, "mail me at ann.lee@example.org or 10.1.2.3 today", *names), (3, None, *names)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", `{n}` string" for n in names))


def test_fresh_names(crowded):
    assert common.fresh_names(crowded, "_id", "_ID", "unheard") == ["___id", "____ID", "unheard"]


def test_one_of_each(crowded):
    for few in (2_000_000, 0):
        out = jaccard.one_of_each(crowded, broadcast_ids=few)
        assert out.columns == crowded.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 3]


def test_redact(crowded):
    for few in (100_000, -1):
        out = pii.redact(crowded, broadcast_patterns=few)
        rows = sorted(out.collect(), key=lambda r: (r.doc_id, r.text or ""))
        assert out.columns == crowded.columns and rows[2].text is None and "ann.lee" not in rows[3].text and "10.1.2.3" not in rows[3].text
        assert all(r[2:] == tuple(own_names()) for r in rows)


def test_write_shards(crowded, tmp_path):
    sharding.write_shards(crowded, f"file://{tmp_path}/s", 60)
    out = crowded.sparkSession.read.parquet(f"file://{tmp_path}/s")
    assert out.count() == 4 and set(out.columns) == {*crowded.columns, "shard_id"}


def test_collapse(crowded):
    assert periods.collapse(crowded).columns == crowded.columns
