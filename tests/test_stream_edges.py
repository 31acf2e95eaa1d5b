import random

import pytest

from causeway.operators import relations as R
from causeway.shared import finished_folders
from causeway.streaming import ingest

CHUNK = "map_key string, doc_id string, chunk_no long, text string, score double"


def some_chunks(n=60):
    r = random.Random(5)
    names = ["coral reefs", "fish biomass", "storm runoff", "seagrass beds", "shrimp harvest"]
    cues = ["reduces", "supports", "is damaged by", "affects"]
    rows = []
    for i in range(n):
        text = " ".join(f"The {r.choice(names)} {r.choice(cues)} {r.choice(names)}." for _ in range(r.randint(0, 5)))
        rows.append((r.choice("xy"), f"d{i}", i, text, r.choice([1.0, 0.3, 0.2])))
    return rows


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("compact_every", [1, 2, 16])
def test_batches_equal_one_merge(spark, tmp_path, compact_every):
    """Three batches, one of them repeated after its end, give the edges of one merge of everything."""
    rows = some_chunks()
    root = f"file://{tmp_path}"
    replayed = []
    for batch in range(3):
        spark.createDataFrame(rows[batch * 20 : batch * 20 + 20], CHUNK).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(CHUNK).parquet(f"{root}/in")

        def find(part):
            found = R.mentions(part)
            replayed.append(found)
            return found

        ingest.merge_edges(stream, f"{root}/edges", f"{root}/state", find, compact_every)
        if batch == 1:  # the last batch's own folders are written once more, as after a failure
            again = replayed[-1]
            R.partial_sums(again).write.mode("overwrite").parquet(f"{root}/edges/sums/1")
            R.said_rows(again).write.mode("overwrite").parquet(f"{root}/edges/said/1")
        so_far = spark.createDataFrame(rows[: batch * 20 + 20], CHUNK)
        assert shown(ingest.edges(spark, f"{root}/edges")) == shown(R.merge_mentions(R.mentions(so_far))) != []
    assert finished_folders(spark, f"{root}/edges/sums") == [0, 1, 2]
    assert finished_folders(spark, f"{root}/edges/base-sums") == {1: [0, 1, 2], 2: [1], 16: []}[compact_every]


def test_nothing_merged(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        ingest.edges(spark, f"file://{tmp_path}/none")
