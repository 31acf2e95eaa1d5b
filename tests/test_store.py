import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import datasource as S

from causeway.sources import store


def flat(path, vectors, mark=b"IxFI"):
    head = np.array([(mark, vectors.shape[1], len(vectors), (1 << 20, 1 << 20), 1, 0, vectors.size)], store.HEAD)
    path.write_bytes(head.tobytes() + vectors.astype("<f4").tobytes())


def rows_of(df):
    return sorted((r.doc_id, r.text, tuple(r.vector)) for r in df.collect())


@pytest.fixture
def known(spark):
    store.register(spark)
    return spark


def test_pair_with_row_groups(known, tmp_path):
    vectors = np.arange(30, dtype="f4").reshape(10, 3)
    flat(tmp_path / "index.faiss", vectors)
    pq.write_table(pa.table({"doc_id": [f"d{i}" for i in range(10)], "text": [None if i == 3 else f"t{i}" for i in range(10)]}), tmp_path / "vector_df.parquet", row_group_size=4)
    df = known.read.format("causeway_store").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    assert {r.doc_id: r.vector for r in df.collect()} == {f"d{i}": list(v) for i, v in enumerate(vectors)}
    assert [r.text for r in df.where("doc_id = 'd9'").collect()] == ["t9"] and df.where("doc_id = 'none'").count() == 0
    assert df.where("text is null").count() == 1


def test_filters_choose_row_groups(tmp_path):
    flat(tmp_path / "index.faiss", np.zeros((10, 2), "f4"))
    pq.write_table(pa.table({"n": list(range(10)), "empty": pa.array([None] * 10, pa.int64())}), tmp_path / "vector_df.parquet", row_group_size=2)
    reader = store.StoreReader(str(tmp_path))
    for test, begins in [(S.EqualTo(("n",), 5), [4]), (S.GreaterThan(("n",), 7), [8]), (S.GreaterThanOrEqual(("n",), 7), [6, 8]), (S.LessThan(("n",), 2), [0]), (S.LessThanOrEqual(("n",), 2), [0, 2]), (S.In(("n",), (0, 9)), [0, 8]), (S.IsNull(("n",)), []), (S.IsNotNull(("empty",)), []), (S.EqualTo(("empty",), 1), []), (S.IsNotNull(("n",)), [0, 2, 4, 6, 8]), (S.EqualTo(("n",), "x"), [0, 2, 4, 6, 8])]:
        assert list(reader.pushFilters([test])) == [test]
        assert [p.begin for p in reader.partitions() if p.names] == begins, test


def test_three_files_and_their_lengths(known, tmp_path):
    vectors = np.arange(14, dtype="f4").reshape(7, 2)
    flat(tmp_path / "faiss_index.idx", vectors, b"IxF2")
    pq.write_table(pa.table({"text": [f"t{i}" for i in range(7)]}), tmp_path / "chunks.parquet", row_group_size=3)
    pq.write_table(pa.table({"source": [f"s{i}" for i in range(7)]}), tmp_path / "sources.parquet", row_group_size=2)
    got = known.read.format("causeway_store").load(str(tmp_path)).collect()
    assert sorted((r.text, r.source, tuple(r.vector)) for r in got) == [(f"t{i}", f"s{i}", tuple(vectors[i])) for i in range(7)]
    pq.write_table(pa.table({"source": ["s"]}), tmp_path / "sources.parquet")
    with pytest.raises(ValueError, match="7 vectors, but 7 rows in chunks.parquet, 1 rows in sources.parquet"):
        store.StoreReader(str(tmp_path)).partitions()


def test_order_of_kinds_and_refusals(tmp_path):
    files, root = store._open(str(tmp_path))
    with pytest.raises(FileNotFoundError, match="expected"):
        store.stores_in(files, root)
    (tmp_path / "index.pkl").write_bytes(b"")
    with pytest.raises(ValueError, match="unsafe"):
        store.stores_in(files, root)
    for name in store.TRIPLE:
        (tmp_path / name).write_bytes(b"")
    assert store.stores_in(files, root) == [(root, store.TRIPLE)]
    for name in store.PAIR:
        (tmp_path / name).write_bytes(b"")
    assert store.stores_in(files, root) == [(root, store.PAIR)]
    (tmp_path / store.MANIFEST).write_text("[]")
    assert store.stores_in(files, root) == []


def test_broken_index(tmp_path):
    files, _ = store._open(str(tmp_path))
    flat(tmp_path / "a", np.zeros((3, 2), "f4"))
    whole = (tmp_path / "a").read_bytes()
    assert store.head_of(files, str(tmp_path / "a")) == (2, 3)
    for broken in (b"", whole[:20], whole[:-1], b"IwFl" + whole[4:]):
        (tmp_path / "b").write_bytes(broken)
        with pytest.raises(ValueError, match="no flat index"):
            store.head_of(files, str(tmp_path / "b"))


def test_written_and_read_back(known, tmp_path, monkeypatch):
    df = known.createDataFrame([(f"d{i:04}", None if i % 7 == 0 else f"t{i}", [float(i), 0.5]) for i in range(300)], "doc_id string, text string, vector array<float>")
    path = str(tmp_path / "s")
    df.repartition(3).write.format("causeway_store").mode("overwrite").save(path)
    assert sum(n for _, n in json.loads((tmp_path / "s" / store.MANIFEST).read_text())) == 3
    back = known.read.format("causeway_store").load("file://" + path)
    want = [(f"d{i:04}", None if i % 7 == 0 else f"t{i}", (float(i), 0.5)) for i in range(300)]
    assert sorted(((r.doc_id, r.text, tuple(r.vector)) for r in back.collect()), key=lambda x: x[0]) == want
    df.limit(2).write.format("causeway_store").mode("append").save(path)
    assert known.read.format("causeway_store").load(path).count() == 302
    os.makedirs(tmp_path / "s" / "rows-of-a-lost-task" / "0")
    df.limit(5).write.format("causeway_store").mode("overwrite").save(path)
    assert known.read.format("causeway_store").load(path).count() == 5
    with pytest.raises(Exception, match="one length and no nulls"):
        known.createDataFrame([("a", [1.0]), ("b", None)], "doc_id string, vector array<float>").coalesce(1).write.format("causeway_store").mode("overwrite").save(path)
    df.limit(0).write.format("causeway_store").mode("overwrite").save(path)
    assert known.read.format("causeway_store").schema(df.schema).load(path).count() == 0


def test_shards_of_bounded_rows(tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SHARD_ROWS", 10)
    monkeypatch.setattr(store, "GROUP_ROWS", 4)
    table = pa.table({"n": list(range(33)), "vector": pa.array([[float(i)] for i in range(33)], pa.list_(pa.float32()))})
    writer = store.StoreWriter(str(tmp_path), True)
    writer.commit([writer.write(iter(table.to_batches())), None])
    reader = store.StoreReader(str(tmp_path))
    parts = reader.partitions()
    assert max(p.end for p in parts) <= 10 and [x for p in parts for b in reader.read(p) for x in b["n"].to_pylist()] == list(range(33))
