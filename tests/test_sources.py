import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from causeway.operators import chunk as C
from causeway.operators import cluster as K
from causeway.operators import gates as B
from causeway.sources import readers as S
from causeway.sources import writers as W
from causeway.streaming import ingest


def test_metadata_and_bodies(spark, tmp_path):
    m, b = tmp_path / "m", tmp_path / "b"
    m.mkdir(), b.mkdir()
    (m / "a.json").write_text(json.dumps([{"Document_ID": "d1", "Title": "old"}, {"Document_ID": "d2", "Title": "two"}]))
    (m / "b.json").write_text(json.dumps({"Document_ID": "d1", "Title": "new"}))
    (m / "c.json").write_text(json.dumps({"Title": "no id"}))
    (m / "bad.json").write_text("{nope")
    (b / "d1.txt").write_text("whole\ntext")
    (b / "x.json").write_text(json.dumps({"Document_ID": "d2", "text": " ", "body": "from body"}))
    (b / "lines.jsonl").write_text('{"Document_ID": "d3", "text": "one"}\n\n{"Document_ID": "d4", "content": "two"}\n')
    meta = {r.Document_ID: r.Title for r in S.metadata(spark, str(m), "f").collect()}
    assert meta == {"d1": "new", "d2": "two", "c": "no id"}
    body = {r.Document_ID: r.text for r in S.bodies(spark, str(b), "f").collect()}
    assert body == {"d1": "whole\ntext", "d2": "from body", "d3": "one", "d4": "two"}
    joined = B.clean_documents(S.metadata(spark, str(m), "f"), S.bodies(spark, str(b), "f"))
    assert {r.Document_ID for r in joined.collect()} == {"d1", "d2"} and B.orphan_bodies(S.metadata(spark, str(m), "f"), S.bodies(spark, str(b), "f")).count() == 2
    W.metadata_csv(S.metadata(spark, str(m)), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    assert "Title: new" in W.rendered(joined).where("Document_ID = 'd1'").first().value


def docx(*lines):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:body></w:document>")
    return out.getvalue()


def xlsx(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r + 1}"><v>{v}</v></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{w}"><sheetData>' + "".join("<row>" + "".join(cell(r, c, v) for c, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(rows)) + "</sheetData></worksheet>")
    return out.getvalue()


def test_uploads(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("one", " ", "two"))
    (tmp_path / "b.txt").write_bytes("über".encode("utf-16"))
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.md").write_bytes(b"  \n")
    got = {r.name: (r.text, r.error) for r in S.uploads(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("one\ntwo", None) and got["b.txt"][0] == "über" and got["c.exe"][1] == "unsupported type"
    assert got["e.docx"][1].startswith("unreadable") and got["f.pdf"][1] == "no PDF reader" and got["g.md"][1] == "no text"


def test_large_weights_keep_to_their_cells(spark, tmp_path):
    edges = spark.createDataFrame([("m,1", "A, b", 'C "d"', 1234567.5, "x"), ("m,1", 'C "d"', "A, b", -2000.0, "y")], "map_key string, source string, target string, weight double, seen string")
    W.matrix_csv(edges, str(tmp_path / "m"))
    got = {(r.map_key, r.source, r.target): r.weight for r in S.matrices(spark, str(tmp_path / "m"), r"\.txt$").collect()}
    assert got == {("m,1", "A, b", "A, b"): 0.0, ("m,1", "A, b", 'C "d"'): 1234567.5, ("m,1", 'C "d"', "A, b"): -2000.0, ("m,1", 'C "d"', 'C "d"'): 0.0}


def test_matrices(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"",Fish,"Reef, old"\nx,0,0.5\ny,bad\n')
    (tmp_path / "b.csv").write_text("name,a\nb,1\n")
    (tmp_path / "c.xlsx").write_bytes(xlsx([["", "Fish", "Price"], ["Fish", 1, -0.25], ["Price", 0, 0]]))
    got = {(r.map_key, r.source, r.target): r.weight for r in S.matrices(spark, str(tmp_path)).collect()}
    assert got[("a.csv", "Fish", "Reef, old")] == 0.5 and got[("a.csv", "Reef, old", "Fish")] == 0.0 and got[("c.xlsx", "Fish", "Price")] == -0.25 and len(got) == 8


def test_network_round_trip(spark, tmp_path):
    rows = [("m", "A & B", "C", 0.5, "positive", 0.9, "e", None, "pattern", 1, "1"), ("n", "X", "Y", -0.25, "negative", 0.9, "e", None, "pattern", 1, "1")]
    e = spark.createDataFrame(rows, "map_key string, source string, target string, weight double, polarity string, confidence double, evidence string, evidence_doc_id string, edge_type string, hops int, seen string")
    W.network(e, str(tmp_path / "n"))
    text = spark.read.text(str(tmp_path / "n/matrix_csv/map_key=m"), wholetext=True).first()[0]
    assert text.splitlines() == ['"","A & B","C"', '"A & B",0.000,0.500', '"C",0.000,0.000']
    assert "A &amp; B" in "".join(r[0] for r in spark.read.text(str(tmp_path / "n/gexf/map_key=m")).collect())
    assert spark.read.json(str(tmp_path / "n/edges_json")).count() == 2


def test_small_state(spark, tmp_path):
    assert S.build_config(spark, str(tmp_path / "none.json"), "m") == "m" and not S.ready(spark, str(tmp_path / "none"))
    (tmp_path / "c.json").write_text('{"model": "x"}')
    assert S.build_config(spark, str(tmp_path / "c.json")) == "x"
    assert S.state(spark, str(tmp_path / "none"), {"a": "1"}) == {"a": "1"} and S.state(spark, str(tmp_path / "c.json"), {"a": "1"}) == {"a": "1", "model": "x"}


def test_feeds(spark, tmp_path):
    item = lambda t, a: f"<item><title>{t}</title><pubDate>Tue, 5 Mar 2024 10:00:00 GMT</pubDate>" + (f'<enclosure url="{a}" type="audio/mpeg"/>' if a else "") + "</item>"
    (tmp_path / "f.xml").write_text("<rss><channel><title>c</title>" + item("one", "http://x/1.mp3") + item("two", "") + "</channel></rss>")
    got = S.feeds(spark, str(tmp_path)).collect()
    assert [(r.title, r.published, r.audio_url) for r in got] == [("one", "2024-03-05", "http://x/1.mp3")]


def test_chunks(spark):
    text = "Word one two. " * 200 + "\n\n" + "x" * 1700
    parts = C.split_text(text)
    assert all(len(p) <= 800 or " " not in p for p in parts) and "".join(parts).replace(" ", "").replace(".", "") == text.replace(" ", "").replace("\n", "").replace(".", "")
    rows = C.chunks(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    assert [r.chunk_id for r in rows if r.doc_id == 3] == ["3#0"] and not [r for r in rows if r.doc_id == 2]
    assert rows[1].text == (parts[0][-120:] + " " + parts[1]).strip()


def test_pages(spark):
    body = "A sentence about the reef that goes on for a while and says a lot. " * 8
    page = f"<html><head><title>T</title></head><body><nav>Home page navigation</nav><article><p>{body}<p>next &amp; last paragraph of it<script>x()</script></article><a href='/ok?x=1#f'>a</a><a href='pic.jpg'>b</a><a href='http://other.org/z'>c</a></body></html>"
    r = C.page_text(spark.createDataFrame([(1, "http://h.org/d/p", page), (2, "http://h.org", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0].text.endswith("next & last paragraph of it") and "navigation" not in r[0].text and r[1].text == ""
    assert [x.link for x in C.links(spark.createDataFrame([(1, "http://h.org/d/p", page)], "page_id long, url string, html string")).collect()] == ["http://h.org/ok?x=1"]
    thread = f'<article data-author="ann" data-content="p1"><time datetime="2020"></time><div class="bbWrapper">{body}</div></article>'
    assert C.thread_posts(thread)[0][:3] == ("p1", "ann", "2020")


def test_clusters(spark):
    v = spark.createDataFrame([(i, [1.0 + i / 100, 0.0] if i < 5 else [0.0, 1.0 + i / 100]) for i in range(10)], "vec_id long, embedding array<double>")
    rows = K.assign(v, 2).collect()
    assert len({r.cluster for r in rows if r.vec_id < 5}) == 1 and len({r.cluster for r in rows}) == 2 and all(0 <= r.relationship <= 1 for r in rows)
    assert K.similar_within(K.assign(v, 2), 0.9).count() == 20 and K.project(v).count() == 10


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    first = pd.DataFrame({"doc_id": [1, 2, 2], "text": ["quota in texas", "none", "none"]})
    (tmp_path / "in").mkdir()
    first.to_parquet(tmp_path / "in/a.parquet")
    schema = spark.read.parquet(str(tmp_path / "in")).schema

    def take():
        stream = ingest.documents(spark, str(tmp_path / "in"), schema)
        ingest.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda s: ingest.hits(s, ["quota"], ["texas"]))
        return sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert take() == [1] and take() == [1]
    pd.DataFrame({"doc_id": [1, 3], "text": ["quota in texas", "a texas quota"]}).to_parquet(tmp_path / "in/b.parquet")
    assert take() == [1, 3]
    whole = B.with_hits(spark.read.parquet(str(tmp_path / "in")).dropDuplicates(["doc_id"]), ["quota"], ["texas"]).where((F.size("policy_hits") > 0) & (F.size("gulf_hits") > 0))
    assert whole.count() == 2


def test_written_tables_are_discarded(spark):
    from causeway import shared

    df = shared.written(spark.range(5), "five")
    assert df.count() == 5 and shared.session_dir(spark).startswith(shared.shared_dir(spark))
    other = spark.newSession()
    assert shared.written(other.range(3), "three").count() == 3


def test_a_cluster_has_to_name_its_shared_folder():
    import pytest

    from causeway import shared

    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
