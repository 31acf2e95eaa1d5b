from paths import SMALL

from causeway.llm import packing, pii, quality, toxicity


def test_stages_against_brute_force(spark):
    import corpus_pipeline as P
    from test_search_joins import brute_classes

    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_copies", "personal_data", "packing"]
    sf = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "quality":
            keep = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).collect() if r.keep}
            assert {r.doc_id for r in rows} == keep and 0 < len(keep) < len(before)
        elif name == "toxicity":
            keep = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if not r.predicted}
            assert {r.doc_id for r in rows} == keep and 0 < len(keep) < len(before)
        elif name == "near_copies":
            classes = brute_classes({d: r.text for d, r in before.items()})
            assert {r.doc_id for r in rows} == {d for d, (_, c) in classes.items() if c == d} and len(rows) < len(before)
        elif name == "personal_data":
            assert {r.doc_id for r in rows} == set(before) and all(not pii.matches(r.text)[0] and r.n_chars == len(r.text) for r in rows) and any(r.text != before[r.doc_id].text for r in rows)
        else:
            want = {d: len(packing.token_ids(r.text)) + 1 for d, r in before.items()}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == want
            break
        assert out.columns == columns
        docs = out


def test_odd_rows_pass_all_stages(spark, docs):
    """Null and repeated ids, null, empty and repeated texts and a further column, end to end; and an empty table."""
    import corpus_pipeline as P

    sf = SMALL.replace("0.001", "0.01")
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    good = [r.text for r in whole.where("length(text) between 300 and 2000").orderBy("doc_id").limit(40).collect()]
    texts = [*good, None, "", None, good[0], good[1]]
    ids = [*range(10**6, 10**6 + len(good)), 10**6 + 900, 10**6 + 901, None, None, 10**6 + 1]
    table = docs(*texts, ids=ids).withColumn("node", quality.F.lit("clash"))
    for empty in (False, True):
        rows = table.limit(0) if empty else table
        for name, stage in P.STAGES[:-1]:
            rows = P.materialize(stage(spark, rows, sf), f"odd-{name}")
            assert rows.columns == table.columns
        kept = rows.collect()
        out = P.packed(spark, rows, sf).collect()
        assert {r.doc_id for r in out} == {r.doc_id for r in kept} and len({(r.sequence_id, r.offset) for r in out}) == len(out) and bool(kept) != empty
        named = [r.doc_id for r in kept if r.doc_id is not None]
        assert len(named) == len(set(named))
