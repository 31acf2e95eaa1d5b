import pytest
from paths import SMALL

from causeway.operators import relations as R
from causeway.plans import queries, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, same, name):
    same(registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


def test_columns_reach_the_scan(spark):
    plan = queries.sentences(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_quantity" not in plan


def test_sentences_of_every_line(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    parts = {r[0] for r in spark.read.parquet(f"{SMALL}/part.parquet").select("p_partkey").collect()}
    want = sum(r.l_partkey in parts and (r.l_partkey * 7 + r.l_suppkey) % (max(parts) + 1) in parts for r in lines.select("l_partkey", "l_suppkey").collect())
    assert sum(r.sentences for r in registry.QUERIES["sentence_split"](spark, SMALL).collect()) == want > 0.9 * lines.count()
    assert registry.QUERIES["modulated_weights"](spark, SMALL).count() == lines.count()


def test_edges_do_not_depend_on_partitions(spark):
    """Weights halfway between two thousandths come out alike however the sentences are dealt."""
    rows = queries.sentences(spark, SMALL)
    found = [sorted(map(tuple, R.merge_mentions(R.mentions(rows.repartition(n))).select("map_key", "source", "target", "weight", "confidence").collect())) for n in (1, 7)]
    assert found[0] == found[1]
