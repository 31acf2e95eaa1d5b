import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests"), str(ROOT / "tests/llm")]

from paths import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from causeway.session import ship

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return c


@pytest.fixture
def same():
    """Are the rows of a DataFrame those of a DuckDB relation, by column name and to nine digits?"""

    def shown(v):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v is None:
            return str(v).lower() if isinstance(v, bool) else str(v)
        return f"{v:.9g}"

    def compare(df, relation):
        rows, names = df.collect(), sorted(df.columns)
        assert names == sorted(relation.columns)
        at = [relation.columns.index(n) for n in names]
        mine = sorted(tuple(shown(r[n]) for n in names) for r in rows)
        theirs = sorted(tuple(shown(r[i]) for i in at) for r in relation.fetchall())
        assert mine == theirs
        return len(mine)

    return compare
