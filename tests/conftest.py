import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def against_sql():
    """Compares a query with its SQL on a folder of tables, rows in any order."""
    import os

    import duckdb

    def norm(v):
        return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else repr(float(v)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    def compare(spark, f, sql, folder):
        con = duckdb.connect()
        for name in os.listdir(folder):
            con.sql(f"create view {name[:-8]} as select * from '{folder}/{name}{'/*.parquet' if os.path.isdir(f'{folder}/{name}') else ''}'")
        df, rel = f(spark, folder), con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        cols = sorted(df.columns)
        mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        theirs = sorted(tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
        assert mine == theirs

    return compare
