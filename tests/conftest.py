import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    top = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(top / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{top}/shared")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def normal(v):
    """Values of either engine in one form."""
    import decimal
    import math

    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return [normal(x) for x in v]
    return str(v)


def same_rows(spark, sf_dir, query, sql):
    """The query's rows equal those of the SQL in DuckDB."""
    import duckdb

    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([normal(r[c]) for c in columns]) for r in df.collect())
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(str([normal(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want
