import tempfile

import duckdb
import pandas as pd
import pytest

from lakeloom.session import local_session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", "tests", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tests-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, with columns by name and values that compare across engines."""

    def value(x):
        if x is None or pd.isna(x):
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return bool(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return round(float(x), 5)
        return str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(value(x) for x in row) for row in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    con = duck(sf_dir)

    def check(query, sql: str) -> None:
        got, wanted = query(spark, sf_dir).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        assert normal(got) == normal(wanted)

    return check
