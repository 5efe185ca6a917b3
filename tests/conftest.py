import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value in a form that is equal for Spark's and DuckDB's results."""
    import datetime
    import decimal

    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (float, decimal.Decimal)) and not isinstance(value, bool):
        return "nan" if value != value else repr(round(float(value), 6))
    if isinstance(value, dict):
        return repr([plain(x) for x in value.values()])
    if isinstance(value, (list, tuple)):
        return repr([plain(x) for x in value])
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def same_as_duckdb(df, sql: str, folder: str) -> None:
    """Compares a DataFrame with the rows that DuckDB gives over the tables of a folder, as bags."""
    import duckdb

    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in sorted(names)) for row in cursor.fetchall())
    have = sorted(tuple(plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert have == want
