import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "4g").config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def compared(df, con, sql):
    """Rows of both engines by column name, in no order."""
    columns = sorted(df.columns)
    ours = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    return ours, theirs


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value
