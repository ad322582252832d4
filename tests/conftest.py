import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.local.dir", folder).config("spark.checkpoint.dir", f"{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in (DATA / "sf0.001").iterdir():
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


def same_rows(a, b):
    """Two pandas frames hold the same rows, in any order."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head().to_string() + "\n" + b[(a != b).any(axis=1)].head().to_string()
