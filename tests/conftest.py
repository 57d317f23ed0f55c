import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(SF).iterdir()):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same(a, b) -> None:
    """Two pandas frames with equal columns and rows, in any order."""
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = [x[cols].astype(object).where(x[cols].notna(), None).astype(str).apply(lambda c: c.str.replace(r"\.0$", "", regex=True)).sort_values(cols).reset_index(drop=True) for x in (a, b)]
    assert len(rows[0]) == len(rows[1])
    assert (rows[0] == rows[1]).all(axis=None), rows[0][(rows[0] != rows[1]).any(axis=1)].head()
