import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from quern.plans.shipping import ship

    ship(s)
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(df, cursor) -> None:
    columns = sorted(df.columns)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
