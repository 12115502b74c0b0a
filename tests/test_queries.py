"""Every query with SQL against the SQL, on the smallest tables; streams against batch."""

from pathlib import Path

import duckdb
import pytest

from claimlens import catalog
from claimlens.streaming import metrics

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got) > 0
    assert rows(got, columns) == rows(want, columns)


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = metrics.windowed(metrics.events(spark, str(tmp_path / "in"), batch.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == batch.count()
