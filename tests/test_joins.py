"""Joins by time and range against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimlens.operators import joins

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("stretch", ["1 hours", "30 days"])
def test_as_of(spark, stretch):
    draw = random.Random(4)
    when = lambda: DAY + dt.timedelta(minutes=draw.randrange(3000))
    left = [(i, draw.choice([1, 1, 1, 2, 3, None]), draw.choice([when(), when(), when(), None])) for i in range(200)]
    right = [(draw.choice([1, 1, 2, None]), when(), draw.randrange(9)) for _ in range(60)]
    right += right[:5]
    got = joins.as_of(spark.createDataFrame(left, "id int, k int, t timestamp"), spark.createDataFrame(right, "k int, t timestamp, v int"), ("k", "k"), ("t", "t"), stretch)
    want = {}
    for i, k, t in left:
        fits = [r for r in right if k is not None and t is not None and r[0] == k and r[1] <= t]
        want[i] = max(fits, key=lambda r: (r[1], r[2]))[1:] if fits else None
    rows = got.collect()
    assert len(rows) == 200 and {r["l"]["id"]: r["r"] and (r["r"]["t"], r["r"]["v"]) for r in rows} == want


def test_in_ranges(spark):
    draw = random.Random(6)
    points = [(i, draw.choice([draw.uniform(-50, 50), float(draw.randrange(-5, 5)), None, float("nan")])) for i in range(150)]
    ranges = [(j, a, a + draw.choice([0.0, 0.25, 1.0, 7.0, 64.0, -1.0, float("inf")])) for j, a in enumerate([draw.uniform(-60, 60) if j % 2 else float(draw.randrange(-5, 5)) for j in range(40)])] + [(99, None, 1.0)]
    got = joins.in_ranges(spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(ranges, "j int, lo double, hi double"), "x", F.col("lo"), F.col("hi"))
    want = sorted((i, j) for i, x in points for j, a, b in ranges if x is not None and a is not None and a <= x < b)
    assert sorted((r["p"]["i"], r["q"]["j"]) for r in got.collect()) == want and want


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "k int, t timestamp, x double")
    one = spark.createDataFrame([(1, DAY, 1.0)], "k int, t timestamp, x double")
    assert joins.as_of(one, empty, ("k", "k"), ("t", "t")).collect()[0]["r"] is None and joins.as_of(empty, one, ("k", "k"), ("t", "t")).count() == 0
    assert joins.in_ranges(one, empty, "x", F.col("x"), F.col("x")).count() == 0 and joins.in_ranges(empty, one, "x", F.col("x"), F.col("x") + 1).count() == 0
