"""Joins by time and by range, as equi-joins and windows over bins: no side is broadcast, no pair is made to be thrown away by key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the points that a range without an end meets one by one.
SALTS = 64


def as_of(left: DataFrame, right: DataFrame, on: tuple[str, str], at: tuple[str, str], stretch: str = "30 days") -> DataFrame:
    """Every row of left, as struct l, with the newest row of right of its key at or before its time, as struct r (null: none).

    on and at name the key and the time on either side.  A key's rows are ordered within
    stretches of time, so a hot key is many tasks' work; what a stretch hands on to the
    next is one row.  Of rows of right at one time the greatest is the newest.  Null keys and times match nothing.
    """
    seconds = f"unix_seconds(timestamp '1970-01-01 00:00:00 UTC' + interval {stretch})"

    def side(df: DataFrame, k: int) -> DataFrame:
        row = F.struct(*df.columns)
        l, r = (row, F.lit(None).cast(right.schema)) if k == 0 else (F.lit(None).cast(left.schema), row)
        return df.select(F.col(on[k]).alias("k"), F.col(at[k]).cast("timestamp").alias("t"), F.lit(1 - k).alias("late"), l.alias("l"), r.alias("r"))

    both = side(left, 0).unionByName(side(right, 1).where("k is not null and t is not null"))
    both = both.withColumn("stretch", F.floor(F.unix_seconds("t") / F.expr(seconds)))
    # a null key meets only left rows: spread by row instead of as one group
    both = both.withColumn("spread", F.when(F.col("k").isNull() | F.col("t").isNull(), F.xxhash64("l")).otherwise(F.lit(0)))
    inside = Window.partitionBy("k", "stretch", "spread").orderBy("t", "late", "r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("here", F.last("r", ignorenulls=True).over(inside)).where("late = 1")
    ends = both.where("k is not null and t is not null").groupBy("k", "stretch").agg(F.max(F.when(F.col("late") == 0, F.struct("t", "r"))).alias("end"))
    earlier = Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("k", "stretch", F.last("end", ignorenulls=True).over(earlier)["r"].alias("before"))
    return found.join(carried, ["k", "stretch"], "left").select("l", F.coalesce("here", "before").alias("r"))


def in_ranges(points: DataFrame, ranges: DataFrame, value: str, low: Column, high: Column) -> DataFrame:
    """Pairs of a row of points (struct p) and a row of ranges (struct q) with low <= value < high, numbers.

    A range lies in one or two bins of the power of two that is its length or more; a
    point is in one bin of each power that occurs (a bounded list).  The join is on power
    and bin, so it shuffles by them and adaptive execution splits hot bins.  Ranges
    without an end meet the points in salts instead of bins.  Nulls, not-a-numbers and
    empty ranges are in no pair.
    """
    a, b = low.cast("double"), high.cast("double")
    size = F.ceil(F.log2(F.greatest(F.lit(2.0**-1000), F.least(F.lit(2.0**1001), F.col("b") - F.col("a"))))).cast("int")
    bin_of = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("power")))
    held = ranges.select(F.struct(*ranges.columns).alias("q"), a.alias("a"), b.alias("b")).where(~F.isnan("a") & ~F.isnan("b") & (F.col("a") < F.col("b"))).withColumn("power", size)
    endless = F.col("power") > 1000
    spans = F.array_distinct(F.array(bin_of(F.col("a")), bin_of(F.col("b"))))
    binned = held.withColumn("bin", F.explode(F.when(endless, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(spans)))
    powers = held.agg(F.collect_set("power").alias("powers"))  # 2002 numbers at most
    placed = points.select(F.struct(*points.columns).alias("p"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    placed = placed.crossJoin(F.broadcast(powers)).withColumn("power", F.explode("powers")).drop("powers").withColumn("bin", F.when(endless, F.pmod(F.xxhash64("p"), F.lit(SALTS))).otherwise(bin_of(F.col("v"))))
    return placed.join(binned, ["power", "bin"]).where((F.col("v") >= F.col("a")) & (F.col("v") < F.col("b"))).select("p", "q")
