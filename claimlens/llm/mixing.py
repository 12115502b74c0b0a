"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key, divided by its quality weight; documents
of a source are taken in the order of keys.  A source's token budget is filled by
whole epochs first, then by the prefix of that order which fits the rest.

The prefix sum never puts a source in one task: keys are mapped to ``buckets``
ranges of their distribution, bucket totals are summed over (a fixed number of
rows a source), and rows are ordered within their bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words: runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 13 hex digits of md5(id:seed)."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """sizes(s_null, s_key, source_size) with target: share of all sizes by weight, at most ceiling times the source's own.

    What sources cannot take is shared again by weight until none is above.  In the
    order of ceiling per weight the sources at their ceiling come first, so the level
    at which the rest settle follows from running sums; one row per source.
    """
    by_name = Window.orderBy("s_null", "s_key")
    cyc = F.array(*map(F.lit, weights))
    w = F.element_at(cyc, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(ceiling) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")), "s_null", "s_key")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    s = s.withColumn("level", (F.lit(share) * total - before) / left)
    # the first source, in that order, which its level does not lift to its ceiling sets the level of all that follow
    settled = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "s_null", "s_key", "level"))).over(Window.partitionBy())
    level = settled.getField("level")
    return s.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * level))).select("s_null", "s_key", "source_size", "target")


def mix(
    docs: DataFrame,
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    seed: str = "mix",
    buckets: int = 4096,
    by_id: DataFrame | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, copies and taken.

    size is the words of the text (null: 0).  quality: a positive weight per row, null
    or absent 1; a row's chance to come early in its source's order grows with it.
    copies is how often the mix takes the row, at most twice; taken = copies * size.
    A row at the edge of the budget is taken if more than half of it fits, so a
    source's taken words miss the target by half a document at most.  A null source is
    a source of its own, after all others.  Keys depend on doc_id and seed alone: reruns
    agree; rows of one id are ordered by their size and text.  Columns of docs (or those
    in carry) are kept, whatever their names; an empty table gives no rows.

    by_id(doc_id, quality_weight), one row an id, gives the weights instead of quality;
    it is joined after the text has become a size, so a text that is not carried never
    travels.
    """
    carry = docs.columns if carry is None else carry

    quality = F.lit(1.0) if quality is None else F.coalesce(quality, F.lit(1.0))
    inner = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(carry)]
    sized = docs.select(
        *inner,
        F.col("doc_id").cast("long").alias("d"),
        size_of(F.col("text")).alias("size"),
        F.col("source").isNull().alias("s_null"),
        F.coalesce(F.col("source"), F.lit("")).alias("s_key"),
        (-F.ln(uniform(F.col("doc_id"), seed))).alias("draw"),
        quality.alias("weight"),
        F.xxhash64("text").alias("tie"),
    )
    if by_id is not None:
        given = by_id.select(F.col("doc_id").alias("d"), F.col("quality_weight").alias("given"))
        sized = sized.join(given, "d", "left").withColumn("weight", F.coalesce("given", F.lit(1.0))).drop("given")
    sized = sized.withColumn("key", F.col("draw") / F.col("weight")).drop("draw", "weight").withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))
    sized = materialize(sized, "sized")
    by_bucket = materialize(sized.groupBy("s_null", "s_key", "bucket").agg(F.sum("size").alias("held")), "buckets")
    by_source = targets(by_bucket.groupBy("s_null", "s_key").agg(F.sum("held").alias("source_size")), weights, share)
    before = Window.partitionBy("s_null", "s_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held").join(by_source, ["s_null", "s_key"])
    inside = Window.partitionBy("s_null", "s_key", "bucket").orderBy("key", "d", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("run", F.sum("size").over(inside)).join(starts, ["s_null", "s_key", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (2 * (F.col("start") + F.col("run")) - F.col("size") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    out = placed.withColumn("epochs", epochs).withColumn("rest", rest).withColumn("copies", F.least(F.lit(2), F.col("epochs") + extra.cast("long")))
    return out.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(carry) if c not in ("size", "source_size", "target", "copies", "taken")],
        "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"),
    )


def quality_weight(labels: DataFrame) -> DataFrame:
    """(doc_id, quality_weight) of labels(doc_id, quality): 2 for good, a half for bad; one row an id."""
    q = F.max("quality")
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.when(q == 1, 2.0).when(q == 0, 0.5).otherwise(1.0).alias("quality_weight"))


#: The same in SQL for documents and labels, for one seed and number of buckets (which do not change the result).
ORACLE_SQL = r"""
WITH base AS (
  SELECT d.doc_id, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, d.source IS NULL AS s_null, coalesce(d.source, '') AS s_key,
         -ln((CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix'), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
           / coalesce(CASE WHEN l.q = 1 THEN 2.0::DOUBLE WHEN l.q = 0 THEN 0.5::DOUBLE END, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
), src AS (
  SELECT s_null, s_key, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY s_null, s_key) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM src
), lv AS (
  SELECT *, cap / w AS r,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, s_null, s_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, s_null, s_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT s_null, s_key, source_size, least(cap, w * coalesce((SELECT level FROM lv x WHERE x.r >= x.level ORDER BY r, s_null, s_key LIMIT 1), 1e300)) AS target FROM lv
), p AS (
  SELECT b.*, t.source_size, t.target, sum(b.size) OVER (PARTITION BY b.s_null, b.s_key ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM base b JOIN t USING (s_null, s_key)
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM p
)
SELECT doc_id, size, source_size, target,
       (least(2, epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * run - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM e
"""
