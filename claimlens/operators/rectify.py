"""Proposed field values: which are accepted, and how well they stand in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judge(proposals: DataFrame, extracted: DataFrame, floor: float = 0.65) -> DataFrame:
    """proposals(request_id, pos, field, value, confidence) with reason: null if accepted.

    A field that extracted(request_id, field, value) has is not overwritten, and the first
    accepted proposal of a field wins over later ones.
    """
    have = extracted.where(F.coalesce("value", F.lit("")) != "").select("request_id", "field", F.lit(True).alias("have")).distinct()
    empty = (F.coalesce("field", F.lit("")) == "") | (F.coalesce("value", F.lit("")) == "")
    first = F.when(empty, "empty").when(F.coalesce("confidence", F.lit(0.0)) < floor, "below floor").when(F.coalesce("have", F.lit(False)), "already extracted")
    judged = proposals.join(have, ["request_id", "field"], "left").withColumn("reason", first)
    order = Window.partitionBy("request_id", "field", F.col("reason").isNull()).orderBy("pos")
    return judged.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(order) > 1), "already extracted").otherwise(F.col("reason"))).drop("have")


def hallucination(proposals: DataFrame, texts: DataFrame) -> DataFrame:
    """(request_id, hallucination_score): the confidence-weighted share of proposed values whose parts the text lacks."""
    squash = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    text = texts.select("request_id", F.regexp_replace(F.lower(F.coalesce("raw_text", F.lit(""))), "\\s+", " ").alias("t"))
    rows = proposals.withColumn("v", F.lower(F.trim(F.coalesce("value", F.lit(""))))).where("v <> ''").join(text, "request_id", "left").withColumn("t", F.coalesce("t", F.lit("")))
    flat = squash(F.col("t"))
    parts = F.filter(F.split("v", "[^a-z0-9]+"), lambda p: F.length(p) >= 2)
    whole = F.contains(F.col("t"), F.col("v")) | ((squash(F.col("v")) != "") & F.contains(flat, squash(F.col("v"))))
    lost = F.size(F.filter("parts", lambda p: ~F.contains(F.col("flat"), p)))
    miss = F.when(F.col("whole"), 0.0).when(F.size("parts") == 0, 1.0).otherwise(lost / F.when(F.size("parts") > 0, F.size("parts")))
    weighed = rows.withColumns({"flat": flat, "parts": parts, "whole": whole, "w": F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.1))}).withColumn("miss", miss)
    return weighed.groupBy("request_id").agg(F.bround(F.sum(F.col("w") * F.col("miss")) / F.sum("w"), 3).alias("hallucination_score"))


def corrected(fields: DataFrame, accepted: DataFrame) -> DataFrame:
    """fields(request_id, fields map) with accepted proposals laid over; a document without any is unchanged."""
    extra = accepted.where("reason is null").groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("extra"))
    merged = F.map_concat(F.map_filter("fields", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys("extra"), k), F.lit(False))), "extra")
    return fields.join(extra, "request_id", "left").withColumn("fields", F.coalesce(merged, F.col("fields"))).drop("extra")
