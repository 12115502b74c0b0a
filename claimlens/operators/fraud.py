"""Forensic signals: weights by document profile, weighted verdict, metadata suspicion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def weights(spark: SparkSession, table=P.WEIGHTS) -> DataFrame:
    rows = [(p, c, w, i) for p, ws in table.items() for i, (c, w) in enumerate(ws.items())]
    return spark.createDataFrame(rows, "profile string, code string, weight double, place int")


def weighed(signals: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """signals(request_id, document_type, code, score) with weight, 0 where the profile has none, and triggered."""
    table = weights(signals.sparkSession) if table is None else table
    profile = F.when(F.upper("document_type").isin(*[p for p in P.WEIGHTS if p != "default"]), F.upper("document_type")).otherwise(F.lit("default"))
    out = signals.withColumn("profile", profile).join(F.broadcast(table.drop("place")), ["profile", "code"], "left")
    return out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("triggered", F.col("score") >= 0.5).withColumn("score", T.clip01(F.col("score")))


def verdicts(signals: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(request_id, fraud_score, fraud_verdict, triggered, explanation) from long signals."""
    rows = weighed(signals, table)
    place = F.create_map(*[F.lit(x) for i, c in enumerate(dict.fromkeys(c for ws in P.WEIGHTS.values() for c in ws)) for x in (c, i)])
    named = F.struct(F.element_at(place, F.col("code")).alias("place"), "code", "score")
    packed = rows.groupBy("request_id", "profile").agg(
        F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"), F.array_sort(F.collect_list(F.when(F.col("triggered"), named))).alias("t")
    )
    score = F.col("s") / F.when(F.col("w") == 0, 1.0).otherwise(F.col("w"))
    at = lambda k: F.when(F.col("profile") == "AADHAAR", P.VERDICT_AT["AADHAAR"][k]).otherwise(P.VERDICT_AT["default"][k])
    verdict = F.when(F.col("fraud_score") >= at(1), "LIKELY_AI").when(F.col("fraud_score") >= at(0), "SUSPICIOUS").otherwise("LIKELY_AUTHENTIC")
    names = F.array_join(F.transform("t", lambda e: F.format_string("%s(%.2f)", e["code"], F.bround(e["score"], 2))), ", ")
    head = F.format_string("%s (confidence=%.2f); ", F.col("fraud_verdict"), F.bround("fraud_score", 2))
    return packed.withColumn("fraud_score", score).withColumn("fraud_verdict", verdict).select(
        "request_id", "fraud_score", "fraud_verdict", F.transform("t", lambda e: e["code"]).alias("triggered"),
        F.concat(head, F.when(F.size("t") == 0, "no individual signal crossed its threshold.").otherwise(F.concat(F.lit("triggered: "), names, F.lit(".")))).alias("explanation"),
    )


def reason(verdict: Column, triggered_names: Column, explanation: Column) -> Column:
    """array<string>: the line that a decision quotes."""
    head = F.when(verdict == "LIKELY_AI", "document looks AI-generated").when(verdict == "SUSPICIOUS", "document has suspicious forensic signals")
    return F.when(verdict == "INSUFFICIENT_DATA", F.array(F.concat(F.lit("fraud check skipped: "), explanation))).when(
        head.isNotNull(), F.array(F.when(triggered_names == "", head).otherwise(F.concat(head, F.lit(": "), triggered_names)))
    ).otherwise(F.array().cast("array<string>"))


def suspicion(signals: DataFrame) -> DataFrame:
    """(request_id, metadata_suspicion, metadata_codes): the metadata signals by default weights, whatever the kind."""
    rows = weighed(signals.where(F.col("code").isin("METADATA", "JPEG_HISTORY")).withColumn("document_type", F.lit("default")))
    return rows.groupBy("request_id").agg(F.bround(F.sum(F.col("score") * F.col("weight")), 3).alias("metadata_suspicion"), F.array_sort(F.collect_list(F.when(F.col("triggered"), F.col("code")))).alias("metadata_codes"))


def metadata_score(file_name: Column, software: Column, make: Column, model: Column, xmp: Column, readable: Column) -> Column:
    """The metadata signal of an image from its tags: unreadable tags give 0.30 whatever the name says."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    any_of = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    tags = F.concat_ws(" ", text(software), text(make), text(model))
    name = text(file_name)
    soft = F.greatest(
        F.when(any_of(name, P.NAME_HINTS_SIGNAL), 0.55).otherwise(0.0), F.when(any_of(tags, P.EDITORS), 0.50).otherwise(0.0),
        F.when((text(make) == "") & (text(model) == "") & name.rlike("\\.jpe?g$"), 0.35).otherwise(0.0),
    )
    return F.when(~F.coalesce(readable, F.lit(False)), 0.30).when(any_of(tags, P.GENERATORS) | any_of(text(xmp), P.GENERATORS), 0.98).otherwise(soft)
