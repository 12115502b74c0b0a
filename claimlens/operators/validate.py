"""Comparison of extracted fields with a claimed profile, through a rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def rules(spark: SparkSession, table=P.RULES) -> DataFrame:
    """(document_type, rule, field, truth_key, compare, required); a program's table, so small."""
    rows = [(kind, i, *rest) for i, (kind, *rest) in enumerate(table)]
    return spark.createDataFrame(rows, "document_type string, rule int, field string, truth_key string, compare string, required boolean")


def checks(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """One row per rule of docs(request_id, document_type, fields, truth): expected, actual, status, reason."""
    table = rules(docs.sparkSession) if table is None else table
    joined = docs.select("request_id", "document_type", "fields", "truth").join(F.broadcast(table), "document_type")
    expected, actual = F.nullif(F.try_element_at("truth", F.col("truth_key")), F.lit("")), F.nullif(F.try_element_at("fields", F.col("field")), F.lit(""))
    pairs = joined.select("request_id", "document_type", "rule", "field", "compare", "required", expected.alias("expected"), actual.alias("actual"))
    e, a, kind = F.col("expected"), F.col("actual"), F.col("compare")
    # each comparison sees only its own rows, so that the fuzzy one stays cheap
    mine = lambda k, c: F.when(kind == k, c)
    equal = (
        F.when(kind == "alnum", T.same_letters(e, a)).when(kind == "last4", T.same_last4(e, a)).when(kind == "date", T.same_date(e, a))
        .otherwise(T.same_name(mine("name", e), mine("name", a)))
    )
    status = F.when(e.isNull(), "NOT_APPLICABLE").when(a.isNull(), "MISSING").when(equal, "PASS").otherwise("FAIL")
    reason = F.when(F.col("status") == "NOT_APPLICABLE", "no ground-truth provided").when(F.col("status") == "MISSING", "field not extracted").when(F.col("status") == "FAIL", "value mismatch")
    return pairs.withColumn("status", status).withColumn("reason", reason).drop("compare")


def report(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """One row per document: overall status, score and counts.

    Failed recognition fails with score 0; a kind without rules is NOT_APPLICABLE with
    score 0; where no truth was given for any required field, MISSING with score 1.
    """
    rows = checks(docs, table)
    told = F.col("status") != "NOT_APPLICABLE"
    required = F.col("required")
    counts = rows.groupBy("request_id").agg(
        F.count_if(required & (F.col("status") == "PASS")).alias("required_passed"), F.count_if(required & told).alias("required_total"),
        F.count_if(~required & (F.col("status") == "PASS")).alias("optional_passed"), F.count_if(~required & told).alias("optional_total"),
        F.count_if(required & (F.col("status") == "FAIL")).alias("failed"), F.count_if(required & (F.col("status") == "MISSING")).alias("missing"),
    )
    out = docs.join(counts, "request_id", "left")
    success = F.coalesce(F.col("ocr_success"), F.lit(True)) if "ocr_success" in docs.columns else F.lit(True)
    overall = (
        F.when(~success, "FAIL").when(F.col("required_total").isNull(), "NOT_APPLICABLE").when(F.col("required_total") == 0, "MISSING")
        .when(F.col("failed") > 0, "FAIL").when(F.col("missing") > 0, "MISSING").otherwise("PASS")
    )
    score = F.when(~success | F.col("required_total").isNull(), 0.0).when(F.col("required_total") == 0, 1.0).otherwise(F.col("required_passed") / F.when(F.col("required_total") > 0, F.col("required_total")))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("required_passed", "required_total", "optional_passed", "optional_total")]
    return out.select(*docs.columns, overall.alias("overall"), score.alias("match_score"), *zero)
