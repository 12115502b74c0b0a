"""What a caller gets: batches with their defaults, one view of a document's fields, the response, and its display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Keys that say nothing about a document.
NOT_FIELDS = ("schema_type", "qr_codes", "tables")
# What a response holds where a result has none.
DEFAULTS = {
    "document_type": "UNKNOWN", "ocr_engine": "paddle", "final_decision": "REVIEW", "risk_band": "HIGH", "risk_score": 1.0, "validation_overall": "MISSING", "field_match_score": 0.0,
    "fraud_verdict": "INSUFFICIENT_DATA", "fraud_score": 0.0, "ocr_confidence": 0.0, "classification_confidence": 0.0, "processing_time": 0.0, "hallucination_score": 0.0,
    "document_status": "NEEDS_REVIEW", "llm_enabled": False,
}


def _none() -> Column:
    return F.create_map().cast("map<string,string>")


def with_defaults(batch: DataFrame, profile: Column, engine: Column | None = None) -> DataFrame:
    """batch(document_path, user_data, ocr_engine) with the batch's profile and engine where a request has none; an empty map or name is none."""
    engine = F.lit("paddle") if engine is None else F.when(engine != "", engine).otherwise(F.lit("paddle"))
    return batch.withColumns({
        "user_data": F.coalesce(F.when(F.size("user_data") > 0, F.col("user_data")), profile, _none()),
        "ocr_engine": F.coalesce(F.when(F.col("ocr_engine") != "", F.col("ocr_engine")), engine),
    })


def told(fields: Column) -> Column:
    """The entries of map<string,string> that say something; of a null map none."""
    return F.map_filter(F.coalesce(fields, _none()), lambda k, v: ~k.isin(*NOT_FIELDS) & v.isNotNull() & ~v.isin("", "[]", "{}"))


def first_told(*maps: Column) -> Column:
    """The first map that says something, without what says nothing; else an empty one."""
    return F.coalesce(*[F.when(F.size(told(m)) > 0, told(m)) for m in maps], _none())


def overlaid(base: Column, above: Column) -> Column:
    """Two maps as one; above's values hold where both have a key."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(above, k)), above)


def document_data(typed: Column, union: Column, dynamic: Column, corrected: Column) -> Column:
    """The view of a document: typed fields, else the union's, else dynamic ones, with corrections on top.

    With any typed payload all corrections count; without one those of keys that are there.
    """
    typed, union, dynamic, corrected = (F.coalesce(m, _none()) for m in (typed, union, dynamic, corrected))
    base = F.when(F.size(told(typed)) > 0, typed).when(F.size(told(union)) > 0, union).otherwise(dynamic)
    return T.let(base, lambda b: overlaid(b, F.map_filter(corrected, lambda k, v: F.map_contains_key(b, k) | (F.size(typed) > 0))))


def union_fields(typed: Column) -> Column:
    """Typed fields under the names that all kinds share: a name from its parts or the legal name, a masked number as the number."""
    at = lambda k: F.when(F.try_element_at(typed, F.lit(k)) != "", F.try_element_at(typed, F.lit(k)))
    parts = F.trim(F.concat_ws(" ", at("given_name"), at("surname")))
    values = {
        "aadhaar_number": at("masked_aadhaar"), "driving_license_number": F.coalesce(at("dl_number"), at("driving_license_number")),
        "name": F.coalesce(F.when(parts != "", parts), at("legal_name"), at("name")),
    } | {k: at(k) for k in ("pan_number", "aadhaar_last4", "passport_number", "gstin", "father_name", "dob", "gender", "address")}
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def as_text(fields: Column) -> Column:
    """One line a field, as key: value."""
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "\n")


def response(results: DataFrame) -> DataFrame:
    """results with every column that a response has a default for: the default where the column is missing or null."""
    return results.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in results.columns else F.lit(v) for k, v in DEFAULTS.items()})


def summary(results: DataFrame, decision: str = "final_decision") -> DataFrame:
    """One row: how many were approved, left to review, rejected, and all."""
    return results.agg(*[F.count_if(F.col(decision) == d).alias(d.lower()) for d in ("APPROVE", "REVIEW", "REJECT")], F.count("*").alias("results"))


def timing(runs: DataFrame, seconds: str, *by: str) -> DataFrame:
    """Runs, and the least, greatest, mean and median time, by columns."""
    s = F.col(seconds)
    return runs.groupBy(*by).agg(F.count(s).alias("runs"), F.min(s).alias("min_s"), F.max(s).alias("max_s"), F.avg(s).alias("mean_s"), F.median(s).alias("p50_s"))


def debug_view(ocr: DataFrame, preview: int = 1500) -> DataFrame:
    """ocr(lines, words, raw_text, ...) with counts and a preview for the long columns."""
    return ocr.select(
        *[c for c in ocr.columns if c not in ("lines", "words", "raw_text")], F.substring("raw_text", 1, preview).alias("raw_text_preview"),
        F.coalesce(F.array_size("lines"), F.lit(0)).alias("line_count"), F.coalesce(F.array_size("words"), F.lit(0)).alias("word_count"),
    )


def label(name: Column) -> Column:
    """A key for display: underscores as spaces, words capitalised."""
    return F.array_join(F.transform(F.split(F.replace(name, F.lit("_"), F.lit(" ")), " "), lambda w: F.initcap(w)), " ")


def shown(value: Column, kind: str = "string") -> Column:
    """A value for display, by its kind: string, number or boolean."""
    if kind == "boolean":
        text = F.when(value, "Yes").otherwise("No")
    elif kind == "number":
        text = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string("%.3f", value.cast("double")))
    else:
        text = F.when(value != "", value)
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("Not returned"))


def percent(score: Column) -> Column:
    """A score as 0 to 100; what is no number is 0."""
    n = score.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(F.least(F.greatest(n * 100, F.lit(0.0)), F.lit(100.0)))


def tone(value: Column) -> Column:
    """How a decision or status is shown."""
    v = F.upper(F.coalesce(value, F.lit("")))
    return F.when(v.rlike("APPROVE|AUTHENTIC|PASS"), "success").when(v.rlike("REJECT|TAMPER|FAKE"), "danger").when(v.rlike("REVIEW|MISMATCH|LOW"), "warning").otherwise("neutral")
