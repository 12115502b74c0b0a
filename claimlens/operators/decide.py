"""Risk, band, decision, findings and rolled-up status of a request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


@dataclass(frozen=True)
class RiskWeights:
    """The shares of the weighted risk."""

    mismatch: float = 0.35
    fraud: float = 0.30
    uncertainty: float = 0.10
    hallucination: float = 0.15
    metadata: float = 0.10


def risk(w: RiskWeights = RiskWeights()) -> Column:
    """From match_score, fraud_score, ocr_confidence, hallucination_score, metadata_suspicion, overall and fraud_verdict."""
    c = F.col
    mismatch = F.when(c("overall") == "NOT_APPLICABLE", 0.0).otherwise(1.0 - T.clip01(c("match_score")))
    drift = T.clip01(F.coalesce("hallucination_score", F.lit(0.0)))
    base = F.lit(w.mismatch) * mismatch + F.lit(w.fraud) * T.clip01(c("fraud_score")) + F.lit(w.uncertainty) * (1.0 - T.clip01(c("ocr_confidence"))) + F.lit(w.hallucination) * drift + F.lit(w.metadata) * T.clip01(F.coalesce("metadata_suspicion", F.lit(0.0)))
    floors = [F.when(c("fraud_verdict") == "LIKELY_AI", 0.95), F.when(c("overall") == "FAIL", 0.75).when(c("overall") == "MISSING", 0.45), F.when(drift >= 0.5, 0.65)]
    return T.clip01(F.greatest(base, *floors))


def band(risk_score: Column) -> Column:
    return F.when(risk_score >= 0.85, "CRITICAL").when(risk_score >= 0.60, "HIGH").when(risk_score >= 0.30, "MEDIUM").otherwise("LOW")


def _ordered() -> list[tuple[Column, str, Column | None]]:
    c = F.col
    rec, conf = F.coalesce("llm_recommendation", F.lit("")), F.coalesce("llm_confidence", F.lit(0.0))
    drift = F.coalesce("hallucination_score", F.lit(0.0))
    say = lambda s, *a: F.format_string(s, *a) if a else F.lit(s)
    return [
        (c("fraud_verdict") == "LIKELY_AI", "REJECT", say("HARD: document flagged as AI-generated")),
        (c("overall") == "FAIL", "REJECT", say("HARD: required field comparison failed")),
        (c("risk_band") == "CRITICAL", "REJECT", say("HARD: risk band CRITICAL")),
        (c("overall") == "NOT_APPLICABLE", "REVIEW", say("document uses dynamic extraction; no fixed KYC validation rules apply")),
        ((rec == "REJECT") & (conf >= 0.70), "REJECT", say("LLM recommends REJECT (conf=%.2f)", conf)),
        ((rec == "APPROVE") & (conf >= 0.70) & (c("overall") == "PASS") & (c("fraud_verdict") != "SUSPICIOUS") & (drift < 0.30), "APPROVE", say("LLM recommends APPROVE (conf=%.2f)", conf)),
        ((c("risk_band") == "LOW") & (c("overall") == "PASS"), "APPROVE", None),
        (c("risk_band") == "HIGH", "REJECT", None),
    ]


def decision() -> Column:
    out = None
    for when, what, _ in _ordered():
        out = F.when(when, what) if out is None else out.when(when, what)
    return out.otherwise("REVIEW")


def decision_reasons() -> Column:
    c = F.col
    drift, conf = F.coalesce("hallucination_score", F.lit(0.0)), F.coalesce("llm_confidence", F.lit(0.0))
    none = F.array().cast("array<string>")
    review = F.array_compact(F.array(
        F.when(c("overall") == "MISSING", "one or more required fields could not be extracted"), F.when(c("fraud_verdict") == "SUSPICIOUS", "fraud signals SUSPICIOUS - manual review"),
        F.when(drift >= 0.30, F.format_string("hallucination signal %.2f above APPROVE floor", drift)), F.when(c("llm_recommendation") == "REVIEW", F.format_string("LLM also recommends REVIEW (conf=%.2f)", conf)),
    ))
    out = None
    for when, _, why in _ordered():
        value = none if why is None else F.array(why)
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(review)


def name_hint(file_name: Column) -> Column:
    n = F.lower(F.coalesce(file_name, F.lit("")))
    has = lambda *w: F.lit(False) if not w else n.rlike("|".join(w))
    return F.when(has("aadhaar", "aadhar"), "AADHAAR").when(has("pan"), "PAN").when(has("passport"), "PASSPORT").when(has("dl", "driving"), "DRIVING_LICENSE").when(has("gst"), "GST_CERTIFICATE")


def findings() -> Column:
    """array<struct<category,severity,message>> of a request, in order; one expression, no unions.

    Columns read, all nullable: fraud_verdict, fraud_score, metadata_codes, file_name, document_type, document_type_hint,
    overall, hallucination_score, blank, too_small, blurry, glare, dynamic_count, visual_concerns.
    """
    c = F.col
    name = F.coalesce("file_name", F.lit(""))
    hints = F.filter(F.array(*map(F.lit, P.NAME_HINTS_FINDING)), lambda h: F.contains(F.lower(name), h))
    drift = F.coalesce("hallucination_score", F.lit(0.0))
    codes = F.coalesce("metadata_codes", F.array().cast("array<string>"))
    known = c("document_type") != "UNKNOWN"
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    row = lambda when, category, severity, message: F.when(when, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), message.alias("message")))
    say = F.format_string
    one = [
        row(c("fraud_verdict") == "LIKELY_AI", "AI_GENERATED", "CRITICAL", say("forensic signals indicate a generated document (score=%.2f)", c("fraud_score"))),
        row(c("fraud_verdict") == "SUSPICIOUS", "POSSIBLE_FORGERY", "HIGH", say("forensic signals are suspicious (score=%.2f)", c("fraud_score"))),
        row(F.array_contains(codes, "METADATA"), "METADATA_ERROR", "HIGH", F.lit("metadata names a generator or an editor")),
        row(F.array_contains(codes, "JPEG_HISTORY"), "METADATA_ERROR", "MEDIUM", F.lit("compression history does not fit a captured photo")),
        row(F.size(hints) > 0, "FILENAME_ERROR", "HIGH", F.concat(F.lit("file name holds "), F.array_join(hints, ", "))),
        row(name_hint(name).isNotNull() & known & (name_hint(name) != c("document_type")), "FILENAME_ERROR", "MEDIUM", F.concat(F.lit("file name suggests "), name_hint(name), F.lit(", detected "), c("document_type"))),
        row((F.coalesce("document_type_hint", F.lit("")) != "") & known & (F.upper("document_type_hint") != c("document_type")), "DOCUMENT_TYPE_MISMATCH", "MEDIUM", F.concat(F.lit("hinted "), c("document_type_hint"), F.lit(", detected "), c("document_type"))),
        row((c("overall") == "NOT_APPLICABLE") | (F.coalesce("dynamic_count", F.lit(0)) > 0), "DYNAMIC_DOCUMENT", "MEDIUM", F.concat(F.lit("general extraction was used for "), c("document_type"))),
    ]
    two = [
        row(yes("blank"), "LOW_QUALITY", "CRITICAL", F.lit("image appears blank")), row(yes("too_small"), "LOW_QUALITY", "HIGH", F.lit("image resolution too low")),
        row(yes("blurry"), "LOW_QUALITY", "MEDIUM", F.lit("image is blurry")), row(yes("glare"), "LOW_QUALITY", "LOW", F.lit("glare covers part of the image")),
        row(c("overall") == "FAIL", "FIELDS_MISMATCH", "HIGH", F.lit("required fields do not match the profile")), row(c("overall") == "MISSING", "FIELDS_MISSING", "MEDIUM", F.lit("required fields could not be extracted")),
        row(drift >= 0.5, "OCR_HALLUCINATION", "HIGH", say("proposed values drift far from the text (score=%.2f)", drift)), row((drift >= 0.3) & (drift < 0.5), "OCR_HALLUCINATION", "MEDIUM", say("some proposed values are not grounded (score=%.2f)", drift)),
    ]
    seen = F.transform(F.coalesce("visual_concerns", F.array().cast("array<string>")), lambda v: F.struct(F.lit("VISUAL_REVIEW").alias("category"), F.lit("MEDIUM").alias("severity"), F.substring(v, 1, 240).alias("message")))
    return F.concat(F.array_compact(F.array(*one)), seen, F.array_compact(F.array(*two)))


def status(found: Column) -> Column:
    """One word for a request.  For tampering the last severity of a category counts, as with the metadata pair."""
    has = lambda category, *severities: F.exists(found, lambda f: (f["category"] == category) & (f["severity"].isin(*severities) if severities else F.lit(True)))
    last = F.get(F.reverse(F.filter(found, lambda f: f["category"] == "METADATA_ERROR")), 0)["severity"]
    return (
        F.when(has("AI_GENERATED"), "FAKE_AI").when(has("POSSIBLE_FORGERY") | F.coalesce(last == "HIGH", F.lit(False)), "TAMPERED").when(has("FILENAME_ERROR", "HIGH", "CRITICAL"), "FILENAME_SUSPECT")
        .when(has("LOW_QUALITY", "HIGH", "CRITICAL"), "LOW_QUALITY").when(has("FIELDS_MISMATCH") | has("OCR_HALLUCINATION"), "DATA_MISMATCH")
        .when((F.col("overall") == "PASS") & (F.col("risk_band") == "LOW") & (F.col("fraud_verdict") == "LIKELY_AUTHENTIC"), "AUTHENTIC").otherwise("NEEDS_REVIEW")
    )


_OPTIONAL = {
    "hallucination_score": "double", "metadata_suspicion": "double", "metadata_codes": "array<string>", "file_name": "string", "document_type_hint": "string", "blank": "boolean", "too_small": "boolean",
    "blurry": "boolean", "glare": "boolean", "dynamic_count": "int", "visual_concerns": "array<string>", "llm_recommendation": "string", "llm_confidence": "double", "llm_reasoning": "string", "llm_concerns": "array<string>",
}


def decide(requests: DataFrame) -> DataFrame:
    """requests with risk_score, risk_band, decision, reasons, findings, categories and status; absent inputs count as none."""
    full = requests.withColumns({k: F.lit(None).cast(t) for k, t in _OPTIONAL.items() if k not in requests.columns})
    said = F.concat(F.array_compact(F.array(F.concat(F.lit("LLM: "), F.nullif("llm_reasoning", F.lit(""))))), F.transform(F.coalesce("llm_concerns", F.array().cast("array<string>")), lambda x: F.concat(F.lit("LLM concern: "), x)))
    scored = full.withColumn("risk_score", risk()).withColumn("risk_band", band(F.col("risk_score")))
    decided = scored.withColumns({"decision": decision(), "reasons": F.concat(decision_reasons(), said), "findings": findings()})
    out = decided.withColumns({"status": status(F.col("findings")), "categories": F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["category"])))})
    return out.select(*requests.columns, "risk_score", "risk_band", "decision", "reasons", "findings", "categories", "status")


def skip_reason() -> Column:
    """Why a request is not sent to a reasoner; null: it is."""
    c = F.col
    return F.when(c("fraud_verdict") == "LIKELY_AI", "hard reject path (fraud LIKELY_AI)").when(c("overall") == "FAIL", "hard reject path (validation FAIL)").when(
        (c("overall") == "PASS") & (c("fraud_verdict") == "LIKELY_AUTHENTIC") & (c("ocr_confidence") >= 0.85), "clean approve path (no ambiguity to resolve)"
    ).when(c("overall") != "MISSING", "no missing required fields")
