"""Queries over files, records, reasons and whole runs from lines to a decision, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import audit, decide, fraud, lines, rectify, respond
from ..sources import files
from . import fixtures, verification
from .verification import _RISK, _load

_K = "CAST(c_custkey AS STRING)"
_EXT = "CASE c_custkey % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'pdf' WHEN 3 THEN 'exe' WHEN 4 THEN 'webp' WHEN 5 THEN 'tiff' WHEN 6 THEN 'bmp' ELSE 'jpeg' END"
#: Files as a binary scan gives them, the first bytes in hex: right, wrong, missing and empty ones, and one above the limit.
FILES = f"""SELECT c_custkey AS file_id, 'in/scan.v2/' || {_K} || '.' || {_EXT} AS path, CASE c_custkey % 5 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FFE000104A46' WHEN 2 THEN '255044462D312E37' WHEN 3 THEN '424D000000000000' END AS head,
  CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 13 = 0 THEN 15728641 ELSE 15728640 END AS length, c_custkey % 3 AS copy, CASE WHEN c_custkey % 4 > 0 THEN 'PAN' END AS kind, c_custkey % 2 = 0 AS tables FROM customer"""
NOTES = f"""SELECT c_custkey AS request_id, 'id 2345 6789 ' || lpad({_K}, 4, '0') || CASE c_custkey % 3 WHEN 0 THEN ' and 234567890123' WHEN 1 THEN '-9 12345678901234' ELSE '' END AS note, 'ABCP' || {_K} AS pan FROM customer"""
PASTED = f"""SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '  one ' || {_K} || chr(13) || chr(10) || chr(10) || ' ' || chr(10) || 'two  words' ELSE 'only' || chr(10) END AS t, CAST(c_custkey % 7 AS DOUBLE) / 4 AS c FROM customer"""


def _read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    _load(spark, sf_dir)
    return spark.sql(sql)


def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines, profiles, signals and proposals to decisions: the branches meet by request."""
    requests, signals, proposals, raw = _load(spark, sf_dir, "kyc_requests", "kyc_signals", "kyc_proposals", "kyc_lines")
    checked = verification.validate_fields(spark, sf_dir).select("request_id", "overall", "match_score")
    judged = fraud.verdicts(signals).select("request_id", "fraud_score", "fraud_verdict")
    tags = fraud.suspicion(signals).select("request_id", "metadata_suspicion")
    text = raw.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), "\n").alias("raw_text"))
    cases = requests.drop("overall", "match_score", "fraud_score", "fraud_verdict", "metadata_suspicion", "hallucination_score")
    for branch in (checked, judged, tags, rectify.hallucination(proposals, text)):
        cases = cases.join(branch, "request_id", "left")
    out = decide.decide(cases.withColumn("hallucination_score", F.coalesce("hallucination_score", F.lit(0.0))))
    return out.select("request_id", "overall", "fraud_verdict", F.round("risk_score", 10).alias("risk_score"), "risk_band", "decision")


def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, FILES).withColumn("content", F.unhex("head"))
    return rows.select("file_id", files.extension(F.col("path")).alias("extension"), files.mime(F.col("path")).alias("mime"), F.coalesce(files.admission(), F.lit("ADMITTED")).alias("code"))


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that need work, one a content and setting."""
    rows = _read(spark, sf_dir, FILES).where("head is not null").withColumn("content", F.unhex("head"))
    keyed = rows.withColumn("content_key", audit.content_key(F.col("content"), F.lit("paddle"), F.col("kind"), F.col("tables")))
    return audit.once_per_content(keyed).select("file_id", "content_key")


def masked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, NOTES)
    shown = audit.redacted(F.create_map(F.lit("pan_number"), F.col("pan"), F.lit("name"), F.lit("A B")))
    return rows.select("request_id", audit.masked(F.col("note")).alias("note"), shown.getItem("pan_number").alias("pan"), shown.getItem("name").alias("name"))


def fraud_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals in exact parts of 64, so that two decimals round alike everywhere."""
    told = fraud.verdicts(_load(spark, sf_dir, "kyc_signals")[0])
    lead = fraud.reason(F.col("fraud_verdict"), F.array_join("triggered", ", "), F.col("explanation"))
    return told.select("request_id", F.regexp_extract("explanation", "; (.*)$", 1).alias("explanation"), F.array_join(lead, "|").alias("reasons"))


def pasted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.pseudo_lines(_read(spark, sf_dir, PASTED), "request_id", "t", F.col("c"))
    return rows.select("request_id", F.col("pos").cast("long").alias("pos"), "text", "confidence", "y")


def field_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shown fields of a document: typed ones with corrections on top, as text."""
    profile = _load(spark, sf_dir, "kyc_profiles")[0]
    typed = F.create_map(F.lit("name"), F.col("name"), F.lit("schema_type"), F.lit("x"), F.lit("dob"), F.when(F.col("request_id") % 2 == 0, F.col("dob")), F.lit("empty"), F.lit(""))
    better = F.create_map(F.lit("name"), F.concat(F.col("name"), F.lit(" Jr")))
    view = respond.document_data(respond.told(typed), F.lit(None), F.lit(None), F.when(F.col("request_id") % 3 == 0, better))
    return profile.select("request_id", F.array_join(F.array_sort(F.split(respond.as_text(view), "\n")), "|").alias("shown"))


_ORDER = {c: i for i, c in enumerate(dict.fromkeys(c for ws in P.WEIGHTS.values() for c in ws))}
QUERIES = {f.__name__: f for f in (end_to_end, file_admission, content_keys, masked_notes, fraud_explanations, pasted_lines, field_views)}
_cte = lambda name: verification.ORACLE_SQL[name]
ORACLE_SQL = {
    "end_to_end": f"""WITH base AS ({fixtures.ALL['kyc_requests']}), va AS ({_cte('validate_fields')}), fr AS ({_cte('fraud_verdicts').replace('round(s, 10)', 's')}), me AS ({_cte('metadata_suspicion')}), ha AS ({_cte('hallucination')}),
kyc_requests AS (SELECT base.* EXCLUDE (overall, match_score, fraud_score, fraud_verdict, metadata_suspicion, hallucination_score), va.overall, va.match_score, fr.fraud_score, fr.fraud_verdict, me.metadata_suspicion, coalesce(ha.hallucination_score, 0) AS hallucination_score
 FROM base LEFT JOIN va USING (request_id) LEFT JOIN fr USING (request_id) LEFT JOIN me USING (request_id) LEFT JOIN ha USING (request_id)), {_RISK}
SELECT request_id, overall, fraud_verdict, round(risk_score, 10) AS risk_score, risk_band, decision FROM d""",
    "file_admission": f"""WITH f AS (SELECT *, lower(split_part(path, '.', -1)) AS e FROM ({FILES})) SELECT file_id, e AS extension,
 CASE e WHEN 'pdf' THEN 'application/pdf' WHEN 'jpg' THEN 'image/jpeg' WHEN 'exe' THEN NULL ELSE 'image/' || e END AS mime,
 CASE WHEN head IS NULL THEN 'FILE_NOT_FOUND' WHEN e = 'exe' THEN 'UNSUPPORTED_FORMAT' WHEN length > 15728640 THEN 'FILE_TOO_LARGE' WHEN length = 0 THEN 'CORRUPT_FILE' WHEN e IN ('webp', 'tiff') THEN 'ADMITTED'
  WHEN (e = 'png' AND head LIKE '89504E47%') OR (e IN ('jpg', 'jpeg') AND head LIKE 'FFD8FF%') OR (e = 'pdf' AND head LIKE '25504446%') OR (e = 'bmp' AND head LIKE '424D%') THEN 'ADMITTED' ELSE 'UNSUPPORTED_FORMAT' END AS code FROM f""",
    "content_keys": f"""WITH f AS (SELECT file_id, path, sha256(unhex(head) || encode('|engine=paddle' || coalesce(kind, 'AUTO') || '|tbl=' || CASE WHEN tables THEN '1' ELSE '0' END)) AS content_key FROM ({FILES}) WHERE head IS NOT NULL)
SELECT arg_min(file_id, path) AS file_id, content_key FROM f GROUP BY content_key""",
    "masked_notes": f"""SELECT request_id, regexp_replace(note, '\\b\\d{{4}}[ \\t-]?\\d{{4}}[ \\t-]?(\\d{{4}})\\b', 'XXXX XXXX \\1', 'g') AS note, CASE WHEN length(pan) > 4 THEN '***' || right(pan, 4) ELSE pan END AS pan, 'A B' AS name FROM ({NOTES})""",
    "fraud_explanations": f"""WITH v AS ({_cte('fraud_verdicts')}), s AS ({fixtures.ALL['kyc_signals']}), t AS (SELECT request_id, string_agg(code || '(' || printf('%.2f', score) || ')', ', ' ORDER BY o) AS names, string_agg(code, ', ' ORDER BY o) AS codes
 FROM (SELECT *, CASE code {' '.join(f"WHEN '{c}' THEN {i}" for c, i in _ORDER.items())} END AS o FROM s) WHERE score >= 0.5 GROUP BY 1)
SELECT request_id, coalesce('triggered: ' || names || '.', 'no individual signal crossed its threshold.') AS explanation,
 CASE fraud_verdict WHEN 'LIKELY_AI' THEN 'document looks AI-generated' || coalesce(': ' || codes, '') WHEN 'SUSPICIOUS' THEN 'document has suspicious forensic signals' || coalesce(': ' || codes, '') ELSE '' END AS reasons FROM v LEFT JOIN t USING (request_id)""",
    "pasted_lines": f"""WITH l AS (SELECT request_id, c, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\n'), lambda s: trim(s)), lambda s: s <> '') AS ls FROM ({PASTED})), r AS (SELECT request_id, c, unnest(ls) AS text, unnest(range(len(ls))) AS pos FROM l)
SELECT request_id, pos, text, least(greatest(c, 0), 1)::DOUBLE AS confidence, pos + 0.5::DOUBLE AS y FROM r""",
    "field_views": f"""WITH p AS ({fixtures.ALL['kyc_profiles']}) SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 'dob: ' || dob || '|' ELSE '' END || 'name: ' || name || CASE WHEN request_id % 3 = 0 THEN ' Jr' ELSE '' END AS shown FROM p""",
}
