"""The verification queries over derived inputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import audit, decide, extract, fraud, lines, rectify, respond, validate
from ..session import ship
from . import fixtures


def _load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    ship(spark)
    for table in ("customer", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return [spark.sql(fixtures.ALL[n]) for n in names]


def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    (requests,) = _load(spark, sf_dir, "kyc_requests")
    out = decide.decide(requests)
    return out.select("request_id", F.round("risk_score", 10).alias("risk_score"), "risk_band", "decision", "status", F.array_join("categories", ",").alias("categories"), F.size("findings").cast("long").alias("n_findings"))


def decisions_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    (requests,) = _load(spark, sf_dir, "kyc_requests")
    return decide.decide(requests).groupBy("document_type", "risk_band", "decision").agg(F.count("*").alias("n"))


def reasoner_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    (requests,) = _load(spark, sf_dir, "kyc_requests")
    return requests.groupBy(F.coalesce(decide.skip_reason(), F.lit("sent")).alias("reason")).agg(F.count("*").alias("n"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _load(spark, sf_dir, "kyc_lines")
    return lines.admit(lines.reading_order(raw), ascii_only=True)


def line_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _load(spark, sf_dir, "kyc_lines")
    clean = raw.withColumn("clean", T.clean(F.col("text"), True))
    return clean.withColumn("code", F.coalesce(T.reject_code(F.col("clean"), F.col("confidence"), 0.55), F.lit("KEPT"))).groupBy("code").agg(F.count("*").alias("n"))


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.filter_stats(_judged(spark, sf_dir))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _load(spark, sf_dir, "kyc_lines")
    return lines.reading_order(raw).select("request_id", "pos", F.col("ord").cast("long").alias("ord"))


def confidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _load(spark, sf_dir, "kyc_lines")
    c = F.col("confidence")
    return raw.groupBy("request_id").agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"), F.min(c).alias("least"), F.count_if(c < 0.70).alias("low"), F.count_if(c < 0.55).alias("suspicious"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assembled from kept lines, classified, with fields."""
    docs = lines.document(lines.admit(lines.reading_order(_load(spark, sf_dir, "kyc_lines")[0].withColumn("confidence", F.lit(0.99))), ascii_only=True))
    kind = extract.classify(F.col("raw_text"))
    return extract.extract(docs.withColumn("kind", kind).withColumn("document_type", F.col("kind.document_type")))


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _load(spark, sf_dir, "kyc_lines")
    text = raw.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), "\n").alias("t"))
    return text.select("request_id", extract.classify(F.col("t")).alias("k")).select("request_id", "k.document_type", "k.confidence")


def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("request_id", "document_type", F.explode("fields").alias("field", "value"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("pan_number", "passport_number", "driving_license_number", "gstin")
    return extract_fields(spark, sf_dir).where(F.col("field").isin(*wanted)).select("request_id", "field", "value")


def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    profile = spark.sql(fixtures.PROFILES)
    truth = profile.select("request_id", F.map_filter(F.create_map(*[x for c in profile.columns[1:] for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull()).alias("truth"))
    return validate.report(docs.join(truth, "request_id", "left").select("request_id", "document_type", "fields", "truth")).select("request_id", "document_type", "overall", F.round("match_score", 6).alias("match_score"), "required_passed", "required_total", "optional_passed", "optional_total")


def general_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _load(spark, sf_dir, "kyc_lines")
    return raw.select("request_id", "pos", extract.general_kind(F.col("text")).alias("k")).select("request_id", "pos", "k.label", "k.category", "k.confidence")


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _load(spark, sf_dir, "kyc_lines")
    text = raw.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), "\n").alias("t"))
    pairs = extract.key_values(text, "request_id", "t")
    return pairs.groupBy("request_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]), "|").alias("vals"))


def fraud_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (signals,) = _load(spark, sf_dir, "kyc_signals")
    return fraud.verdicts(signals).select("request_id", F.round("fraud_score", 10).alias("fraud_score"), "fraud_verdict", F.size("triggered").cast("long").alias("n_triggered"))


def metadata_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    (signals,) = _load(spark, sf_dir, "kyc_signals")
    return fraud.suspicion(signals).select("request_id", F.round("metadata_suspicion", 3).alias("metadata_suspicion"), F.array_join("metadata_codes", ",").alias("codes"))


def rectify_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    (proposals, profile) = _load(spark, sf_dir, "kyc_proposals", "kyc_profiles")
    have = profile.where("request_id % 3 = 0").select("request_id", F.lit("dob").alias("field"), F.col("dob").alias("value"))
    return rectify.judge(proposals, have).select("request_id", "pos", "field", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


def hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    (proposals, raw) = _load(spark, sf_dir, "kyc_proposals", "kyc_lines")
    text = raw.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), "\n").alias("raw_text"))
    return rectify.hallucination(proposals, text)


def audit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    (log,) = _load(spark, sf_dir, "kyc_audit")
    return audit.newest(log).select("request_id", "seq", "decision")


def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    (log,) = _load(spark, sf_dir, "kyc_audit")
    return audit.metrics(log).select("requests_total", "errors_total", "approve", "review", "reject", "p50", "p95", F.col("samples").cast("long").alias("samples"))


def check_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    (profile,) = _load(spark, sf_dir, "kyc_profiles")
    return profile.select("request_id", T.check_pan(F.col("pan")).alias("p"), T.check_aadhaar(F.col("aadhaar")).alias("a")).select("request_id", F.col("p.valid").alias("pan_valid"), "p.holder_type", F.col("a.valid").alias("aadhaar_valid"), "a.last4")


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    (profile,) = _load(spark, sf_dir, "kyc_profiles")
    turned = F.concat_ws(" ", F.substring_index("name", " ", -1), F.substring_index("name", " ", 1))
    return profile.select("request_id", T.same_name(F.col("name"), turned).alias("turned"), T.same_name(F.col("name"), F.concat(F.col("name"), F.lit(" Rao"))).alias("longer"), T.same_name(F.col("name"), F.lit("Quite Other")).alias("other"), *[T.same_name(F.col("name"), F.concat(F.expr(f"left(name, length(name) - {k})"), F.lit("9" * k))).alias(f"off_by_{k}") for k in (2, 3)])


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    (requests,) = _load(spark, sf_dir, "kyc_requests")
    return respond.summary(decide.decide(requests), "decision")


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    (requests,) = _load(spark, sf_dir, "kyc_requests")
    out = decide.decide(requests)
    return out.select("request_id", respond.label(F.lower("document_type")).alias("kind"), respond.tone(F.col("decision")).alias("tone"), F.round(respond.percent(F.col("risk_score")), 6).alias("risk_percent"))


def audit_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    (log,) = _load(spark, sf_dir, "kyc_audit")
    return respond.timing(log, "latency_ms", "decision").withColumns({c: F.round(c, 6) for c in ("min_s", "max_s", "mean_s", "p50_s")})


_WITH = lambda *names: "WITH " + ", ".join(f"{n} AS ({fixtures.ALL[n]})" for n in names)
_RISK = """r AS (SELECT *, least(greatest(0.0::DOUBLE, greatest(
   0.35::DOUBLE * CASE WHEN overall = 'NOT_APPLICABLE' THEN 0.0::DOUBLE ELSE 1 - least(greatest(match_score, 0), 1) END + 0.30::DOUBLE * least(greatest(fraud_score, 0), 1) + 0.10::DOUBLE * (1 - least(greatest(ocr_confidence, 0), 1))
   + 0.15::DOUBLE * least(greatest(hallucination_score, 0), 1) + 0.10::DOUBLE * least(greatest(metadata_suspicion, 0), 1),
   CASE WHEN fraud_verdict = 'LIKELY_AI' THEN 0.95 ELSE 0 END::DOUBLE, CASE overall WHEN 'FAIL' THEN 0.75 WHEN 'MISSING' THEN 0.45 ELSE 0 END::DOUBLE, CASE WHEN hallucination_score >= 0.5 THEN 0.65 ELSE 0 END::DOUBLE)), 1.0::DOUBLE) AS risk_score FROM kyc_requests),
b AS (SELECT *, CASE WHEN risk_score >= 0.85 THEN 'CRITICAL' WHEN risk_score >= 0.60 THEN 'HIGH' WHEN risk_score >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM r),
d AS (SELECT *, CASE WHEN fraud_verdict = 'LIKELY_AI' OR overall = 'FAIL' OR risk_band = 'CRITICAL' THEN 'REJECT' WHEN overall = 'NOT_APPLICABLE' THEN 'REVIEW'
   WHEN llm_recommendation = 'REJECT' AND llm_confidence >= 0.7::DOUBLE THEN 'REJECT'
   WHEN llm_recommendation = 'APPROVE' AND llm_confidence >= 0.7::DOUBLE AND overall = 'PASS' AND fraud_verdict <> 'SUSPICIOUS' AND hallucination_score < 0.3::DOUBLE THEN 'APPROVE'
   WHEN risk_band = 'LOW' AND overall = 'PASS' THEN 'APPROVE' WHEN risk_band = 'HIGH' THEN 'REJECT' ELSE 'REVIEW' END AS decision,
   CASE WHEN file_name LIKE '%aadhaar%' OR file_name LIKE '%aadhar%' THEN 'AADHAAR' WHEN file_name LIKE '%pan%' THEN 'PAN' WHEN file_name LIKE '%passport%' THEN 'PASSPORT' WHEN file_name LIKE '%dl%' OR file_name LIKE '%driving%' THEN 'DRIVING_LICENSE' WHEN file_name LIKE '%gst%' THEN 'GST_CERTIFICATE' END AS named FROM b),
f AS (SELECT *, list_filter([
   CASE WHEN fraud_verdict = 'LIKELY_AI' THEN 'AI_GENERATED/CRITICAL' END, CASE WHEN fraud_verdict = 'SUSPICIOUS' THEN 'POSSIBLE_FORGERY/HIGH' END,
   CASE WHEN regexp_matches(file_name, 'ai_|_ai|ai-gen|generated|diffusion|synth|midjourney|stable_diff|dalle|fake') THEN 'FILENAME_ERROR/HIGH' END,
   CASE WHEN named <> document_type AND document_type <> 'UNKNOWN' THEN 'FILENAME_ERROR/MEDIUM' END,
   CASE WHEN document_type_hint <> document_type AND document_type <> 'UNKNOWN' THEN 'DOCUMENT_TYPE_MISMATCH/MEDIUM' END, CASE WHEN overall = 'NOT_APPLICABLE' THEN 'DYNAMIC_DOCUMENT/MEDIUM' END,
   CASE WHEN blank THEN 'LOW_QUALITY/CRITICAL' END, CASE WHEN too_small THEN 'LOW_QUALITY/HIGH' END, CASE WHEN blurry THEN 'LOW_QUALITY/MEDIUM' END, CASE WHEN glare THEN 'LOW_QUALITY/LOW' END,
   CASE overall WHEN 'FAIL' THEN 'FIELDS_MISMATCH/HIGH' WHEN 'MISSING' THEN 'FIELDS_MISSING/MEDIUM' END,
   CASE WHEN hallucination_score >= 0.5::DOUBLE THEN 'OCR_HALLUCINATION/HIGH' WHEN hallucination_score >= 0.3::DOUBLE THEN 'OCR_HALLUCINATION/MEDIUM' END], lambda x: x IS NOT NULL) AS found FROM d)"""
_TEXTS = "t AS (SELECT request_id, string_agg(text, chr(10) ORDER BY pos) AS t FROM kyc_lines GROUP BY 1)"
_re = lambda col, p: f"regexp_matches({col}, '{p}')"
_bare = lambda p: p.replace("'", "''")
_CLASS = " ".join(
    [f"WHEN {('regexp_matches(t, ' + chr(39) + P.MRZ + chr(39) + ') OR ') if k == 'PASSPORT' else ''}({_re('t', n)} AND {_re('t', w)}) THEN '{k}/1.0'" for k, n, w in (("AADHAAR", P.AADHAAR, P.AADHAAR_WORDS), ("PAN", P.PAN, P.PAN_WORDS), ("PASSPORT", P.PASSPORT, P.PASSPORT_WORDS), ("DRIVING_LICENSE", P.DRIVING, P.DRIVING_WORDS), ("GST_CERTIFICATE", P.GSTIN, P.GST_WORDS))]
    + [f"WHEN {_re('t', P.BANK_WORDS)} THEN 'BANK_STATEMENT/0.75' WHEN {_re('t', P.SALARY_WORDS)} THEN 'SALARY_SLIP/0.75'"]
    + [f"WHEN {_re('t', n)} OR {_re('t', w)} THEN '{k}/0.55'" for k, n, w in (("AADHAAR", P.AADHAAR, P.AADHAAR_WORDS), ("PAN", P.PAN, P.PAN_WORDS), ("PASSPORT", P.PASSPORT, P.PASSPORT_WORDS), ("DRIVING_LICENSE", P.DRIVING, P.DRIVING_WORDS), ("GST_CERTIFICATE", P.GSTIN, P.GST_WORDS))]
)
_KEYED = "regexp_matches(upper(c), '" + "|".join(P.KEYWORDS) + "')"
_IDENT = " OR ".join(_re("c", p) for p in (P.PAN, P.AADHAAR, P.PASSPORT, P.GSTIN, P.BIRTH, P.GENDER_WORD))
_W = lambda p: " ".join(f"WHEN '{c}' THEN {w}" for c, w in P.WEIGHTS[p].items())
_EMPTY_OR = "coalesce(value, '') = ''"
_VERHOEFF = "list_reduce(list_prepend(0, range(0, 12)), lambda a, i: CAST(substr({d}, a * 10 + CAST(substr({p}, (i % 8) * 10 + CAST(substr(reverse(n), i + 1, 1) AS INT) + 1, 1) AS INT) + 1, 1) AS INT))"
_FLAT = {"d": "'" + "".join(str(x) for r in P.VERHOEFF_D for x in r) + "'", "p": "'" + "".join(str(x) for r in P.VERHOEFF_P for x in r) + "'"}

_ADMITTED = f"""{_WITH('kyc_lines')}, c AS (SELECT regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([0-9])[Oo]([0-9])', '\\10\\2', 'g'), '([0-9])[lI]([0-9])', '\\11\\2', 'g'), '([0-9])B([0-9])', '\\18\\2', 'g') AS c, confidence, request_id, pos, x, y FROM kyc_lines),
m AS (SELECT request_id, pos, x, y, c, confidence, {_KEYED} AS k, length(regexp_replace(c, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(c, '[^0-9]', '', 'g')) AS g, greatest(1, length(replace(c, ' ', ''))) AS total FROM c),
a AS (SELECT request_id, pos, x, y, c, CASE WHEN {_IDENT} THEN 'KEPT' WHEN confidence < CASE WHEN k THEN 0.75::DOUBLE * 0.55::DOUBLE ELSE 0.55::DOUBLE END THEN 'LOW_CONFIDENCE' WHEN length(c) < 3 AND NOT k THEN 'TOO_SHORT'
  WHEN (total - l - g)::DOUBLE / total > 0.4::DOUBLE AND NOT k THEN 'SYMBOL_HEAVY' WHEN l = 0 AND g = 0 THEN 'NO_LETTERS' WHEN l BETWEEN 3 AND 8 AND g = 0 AND NOT regexp_matches(c, '[AEIOUaeiou]') AND NOT k THEN 'NO_VOWELS'
  WHEN regexp_matches(c, '{P.GIBBERISH}') AND NOT k THEN 'GIBBERISH' ELSE 'KEPT' END AS code FROM m)"""
#: What the cards were made from, and whether their numbers can be read: a checksum, and no letter that is taken for a digit.
_KEYED_CARDS = f"""WITH p AS ({fixtures.ALL['kyc_profiles']}), k AS (SELECT request_id, {fixtures._KIND.replace('c_custkey', 'request_id')} AS kind, split_part(name, ' ', 1) AS f, split_part(name, ' ', 2) AS l, dob, passport, gstin,
 gstin[3:12] AS pan, gstin[12] NOT IN ('O', 'I', 'B') AS whole, n, {_VERHOEFF.format(**_FLAT)} = 0 AS ok FROM (SELECT *, replace(aadhaar, ' ', '') AS n FROM p))"""
_is = lambda **at: ", ".join(f"{{'field': '{k}', 'value': {v}}}" for k, v in at.items())

QUERIES = {f.__name__: f for f in (verify, decisions_by_kind, reasoner_gate, line_admission, line_stats, reading_order, confidence_rollup, classify, extract_fields, identifiers, validate_fields, general_documents, key_values, fraud_verdicts, metadata_suspicion, rectify_fields, hallucination, audit_newest, audit_metrics, check_identifiers, fuzzy_names, run_summary, display, audit_timing)}
ORACLE_SQL = {
    "verify": f"""{_WITH('kyc_requests')}, {_RISK}
SELECT request_id, round(risk_score, 10) AS risk_score, risk_band, decision,
  CASE WHEN list_contains(found, 'AI_GENERATED/CRITICAL') THEN 'FAKE_AI' WHEN list_contains(found, 'POSSIBLE_FORGERY/HIGH') THEN 'TAMPERED' WHEN list_contains(found, 'FILENAME_ERROR/HIGH') THEN 'FILENAME_SUSPECT'
    WHEN list_has_any(found, ['LOW_QUALITY/HIGH', 'LOW_QUALITY/CRITICAL']) THEN 'LOW_QUALITY' WHEN list_has_any(found, ['FIELDS_MISMATCH/HIGH', 'OCR_HALLUCINATION/HIGH', 'OCR_HALLUCINATION/MEDIUM']) THEN 'DATA_MISMATCH'
    WHEN overall = 'PASS' AND risk_band = 'LOW' AND fraud_verdict = 'LIKELY_AUTHENTIC' THEN 'AUTHENTIC' ELSE 'NEEDS_REVIEW' END AS status,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda x: split_part(x, '/', 1)))), ','), '') AS categories, len(found)::BIGINT AS n_findings FROM f""",
    "decisions_by_kind": f"{_WITH('kyc_requests')}, {_RISK} SELECT document_type, risk_band, decision, count(*) AS n FROM d GROUP BY ALL",
    "run_summary": f"{_WITH('kyc_requests')}, {_RISK} SELECT count(*) FILTER (decision = 'APPROVE') AS approve, count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'REJECT') AS reject, count(*) AS results FROM d",
    "display": f"""{_WITH('kyc_requests')}, {_RISK} SELECT request_id, array_to_string(list_transform(string_split(lower(document_type), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS kind,
  CASE decision WHEN 'APPROVE' THEN 'success' WHEN 'REJECT' THEN 'danger' ELSE 'warning' END AS tone, round(least(greatest(risk_score * 100, 0::DOUBLE), 100::DOUBLE), 6) AS risk_percent FROM d""",
    "audit_timing": f"{_WITH('kyc_audit')} SELECT decision, count(latency_ms) AS runs, round(min(latency_ms)::DOUBLE, 6) AS min_s, round(max(latency_ms)::DOUBLE, 6) AS max_s, round(avg(latency_ms), 6) AS mean_s, round(median(latency_ms), 6) AS p50_s FROM kyc_audit GROUP BY 1",
    "reasoner_gate": f"""{_WITH('kyc_requests')} SELECT CASE WHEN fraud_verdict = 'LIKELY_AI' THEN 'hard reject path (fraud LIKELY_AI)' WHEN overall = 'FAIL' THEN 'hard reject path (validation FAIL)'
 WHEN overall = 'PASS' AND fraud_verdict = 'LIKELY_AUTHENTIC' AND ocr_confidence >= 0.85::DOUBLE THEN 'clean approve path (no ambiguity to resolve)' WHEN overall <> 'MISSING' THEN 'no missing required fields' ELSE 'sent' END AS reason, count(*) AS n FROM kyc_requests GROUP BY 1""",
    "line_admission": f"""{_ADMITTED} SELECT code, count(*) AS n FROM a GROUP BY 1""",
    "line_stats": f"""{_ADMITTED}, d AS (SELECT request_id, code = 'KEPT' AND row_number() OVER (PARTITION BY request_id, code = 'KEPT', upper(c), round_even(y / 10, 0) ORDER BY y, x, pos) = 1 AS kept FROM a)
SELECT request_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS rejected FROM d GROUP BY 1""",
    "reading_order": f"""WITH RECURSIVE kyc_lines AS ({fixtures.ALL['kyc_lines']}), s AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY y, x, pos) AS i FROM kyc_lines),
b AS (SELECT request_id, greatest(8.0::DOUBLE, 0.5::DOUBLE * list_sort(list(h))[len(list(h)) // 2 + 1]) AS band FROM s GROUP BY 1),
f AS (SELECT request_id, i, pos, x, y, y AS mid, 1 AS r FROM s WHERE i = 1 UNION ALL
 SELECT s.request_id, s.i, s.pos, s.x, s.y, CASE WHEN abs(s.y - f.mid) > band THEN s.y ELSE (f.mid + s.y) / 2 END, f.r + CASE WHEN abs(s.y - f.mid) > band THEN 1 ELSE 0 END FROM f JOIN s ON s.request_id = f.request_id AND s.i = f.i + 1 JOIN b ON b.request_id = s.request_id)
SELECT request_id, pos, row_number() OVER (PARTITION BY request_id ORDER BY r, x, y, pos) - 1 AS ord FROM f""",
    "hallucination": f"""{_WITH('kyc_proposals', 'kyc_lines')}, {_TEXTS}, j AS (SELECT p.request_id, greatest(coalesce(confidence, 0), 0.1::DOUBLE) AS w, lower(trim(value)) AS v, coalesce(lower(regexp_replace(t, '\\s+', ' ', 'g')), '') AS t FROM kyc_proposals p LEFT JOIN t USING (request_id) WHERE trim(coalesce(value, '')) <> ''),
q AS (SELECT *, regexp_replace(t, '[^a-z0-9]', '', 'g') AS flat, regexp_replace(v, '[^a-z0-9]', '', 'g') AS vf, list_filter(regexp_split_to_array(v, '[^a-z0-9]+'), lambda s: length(s) >= 2) AS parts FROM j),
m AS (SELECT request_id, w, CASE WHEN contains(t, v) OR (vf <> '' AND contains(flat, vf)) THEN 0 WHEN len(parts) = 0 THEN 1 ELSE len(list_filter(parts, lambda s: NOT contains(flat, s)))::DOUBLE / len(parts) END AS miss FROM q)
SELECT request_id, round_even(sum(w * miss) / sum(w), 3) AS hallucination_score FROM m GROUP BY 1""",
    "extract_fields": f"""{_KEYED_CARDS} SELECT request_id, document_type, e.field, e.value FROM (SELECT request_id, kind AS document_type, unnest(CASE kind
 WHEN 'PAN' THEN [{_is(pan_number='pan', father_name="'Dev ' || l", name="f || ' ' || l", dob='dob')}]
 WHEN 'AADHAAR' THEN [{_is(name="f || ' ' || l", dob='dob', gender="CASE request_id % 2 WHEN 0 THEN 'MALE' ELSE 'FEMALE' END", aadhaar_last4="CASE WHEN ok THEN right(n, 4) END", masked_aadhaar="CASE WHEN ok THEN 'XXXX XXXX ' || right(n, 4) END")}]
 WHEN 'PASSPORT' THEN [{_is(passport_number='passport', surname='l', given_name='f', nationality="'IND'", dob='dob', name="f || ' ' || l")}]
 WHEN 'DRIVING_LICENSE' THEN [{_is(driving_license_number="'MH122011' || substr(passport, 2)", name="f || ' ' || l", dob='dob')}]
 WHEN 'GST_CERTIFICATE' THEN [{_is(gstin="CASE WHEN whole THEN gstin END", legal_name="f || ' Traders'", trade_name="l || ' Stores'", name="f || ' Traders'")}] END) AS e FROM k) WHERE e.value IS NOT NULL""",
    "validate_fields": f"""{_KEYED_CARDS}, v AS (SELECT request_id, kind, CASE kind WHEN 'PAN' THEN 3 WHEN 'AADHAAR' THEN 3 WHEN 'PASSPORT' THEN 3 WHEN 'DRIVING_LICENSE' THEN CASE WHEN request_id % 3 = 0 THEN 2 ELSE 3 END WHEN 'GST_CERTIFICATE' THEN 1 ELSE 0 END AS total,
 CASE kind WHEN 'PAN' THEN CASE WHEN request_id % 5 = 0 THEN 'FAIL' ELSE 'PASS' END WHEN 'AADHAAR' THEN CASE WHEN ok THEN 'PASS' ELSE 'MISSING' END WHEN 'PASSPORT' THEN 'PASS' WHEN 'DRIVING_LICENSE' THEN 'PASS' WHEN 'GST_CERTIFICATE' THEN CASE WHEN whole THEN 'PASS' ELSE 'MISSING' END ELSE 'NOT_APPLICABLE' END AS overall FROM k),
w AS (SELECT *, total - CASE WHEN overall IN ('FAIL', 'MISSING') THEN 1 ELSE 0 END AS passed FROM v)
SELECT request_id, kind AS document_type, overall, CASE WHEN total = 0 THEN 0 ELSE round(passed / total, 6) END::DOUBLE AS match_score, passed AS required_passed, total AS required_total, CASE kind WHEN 'AADHAAR' THEN 1 ELSE 0 END AS optional_passed, CASE WHEN kind IN ('AADHAAR', 'GST_CERTIFICATE') THEN 1 ELSE 0 END AS optional_total FROM w""",
    "confidence_rollup": f"{_WITH('kyc_lines')} SELECT request_id, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, min(confidence) AS least, count(*) FILTER (confidence < 0.70::DOUBLE) AS low, count(*) FILTER (confidence < 0.55::DOUBLE) AS suspicious FROM kyc_lines GROUP BY 1",
    "classify": f"{_WITH('kyc_lines')}, {_TEXTS}, k AS (SELECT request_id, CASE {_CLASS} ELSE 'UNKNOWN/0.0' END AS k FROM t) SELECT request_id, split_part(k, '/', 1) AS document_type, CAST(split_part(k, '/', 2) AS DOUBLE) AS confidence FROM k",
    "identifiers": f"""{_WITH('kyc_lines')}, {_TEXTS}, u AS (SELECT request_id, regexp_replace(regexp_replace(regexp_replace(t, '([0-9])[Oo]([0-9])', '\\10\\2', 'g'), '([0-9])[lI]([0-9])', '\\11\\2', 'g'), '([0-9])B([0-9])', '\\18\\2', 'g') AS t FROM t),
k AS (SELECT request_id, upper(t) AS t, split_part(CASE {_CLASS} ELSE 'UNKNOWN/0' END, '/', 1) AS k FROM u),
v AS (SELECT request_id, CASE k WHEN 'PAN' THEN 'pan_number' WHEN 'PASSPORT' THEN 'passport_number' WHEN 'DRIVING_LICENSE' THEN 'driving_license_number' WHEN 'GST_CERTIFICATE' THEN 'gstin' END AS field,
  CASE k WHEN 'PAN' THEN regexp_extract(t, '{P.PAN}') WHEN 'PASSPORT' THEN regexp_extract(t, '{P.PASSPORT}') WHEN 'DRIVING_LICENSE' THEN regexp_replace(regexp_extract(t, '{P.DRIVING}'), '[-\\s]', '', 'g') WHEN 'GST_CERTIFICATE' THEN regexp_extract(t, '{P.GSTIN}') END AS value FROM k)
SELECT request_id, field, value FROM v WHERE field IS NOT NULL AND value <> ''""",
    "general_documents": f"""{_WITH('kyc_lines')}, k AS (SELECT request_id, pos, CASE {' '.join(f"WHEN regexp_matches(lower(text), '{'|'.join(ws)}') THEN '{a}/{b}/{c}'" for a, b, c, ws in P.GENERAL)} WHEN trim(text) <> '' THEN 'Unknown Document/OTHER/0.2' ELSE 'Unknown Document/OTHER/0.0' END AS k FROM kyc_lines)
SELECT request_id, pos, split_part(k, '/', 1) AS label, split_part(k, '/', 2) AS category, CAST(split_part(k, '/', 3) AS DOUBLE) AS confidence FROM k""",
    "key_values": f"""{_WITH('kyc_lines')}, p AS (SELECT request_id, pos, trim(regexp_replace(regexp_replace(lower(trim(regexp_extract(text, '{P.KEY_VALUE}', 1))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS key, trim(regexp_extract(text, '{P.KEY_VALUE}', 2), ' :-') AS v
 FROM kyc_lines WHERE regexp_matches(text, '{P.KEY_VALUE}')) SELECT request_id, key, string_agg(v, '|' ORDER BY pos) AS vals FROM p WHERE v <> '' AND (length(key) >= 3 OR key = 'no') GROUP BY ALL""",
    "fraud_verdicts": f"""{_WITH('kyc_signals')}, w AS (SELECT request_id, document_type, score, coalesce(CAST(CASE WHEN document_type = 'AADHAAR' THEN CASE code {_W('AADHAAR')} END ELSE CASE code {_W('default')} END END AS DOUBLE), 0) AS w FROM kyc_signals),
a AS (SELECT request_id, document_type, sum(score * w) / (CASE WHEN sum(w) = 0 THEN 1 ELSE sum(w) END) AS s, count(*) FILTER (score >= 0.5::DOUBLE) AS n FROM w GROUP BY ALL)
SELECT request_id, round(s, 10) AS fraud_score, CASE WHEN s >= CASE document_type WHEN 'AADHAAR' THEN 0.55::DOUBLE ELSE 0.62::DOUBLE END THEN 'LIKELY_AI' WHEN s >= CASE document_type WHEN 'AADHAAR' THEN 0.35::DOUBLE ELSE 0.40::DOUBLE END THEN 'SUSPICIOUS' ELSE 'LIKELY_AUTHENTIC' END AS fraud_verdict, n AS n_triggered FROM a""",
    "metadata_suspicion": f"""{_WITH('kyc_signals')} SELECT request_id, round_even(sum(score * CASE code WHEN 'METADATA' THEN 0.28::DOUBLE ELSE 0.10::DOUBLE END), 3) AS metadata_suspicion, coalesce(string_agg(code, ',' ORDER BY code) FILTER (score >= 0.5::DOUBLE), '') AS codes
FROM kyc_signals WHERE code IN ('METADATA', 'JPEG_HISTORY') GROUP BY 1""",
    "rectify_fields": f"""{_WITH('kyc_proposals')}, j AS (SELECT *, CASE WHEN coalesce(field, '') = '' OR {_EMPTY_OR} THEN 'empty' WHEN confidence < 0.65::DOUBLE THEN 'below floor' WHEN field = 'dob' AND request_id % 3 = 0 THEN 'already extracted' END AS reason FROM kyc_proposals)
SELECT request_id, pos, field, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY request_id, field, reason IS NULL ORDER BY pos) > 1 THEN 'already extracted' ELSE coalesce(reason, 'accepted') END AS outcome FROM j""",
    "audit_newest": f"{_WITH('kyc_audit')} SELECT request_id, seq, decision FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, seq DESC) AS rn FROM kyc_audit) WHERE rn = 1",
    "audit_metrics": f"""{_WITH('kyc_audit')}, l AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS i, count(*) OVER () AS n FROM (SELECT latency_ms FROM kyc_audit ORDER BY created_at DESC, seq DESC LIMIT 512))
SELECT (SELECT count(*) FROM kyc_audit) AS requests_total, (SELECT count(*) FROM kyc_audit WHERE errored) AS errors_total, (SELECT count(*) FROM kyc_audit WHERE decision = 'APPROVE') AS approve, (SELECT count(*) FROM kyc_audit WHERE decision = 'REVIEW') AS review,
 (SELECT count(*) FROM kyc_audit WHERE decision = 'REJECT') AS reject, round((SELECT median(latency_ms) FROM l), 1) AS p50, round((SELECT latency_ms FROM l WHERE i = 1 + floor(0.95 * (n - 1))), 1) AS p95, (SELECT count(*) FROM l) AS samples""",
    "check_identifiers": f"""{_WITH('kyc_profiles')}, n AS (SELECT request_id, pan, regexp_replace(aadhaar, '\\D', '', 'g') AS n FROM kyc_profiles)
SELECT request_id, regexp_matches(pan, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') AND strpos('PCHFATBLJG', substr(pan, 4, 1)) > 0 AS pan_valid, CASE substr(pan, 4, 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.HOLDERS.items())} END AS holder_type,
 NOT regexp_matches(n, '^[01]') AND {_VERHOEFF.format(**_FLAT)} = 0 AS aadhaar_valid, right(n, 4) AS last4 FROM n""",
    "fuzzy_names": f"{_WITH('kyc_profiles')} SELECT request_id, TRUE AS turned, TRUE AS longer, FALSE AS other, 200.0 * (length(name) - 2) / (2 * length(name)) >= 85 AS off_by_2, 200.0 * (length(name) - 3) / (2 * length(name)) >= 85 AS off_by_3 FROM kyc_profiles",
}
