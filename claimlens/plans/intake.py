"""Queries over what recognisers and reasoners return, derived from keys like the other inputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import intake
from . import fixtures
from .verification import _CLASS, _WITH, _load

_K = "CAST(c_custkey AS STRING)"
_S = "CAST(c_custkey % 7 AS STRING)"
_POLY = f"'[[0,0],[1' || {_S} || ',0],[1' || {_S} || ',5],[0,5.5]]'"
#: Pages as parallel lists: boxes under each of three names, a score that is none, lists of unequal length, a broken box.
LISTS = f"""SELECT c_custkey AS request_id, '[' || CASE WHEN c_custkey % 2 = 0 THEN '{{"res": ' ELSE '' END
  || '{{"rec_texts": ["line ' || {_K} || '", "second", "third", "fourth"], "rec_scores": [0.' || {_S} || ', ' || CASE c_custkey % 3 WHEN 0 THEN '"bad"' WHEN 1 THEN '"0.75"' ELSE 'null' END || ', 1' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ', 0.5' END || '], '
  || CASE c_custkey % 5 WHEN 0 THEN '"rec_polys": [], "dt_polys": ' WHEN 1 THEN '"rec_polys": null, "rec_boxes": ' ELSE '"rec_boxes": [[9,9,9,9]], "rec_polys": ' END
  || '[' || {_POLY} || ', [9,8,3,' || {_S} || '], [[4,1],[2,6],[3,' || {_S} || ']], ' || CASE WHEN c_custkey % 6 = 0 THEN '[1,2,3]' ELSE '[7,7]' END || ']}}'
  || CASE WHEN c_custkey % 2 = 0 THEN '}}' ELSE '' END || ']' AS raw FROM customer"""
#: Pages as pairs of box and payload: a pair, a text alone, a score that is none, a payload that is too short.
PAIRS = f"""SELECT c_custkey AS request_id, CASE WHEN c_custkey % 9 = 0 THEN '[]' ELSE '[[[' || {_POLY} || ', ["line ' || {_K} || '", 0.' || {_S} || ']], [[1,2,3,4], "alone ' || {_S} || '"], [[1,2,3,4], ["x", ' || CASE c_custkey % 3 WHEN 0 THEN '"no"' ELSE '"0.25"' END || ']], [[5,6], ["y"]]], [[[0,0,1,1], ["next page", 1]]]]' END AS raw FROM customer"""
REVIEWS = f"""SELECT c_custkey AS request_id, CASE c_custkey % 8 WHEN 0 THEN '{{}}' WHEN 1 THEN 'not json' WHEN 2 THEN '{{"recommendation": "approve", "confidence": "0.' || {_S} || '", "reasoning": "fine", "concerns": ["a", "", null, "b"]}}'
  WHEN 3 THEN '{{"recommendation": "maybe", "confidence": 0.5, "reasoning": null}}' WHEN 4 THEN '{{"recommendation": "REJECT", "confidence": "high"}}' WHEN 5 THEN '{{"recommendation": null, "confidence": 1, "concerns": []}}'
  WHEN 6 THEN '{{"confidence": null}}' ELSE '{{"recommendation": "Reject", "confidence": 0.9, "reasoning": "' || repeat('xy', 400) || '", "concerns": ["' || repeat('z', 300) || '"]}}' END AS raw FROM customer"""
OFFERS = f"""SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"rectifications": []}}' ELSE '{{"rectifications": [{{"field": "name", "value": "V ' || {_K} || '", "confidence": 0.' || {_S} || ', "source": "' || repeat('s', 250) || '"}}, {{"field": "dob"}}, {{"field": "dob", "value": null}}, {{"field": "pan", "value": 12, "confidence": "x"}}, {{"field": "gender", "value": "M", "confidence": "0.5"}}]}}' END AS raw FROM customer"""
ANALYSES = f"""SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"document_type_label": "", "confidence": 1' || {_S} || ', "summary": "' || repeat('w', 900) || '"}}'
  WHEN 2 THEN '{{"document_type_label": "Utility Bill", "document_category": "BILL", "confidence": "0.4", "visual_concerns": ["blur", "", null], "extraction_notes": ["n"]}}' ELSE '{{"confidence": "none", "document_category": null}}' END AS raw FROM customer"""
CHECKS = """SELECT c_custkey AS request_id, f.field AS field, (c_custkey + f.i) % 3 <> 0 AS required, CASE (c_custkey + f.i) % 4 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'MATCH' WHEN 2 THEN 'MISSING' ELSE 'MISMATCH' END AS status
FROM customer CROSS JOIN (SELECT 'name' AS field, 0 AS i UNION ALL SELECT 'dob', 1 UNION ALL SELECT 'pan', 2 UNION ALL SELECT 'gender', 4) f"""
#: The text of a request, on every second one with a sign of another kind, on every sixth with a kind that was asked for.
_TOLD = f"""SELECT request_id, string_agg(text, chr(10) ORDER BY pos) || CASE WHEN request_id % 2 = 0 THEN chr(10) || 'Permanent Account Number' ELSE '' END AS t, CASE WHEN request_id % 6 = 0 THEN 'PAN' END AS hint FROM ({fixtures.LINES}) l GROUP BY request_id"""


def _read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    _load(spark, sf_dir)
    return spark.sql(sql)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_TOLD in DataFrame operations."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), "\n")
    more = F.when(F.col("request_id") % 2 == 0, F.lit("\nPermanent Account Number")).otherwise("")
    return _load(spark, sf_dir, "kyc_lines")[0].groupBy("request_id").agg(text.alias("t")).select("request_id", F.concat("t", more).alias("t"), F.when(F.col("request_id") % 6 == 0, "PAN").alias("hint"))


def _flat(lines: DataFrame) -> DataFrame:
    corner = lambda i, c: F.get("bbox", i).getField(c).alias(f"{c}{i}")
    return lines.select("request_id", F.col("page").cast("long").alias("page"), F.col("pos").cast("long").alias("pos"), "text", "confidence", *[corner(i, c) for i in (0, 1, 2, 3) for c in "xy"])


def recognized_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(intake.recognized_lists(_read(spark, sf_dir, LISTS), "request_id", "raw"))


def recognized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(intake.recognized_pairs(_read(spark, sf_dir, PAIRS), "request_id", "raw"))


def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intake.reclassified(F.col("t"), F.col("hint"))
    return _told(spark, sf_dir).select("request_id", out.alias("k")).select("request_id", "k.document_type", "k.confidence")


def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.missing_required(_read(spark, sf_dir, CHECKS)).select("request_id", F.array_join("fields", ",").alias("fields"))


def sanitized_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _read(spark, sf_dir, REVIEWS).select("request_id", intake.review(F.col("raw")).alias("r"))
    return made.where("r is not null").select("request_id", "r.recommendation", "r.confidence", F.length("r.reasoning").cast("long").alias("n_reasoning"), F.substring("r.reasoning", 1, 8).alias("reasoning"), F.array_join("r.concerns", ",").alias("concerns"))


def sanitized_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _read(spark, sf_dir, OFFERS).select("request_id", F.explode(intake.proposals(F.col("raw"))).alias("r"))
    return made.select("request_id", "r.field", "r.value", "r.confidence", F.length("r.source").cast("long").alias("n_source"))


def coerced_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _read(spark, sf_dir, ANALYSES).select("request_id", intake.analysis(F.col("raw"), F.lit("Invoice"), F.lit("FINANCE"), F.lit(0.7), intake.heuristic_summary(F.lit("Invoice"))).alias("a"))
    return made.select("request_id", "a.label", "a.category", "a.confidence", F.length("a.summary").cast("long").alias("n_summary"), F.array_join("a.concerns", ",").alias("concerns"), F.array_join("a.notes", ",").alias("notes"))


def state_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _load(spark, sf_dir, "kyc_requests")[0].withColumns({"raw_text": F.expr("repeat('abc ', 500)"), "risk_score": F.lit(0.25), "risk_band": F.lit("LOW")})
    at = lambda p: F.get_json_object("digest", p)
    return intake.digest(states).select("request_id", at("$.document_type").alias("document_type"), at("$.validation.overall").alias("overall"), at("$.fraud.verdict").alias("verdict"), at("$.risk.band").alias("band"), F.length(at("$.ocr_text_snippet")).cast("long").alias("n_text"))


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _load(spark, sf_dir, "kyc_lines")[0].groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]).alias("lines"))
    return lines.select("request_id", intake.name_candidate(F.col("lines")).alias("name"))


def console_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.console_pairs(_told(spark, sf_dir), "request_id", "t").select("request_id", "key", F.array_join("values", "|").alias("vals"))


def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir).select("request_id", F.array_join(intake.preview(F.col("t"), 4), "|").alias("preview"))


_NUMS = "list_transform(regexp_extract_all({p}::VARCHAR, '-?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?'), lambda s: s::DOUBLE)"
_CORNERS = ", ".join(
    f"CASE len(v) WHEN 8 THEN v[{2 * i + j + 1}] WHEN 4 THEN v[{w4}] ELSE {agg}(list_filter(v, lambda e, k: k % 2 = {1 - j})) END AS {c}{i}"
    for i in range(4)
    for j, c in enumerate("xy")
    for w4, agg in [((1, 2, 3, 4)[[(0, 1), (2, 1), (2, 3), (0, 3)][i][j]], ("list_min", "list_max")[[(0, 0), (1, 0), (1, 1), (0, 1)][i][j]])]
)
_FLAT_SQL = f"SELECT request_id, page, pos, text, confidence, {_CORNERS} FROM e WHERE text IS NOT NULL AND confidence IS NOT NULL AND len(v) > 0 AND len(v) % 2 = 0"
_GENERAL = " ".join(f"WHEN regexp_matches(lower(t), '{'|'.join(ws)}') THEN '{a}/{c}'" for a, b, c, ws in P.GENERAL)
_LABELED = lambda kinds: "regexp_matches(lower(label), '" + "|".join(w for k in kinds for w in P.LABEL_WORDS[k]) + "')"
_JSON_LIST = "list_filter(list_transform({j}::JSON[], lambda c: c ->> '$'), lambda c: c IS NOT NULL AND c <> '')"
_NAMELIKE = "len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: NOT regexp_full_match(w, '[A-Za-z][A-Za-z.''-]+') OR upper(w) IN (" + ", ".join(f"'{w}'" for w in P.NOT_NAMES) + "))) = 0 AND len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) BETWEEN 2 AND 4"

QUERIES = {f.__name__: f for f in (recognized_lists, recognized_pairs, reclassified, missing_required, sanitized_reviews, sanitized_proposals, coerced_analyses, state_digests, name_candidates, console_pairs, text_previews)}
ORACLE_SQL = {
    "recognized_lists": f"""WITH r AS (SELECT request_id, raw::JSON AS j FROM ({LISTS})), d AS (SELECT request_id, CASE WHEN (j -> '$[0].res') IS NOT NULL THEN j -> '$[0].res' ELSE j -> '$[0]' END AS d FROM r),
b AS (SELECT request_id, d, CASE WHEN json_array_length(d -> 'rec_polys') > 0 THEN d -> 'rec_polys' WHEN json_array_length(d -> 'dt_polys') > 0 THEN d -> 'dt_polys' ELSE d -> 'rec_boxes' END AS p FROM d),
i AS (SELECT request_id, d, p, unnest(range(least(json_array_length(d -> 'rec_texts'), json_array_length(d -> 'rec_scores'), json_array_length(p))::BIGINT)) AS pos FROM b),
e AS (SELECT request_id, 0::BIGINT AS page, pos, d ->> ('$.rec_texts[' || pos || ']') AS text, TRY_CAST(d ->> ('$.rec_scores[' || pos || ']') AS DOUBLE) AS confidence, {_NUMS.format(p="(p -> ('$[' || pos || ']'))")} AS v FROM i) {_FLAT_SQL}""",
    "recognized_pairs": f"""WITH r AS (SELECT request_id, raw::JSON AS j FROM ({PAIRS})), i AS (SELECT request_id, j, unnest(range(json_array_length(j -> '$[0]')::BIGINT)) AS pos FROM r WHERE json_array_length(j) > 0),
x AS (SELECT request_id, pos, j -> ('$[0][' || pos || '][0]') AS box, j -> ('$[0][' || pos || '][1]') AS pay FROM i),
e AS (SELECT request_id, 0::BIGINT AS page, pos, CASE WHEN json_type(pay) = 'ARRAY' THEN pay ->> '$[0]' ELSE pay ->> '$' END AS text, CASE WHEN json_type(pay) = 'ARRAY' THEN TRY_CAST(pay ->> '$[1]' AS DOUBLE) ELSE 1 END AS confidence, {_NUMS.format(p="box")} AS v FROM x) {_FLAT_SQL}""",
    "reclassified": f"""WITH t AS ({_TOLD}), k AS (SELECT *, CASE {_CLASS} ELSE CASE WHEN hint IS NOT NULL THEN hint || '/0.0' ELSE 'UNKNOWN/0.0' END END AS k, CASE {_GENERAL} ELSE NULL END AS g FROM t),
s AS (SELECT request_id, hint, split_part(k, '/', 1) AS kind, CAST(split_part(k, '/', 2) AS DOUBLE) AS c, regexp_replace(g, '/[0-9.]+$', '') AS label, CAST(regexp_extract(g, '/([0-9.]+)$', 1) AS DOUBLE) AS gc FROM k),
o AS (SELECT *, coalesce(hint IS NULL AND c < 1 AND kind IN ('PAN', 'AADHAAR', 'PASSPORT', 'DRIVING_LICENSE', 'GST_CERTIFICATE') AND lower(label) NOT IN ('', 'unknown', 'unknown document', 'document') AND NOT {_LABELED(P.LABEL_WORDS)}, FALSE) AS other FROM s)
SELECT request_id, CASE WHEN other THEN 'UNKNOWN' ELSE kind END AS document_type, CASE WHEN other THEN greatest(c, gc) ELSE c END AS confidence FROM o""",
    "missing_required": f"SELECT request_id, string_agg(field, ',' ORDER BY field) AS fields FROM ({CHECKS}) WHERE required AND status = 'MISSING' GROUP BY 1",
    "sanitized_reviews": f"""WITH j AS (SELECT request_id, TRY_CAST(raw AS JSON) AS j FROM ({REVIEWS}) WHERE json_valid(raw)),
f AS (SELECT request_id, j, CASE WHEN list_contains(json_keys(j), 'confidence') THEN TRY_CAST(j ->> 'confidence' AS DOUBLE) ELSE 0 END AS confidence, upper(CASE WHEN list_contains(json_keys(j), 'recommendation') THEN coalesce(j ->> 'recommendation', 'None') ELSE 'REVIEW' END) AS rec,
  left(CASE WHEN list_contains(json_keys(j), 'reasoning') THEN coalesce(j ->> 'reasoning', 'None') ELSE '' END, 600) AS why FROM j)
SELECT request_id, CASE WHEN rec IN ('APPROVE', 'REVIEW', 'REJECT') THEN rec ELSE 'REVIEW' END AS recommendation, confidence, length(why) AS n_reasoning, left(why, 8) AS reasoning,
  coalesce(array_to_string(list_transform({_JSON_LIST.format(j="coalesce(j -> 'concerns', '[]'::JSON)")}, lambda c: left(c, 200)), ','), '') AS concerns FROM f WHERE confidence IS NOT NULL""",
    "sanitized_proposals": f"""WITH j AS (SELECT request_id, unnest((raw::JSON -> 'rectifications')::JSON[]) AS r FROM ({OFFERS})), f AS (SELECT request_id, r, CASE WHEN list_contains(json_keys(r), 'confidence') THEN TRY_CAST(r ->> 'confidence' AS DOUBLE) ELSE 0 END AS confidence FROM j)
SELECT request_id, coalesce(r ->> 'field', 'None') AS field, coalesce(r ->> 'value', 'None') AS value, confidence, length(left(coalesce(r ->> 'source', ''), 200)) AS n_source FROM f WHERE list_has_all(json_keys(r), ['field', 'value']) AND confidence IS NOT NULL""",
    "coerced_analyses": f"""WITH j AS (SELECT request_id, raw::JSON AS j FROM ({ANALYSES})) SELECT request_id, coalesce(nullif(j ->> 'document_type_label', ''), 'Invoice') AS label, coalesce(nullif(j ->> 'document_category', ''), 'FINANCE') AS category,
  least(greatest(coalesce(TRY_CAST(j ->> 'confidence' AS DOUBLE), 0.7), 0), 1)::DOUBLE AS confidence, length(left(coalesce(nullif(j ->> 'summary', ''), 'Document appears to be Invoice.'), 800)) AS n_summary,
  coalesce(array_to_string({_JSON_LIST.format(j="coalesce(j -> 'visual_concerns', '[]'::JSON)")}, ','), '') AS concerns, coalesce(array_to_string({_JSON_LIST.format(j="coalesce(j -> 'extraction_notes', '[]'::JSON)")}, ','), '') AS notes FROM j""",
    "state_digests": f"{_WITH('kyc_requests')} SELECT request_id, document_type, overall, fraud_verdict AS verdict, 'LOW' AS band, 1500 AS n_text FROM kyc_requests",
    "name_candidates": f"""{_WITH('kyc_lines')}, m AS (SELECT request_id, pos, text, contains(upper(text), 'NAME') AND length(text) < 32 AS label, {_NAMELIKE} AS named FROM kyc_lines),
w AS (SELECT *, min(CASE WHEN label THEN pos END) OVER (PARTITION BY request_id) AS label_at FROM m), c AS (SELECT request_id, coalesce(min_by(text, pos) FILTER (named AND NOT label AND pos > label_at), min_by(text, pos) FILTER (named AND NOT label)) AS n FROM w GROUP BY 1)
SELECT request_id, array_to_string(list_transform(string_split(n, ' '), lambda s: upper(s[1]) || lower(s[2:])), ' ') AS name FROM c""",
    "console_pairs": f"""WITH t AS ({_TOLD}), l AS (SELECT request_id, string_split(t, chr(10)) AS ls FROM t), r AS (SELECT request_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
p AS (SELECT request_id, pos, regexp_replace(regexp_replace(lower(trim(regexp_extract(line, '{intake.CONSOLE_PAIR}', 1))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, trim(regexp_extract(line, '{intake.CONSOLE_PAIR}', 2)) AS v FROM r WHERE regexp_matches(line, '{intake.CONSOLE_PAIR}'))
SELECT request_id, key, string_agg(v, '|' ORDER BY pos) AS vals FROM p WHERE key <> '' AND v <> '' GROUP BY ALL""",
    "text_previews": f"WITH t AS ({_TOLD}) SELECT request_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')[1:4], '|') AS preview FROM t",
}
