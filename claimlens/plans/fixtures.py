"""Verification inputs derived from the business tables.

The given tables hold no identity documents, so requests, lines, profiles, signals,
proposals and audit events are derived from keys by integer arithmetic, in SQL that
Spark and other engines read alike.
"""

from __future__ import annotations

_D = "CAST({} AS DOUBLE)"
_KIND = "CASE c_custkey % 7 WHEN 0 THEN 'PAN' WHEN 1 THEN 'AADHAAR' WHEN 2 THEN 'PASSPORT' WHEN 3 THEN 'DRIVING_LICENSE' WHEN 4 THEN 'GST_CERTIFICATE' WHEN 5 THEN 'BANK_STATEMENT' ELSE 'UNKNOWN' END"
_L = lambda k: f"chr(CAST(65 + (c_custkey * {k}) % 26 AS INT))"
_FIRST = f"({_L(1)} || 'avin' || lower({_L(3)}) || 'u')"
_LAST = f"({_L(5)} || 'hett' || lower({_L(7)}) || 'n')"
_PAN = f"({_L(1)} || {_L(3)} || {_L(5)} || 'P' || {_L(7)} || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || {_L(11)})"
#: A zero between digits, read as the letter, on every third card.
_MISREAD = f"CASE WHEN c_custkey % 3 = 0 THEN substr({_PAN}, 1, 6) || replace(substr({_PAN}, 7, 1), '0', 'o') || substr({_PAN}, 8) ELSE {_PAN} END"
_DAY, _MONTH, _YEAR = "lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')", "lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0')", "CAST(1950 + c_custkey % 55 AS STRING)"
_TWELVE = "lpad(CAST((c_custkey * 7919 + 234567) % 10000 AS STRING), 4, '2') || ' ' || lpad(CAST((c_custkey * 104729) % 10000 AS STRING), 4, '0') || ' ' || lpad(CAST((c_custkey * 31 + 17) % 10000 AS STRING), 4, '0')"

REQUESTS = f"""
SELECT c_custkey AS request_id, {_KIND} AS document_type,
  CASE c_custkey % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'NOT_APPLICABLE' ELSE 'PASS' END AS overall,
  {_D.format('(c_custkey * 31) % 5')} / 4 AS match_score, {_D.format('(c_custkey * 53) % 101')} / 100 AS ocr_confidence,
  {_D.format('(c_custkey * 17) % 97')} / 128 AS fraud_score,
  CASE WHEN (c_custkey * 17) % 97 >= 80 THEN 'LIKELY_AI' WHEN (c_custkey * 17) % 97 >= 52 THEN 'SUSPICIOUS' ELSE 'LIKELY_AUTHENTIC' END AS fraud_verdict,
  {_D.format('(c_custkey * 13) % 50')} / 64 AS hallucination_score, {_D.format('(c_custkey * 7) % 40')} / 100 AS metadata_suspicion,
  CASE c_custkey % 4 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'REVIEW' END AS llm_recommendation,
  {_D.format('(c_custkey * 3) % 11')} / 10 AS llm_confidence,
  CASE c_custkey % 9 WHEN 0 THEN 'company_pan.jpg' WHEN 1 THEN 'ai_card.png' WHEN 2 THEN 'passport.png' WHEN 3 THEN 'scan.jpg' WHEN 4 THEN 'aadhar_fake.png' ELSE 'upload.pdf' END AS file_name,
  CASE WHEN c_custkey % 6 = 0 THEN 'PAN' END AS document_type_hint,
  c_custkey % 11 = 0 AS blank, c_custkey % 13 = 0 AS too_small, c_custkey % 3 = 0 AS blurry, c_custkey % 8 = 0 AS glare
FROM customer"""

_TEXT = {
    "PAN": ["'INCOME TAX DEPARTMENT'", "'GOVT. OF INDIA'", f"upper({_FIRST} || ' ' || {_LAST})", "'Father''s Name'", f"'Dev ' || {_LAST}", "'Date of Birth'", f"{_DAY} || '/' || {_MONTH} || '/' || {_YEAR}", _MISREAD, "'~~%% ##'"],
    "AADHAAR": ["'Government of India'", f"{_FIRST} || ' ' || {_LAST}", f"'DOB: ' || {_DAY} || '/' || {_MONTH} || '/' || {_YEAR}", "CASE c_custkey % 2 WHEN 0 THEN 'Gender: MALE' ELSE 'Gender: F' END", _TWELVE, "'xkcdf'", "'abCDe'", "'Unique Identification'", "'Unique Identification'"],
    "PASSPORT": ["'REPUBLIC OF INDIA'", f"'P<IND' || upper({_LAST}) || '<<' || upper({_FIRST}) || '<<<<<<'", "'Passport No. K' || lpad(CAST(c_custkey AS STRING), 7, '0')", f"'Date of Birth ' || {_DAY} || '-' || {_MONTH} || '-' || {_YEAR}", "'Nationality: INDIAN'", "'Date of Expiry 11/03/2031'", "'...'", "'Place'", "'-'"],
    "DRIVING_LICENSE": ["'Driving Licence'", "'MH-12-2011-' || lpad(CAST(c_custkey AS STRING), 7, '0')", f"'Name: ' || {_FIRST} || ' ' || {_LAST}", f"'DOB: ' || {_DAY} || '.' || {_MONTH} || '.' || {_YEAR}", "'Valid Till: 01/02/2030'", "'ok'", "'a1b2c'", "'State'", "'## $$ !!'"],
    "GST_CERTIFICATE": ["'Goods and Services Tax'", f"'27' || {_PAN} || '1Z5'", f"'Legal Name: ' || {_FIRST} || ' Traders'", f"'Trade Name: ' || {_LAST} || ' Stores'", "'Form REG'", "'bcdf'", "'--'", "'Registration'", "'Registration'"],
    "BANK_STATEMENT": ["'Account Statement'", "'Account No: 00' || CAST(c_custkey AS STRING)", "'IFSC: BANK0001234'", f"'Name: ' || {_FIRST} || ' ' || {_LAST}", "'Opening Balance: 1200.50'", "'Note: first'", "'Note: second'", "'Closing Balance: 99.10'", "'***'"],
    "UNKNOWN": ["'Total amount due'", "'Bill to: ' || " + _FIRST, "'Invoice No: ' || CAST(c_custkey AS STRING)", "'misc line'", "'q'", "'12'", "'hello world'", "'hello world'", "'zzz'"],
}
_CASES = " ".join(f"WHEN '{k}' THEN CASE p.pos " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(vs)) + " END" for k, vs in _TEXT.items())
LINES = f"""
SELECT request_id, 0 AS page, pos, text, confidence, y, x, h FROM (
  SELECT c_custkey AS request_id, p.pos AS pos, CASE {_KIND} {_CASES} END AS text,
    {_D.format('(c_custkey * 7 + p.pos * 29) % 61 + 40')} / 100 AS confidence,
    {_D.format('p.pos * 24 + (c_custkey * (p.pos + 3)) % 7')} AS y, {_D.format('(c_custkey + p.pos) % 3 * 40')} AS x, {_D.format(20)} AS h
  FROM customer CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) p
) t"""
PROFILES = f"""
SELECT c_custkey AS request_id, {_FIRST} || ' ' || {_LAST} AS name, {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} AS dob,
  CASE WHEN c_custkey % 5 <> 0 THEN {_PAN} ELSE 'ZZZZZ9999Z' END AS pan, {_TWELVE} AS aadhaar, 'K' || lpad(CAST(c_custkey AS STRING), 7, '0') AS passport,
  CASE WHEN c_custkey % 3 <> 0 THEN 'MH122011' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS driving_license, '27' || {_PAN} || '1Z5' AS gstin, CASE c_custkey % 2 WHEN 0 THEN 'Male' ELSE 'female' END AS gender
FROM customer"""
_CODES = ("METADATA", "FFT_SPECTRUM", "ELA", "NOISE_RESIDUAL", "COLOR_ENTROPY", "SATURATION", "JPEG_HISTORY", "EDGE_DENSITY", "LAYOUT_ANCHOR")
SIGNALS = f"""
SELECT c_custkey AS request_id, {_KIND} AS document_type, s.code AS code, {_D.format('(c_custkey * (13 + s.i * 4) + s.i * 37) % 65')} / 64 AS score
FROM customer CROSS JOIN ({' UNION ALL '.join(f"SELECT '{c}' AS code, {i} AS i" for i, c in enumerate(_CODES))}) s WHERE s.i < 8 OR c_custkey % 7 = 1"""
PROPOSALS = f"""
SELECT c_custkey AS request_id, p.pos AS pos, CASE (c_custkey + p.pos) % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'dob' WHEN 2 THEN 'name' ELSE 'gender' END AS field,
  CASE (c_custkey * 5 + p.pos) % 6 WHEN 0 THEN '' WHEN 1 THEN '1985-03-12' WHEN 2 THEN {_FIRST} WHEN 3 THEN 'invented value' WHEN 4 THEN {_LAST} || ' ghost' ELSE 'male' END AS value,
  {_D.format('(c_custkey * 11 + p.pos * 7) % 20 + 1')} / 20 AS confidence
FROM customer CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) p WHERE c_custkey % 2 = 0"""
AUDIT = f"""
SELECT user_id AS request_id, ts AS created_at, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'APPROVE' WHEN 'click' THEN 'REVIEW' WHEN 'view' THEN 'REVIEW' ELSE 'REJECT' END AS decision,
  event_type = 'error' AS errored, {_D.format('event_id * 37 % 1009')} / 8 AS latency_ms FROM events"""
ALL = {"kyc_requests": REQUESTS, "kyc_lines": LINES, "kyc_profiles": PROFILES, "kyc_signals": SIGNALS, "kyc_proposals": PROPOSALS, "kyc_audit": AUDIT}
