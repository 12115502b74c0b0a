"""Fields, comparisons, risk and status on hand-made documents; values are invented."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.functions import text as T
from claimlens.operators import audit, decide, extract, fraud, images, lines, rectify, validate

AADHAAR = "2345 6789 0124"


def docs(spark, kind, rows):
    return spark.createDataFrame([(1, kind, rows, "\n".join(rows))], "request_id long, document_type string, lines array<string>, raw_text string")


def fields(spark, kind, *rows):
    return extract.extract(docs(spark, kind, list(rows))).first()["fields"]


def kind(spark, text, hint=None):
    k = spark.createDataFrame([(text, hint)], "t string, h string").select(extract.classify(F.col("t"), F.col("h")).alias("k")).first()["k"]
    return k["document_type"], k["confidence"]


def value(spark, expr, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr(*[F.col(n) for n in names]).alias("v")).first()["v"]


def test_tax_card(spark):
    f = fields(spark, "PAN", "INCOME TAX DEPARTMENT", "GOVT. OF INDIA", "RAVIN SHETTU", "Father's Name", "Dev Shettu Date of Birth", "12/03/1985", "ABCPD1234E")
    assert f["pan_number"] == "ABCPD1234E" and f["name"] == "Ravin Shettu" and f["father_name"] == "Dev Shettu" and f["dob"] == "1985-03-12"


@pytest.mark.parametrize("rows,missing", [(["x", "Father's Name", "Date of Birth"], "father_name"), (["x", "Father's Name", "D3v Kumar"], "father_name"), (["nothing here"], "pan_number"), (["Date of Birth: 12/03/2999"], "dob")])
def test_tax_card_nulls(spark, rows, missing):
    assert missing not in fields(spark, "PAN", *rows)


@pytest.mark.parametrize("date", ["12/03/1985", "12-03-1985", "12.03.1985", "12 Mar 1985", "12/03/85"])
def test_dates(spark, date):
    assert value(spark, T.normalize_date, x=date) == "1985-03-12"


def test_verhoeff(spark):
    digits = AADHAAR.replace(" ", "")
    valid = [d for d in (digits[:-1] + str(i) for i in range(10)) if value(spark, T.verhoeff, x=d)]
    assert len(valid) == 1
    number = valid[0]
    f = fields(spark, "AADHAAR", "Government of India", "Ravin Shettu", "DOB: 12/03/1985", "Gender: F", f"{number[:4]} {number[4:8]} {number[8:]}")
    assert f["aadhaar_last4"] == number[8:] and f["masked_aadhaar"] == f"XXXX XXXX {number[8:]}" and f["name"] == "Ravin Shettu" and f["gender"] == "FEMALE"
    assert number not in str(f)
    wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
    assert "aadhaar_last4" not in fields(spark, "AADHAAR", wrong)


def test_label_on_first_line_does_not_count(spark):
    assert "gender" not in fields(spark, "AADHAAR", "Gender: MALE", "x")
    assert fields(spark, "DRIVING_LICENSE", "Driving Licence", "Name: Ravin Shettu")["name"] == "Ravin Shettu"
    assert "name" not in fields(spark, "DRIVING_LICENSE", "Name: Ravin Shettu", "x")


def test_passport_and_registration(spark):
    f = fields(spark, "PASSPORT", "REPUBLIC OF INDIA", "P<INDSHETTU<<RAVIN<K<<<<", "K1234567", "Date of Birth 12-03-1985")
    assert (f["surname"], f["given_name"], f["nationality"], f["passport_number"], f["dob"], f["name"]) == ("Shettu", "Ravin K", "IND", "K1234567", "1985-03-12", "Ravin K Shettu")
    g = fields(spark, "GST_CERTIFICATE", "Goods and Services Tax", "27ABCPD1234E1Z5", "Legal Name", "Ravin Traders")
    assert g["gstin"] == "27ABCPD1234E1Z5" and g["legal_name"] == "Ravin Traders"


def test_kinds(spark):
    assert kind(spark, "ABCPD1234E") == ("PAN", 0.55) and kind(spark, "ABCPD1234E Income Tax") == ("PAN", 1.0)
    assert kind(spark, "Aadhaar 2345 6789 0123 ABCPD1234E Income Tax") == ("AADHAAR", 1.0)
    assert kind(spark, "Account Statement") == ("BANK_STATEMENT", 0.75) and kind(spark, "Net Pay") == ("SALARY_SLIP", 0.75)
    assert kind(spark, "zz", "PAN") == ("PAN", 0.0) and kind(spark, "zz") == ("UNKNOWN", 0.0)


def test_comparisons(spark):
    assert value(spark, T.same_letters, a="ab c", b="ABC") and not value(spark, T.same_letters, a="abc", b="")
    assert value(spark, T.same_date, a="1985-03-12", b="12-Mar-1985") and not value(spark, T.same_date, a="x", b="x")
    assert value(spark, T.same_name, a="Ravin Shettu", b="SHETTU RAVIN") and not value(spark, T.same_name, a="Ravin Shettu", b="Quite Other")
    assert T.token_set_ratio("RAVIN SHETTU", "RAVIN SHETTY") == pytest.approx(200 * 11 / 24)
    assert value(spark, T.title_case, x="o'brien d.k. SMITH-jones") == "O'Brien D.K. Smith-Jones"


def test_cleaning(spark):
    assert value(spark, T.clean, x="a\tb  c 1O2 ３") == "ab c 102 3"


def test_lines(spark):
    rows = [(1, 0, i, t, c, y, x, 20.0) for i, (t, c, y, x) in enumerate([("right", 0.9, 10.0, 50.0), ("left", 0.9, 12.0, 0.0), ("below", 0.9, 60.0, 0.0), ("BELOW", 0.9, 61.0, 90.0), ("bcdfg", 0.9, 90.0, 0.0), ("weak line", 0.3, 120.0, 0.0)])]
    raw = spark.createDataFrame(rows, "request_id long, page int, pos int, text string, confidence double, y double, x double, h double")
    ordered = lines.reading_order(raw)
    assert [r["text"] for r in ordered.orderBy("ord").collect()][:4] == ["left", "right", "below", "BELOW"]
    judged = {r["text"]: r["code"] for r in lines.admit(ordered).collect()}
    assert judged == {"left": None, "right": None, "below": None, "BELOW": "DUPLICATE", "bcdfg": "NO_VOWELS", "weak line": "LOW_CONFIDENCE"}
    d = lines.document(lines.admit(ordered)).first()
    assert d["raw_text"] == "left\nright\nbelow" and d["low"] == 0
    text = spark.createDataFrame([(1, "a\r\n\n b c\n")], "id long, t string")
    assert [r["text"] for r in lines.pseudo_lines(text, "id", "t", F.lit(2.0)).orderBy("pos").collect()] == ["a", "b", "c"]


def test_report(spark):
    rows = [(1, "PAN", {"pan_number": "ABCPD1234E", "name": "Ravin Shettu"}, {"pan": "abcpd1234e", "name": "Ravin Shettu", "dob": "1985-03-12"}), (2, "PAN", {}, {}), (3, "BANK_STATEMENT", {}, {"pan": "x"})]
    d = spark.createDataFrame(rows, "request_id long, document_type string, fields map<string,string>, truth map<string,string>")
    got = {r["request_id"]: (r["overall"], r["match_score"]) for r in validate.report(d).collect()}
    assert got == {1: ("MISSING", pytest.approx(2 / 3)), 2: ("MISSING", 1.0), 3: ("NOT_APPLICABLE", 0.0)}


def test_decisions(spark):
    rows = [(1, "PASS", 1.0, 0.1, "LIKELY_AUTHENTIC", 0.95, ["METADATA", "JPEG_HISTORY"]), (2, "FAIL", 0.0, 0.1, "LIKELY_AUTHENTIC", 0.9, []), (3, "PASS", 1.0, 0.7, "LIKELY_AI", 0.9, []), (4, "PASS", 1.0, 0.1, "LIKELY_AUTHENTIC", 0.95, []), (5, "MISSING", 1.0, 0.1, "SUSPICIOUS", 0.9, [])]
    d = spark.createDataFrame(rows, "request_id long, overall string, match_score double, fraud_score double, fraud_verdict string, ocr_confidence double, metadata_codes array<string>").withColumn("document_type", F.lit("PAN"))
    got = {r["request_id"]: (r["decision"], r["status"], r["risk_band"]) for r in decide.decide(d).collect()}
    # the later, milder metadata finding hides the earlier one
    assert got == {1: ("APPROVE", "AUTHENTIC", "LOW"), 2: ("REJECT", "DATA_MISMATCH", "HIGH"), 3: ("REJECT", "FAKE_AI", "CRITICAL"), 4: ("APPROVE", "AUTHENTIC", "LOW"), 5: ("REVIEW", "TAMPERED", "MEDIUM")}


def test_signals(spark):
    s = spark.createDataFrame([(1, "PAN", "METADATA", 0.98), (1, "PAN", "ELA", 0.98), (2, "AADHAAR", "LAYOUT_ANCHOR", 0.4)], "request_id long, document_type string, code string, score double")
    got = {r["request_id"]: r["fraud_verdict"] for r in fraud.verdicts(s).collect()}
    assert got == {1: "LIKELY_AI", 2: "SUSPICIOUS"}


def test_proposals(spark):
    p = spark.createDataFrame([(1, 0, "name", "Ravin", 0.9), (1, 1, "name", "Other", 0.9), (1, 2, "dob", "x", 0.5), (1, 3, "pan", "", 0.9)], "request_id long, pos int, field string, value string, confidence double")
    have = spark.createDataFrame([], "request_id long, field string, value string")
    assert [r["reason"] for r in rectify.judge(p, have).orderBy("pos").collect()] == [None, "already extracted", "below floor", "empty"]
    t = spark.createDataFrame([(1, "ravin x")], "request_id long, raw_text string")
    assert rectify.hallucination(p, t).first()["hallucination_score"] == pytest.approx(round(0.9 / 2.3, 3), abs=0.3)


def test_audit(spark):
    assert value(spark, audit.masked, x="id 2345 6789 0124.") == "id XXXX XXXX 0124."
    log = spark.createDataFrame([(i, i, "APPROVE", False, float(i)) for i in range(1, 11)], "created_at long, seq long, decision string, errored boolean, latency_ms double")
    m = audit.metrics(log).first()
    assert (m["p50"], m["p95"], m["samples"]) == (5.5, 9.0, 10)


def test_pixels():
    flat = np.full((400, 400), 128, np.uint8)
    assert images.is_blank(flat) and images.flags(flat)["blurry"] and images.quality(flat)[1] == "REJECTED"
    rough = np.random.default_rng(1).integers(0, 256, (400, 400)).astype(np.uint8)
    assert not images.flags(rough)["blurry"] and images.spectrum(rough) == 1.0 and images.noise(flat) == 1.0
    table = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(64) + b"\xff\xda"
    assert images.jpeg_tables(table) == 1 and images.jpeg_history("jpg", table) == 0.30 and images.jpeg_history("png", b"") == 0.55
