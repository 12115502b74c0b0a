"""Batches, views and display on hand-made rows."""

from pyspark.sql import functions as F

from claimlens.operators import respond as R

M = "map<string,string>"


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_views(spark):
    view = R.document_data(F.col("t"), F.col("u"), F.col("d"), F.col("c"))
    schema = f"t {M}, u {M}, d {M}, c {M}"
    assert one(spark, schema, ({"schema_type": "PAN", "name": "A"}, {"name": "B"}, None, {"dob": "x"}), view)[0] == {"schema_type": "PAN", "name": "A", "dob": "x"}
    assert one(spark, schema, (None, {"name": "B"}, {"z": "1"}, {"dob": "x", "name": "C"}), view)[0] == {"name": "C"}
    # a payload that says nothing is not the base, but lets all corrections through
    assert one(spark, schema, ({"schema_type": "PAN"}, {}, {"z": "1"}, {"dob": "x"}), view)[0] == {"z": "1", "dob": "x"}
    assert one(spark, schema, (None, None, None, None), view)[0] == {}
    assert one(spark, f"a {M}, b {M}", ({"tables": "[]", "x": ""}, {"k": "v"}), R.first_told(F.col("a"), F.col("b")))[0] == {"k": "v"}


def test_union_fields(spark):
    u = R.union_fields(F.col("t"))
    assert one(spark, f"t {M}", ({"given_name": "Asha", "surname": "Rao", "passport_number": "K1234567"},), u)[0] == {"name": "Asha Rao", "passport_number": "K1234567"}
    assert one(spark, f"t {M}", ({"legal_name": "X Ltd", "gstin": "g"},), u)[0] == {"name": "X Ltd", "gstin": "g"}
    assert one(spark, f"t {M}", ({"masked_aadhaar": "XXXX XXXX 0124", "name": ""},), u)[0] == {"aadhaar_number": "XXXX XXXX 0124"}
    assert one(spark, f"t {M}", ({"a": "1", "b": None},), R.as_text(F.col("t")))[0] == "a: 1\nb: None"


def test_batch_and_response(spark):
    batch = spark.createDataFrame([("p", {}, ""), ("q", {"pan": "1"}, "vision"), ("r", None, None)], f"document_path string, user_data {M}, ocr_engine string")
    got = R.with_defaults(batch, F.create_map(F.lit("pan"), F.lit("0")), F.lit("")).orderBy("document_path").collect()
    assert [(r["user_data"], r["ocr_engine"]) for r in got] == [({"pan": "0"}, "paddle"), ({"pan": "1"}, "vision"), ({"pan": "0"}, "paddle")]
    r = R.response(spark.createDataFrame([("i", None, 0.2)], "request_id string, final_decision string, risk_score double")).first()
    assert (r["final_decision"], r["risk_score"], r["fraud_verdict"], r["llm_enabled"]) == ("REVIEW", 0.2, "INSUFFICIENT_DATA", False)
    s = R.summary(spark.createDataFrame([("APPROVE",), ("REJECT",), ("REJECT",), (None,)], "final_decision string")).first()
    assert tuple(s) == (1, 0, 2, 4)
    t = R.timing(spark.createDataFrame([(1.0,), (2.0,), (6.0,), (3.0,)], "s double"), "s").first()
    assert tuple(t) == (4, 1.0, 6.0, 3.0, 2.5)
    d = R.debug_view(spark.createDataFrame([(["a"], None, "x" * 1600, 7)], "lines array<string>, words array<string>, raw_text string, k int")).first()
    assert (d["k"], len(d["raw_text_preview"]), d["line_count"], d["word_count"]) == (7, 1500, 1, 0)


def test_display(spark):
    c = F.col("x")
    assert one(spark, "x string", ("father_name",), R.label(c), R.shown(c)) == ("Father Name", "father_name")
    assert one(spark, "x string", ("",), R.shown(c), R.percent(c), R.tone(c)) == ("Not returned", 0.0, "neutral")
    assert one(spark, "x double", (0.25,), R.shown(c, "number"), R.percent(c)) == ("0.250", 25.0)
    assert one(spark, "x double", (3.0,), R.shown(c, "number"), R.percent(c)) == ("3", 100.0)
    assert one(spark, "x boolean", (False,), R.shown(c, "boolean"))[0] == "No"
    assert [one(spark, "x string", (v,), R.tone(c))[0] for v in ("APPROVE", "TAMPERED", "NEEDS_REVIEW", None)] == ["success", "danger", "warning", "neutral"]
