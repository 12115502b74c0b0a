"""What recognisers and reasoners return, as JSON, brought to rows and checked values; reclassification and gates before a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract

_NUMBER = "-?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
#: Kinds with fields of their own.
TYPED = ("PAN", "AADHAAR", "PASSPORT", "DRIVING_LICENSE", "GST_CERTIFICATE")
# What a reasoner may recommend.
RECOMMENDATIONS = ("APPROVE", "REVIEW", "REJECT")


def polygon(raw: Column) -> Column:
    """Four corners, array<struct<x,y>>, of a JSON polygon: four points as they are, two as opposite corners, else the rectangle around them; null if it is none."""
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(f"({_NUMBER})"), F.lit(1)), lambda s: s.cast("double"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def corners(v: Column) -> Column:
        xs, ys = F.filter(v, lambda _, i: i % 2 == 0), F.filter(v, lambda _, i: i % 2 == 1)
        frame = lambda x0, y0, x1, y1: F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
        return (
            F.when((F.size(v) == 0) | (F.size(v) % 2 == 1), None)
            .when(F.size(v) == 4, frame(F.get(v, 0), F.get(v, 1), F.get(v, 2), F.get(v, 3)))
            .when(F.size(v) == 8, F.zip_with(xs, ys, point))
            .otherwise(frame(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
        )

    return T.let(numbers, corners)


def first_nonempty(*arrays: Column) -> Column:
    """The first array that is not null and has elements; else an empty one."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array().cast("array<string>"))


def _lines(entries: DataFrame, id_col: str) -> DataFrame:
    good = entries.where(F.col("text").isNotNull() & F.col("confidence").isNotNull() & F.col("bbox").isNotNull())
    return good.select(id_col, "page", "pos", "text", "confidence", "bbox")


def recognized_lists(results: DataFrame, id_col: str, raw: str) -> DataFrame:
    """(id, page, pos, text, confidence, bbox) of results whose raw is a JSON array of pages with parallel lists.

    A page is an object, or one under "res"; boxes are rec_polys, else dt_polys, else
    rec_boxes.  The shortest list ends a page; entries without a number for a score or
    with a broken box are left out.
    """
    body = "rec_texts array<string>, rec_scores array<string>, rec_polys array<string>, dt_polys array<string>, rec_boxes array<string>"
    pages = results.select(id_col, F.posexplode(F.from_json(raw, f"array<struct<res struct<{body}>, {body}>>")).alias("page", "p"))
    held = pages.withColumn("d", F.coalesce(F.col("p.res"), F.col("p").dropFields("res")))
    zipped = F.arrays_zip("d.rec_texts", "d.rec_scores", first_nonempty(F.col("d.rec_polys"), F.col("d.dt_polys"), F.col("d.rec_boxes")).alias("poly"))
    least = F.least(F.size("d.rec_texts"), F.size("d.rec_scores"), F.size(first_nonempty(F.col("d.rec_polys"), F.col("d.dt_polys"), F.col("d.rec_boxes"))))
    rows = held.where(least > 0).select(id_col, "page", F.posexplode(F.slice(zipped, F.lit(1), least)).alias("pos", "e"))
    return _lines(rows.select(id_col, "page", "pos", F.coalesce("e.rec_texts", F.lit("None")).alias("text"), F.trim("e.rec_scores").try_cast("double").alias("confidence"), polygon(F.col("e.poly")).alias("bbox")), id_col)


def recognized_pairs(results: DataFrame, id_col: str, raw: str) -> DataFrame:
    """(id, page, pos, text, confidence, bbox) of results whose raw is a JSON array of pages of [box, [text, score]] or [box, text] entries.

    A text without a score has 1; only the first page counts, and broken entries are left out.
    """
    page = F.get(F.from_json(raw, "array<array<array<string>>>"), 0)
    rows = results.select(id_col, F.lit(0).alias("page"), F.posexplode(page).alias("pos", "e"))
    payload = F.get("e", 1)
    pair = F.when(payload.startswith("["), F.from_json(payload, "array<string>"))
    told = rows.withColumn("pair", pair)
    text = F.when(F.col("pair").isNotNull(), F.get("pair", 0)).otherwise(payload)
    score = F.when(F.col("pair").isNotNull(), F.trim(F.get("pair", 1)).try_cast("double")).otherwise(1.0)
    return _lines(told.select(id_col, "page", "pos", text.alias("text"), score.alias("confidence"), polygon(F.get("e", 0)).alias("bbox")), id_col)


def reclassified(text: Column, hint: Column) -> Column:
    """struct(document_type, confidence) of a text: a typed kind of which only one sign was seen becomes UNKNOWN where the words name another document and no kind was asked for."""
    kind = extract.classify(text, hint)
    asked = hint.isNotNull()

    def judged(k: Column) -> Column:
        general = extract.general_kind(text, F.nullif(k["document_type"], F.lit("UNKNOWN")))
        supported = F.lit(False)
        for t in TYPED:
            supported = supported | ((k["document_type"] == t) & extract.supports(general["label"], t))
        other = k["document_type"].isin(*TYPED) & (k["confidence"] < 1) & ~asked & extract.is_other_label(general["label"]) & ~supported
        made = lambda t, c: F.struct(t.alias("document_type"), c.alias("confidence"))
        return F.when(other, made(F.lit("UNKNOWN"), F.greatest(k["confidence"], general["confidence"]))).otherwise(made(k["document_type"], k["confidence"]))

    return T.let(kind, judged)


def missing_required(checks: DataFrame) -> DataFrame:
    """(request_id, fields): the required fields of checks(request_id, field, required, status) that are missing, by name."""
    return checks.where(F.col("required") & (F.col("status") == "MISSING")).groupBy("request_id").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def _has(raw: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))


def _spoken(raw: Column, key: str, absent: str = "") -> Column:
    """A value as text: absent where the key is, "None" for null."""
    return F.when(~_has(raw, key), F.lit(absent)).otherwise(F.coalesce(F.get_json_object(raw, f"$.{key}"), F.lit("None")))


def _number(raw: Column, key: str, absent: float = 0.0) -> Column:
    """A number, or a text of one; null for anything else."""
    return F.when(~_has(raw, key), F.lit(absent)).otherwise(F.trim(F.get_json_object(raw, f"$.{key}")).try_cast("double"))


def _said(items: Column, most: int) -> Column:
    return F.transform(F.filter(items, lambda c: c.isNotNull() & ~c.isin("", "0", "false", "[]", "{}")), lambda c: F.substring(c, 1, most))


def review(raw: Column) -> Column:
    """struct(recommendation, confidence, reasoning, concerns) of a reasoner's JSON; null if its confidence or concerns are malformed."""
    rec = F.upper(_spoken(raw, "recommendation", "REVIEW"))
    concerns = F.from_json(F.get_json_object(raw, "$.concerns"), "array<string>")
    told = F.when(~_has(raw, "concerns"), F.array().cast("array<string>")).otherwise(concerns)
    made = F.struct(
        F.when(rec.isin(*RECOMMENDATIONS), rec).otherwise("REVIEW").alias("recommendation"), _number(raw, "confidence").alias("confidence"),
        F.substring(_spoken(raw, "reasoning"), 1, 600).alias("reasoning"), _said(told, 200).alias("concerns"),
    )
    return F.when(F.json_object_keys(raw).isNotNull() & _number(raw, "confidence").isNotNull() & told.isNotNull(), made)


def proposals(raw: Column) -> Column:
    """array<struct(field, value, confidence, source)> of a reasoner's JSON; entries without field, value or a number for a confidence are left out."""
    items = F.from_json(F.get_json_object(raw, "$.rectifications"), "array<string>")
    made = lambda r: F.struct(_spoken(r, "field").alias("field"), _spoken(r, "value").alias("value"), _number(r, "confidence").alias("confidence"), F.substring(_spoken(r, "source"), 1, 200).alias("source"))
    whole = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda r: _has(r, "field") & _has(r, "value") & _number(r, "confidence").isNotNull())
    return F.transform(whole, made)


def analysis(raw: Column, label: Column, category: Column, confidence: Column, summary: Column) -> Column:
    """struct(label, category, confidence, summary, concerns, notes) of a reasoner's JSON, with a heuristic's values where it says nothing."""
    said = lambda key, other, last, most: F.substring(F.coalesce(F.nullif(F.get_json_object(raw, f"$.{key}"), F.lit("")), F.nullif(other, F.lit("")), F.lit(last)), 1, most)
    several = lambda key: _said(F.coalesce(F.from_json(F.get_json_object(raw, f"$.{key}"), "array<string>"), F.array().cast("array<string>")), 240)
    return F.struct(
        said("document_type_label", label, "Unknown Document", 120).alias("label"), said("document_category", category, "OTHER", 80).alias("category"),
        T.clip01(F.coalesce(F.trim(F.get_json_object(raw, "$.confidence")).try_cast("double"), confidence)).alias("confidence"), said("summary", summary, "", 800).alias("summary"),
        several("visual_concerns").alias("concerns"), several("extraction_notes").alias("notes"),
    )


def heuristic_summary(label: Column) -> Column:
    return F.when(label != "Unknown Document", F.concat(F.lit("Document appears to be "), label, F.lit("."))).otherwise("Document type could not be confidently identified.")


def preview(text: Column, lines: int = 12) -> Column:
    """The first lines that are not blank, white space as one space."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"), lambda s: F.trim(F.regexp_replace(s, "\\s+", " ")))
    return F.slice(F.filter(cut, lambda s: s != ""), 1, lines)


def digest(states: DataFrame, snippet: int = 1500) -> DataFrame:
    """states with digest: what a reviewer is shown of a run, as JSON, the text cut to a snippet."""
    packed = F.struct(
        "document_type", "ocr_confidence", F.struct(F.col("overall"), F.col("match_score").alias("score")).alias("validation"),
        F.struct(F.col("fraud_verdict").alias("verdict"), F.col("fraud_score").alias("score")).alias("fraud"), F.struct(F.col("risk_score").alias("score"), F.col("risk_band").alias("band")).alias("risk"),
        F.substring(F.coalesce("raw_text", F.lit("")), 1, snippet).alias("ocr_text_snippet"),
    )
    return states.withColumn("digest", F.to_json(packed, {"ignoreNullFields": "false"}))


def name_candidate(lines: Column) -> Column:
    """The first line like a person's name behind a line that says NAME, else the first such line at all; in title case."""
    label = lambda s: F.contains(F.upper(s), F.lit("NAME")) & (F.length(s) < 32)
    at = F.array_position(F.transform(lines, lambda s: F.coalesce(label(s), F.lit(False))), F.lit(True))
    named = lambda s: ~label(s) & T.is_person_name(s)
    behind = F.get(F.filter(lines, lambda s, i: (at > 0) & (i >= at) & named(s)), 0)
    found = F.coalesce(behind, F.get(F.filter(lines, named), 0))
    return F.initcap(F.trim(F.regexp_replace(found, "\\s+", " ")))


#: Fixed value: a "key: value" line as the console reads it.
CONSOLE_PAIR = r"^\s*([A-Za-z][A-Za-z0-9\s/&().,#-]{1,52})\s*[:-]\s*(.{2,220})\s*$"


def console_pairs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key, values) of a text's "key: value" lines as the console reads them: any key, values in order."""
    rows = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\\r?\\n")).alias("pos", "line")).where(F.col("line").rlike(CONSOLE_PAIR))
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_extract("line", CONSOLE_PAIR, 1))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    pairs = rows.select(id_col, "pos", key.alias("key"), F.trim(F.regexp_extract("line", CONSOLE_PAIR, 2)).alias("value")).where("key <> '' and value <> ''")
    return pairs.groupBy(id_col, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("values"))
