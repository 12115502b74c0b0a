"""Recognised lines: pseudo-lines of a text, reading order, admission, duplicates, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: White space at the ends of a line, as Unicode has it, with the separators \x1c to \x1f.
ENDS = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def pseudo_lines(docs: DataFrame, id_col: str, text: str, confidence: Column) -> DataFrame:
    """One row per non-blank line of a text: (id, page, pos, text, confidence, y, x, h), unit boxes."""
    cut = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), BREAKS), lambda s: F.regexp_replace(s, ENDS, "")), lambda s: s != "")
    rows = docs.select(F.col(id_col), T.clip01(confidence).alias("confidence"), F.posexplode(cut).alias("pos", "text"))
    return rows.select(id_col, F.lit(0).alias("page"), "pos", "text", "confidence", (F.col("pos") + F.lit(0.5)).alias("y"), F.lit(0.0).alias("x"), F.lit(1.0).alias("h"))


def box(bbox: Column) -> tuple[Column, Column, Column]:
    """Centre y, left x and height of array<struct<x,y>>."""
    ys = F.transform(bbox, lambda p: p["y"])
    return F.aggregate(ys, F.lit(0.0), lambda a, v: a + v) / F.size(ys), F.array_min(F.transform(bbox, lambda p: p["x"])), F.array_max(ys) - F.array_min(ys)


def rectangle(points: Column) -> Column:
    """Four corners: four points stay, others become the rectangle around them."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when(F.size(points) == 4, points).otherwise(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def reading_order(lines: DataFrame, id_col: str = "request_id") -> DataFrame:
    """lines with ord: top to bottom in bands around a running centre, left to right in a band.

    The band is half the upper median height, 8 at least.  One shuffle by document; the
    bands are a fold over its sorted lines.
    """
    key = [id_col, "page"]
    rest = [c for c in lines.columns if c not in key]
    packed = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("pos").alias("_p"), F.struct(*rest).alias("row")))).alias("items"))
    heights = F.array_sort(F.transform("items", lambda e: e["row"]["h"]))
    middle = F.element_at(heights, (F.floor(F.size("items") / 2) + 1).cast("int"))
    band = F.greatest(F.lit(8.0), F.lit(0.5) * F.when(middle == 0, F.lit(1.0)).otherwise(middle))
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("at"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, e: Column) -> Column:
        fresh = s["at"].isNull() | (F.abs(e["_y"] - s["at"]) > F.col("band"))
        row = F.when(fresh, s["row"] + 1).otherwise(s["row"])
        return F.struct(row.alias("row"), F.when(fresh, e["_y"]).otherwise((s["at"] + e["_y"]) / 2).alias("at"), F.concat(s["rows"], F.array(row)).alias("rows"))

    banded = packed.withColumn("band", band).withColumn("rows", F.aggregate("items", start, step)["rows"])
    ordered = F.array_sort(F.zip_with("rows", "items", lambda r, e: F.struct(r.alias("r"), e["_x"].alias("x"), e["_y"].alias("y"), e["_p"].alias("p"), e["row"].alias("row"))))
    out = banded.select(*key, F.posexplode(ordered).alias("ord", "e"))
    return out.select(*key, "ord", *[F.col(f"e.row.{c}").alias(c) for c in rest])


def admit(lines: DataFrame, min_confidence: float = 0.55, min_length: int = 3, max_symbols: float = 0.40, id_col: str = "request_id", ascii_only: bool = False) -> DataFrame:
    """lines(ord) with clean text and code: the rule that turned the line away, DUPLICATE for a repeat, null if kept.

    A repeat has the upper-case text of an earlier kept line of the page within about ten pixels.
    """
    judged = lines.withColumn("clean", T.clean(F.col("text"), ascii_only)).withColumn("code", T.reject_code(F.col("clean"), F.col("confidence"), min_confidence, min_length, max_symbols))
    same = Window.partitionBy(id_col, "page", F.col("code").isNull(), F.upper("clean"), F.bround(F.col("y") / 10).cast("long")).orderBy("ord")
    return judged.withColumn("code", F.when(F.col("code").isNull() & (F.row_number().over(same) > 1), "DUPLICATE").otherwise(F.col("code")))


def filter_stats(judged: DataFrame, id_col: str = "request_id") -> DataFrame:
    return judged.groupBy(id_col).agg(F.count_if(F.col("code").isNull()).alias("kept"), F.count_if(F.col("code").isNotNull()).alias("rejected"))


def document(judged: DataFrame, id_col: str = "request_id") -> DataFrame:
    """One row per document: its kept lines in order, pages joined by a blank line, and the confidence roll-up."""
    kept = judged.where("code is null")
    at = F.struct("page", "ord", "clean", "confidence")
    packed = kept.groupBy(id_col).agg(
        F.array_sort(F.collect_list(at)).alias("items"), F.avg("confidence").alias("mean"), F.median("confidence").alias("median"), F.min("confidence").alias("least"),
        F.count_if(F.col("confidence") < 0.70).alias("low"), F.count_if(F.col("confidence") < 0.55).alias("suspicious"),
    )
    lines = F.transform("items", lambda e: e["clean"])
    pages = F.array_distinct(F.transform("items", lambda e: e["page"]))
    text = F.array_join(F.transform(pages, lambda p: F.array_join(F.transform(F.filter("items", lambda e: e["page"] == p), lambda e: e["clean"]), "\n")), "\n\n")
    low = F.slice(F.transform(F.filter("items", lambda e: e["confidence"] < 0.70), lambda e: e["clean"]), 1, 25)
    return packed.select(id_col, lines.alias("lines"), text.alias("raw_text"), "mean", "median", "least", "low", "suspicious", low.alias("low_lines"))
