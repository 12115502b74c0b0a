"""Text expressions: cleaning, line admission, names, key-value lines, dates, comparisons."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from . import patterns as P


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x) if not unicodedata.category(c).startswith("C")))


def fold_digits(text: Column) -> Column:
    """White space to one space, trimmed, and letters between digits that were misread: O and o as 0, l and I as 1, B as 8."""
    out = F.trim(F.regexp_replace(text, "\\s+", " "))
    for letter, digit in (("[Oo]", "0"), ("[lI]", "1"), ("B", "8")):
        out = F.regexp_replace(out, f"(?<=\\d){letter}(?=\\d)", digit)
    return out


def clean(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, control and format characters dropped (before white space collapses, so a tab joins), then fold_digits.

    ascii_only keeps the whole expression in the JVM, for text known to be ASCII.
    """
    base = F.regexp_replace(text, "[\\x00-\\x1f\\x7f]", "") if ascii_only else _nfkc(text)
    return fold_digits(base)


def has_identifier(text: Column) -> Column:
    out = F.lit(False)
    for p in (P.PAN, P.AADHAAR, P.PASSPORT, P.GSTIN, P.BIRTH, P.GENDER_WORD):
        out = out | text.rlike(p)
    return out


def has_keyword(text: Column) -> Column:
    return F.upper(text).rlike("|".join(re.escape(k) for k in P.KEYWORDS))


def reject_code(text: Column, confidence: Column, min_confidence: float = 0.50, min_length: int = 3, max_symbols: float = 0.40) -> Column:
    """Why a line is not admitted, first rule that holds; null: admitted.  Lines with an identifier always are."""
    keyword = has_keyword(text)
    letters, digits = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[0-9]"))
    total = F.greatest(F.lit(1), F.length(F.regexp_replace(text, " ", "")))
    devanagari = F.regexp_count(text, F.lit("[\\u0900-\\u097F]"))
    floor = F.when(keyword, F.lit(0.75 * min_confidence)).otherwise(F.lit(float(min_confidence)))
    return (
        F.when(F.length(text) == 0, "TOO_SHORT")
        .when(has_identifier(text), F.lit(None).cast("string"))
        .when(confidence < floor, "LOW_CONFIDENCE")
        .when((F.length(text) < min_length) & ~keyword, "TOO_SHORT")
        .when(((total - letters - digits) / total > max_symbols) & ~keyword, "SYMBOL_HEAVY")
        .when((letters == 0) & (digits == 0), "NO_LETTERS")
        .when((devanagari > 0) & (devanagari >= letters), "DEVANAGARI")
        .when(letters.between(3, 8) & (digits == 0) & ~text.rlike("[AEIOUaeiou]") & ~keyword, "NO_VOWELS")
        .when(text.rlike(P.GIBBERISH) & ~keyword, "GIBBERISH")
    )


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first: O'Brien, D.K."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), F.initcap), "")


def is_person_name(text: Column) -> Column:
    """Two to four words of letters, none of them a card's own."""
    words = F.split(F.trim(text), "\\s+")
    return (
        F.size(words).between(2, 4)
        & ~F.arrays_overlap(F.transform(words, F.upper), F.array(*map(F.lit, P.NOT_NAMES)))
        & F.forall(words, lambda w: w.rlike("^[A-Za-z][A-Za-z.'-]+$"))
    )


_BOUNDARY = "(?i)\\b(?:" + "|".join(re.escape(x) for x in P.LABELS) + ")\\b"


def strip_marks(text: Column, marks: str = " :\\-,\\t") -> Column:
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def up_to_label(text: Column) -> Column:
    """The text before the first label in it."""
    return strip_marks(F.regexp_replace(F.regexp_replace(text, _BOUNDARY + "[\\s\\S]*$", ""), "\\s+", " "))


def is_label(text: Column) -> Column:
    whole = "^" + _BOUNDARY[4:].replace("\\b(?:", "(?:", 1).removesuffix("\\b") + "$"
    return let(F.lower(strip_marks(F.regexp_replace(text, "\\s+", " "))), lambda bare: (bare == "") | bare.rlike(whole))


def without_leak(value: Column, digits: bool = False) -> Column:
    """Null where a label (or, unless allowed, a digit) is left in the value, or under two letters remain."""
    bad = _BOUNDARY if digits else f"{_BOUNDARY}|\\d"
    return let(value, lambda v: let(strip_marks(F.regexp_replace(v, "\\s+", " "), " :\\-,.\\t"), lambda out: F.when(~v.rlike(bad) & (F.length(out) >= 2), out)))


def person_name(value: Column) -> Column:
    """A name in title case; null for a single word under four letters."""
    return let(strip_marks(F.regexp_replace(value, "\\s+", " "), " :\\-,.\\t"), lambda out: F.when(out.rlike(" |....") & (out != ""), title_case(out)))


_DATE_FORMATS = ("d/M/yyyy", "d/M/yy", "d-M-yyyy", "d-M-yy", "d.M.yyyy", "d.M.yy", "d MMM yyyy", "d MMMM yyyy", "d/MMM/yyyy", "d/MMMM/yyyy")
_COMPARED_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d-M-yy", "d-MMM-yyyy", "d-MMMM-yyyy")


def _parsed(text: Column, formats: tuple[str, ...]) -> Column:
    out = []
    for f in formats:
        d = F.try_to_date(text, f)
        # two-digit years above 68 are of the last century
        short = f.endswith("yy") and not f.endswith("yyyy")
        out.append(let(d, lambda x: F.when(F.year(x) > 2068, F.add_months(x, -1200)).otherwise(x)) if short else d)
    return F.coalesce(*out)


def normalize_date(raw: Column, as_of: str | None = None) -> Column:
    """ISO text of a date as cards print it; null if it is none, before 1900 or after as_of (today)."""
    last = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return let(
        let(F.trim(F.regexp_replace(raw, "\\s+", " ")), lambda s: _parsed(s, _DATE_FORMATS)),
        lambda d: F.when((F.year(d) >= 1900) & (d <= last), F.date_format(d, "yyyy-MM-dd")),
    )


def iso_date(raw: Column) -> Column:
    """ISO text of a date as profiles hold it; empty if it is none."""
    return F.coalesce(F.date_format(let(F.translate(F.trim(raw), "./", "--"), lambda s: _parsed(s, _COMPARED_FORMATS)), "yyyy-MM-dd"), F.lit(""))


def same_letters(a: Column, b: Column) -> Column:
    squeeze = lambda x: F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "\\s+", ""))
    return (F.coalesce(b, F.lit("")) != "") & (squeeze(a) == squeeze(b))


def same_last4(a: Column, b: Column) -> Column:
    last = lambda x: F.right(F.regexp_replace(F.coalesce(x, F.lit("")), "\\D", ""), F.lit(4))
    return (last(a) != "") & (last(a) == last(b))


def same_date(a: Column, b: Column) -> Column:
    return let(iso_date(F.coalesce(a, F.lit(""))), lambda x: (x != "") & (x == iso_date(F.coalesce(b, F.lit("")))))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u) | (row - u)
    return bin(~row & ((1 << len(a)) - 1)).count("1")


def _indel(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Likeness of two names by their sets of words, 0 to 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {left}".strip(), f"{both} {right}".strip())
    best = _indel(left, right) if not both else max(_indel(one, two), _indel(both, one), _indel(both, two))
    return best


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") >= 85 for x, y in zip(a, b)])


def same_name(a: Column, b: Column) -> Column:
    """Token-set ratio of 85 or more.  Equal sets and subsets are told in the JVM; only the rest goes to Python."""
    up = lambda x: F.upper(F.trim(F.coalesce(x, F.lit(""))))
    x, y = (F.array_distinct(F.split(up(v), "\\s+")) for v in (a, b))
    some = F.size(F.array_intersect(x, y)) > 0
    whole = some & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    return F.when((up(a) == "") | (up(b) == ""), F.lit(False)).when(whole, F.lit(True)).otherwise(_alike(F.when(~whole, up(a)), F.when(~whole, up(b))))


def verhoeff(digits: Column) -> Column:
    """Whether twelve digits pass the checksum; false for any other text."""
    table = lambda rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    d, p = table(P.VERHOEFF_D), table(P.VERHOEFF_P)
    ok = digits.rlike("^[0-9]{12}$")
    safe = F.reverse(F.when(ok, digits).otherwise(F.lit("0" * 12)))
    step = lambda c, i: F.get(F.get(d, c), F.get(F.get(p, (i % 8).cast("int")), F.substring(safe, i + 1, F.lit(1)).cast("int")))
    return ok & (F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step) == 0)


def check_aadhaar(value: Column) -> Column:
    """struct(valid, normalized, last4, checksum_ok, reason)."""
    n = F.regexp_replace(F.coalesce(value, F.lit("")), "\\D", "")
    lead, ok = n.rlike("^[01]"), verhoeff(n)
    full, four = F.length(n) == 12, F.length(n) == 4
    return F.struct(
        F.when(full, ~lead & ok).otherwise(four).alias("valid"),
        F.nullif(n, F.lit("")).alias("normalized"),
        F.when(full | four, F.right(n, F.lit(4))).alias("last4"),
        F.when(full, ~lead & ok).alias("checksum_ok"),
        F.when(F.coalesce(value, F.lit("")) == "", "empty Aadhaar").when(full & lead, "first digit must be 2-9 per UIDAI spec").when(full & ~ok, "Verhoeff checksum failed")
        .when(four, "only last4 available; checksum skipped").when(~full, F.format_string("expected 12 digits (or last 4), got %d", F.length(n))).alias("reason"),
    )


def check_pan(value: Column) -> Column:
    """struct(valid, normalized, holder_type, reason)."""
    n = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", ""))
    shape = n.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")
    holders = F.create_map(*[F.lit(x) for kv in P.HOLDERS.items() for x in kv])
    holder = F.try_element_at(holders, F.substring(n, 4, 1))
    return F.struct(
        (shape & holder.isNotNull()).alias("valid"), F.nullif(n, F.lit("")).alias("normalized"), F.when(shape, holder).alias("holder_type"),
        F.when(n == "", "empty PAN").when(~shape, "format mismatch (expect AAAAA9999A)").when(holder.isNull(), F.concat(F.lit("unknown holder-type char '"), F.substring(n, 4, 1), F.lit("'"))).alias("reason"),
    )


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def register(spark) -> None:
    """SQL functions for the parts that SQL lacks."""
    spark.udf.register("nfkc_clean", _nfkc)
    spark.udf.register("names_alike", _alike)
