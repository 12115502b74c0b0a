"""Classification, and typed and general fields, as expressions over a document's lines and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def classify(text: Column, hint: Column | None = None) -> Column:
    """struct(document_type, confidence, signals): both signs of a kind 1.0, bank and salary words 0.75, one sign 0.55, else the hint at 0."""
    kinds = (("AADHAAR", P.AADHAAR, P.AADHAAR_WORDS, "AADHAAR"), ("PAN", P.PAN, P.PAN_WORDS, "PAN"), ("PASSPORT", P.PASSPORT, P.PASSPORT_WORDS, "PASSPORT"), ("DRIVING_LICENSE", P.DRIVING, P.DRIVING_WORDS, "DL"), ("GST_CERTIFICATE", P.GSTIN, P.GST_WORDS, "GST"))
    made = lambda kind, c, *signals: F.struct(kind.alias("document_type"), F.lit(c).alias("confidence"), F.array(*map(F.lit, signals)).cast("array<string>").alias("signals"))
    named = {"AADHAAR": ("AADHAAR_NUM", "AADHAAR_KW"), "PAN": ("PAN_NUM", "PAN_KW"), "PASSPORT": ("PASSPORT_MRZ_OR_NUM_KW",), "DRIVING_LICENSE": ("DL_NUM", "DL_KW"), "GST_CERTIFICATE": ("GSTIN", "GST_KW")}
    out = None
    for kind, number, words, _ in kinds:
        full = text.rlike(number) & text.rlike(words)
        full = text.rlike(P.MRZ) | full if kind == "PASSPORT" else full
        value = made(F.lit(kind), 1.0, *named[kind])
        out = F.when(full, value) if out is None else out.when(full, value)
    out = out.when(text.rlike(P.BANK_WORDS), made(F.lit("BANK_STATEMENT"), 0.75, "BANK_STATEMENT_KW")).when(text.rlike(P.SALARY_WORDS), made(F.lit("SALARY_SLIP"), 0.75, "SALARY_SLIP_KW"))
    for kind, number, words, short in kinds:
        out = out.when(text.rlike(number) | text.rlike(words), made(F.lit(kind), 0.55, f"{short}_PARTIAL"))
    if hint is not None:
        out = out.when(hint.isNotNull() & (hint != "UNKNOWN"), made(hint, 0.0, "HINT_FALLBACK"))
    return out.otherwise(made(F.lit("UNKNOWN"), 0.0))


def label_line(lines: Column, pattern: str) -> Column:
    """The 0-based place of the first line that matches, null if none."""
    at = F.transform(lines, lambda s: s.rlike(pattern))
    return F.nullif(F.array_position(at, F.lit(True)).cast("int"), F.lit(0)) - 1


def after_label(lines: Column, at: Column, pattern: str) -> Column:
    """What follows the label: the rest of its line, else the next of two lines that is not blank; null if that is a label."""
    def found(at: Column) -> Column:
        # the tail behind the first match of the label, by taking off the shortest head that ends with it
        tail = T.up_to_label(T.strip_marks(F.regexp_replace(F.get(lines, at), f"^[\\s\\S]*?{_inline(pattern)}", ""), " :\\-\\t"))
        one, two = F.trim(F.get(lines, at + 1)), F.trim(F.get(lines, at + 2))
        below = F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit("")))
        return T.let(tail, lambda t: F.when((t != "") & ~T.is_label(t), t).otherwise(T.let(below, lambda b: F.when(~T.is_label(b), T.up_to_label(b)))))

    return T.let(at, found)


def _inline(pattern: str) -> str:
    return "(?i:" + pattern[4:] + ")" if pattern.startswith("(?i)") else "(?:" + pattern + ")"


def _named(lines: Column, pattern: str, first: bool = False) -> Column:
    """The name behind a label.  The label on the document's first line does not count unless first."""
    value = lambda at: T.person_name(T.without_leak(after_label(lines, at, pattern)))
    return T.let(label_line(lines, pattern), value if first else lambda at: F.when(at > 0, value(at)))


def _first_date(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, P.DATE, 1), F.lit(""))


def _birth(lines: Column, text: Column, pattern: str, as_of: str | None) -> Column:
    return T.normalize_date(F.coalesce(F.nullif(after_label(lines, label_line(lines, pattern), pattern), F.lit("")), _first_date(text)), as_of)


def _date_at(lines: Column, pattern: str, as_of: str | None) -> Column:
    return T.normalize_date(_first_date(after_label(lines, label_line(lines, pattern), pattern)), as_of)


def _above(lines: Column, at: Column, how_many: int, value) -> Column:
    """The first non-null value(line) going up from the line above at."""
    nearer = lambda at: F.reverse(F.slice(lines, F.greatest(F.lit(1), at - how_many + 1), F.least(F.lit(how_many), at)))
    return T.let(at, lambda at: F.when(at > 0, F.get(F.filter(F.transform(nearer(at), lambda s: value(F.trim(s))), lambda v: v.isNotNull()), 0)))


def _take(pattern: str, text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def fields(lines: Column, text: Column, as_of: str | None = None) -> dict[str, Column]:
    """Every field by document kind: {kind.field: expression}."""
    up = F.upper(text)
    father = label_line(lines, P.FATHER_LABEL)
    card = F.array(*map(F.lit, P.CARD_LABELS))
    above_father = _above(lines, father, 3, lambda s: F.when(~F.array_contains(card, F.lower(T.strip_marks(s))), T.person_name(T.without_leak(s))))
    numbers = F.transform(F.regexp_extract_all(text, F.lit("(" + P.AADHAAR_PARTS.replace("(\\d{4})", "\\d{4}") + ")"), F.lit(1)), lambda s: F.regexp_replace(s, "\\D", ""))
    valid = F.get(F.filter(numbers, T.verhoeff), 0)
    dob_at = label_line(lines, P.AADHAAR_DOB_LABEL)

    def plain_name(s: Column) -> Column:
        def judged(low: Column) -> Column:
            words = F.split(low, "\\s+")
            slogan = low.rlike("[,;]") | (F.size(words) > 5) | F.exists(words, lambda w: F.regexp_replace(w, "^\\.+|\\.+$", "").isin(*P.SLOGAN_WORDS)) | low.rlike("|".join(P.SLOGAN_PARTS))
            return ~low.rlike("|".join(P.ABOVE_BIRTH)) & ~slogan

        return T.let(T.person_name(T.without_leak(s)), lambda name: F.when((F.size(F.split(name, " ")) >= 2) & T.let(F.lower(s), judged), name))

    top = F.get(F.filter(F.transform(F.slice(lines, 1, 8), lambda s: plain_name(F.trim(s))), lambda v: v.isNotNull()), 0)
    gender_at = label_line(lines, P.GENDER_LABEL)
    gender = F.upper(F.nullif(F.regexp_extract(after_label(lines, gender_at, P.GENDER_LABEL), P.GENDER_VALUE, 1), F.lit("")))
    mrz = F.get(F.filter(F.transform(lines, lambda s: F.regexp_replace(s, " ", "")), lambda s: s.rlike(P.MRZ_LINE)), 0)
    holder = F.regexp_replace(F.regexp_extract(mrz, P.MRZ_LINE, 2), "^<+|<+$", "")
    part = lambda v: T.person_name(F.trim(F.regexp_replace(v, "<", " ")))
    two = F.instr(holder, "<<") > 0
    nation_at = label_line(lines, P.NATIONALITY_LABEL)
    return {
        "PAN.pan_number": _take(P.PAN, up),
        "PAN.father_name": _named(lines, P.FATHER_LABEL, True),
        "PAN.name": F.coalesce(above_father, _named(lines, P.NAME_LABEL, True)),
        "PAN.dob": _birth(lines, text, P.PAN_DOB_LABEL, as_of),
        "AADHAAR.aadhaar_last4": F.right(valid, F.lit(4)),
        "AADHAAR.masked_aadhaar": F.concat(F.lit("XXXX XXXX "), F.right(valid, F.lit(4))),
        "AADHAAR.dob": _birth(lines, text, P.AADHAAR_DOB_LABEL, as_of),
        "AADHAAR.gender": F.when(gender_at > 0, T.let(gender, lambda g: F.when(g == "M", "MALE").when(g == "F", "FEMALE").otherwise(g))),
        "AADHAAR.name": T.let(dob_at, lambda at: F.when(at > 0, _above(lines, at, 3, plain_name)).otherwise(top)),
        "PASSPORT.passport_number": F.upper(_take(P.PASSPORT_ANY, text)),
        "PASSPORT.surname": F.coalesce(F.when(two, part(F.substring_index(holder, "<<", 1))), _named(lines, P.SURNAME_LABEL)),
        "PASSPORT.given_name": F.coalesce(F.when(two, part(F.regexp_replace(holder, "^.*?<<", ""))), _named(lines, P.GIVEN_LABEL)),
        "PASSPORT.nationality": F.coalesce(F.nullif(F.regexp_extract(mrz, P.MRZ_LINE, 1), F.lit("")), F.when(nation_at > 0, F.nullif(F.substring(F.upper(after_label(lines, nation_at, P.NATIONALITY_LABEL)), 1, 3), F.lit("")))),
        "PASSPORT.dob": _date_at(lines, P.DOB_LABEL, as_of),
        "PASSPORT.expiry_date": _date_at(lines, P.EXPIRY_LABEL, as_of),
        "DRIVING_LICENSE.driving_license_number": F.regexp_replace(_take(P.DRIVING, up), "[-\\s]", ""),
        "DRIVING_LICENSE.name": _named(lines, P.NAME_LABEL),
        "DRIVING_LICENSE.dob": _date_at(lines, P.DOB_LABEL, as_of),
        "DRIVING_LICENSE.validity": _date_at(lines, P.VALIDITY_LABEL, as_of),
        "GST_CERTIFICATE.gstin": _take(P.GSTIN, up),
        "GST_CERTIFICATE.legal_name": _named(lines, P.LEGAL_LABEL),
        "GST_CERTIFICATE.trade_name": _named(lines, P.TRADE_LABEL),
    }


def extract(docs: DataFrame, as_of: str | None = None) -> DataFrame:
    """docs(document_type, lines, raw_text) with fields map<string,string> of its kind, and name for comparison.

    A passport's name is its given name and surname, a registration's its legal name.
    Dates after as_of (today) are null, expiry and validity too.
    """
    every = fields(F.col("lines"), F.col("raw_text"), as_of)
    kinds = sorted({k.split(".")[0] for k in every})
    out = F.lit(None).cast("map<string,string>")
    for kind in kinds:
        own = {k.split(".")[1]: v for k, v in every.items() if k.startswith(kind + ".")}
        if kind == "PASSPORT":
            own["name"] = F.nullif(F.concat_ws(" ", own["given_name"], own["surname"]), F.lit(""))
        if kind == "GST_CERTIFICATE":
            own["name"] = F.coalesce(own["legal_name"], own["trade_name"])
        packed = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
        out = F.when(F.col("document_type") == kind, packed).otherwise(out)
    return docs.withColumn("fields", F.coalesce(out, F.create_map().cast("map<string,string>")))


def key_values(docs: DataFrame, id_col: str, text: str, max_lines: int = 100) -> DataFrame:
    """(id, pos, key, value) of a text's "key: value" lines."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"), lambda s: F.trim(F.regexp_replace(s, "\\s+", " "))), lambda s: s != ""), 1, max_lines)
    rows = docs.select(id_col, F.posexplode(lines).alias("pos", "line")).where(F.col("line").rlike(P.KEY_VALUE))
    key = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_extract("line", P.KEY_VALUE, 1))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 64)
    value = T.strip_marks(F.regexp_extract("line", P.KEY_VALUE, 2), " :\\-\\t")
    return rows.select(id_col, "pos", key.alias("key"), value.alias("value")).where((F.col("value") != "") & (F.length("value") <= 240) & ((F.length("key") >= 3) | (F.col("key") == "no")))


def key_value_map(pairs: DataFrame, id_col: str) -> DataFrame:
    """One map per document; a repeated key holds all its values in order."""
    by_key = pairs.groupBy(id_col, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("values"))
    return by_key.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("fields"))


def general_kind(text: Column, hint: Column | None = None) -> Column:
    """struct(label, category, confidence) of a document by its words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    made = lambda a, b, c: F.struct(a.alias("label"), F.lit(b).alias("category"), c.alias("confidence"))
    title = F.lit("Unknown Document") if hint is None else F.coalesce(F.initcap(F.replace(F.nullif(hint, F.lit("")), F.lit("_"), F.lit(" "))), F.lit("Unknown Document"))
    out = None
    for label, category, confidence, words in P.GENERAL:
        hit = low.rlike("|".join(words))
        value = made(F.lit(label), category, F.lit(confidence))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(made(title, "OTHER", F.when(F.trim(low) != "", F.lit(0.2)).otherwise(F.lit(0.0))))


def supports(label: Column, kind: str) -> Column:
    return F.lower(F.coalesce(label, F.lit(""))).rlike("|".join(P.LABEL_WORDS[kind]))


def is_other_label(label: Column) -> Column:
    """A label that names a document outside the fixed kinds."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return ~low.isin("", "unknown", "unknown document", "document") & ~low.rlike("|".join(w for ws in P.LABEL_WORDS.values() for w in ws))
