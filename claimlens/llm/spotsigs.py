"""SpotSigs document fingerprints in DataFrame operations only.

A spot is a common word (the anchor) and the chain of the next ``chain`` content
words after it.  In a run of anchors the last one counts.  A fingerprint is the
sorted set of 32-bit digests of a text's spots; pairs of fingerprints are compared by
Jaccard similarity.  With a threshold, which the query does not give, sizes whose
ratio is below it are not compared.  There is no join over all signatures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Common words of four languages, lower case; any of them is an anchor.  The list is a parameter.
ANCHORS = tuple(
    "the a an of to in is was are were be been and or that this it he she they with for on at by from as not but have has had will would can could there which who what when "
    "der die das und ist war sind ein eine einer einen im den dem des mit von zu auf für als auch nicht sich es er sie wir bei nach aus um "
    "le la les un une et est de du que qui dans par pour pas sur ce cette il elle ils au aux avec son sa ses ou mais plus "
    "el los las una y es en por con para no se su al lo como más pero sus o"
    .split()
)


_ANCHOR, _START = "\x01", "\x02"


def add_signature(df: DataFrame, text: str, to: str, anchors: tuple[str, ...] = ANCHORS, chain: int = 2, every: int = 8) -> DataFrame:
    """df with the signature of column text as column to: the sorted set of digests, array<int>.

    Words are runs of letters and digits, in lower case.  So that lists and languages
    without anchors are not left with nothing, one in ``every`` content words, told by
    its hash, starts a chain too.  A text without any spot has its whole word sequence
    as its only one, one without a word itself.  Null counts as empty, and empty has none.

    Each step is a column of its own: what several steps read is computed once.
    """
    word, skip = f"[^ {_ANCHOR}][^ ]* ", f"(?:{_ANCHOR}[^ ]+ )?"
    chained = f"[{_ANCHOR}{_START}](?=([^ ]+ {(skip + word) * chain}))"
    mark = lambda w: F.when(w.isin(*anchors), F.concat(F.lit(_ANCHOR), w)).when(F.xxhash64(w) % every == 0, F.concat(F.lit(_START), w)).otherwise(w)
    return (
        df.withColumn("_w", F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+", " ")), " "))
        .withColumn("_l", F.concat(F.array_join(F.transform("_w", mark), " "), F.lit(" ")))
        # of a run of anchors the last stays, so that no more than one stands between content words
        .withColumn("_s", F.regexp_extract_all(F.regexp_replace("_l", f"{_ANCHOR}[^ ]+ (?={_ANCHOR})", ""), F.lit(chained), F.lit(1)))
        .withColumn(
            "_s",
            F.when(F.size("_s") > 0, F.transform("_s", lambda s: F.regexp_replace(s, f"{_ANCHOR}[^ ]+ |{_START}", "")))
            .when(F.element_at("_w", 1) != "", F.array(F.array_join("_w", " ")))
            .when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>"))
            .otherwise(F.array(text)),
        )
        .withColumn(to, F.array_sort(F.array_distinct(F.transform("_s", lambda s: F.xxhash64(s).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))))
        .drop("_w", "_l", "_s")
    )


def spelled(sig: Column) -> Column:
    """A signature as text: eight hex digits a digest."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two signatures; two empty ones are alike.

    Below threshold the result is 0; if the sizes alone rule the threshold out, the
    sets are not compared.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common.cast("double") / (F.size(a) + F.size(b) - common)
    compared = F.when(large == 0, 1.0).when(small == 0, 0.0).when(a == b, 1.0).otherwise(exact)
    if threshold <= 0:
        return compared
    return F.when(small < threshold * large, 0.0).otherwise(F.when(compared >= threshold, compared).otherwise(0.0))


#: Bytes of rows that one range of ids holds, about, and what a row takes besides its text.
RANGE_BYTES, ROW_BYTES = 32 << 20, 64


def _ranges(sized: DataFrame, held: int, parts: int) -> list[tuple[int, int]]:
    """Edges that cut sized(k, h, bytes), of held bytes in all, into about parts ranges of equal bytes.

    Rows are drawn by their bytes, some 64 a range; a row that is drawn for certain stands
    for all its bytes, any other for as many as one draw.
    """
    if parts < 2:
        return []
    each = held / (64.0 * parts)
    drawn = sized.where(F.rand(1) * F.lit(each) < F.col("bytes")).collect()
    found = sorted((r["k"], r["h"], max(float(r["bytes"]), each)) for r in drawn)
    room = sum(w for _, _, w in found) / parts
    edges, before = set(), 0.0
    for k, h, weight in found:
        if before // room != (before + weight) // room and before:
            edges.add((k, h))
        before += weight
    return sorted(edges)[: parts - 1]


def _place(k: Column, h: Column, edges: list[tuple[int, int]]) -> Column:
    """How many edges are at most (k, h): a binary search in a constant array."""
    if not edges:
        return F.lit(0)
    one, two = (F.array(*map(F.lit, x)).cast("array<long>") for x in zip(*edges))
    steps = F.array(*[F.lit(1 << i) for i in range(len(edges).bit_length() - 1, -1, -1)])

    def halve(at: Column, step: Column) -> Column:
        edge = F.get(one, at + step - 1)
        below = (edge < k) | ((edge == k) & (F.get(two, at + step - 1) <= h))
        return F.when((at + step <= len(edges)) & below, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def with_next(docs: DataFrame, extra: Callable[[DataFrame], DataFrame] | None = None, carry: tuple[str, ...] = (), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs(doc_id, text) with next, the text and carry of the next row by ascending doc_id, after the last the first's.

    extra adds the carried columns to rows of text.

    Ids are cut into ranges of about equal bytes at sampled edges, a range a task; each is ordered
    on its own, and a range's last row finds the next range's first, which is sent
    along.  Rows of one id are ordered by their texts' hashes, then texts, and ranges
    cut between them too; null ids come first.  A text travels once.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("k")).withColumn("h", F.xxhash64("text"))
    size = F.octet_length("text").cast("long") + ROW_BYTES
    held = rows.agg(F.sum(size)).first()[0] or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // range_bytes)), 1 << 15)
    edges = _ranges(rows.select("k", "h", size.alias("bytes")), held, parts) if held else []
    rows = rows.withColumn("part", _place(F.col("k"), F.col("h"), edges).cast("int"))
    firsts = rows.groupBy("part").agg(F.min(F.struct("k", "h", "text")).alias("first")).select("part", "first.*")
    before = Window.orderBy("part")  # one row a range
    ends = firsts.withColumn("part", F.coalesce(F.lag("part").over(before), F.max("part").over(Window.partitionBy())))
    both = rows.withColumn("after", F.lit(0)).unionByName(ends.withColumn("doc_id", F.lit(None).cast("long")).withColumn("after", F.lit(1)))
    dealt = both.repartitionById(len(edges) + 1, "part")  # a range a task
    dealt = extra(dealt) if extra else dealt
    order = Window.partitionBy("part").orderBy("after", "k", "h", "text")
    return dealt.withColumn("next", F.lead(F.struct("text", *carry)).over(order)).where("after = 0").drop("k", "h", "part", "after")


def edited(text: Column, other: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the other text (or all it has)."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))


def fingerprint_report(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = 2, every: int = 8) -> DataFrame:
    """Fingerprints of every row of docs(doc_id, text) and of its edited text, and how alike they and the next row's are.

    Null texts count as empty; an empty text has an empty fingerprint, alike to
    another empty one only.  Repeated rows follow each other.  In a table of one row
    the next row is the row itself.  Other columns are ignored; no rows give none.
    """
    sign = lambda df, text, to: add_signature(df, text, to, anchors, chain, every)
    rows = with_next(docs, lambda df: sign(df, "text", "a"), ("a",))
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next.text")))
    made = sign(rows, "edit", "b").select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), "a", "b", F.col("next.a").alias("c")
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("a")).alias("fingerprint"), spelled(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
