"""Language identification by bit-sliced Bloom filters of character n-grams.

One table holds the filters of all languages, one bit plane each: a slot has one
64-bit word for every 64 languages, the set of those that have an n-gram there.  Two
probes ANDed give every language that has the n-gram.  A text's n-grams are
counted per language; what a language would get by chance (its filter's measured
false-positive rate) is taken off, and the largest corrected count decides.

Learning takes a bounded, deterministic sample of the labelled rows
(``train_per_language`` documents of each language in expectation), counts on
the executors in how many documents each n-gram stands, and keeps per language
about the ``grams_per_language`` most common ones whose share of documents is at least
``min_share`` of that in the language where they are most common.  An n-gram that
stands in one document only counts in languages of fewer than ``few`` documents,
which take none from larger ones.  This model is all that reaches the driver; its
size grows with the number of languages, not with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, slices, texts

SIZES = (2, 3, 4)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
#: Low bits that a hash leaves to a text's or language's number.
_ROOM = np.uint64(0xFFFF)
#: A worker's table of letters: code points to themselves where a letter, else to a space.
_letters: list[np.ndarray] = []


def _points(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts end to end, everything else as single spaces, and the text of each.

    Each text starts and ends with a space, so word edges are part of n-grams.
    """
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = c
        _letters.append(table)
    low = [" " + t.lower() + " " for t in docs]
    size = np.fromiter(map(len, low), np.int64, len(low))
    point = _letters[0][np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")]
    owner = np.repeat(np.arange(len(docs)), size)
    keep = np.ones(len(point), bool)
    keep[1:] = (point[1:] != 32) | (point[:-1] != 32) | (owner[1:] != owner[:-1])
    return point[keep], owner[keep]


def _grams(point: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of each size that lie in one text and hold no space inside, and their texts."""
    mixed = (point.astype(np.uint64) + np.uint64(1)) * _MIX[3]
    space = point == 32
    inner = space.copy()
    h = mixed.copy()
    for n in range(2, max(SIZES) + 1):
        if len(point) < n:
            return
        h = (h[:-1] * _MIX[2]) ^ (mixed[n - 1 :] + (h[:-1] >> np.uint64(31)))
        if n not in SIZES:
            continue
        ok = owner[n - 1 :] == owner[: len(h)]
        for k in range(1, n - 1):
            ok &= ~inner[k : k + len(h)]
        yield (h[ok] ^ (np.uint64(n) << np.uint64(32))) & ~_ROOM, owner[: len(h)][ok]


def _probes(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - slots.bit_length() + 1)
    return ((h * _MIX[0]) >> shift).astype(np.int64), ((h * _MIX[1]) >> shift).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # uint64 of words by slots; word w holds languages 64 w to 64 w + 63
    chance: np.ndarray  # of a false positive, by language

    def classify(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number (-1: no letter or no model), the score, and all corrected counts."""
        point, owner = _points(docs)
        n, many = len(docs), len(self.languages)
        letters = np.bincount(owner[point != 32], minlength=n)
        total = np.zeros(n)
        hits = np.zeros((n, many))
        for h, of in _grams(point, owner):
            a, b = _probes(h, self.table.shape[1])
            total += np.bincount(of, minlength=n)
            for word, plane in enumerate(self.table):
                mask = plane[a] & plane[b]
                for bit in range(min(64, many - 64 * word)):
                    hits[:, 64 * word + bit] += np.bincount(of[(mask >> np.uint64(bit)) & np.uint64(1) > 0], minlength=n)
        if not many:
            return np.full(n, -1), np.zeros(n), hits
        corrected = np.maximum(hits - total[:, None] * self.chance, 0) / (1 - self.chance)
        best = corrected.argmax(axis=1)
        top = corrected[np.arange(n), best]
        ordered = np.sort(corrected, axis=1)
        second = ordered[:, -2] if many > 1 else np.zeros(n)
        # how much of the n-grams the language knows, and how far it leads
        score = np.where(total > 0, top / np.maximum(total, 1) * (top / np.maximum(top + second, 1e-9)), 0.0)
        best = np.where(letters > 0, best, -1)
        return best, np.where(letters > 0, np.clip(score, 0, 1), 0.0), corrected


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, train_per_language: int = 2000, grams_per_language: int = 20_000, slots: int = 1 << 21, min_share: float = 0.3, few: int = 10) -> Model:
    """Learn from text and lang of the rows of docs(doc_id, text, lang) that are not held out, all their languages.

    A language whose documents are all held out cannot be learned.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    many = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(many)
    words = -(-len(languages) // 64)
    table = np.zeros((words, slots), np.uint64)
    if not languages:
        return Model([], table, np.zeros(0))
    spark = docs.sparkSession
    rows = [(k, i, min(1.0, train_per_language / many[k]), float(min(train_per_language, many[k]))) for i, k in enumerate(languages)]
    kinds = F.broadcast(spark.createDataFrame(rows, "lang string, at int, share double, docs double"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.select("lang", "text", draw.alias("draw")).join(kinds, "lang").where("draw < share").select("at", "text")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            here, lang = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            lang = lang.astype(np.uint64)
            point, owner = _points([t.decode("utf-8", "replace") for t in texts(batch, "text")])
            for h, of in _grams(point, owner):
                # once a document, then documents by language; low bits of the hash make room for either
                pair = np.unique((h & ~_ROOM) | of.astype(np.uint64))
                both, n = np.unique((pair & ~_ROOM) | lang[(pair & _ROOM).astype(np.int64)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(here[(both & _ROOM).astype(np.int64)]), pa.array((both & ~_ROOM).view(np.int64)), pa.array(n.astype(np.int64))], names=["at", "gram", "n"])

    grams = sample.mapInArrow(count, "at int, gram long, n long").groupBy("at", "gram").agg(F.sum("n").alias("n"))
    # an n-gram is a language's if it is about as common there as anywhere; one in a single document is a chance word where there are many
    rated = grams.join(kinds, "at").where((F.col("n") > 1) | (F.col("docs") < few)).select("at", "gram", "n", (F.col("docs") < few).alias("small"), (F.col("n") / F.col("docs")).alias("rate"))
    same = Window.partitionBy("gram")
    most = F.when(F.col("small"), F.max("rate").over(same)).otherwise(F.max(F.when(~F.col("small"), F.col("rate"))).over(same))
    own = rated.withColumn("most", most).where(F.col("rate") >= min_share * F.col("most"))
    best = _most_common(materialize(own.select("at", "gram", "n"), "grams"), grams_per_language).toPandas()
    at = best["at"].to_numpy(np.int64)
    bits = np.uint64(1) << (at % 64).astype(np.uint64)
    for place in _probes(best["gram"].to_numpy(np.int64).view(np.uint64), slots):
        np.bitwise_or.at(table, (at // 64, place), bits)
    fill = np.array([((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, table, fill**2)


def _most_common(grams: DataFrame, most: int) -> DataFrame:
    """(at, gram) of the n-grams of grams(at, gram, n) that are the most common of their language, about ``most`` of them.

    Counts by how many n-grams have them tell from which count on all fit; of those
    with the next lower count a share told by a hash fills up, so no task ranks a language.
    """
    counts = grams.groupBy("at", "n").agg(F.count("*").alias("has"))
    above = F.coalesce(F.sum("has").over(Window.partitionBy("at").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each number of documents of the sample that some n-gram of a language stands in: bounded as the sample is
    share = counts.withColumn("share", (F.lit(most) - above) / F.col("has")).where("share > 0").select("at", "n", "share")
    draw = F.pmod(F.xxhash64("gram", F.lit("grams")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return grams.join(F.broadcast(share), ["at", "n"]).where(draw < F.col("share")).select("at", "gram")


def identify(docs: DataFrame, model: Model | None = None, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text, lang).

    lang is read for learning only.  A text that is null or has no letter, and any
    text when there is nothing to learn from, gets ``und`` and score 0.  Ties go to
    the language that sorts first.  Repeated rows and null ids stay; other columns
    are ignored.
    """
    model = model or train(docs, **settings)
    return docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        _apply(docs.sparkSession, model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def _apply(spark: SparkSession, model: Model, keep: list[str]):
    # the table is slots * 8 bytes, whatever the data
    sent = spark.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        for batch in slices(batches, "text", 1 << 20):
            best, score, _ = model.classify([t.decode("utf-8", "replace") for t in texts(batch, "text")])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return run


def accepted(docs: DataFrame, min_score: float = 0.1) -> DataFrame:
    """The rows of docs whose language is told, with score min_score or more; docs' columns are unchanged."""
    model = train(docs)
    names = docs.columns
    keep = [c if c == "text" else f"in_{i}" for i, c in enumerate(names)]
    inner = docs.select([F.col(f"`{c}`").alias(k) for c, k in zip(names, keep)])
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(inner.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    told = inner.mapInArrow(_apply(docs.sparkSession, model, keep), schema)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select([F.col(k).alias(c) for k, c in zip(keep, names)])
