"""A training-data pipeline over documents: each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import bpe, langid, mixing, simhash, suffix_dedup
from claimlens.llm.common import materialize
from claimlens.session import ship


#: Bytes and words from which on a passage that stands elsewhere too goes.  Of the windows of 51 words in the
#: given texts one in a hundred has fewer bytes (lists of short words).
PASSAGE_BYTES, PASSAGE_WORDS = 240, 51


def _marked(docs: DataFrame, salt: str, *names: str) -> DataFrame:
    """docs as row, its columns names, and _row and _row2, 128 bits of hashes that tell rows apart.

    Maps, which have no hash, count as their JSON.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(every, docs.schema.fields)]
    return docs.select(F.struct(*every).alias("row"), *names, F.xxhash64(*plain).alias("_row"), F.xxhash64(F.lit(salt), *plain).alias("_row2"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without text or letters, or far from all languages, go."""
    ship(spark)
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the smallest doc_id, a null one only where there is no other."""
    ship(spark)
    key = ("_row", "_row2")
    marked = _marked(docs, "near", "doc_id", "text")
    kept = simhash.representatives(marked.select("doc_id", "text", *key), key)
    # rows that are equal in every column have one key
    return marked.select("row", *key).join(kept, list(key)).groupBy(*key).agg(F.first("row").alias("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that stand more than once among them."""
    ship(spark)
    return suffix_dedup.without_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    The mix works on ids and sizes; texts travel once, when each row learns its copies.
    Rows that are equal in every column are one row then, with the copies of all.
    """
    ship(spark)
    weight = mixing.quality_weight(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key = ["_row", "_row2"]
    marked = _marked(docs, "mix", "doc_id", "text", "source")
    copies = mixing.mix(marked, by_id=weight, carry=["doc_id", *key]).groupBy(*key).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    # the join leaves rows dealt out and sorted by key, as the aggregation needs them
    found = marked.select("row", *key).join(copies, key).groupBy(*key).agg(F.first("row").alias("row"), F.first("_copies").alias("_copies"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents, one row per row."""
    ship(spark)
    return bpe.encode_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("bpe", tokens),
]
#: SQL cannot express the first stages; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
