"""File scans and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Claimed profiles from JSON files, as one map per file."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.from_json("value", "map<string,string>").alias("truth"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def mime(path: Column) -> Column:
    """The type that an extension stands for; null for one that is not admitted.

    All admitted extensions stand for images or PDF, so the rule on types follows from that on extensions.
    """
    ext = extension(path)
    return F.when(ext == "pdf", "application/pdf").when(ext == "jpg", "image/jpeg").when(ext == "tif", "image/tiff").when(ext.isin(*P.EXTENSIONS), F.concat(F.lit("image/"), ext))


def admission(max_mb: int = 15) -> Column:
    """Over binaryFile columns: the error code of a file, first rule that holds; null: admitted."""
    ext = extension(F.col("path"))
    head = F.hex(F.substring("content", 1, 8))
    fits = ext.isin("tif", "tiff", "webp")
    for magic, kind in P.MAGIC:
        fits = fits | (head.startswith(magic) & (ext == kind))
    return (
        F.when(F.col("content").isNull(), "FILE_NOT_FOUND").when(~ext.isin(*P.EXTENSIONS), "UNSUPPORTED_FORMAT").when(F.col("length") > max_mb * 1024 * 1024, "FILE_TOO_LARGE")
        .when(F.col("length") == 0, "CORRUPT_FILE").when(~fits, "UNSUPPORTED_FORMAT")
    )


def cap_batch(requests: DataFrame, most: int = 20) -> DataFrame:
    """The batch itself; an error if it is empty or above its limit (never a truncation)."""
    n = requests.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"a batch holds 1 to {most} requests")
    return requests
