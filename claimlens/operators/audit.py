"""Audit records, metrics, and the result cache by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked(text: Column) -> Column:
    """Twelve-digit numbers with all but the last four digits covered; audit records never hold them whole."""
    return F.regexp_replace(text, "\\b\\d{4}[ \\t-]?\\d{4}[ \\t-]?(\\d{4})\\b", "XXXX XXXX $1")


def redacted(fields: Column, keys: tuple[str, ...] = ("pan_number", "aadhaar_number", "aadhaar", "passport_number")) -> Column:
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*keys) & (F.length(v) > 4), F.concat(F.lit("***"), F.right(v, F.lit(4)))).otherwise(v))


def records(results: DataFrame, created_at: Column) -> DataFrame:
    """(request_id, created_at, decision, record): the JSON line of each result, numbers masked."""
    return results.select("request_id", created_at.alias("created_at"), F.coalesce("decision", F.lit("REVIEW")).alias("decision"), masked(F.to_json(F.struct(*results.columns))).alias("record"))


def write(audit: DataFrame, path: str) -> None:
    """Append to the log; Spark's commit protocol keeps retried tasks from writing twice."""
    audit.write.mode("append").json(path)


def newest(log: DataFrame, request_id: str | None = None) -> DataFrame:
    """The newest record per request (or of one): by time, then by place in the log."""
    rows = log if request_id is None else log.where(F.col("request_id") == request_id)
    return rows.groupBy("request_id").agg(F.max(F.struct("created_at", "seq", *[c for c in log.columns if c not in ("request_id", "created_at", "seq")])).alias("r")).select("request_id", "r.*")


def unexpired(log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return log.where(F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS"))


def metrics(log: DataFrame, latest: int = 512) -> DataFrame:
    """One row over the log(created_at, seq, decision, errored, latency_ms): totals, and p50 and p95 of the latest samples.

    p95 is the sample at the floor of 0.95 (n - 1).  The latest are taken by a top-k, not by a sort of the log.
    """
    totals = log.agg(F.count("*").alias("requests_total"), F.count_if("errored").alias("errors_total"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("APPROVE", "REVIEW", "REJECT")])
    last = log.orderBy(F.desc("created_at"), F.desc("seq")).limit(latest)
    sample = last.agg(F.array_sort(F.collect_list("latency_ms")).alias("s"), F.median("latency_ms").alias("p50"))
    n = F.size("s")
    return totals.crossJoin(sample).select(
        "requests_total", "errors_total", "approve", "review", "reject", F.round(F.coalesce("p50", F.lit(0.0)), 1).alias("p50"),
        F.round(F.coalesce(F.get("s", F.floor(F.lit(0.95) * (n - 1)).cast("int")), F.lit(0.0)), 1).alias("p95"), n.alias("samples"),
    )


def content_key(content: Column, engine: Column, kind: Column, tables: Column) -> Column:
    """SHA-256 over the bytes and the settings that change a result."""
    return F.sha2(F.concat(content, F.concat(F.lit("|engine="), engine, F.coalesce(kind, F.lit("AUTO")), F.lit("|tbl="), F.when(tables, "1").otherwise("0")).cast("binary")), 256)


def once_per_content(files: DataFrame, key: str = "content_key") -> DataFrame:
    """The files that need work: one per content; results join back on the key."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("path"))).where("_n = 1").drop("_n")
