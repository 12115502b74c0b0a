"""All verification queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import intake, relational, service, verification

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**verification.QUERIES, **intake.QUERIES, **service.QUERIES, **relational.QUERIES}
ORACLE_SQL: dict[str, str] = {**verification.ORACLE_SQL, **intake.ORACLE_SQL, **service.ORACLE_SQL, **relational.ORACLE_SQL}
