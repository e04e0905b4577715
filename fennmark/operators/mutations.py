"""Validated rewrites of records: what is asked for is checked, and only what passes is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gates

LEAST_REASON = 40


def withdrawals(records: DataFrame, asked: DataFrame, key: str, status: str, withdrawn: str = "withdrawn") -> DataFrame:
    """Each request (key, reason) with the names of the checks that it fails: the record exists, is not withdrawn yet, and the
    reason has LEAST_REASON characters at least. Of several requests for a record the least reason counts."""
    once = asked.groupBy(key).agg(F.min("reason").alias("reason"))
    joined = once.join(records.select(key, F.col(status).alias("__status"), F.lit(True).alias("__known")), key, "left")
    checks = {"known": F.col("__known"), "active": F.coalesce(F.col("__status") != withdrawn, F.lit(True)), "reason": F.char_length("reason") >= LEAST_REASON}
    return joined.select(key, "reason", gates.failures(checks).alias("failures"))


def withdraw(records: DataFrame, asked: DataFrame, key: str, status: str, withdrawn: str = "withdrawn") -> DataFrame:
    """The records, those with a valid request withdrawn; nothing else changes."""
    valid = withdrawals(records, asked, key, status, withdrawn).where(F.size("failures") == 0).select(key, F.lit(True).alias("__go"))
    return records.join(valid, key, "left").withColumn(status, F.when(F.col("__go"), withdrawn).otherwise(F.col(status))).select(*records.columns)
