"""Amounts in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(text: Column) -> Column:
    """The runs of one to nine digits that are no part of a longer word, as whole numbers in order."""
    bare = F.filter(F.split(text, "[^0-9A-Za-z]+"), lambda w: w.rlike("^[0-9]{1,9}$"))
    return F.transform(bare, lambda w: w.cast("bigint"))


def claim_numbers(text: Column) -> Column:
    """The numbers of a list of claims such as "1-3, 7": ranges in full, distinct, in order. A range that runs backwards is its two ends."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]{1,4}-[0-9]{1,4}|[0-9]{1,4})"), F.lit(1))

    def expanded(p: Column) -> Column:
        a, b = F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.when(F.contains(p, F.lit("-")), F.split_part(p, F.lit("-"), F.lit(2)).cast("int"))
        return F.when(b.isNull(), F.array(a)).when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expanded))))
