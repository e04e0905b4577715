"""Orders by several keys, texts among them in the order of a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The collation of Swedish: å, ä and ö behind z, accents and capitals only where texts are else the same.
SWEDISH = "sv"


def by(*keys: str, locale: str = SWEDISH) -> list[Column]:
    """Columns to order by: `-name` for descending, `~name` for a text in the order of a language, `-~name` for both. Nulls come last."""

    def key(k: str) -> Column:
        down, text = k.startswith("-"), "~" in k[:2]
        column = F.col(k.lstrip("-~"))
        column = F.collate(column, locale) if text else column
        return column.desc_nulls_last() if down else column.asc_nulls_last()

    return [key(k) for k in keys]


def ordered(df: DataFrame, *keys: str, tie: str, locale: str = SWEDISH) -> DataFrame:
    """`df` in an order of its own for every row: by the keys, then by `tie`, which no two rows share. The sort is by ranges, in as many tasks as there are partitions."""
    return df.orderBy(*by(*keys, tie, locale=locale))


def first_of_each(df: DataFrame, group: list[str], *keys: str, tie: str, most: int, locale: str = SWEDISH) -> DataFrame:
    """The first `most` rows of each group, with their `place`."""
    window = Window.partitionBy(*group).orderBy(*by(*keys, tie, locale=locale))
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= most)
