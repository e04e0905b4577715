"""State that grows: keyed merges, append-only histories, retries, memories of what was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` replaces rows of `old` with the same key. Keys of `new` are distinct."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` are added where `old` lacks their key."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key, as an aggregation with partial results."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in (*order, *columns)])


def changes(df: DataFrame, cell: str, order: list[str], position: str) -> DataFrame:
    """Each statement of a cell with the position before it, where that differs."""
    before = F.lag(position).over(Window.partitionBy(cell).orderBy(*order))
    return df.withColumn("before", before).where(F.col("before") != F.col(position))


def retry_state(df: DataFrame, keys: list[str], time: str, now: Column, most_days: int) -> DataFrame:
    """First and latest attempt, their number, and whether the first lies over `most_days` whole days back."""
    out = df.groupBy(*keys).agg(F.min(time).alias("first"), F.max(time).alias("latest"), F.count("*").alias("attempts"))
    return out.withColumn("overdue", F.floor((F.unix_micros(now) - F.unix_micros(F.col("first").cast("timestamp"))) / 86_400_000_000) > most_days)


def unseen(df: DataFrame, seen: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key that `seen` (a column `key`) lacks."""
    keyed = df.withColumn("key", key)
    firsts = keyed.groupBy("key").agg(F.min(order).alias(order))
    return firsts.join(seen.select("key").distinct(), "key", "left_anti")


def copy_difference(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that are missing in `new`, left over there, or changed."""
    side = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("o").isNull(), "left_over").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select(key, kind.alias("kind")).where("kind IS NOT NULL")


def out_of_order(df: DataFrame, cell: str, order: str, time: str) -> DataFrame:
    """For each cell with any, the statements whose time lies before that of the one before them."""
    before = F.lag(time).over(Window.partitionBy(cell).orderBy(order))
    return df.withColumn("__b", before).where(F.col("__b") > F.col(time)).groupBy(cell).agg(F.count("*").alias("n"))


def unresolved(queue: DataFrame, published: DataFrame, rejected: DataFrame, title: Column, quote: Column, least: int = 30) -> DataFrame:
    """Rows of the queue whose title key and quote fingerprint are neither published nor rejected. Fingerprints under `least` characters match
    nothing, and null keys neither. A fingerprint is made once a row: conditions on what `explode` gives are not tested before it, where they would make it anew."""
    quoted = lambda df, *columns: df.select(*columns, F.explode(F.array(quote)).alias("__f"))
    key = F.when(F.char_length("__f") >= least, F.md5("__f")).alias("__q")
    done = published.unionByName(rejected)
    out = quoted(queue, "*", F.md5(title).alias("__t")).select(*queue.columns, "__t", key)
    out = out.join(done.select(F.md5(title).alias("__t")).where("__t IS NOT NULL").distinct(), "__t", "left_anti")
    out = out.join(quoted(done).select(key).where("__q IS NOT NULL").distinct(), "__q", "left_anti")
    return out.drop("__t", "__q")


def canonical_json(*columns: str) -> Column:
    """The columns as a JSON object with its keys in order, nulls included; two rows have the same text only if they are equal."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
