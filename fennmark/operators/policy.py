"""Costs of policies: totals over a term, one representative of each shared policy, and what is summed over those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: For sums of other numbers that must not depend on the order of rows.
FINE = "decimal(30,8)"
TERM_YEARS = 4
#: Standard scores of the two-sided levels that are offered; any other level counts as 0.8.
LEVELS = {0.8: 1.2816, 0.9: 1.6449, 0.95: 1.96}


def term_total(amount: Column, yearly: Column) -> Column:
    """An amount over the whole term; a null flag is one-off."""
    return amount * F.when(yearly, TERM_YEARS).otherwise(1)


def signed(amount: Column, lowers: Column) -> Column:
    """Savings and added revenue count against costs."""
    return F.when(lowers, -amount).otherwise(amount)


def money_sum(amount: Column) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.coalesce(F.sum(amount.cast(MONEY)), F.lit(0)).cast("double")


def representatives(df: DataFrame, group: list[str], total: str, order: list[str]) -> DataFrame:
    """One row for each group: the largest total, then the least of `order`. An aggregation with partial results, so a group with a third of
    all rows is no hot task."""
    rest = [c for c in df.columns if c not in (*group, total, *order)]
    first = F.min(F.struct((-F.col(total)).alias("__t"), *order, *rest)).alias("__r")
    return df.groupBy(*group).agg(first).select(*group, (-F.col("__r.__t")).alias(total), *[F.col(f"__r.{c}").alias(c) for c in (*order, *rest)])


def interval(df: DataFrame, low: Column, base: Column, high: Column, correlation: float = 0.3, level: float = 0.8) -> DataFrame:
    """The sum of triangular amounts with a band: variances add, and standard deviations to the share of `correlation`."""
    variance = F.greatest(F.lit(0.0), (low * low + base * base + high * high - low * base - low * high - base * high) / 18)
    sums = df.select(base.alias("b"), variance.alias("v")).agg(money_sum(F.col("b")).alias("base"), F.sum(F.col("v").cast(FINE)).cast("double").alias("v"), F.sum(F.sqrt("v").cast(FINE)).cast("double").alias("s"))
    sd = F.sqrt((1 - correlation) * F.col("v") + correlation * F.col("s") * F.col("s"))
    z = LEVELS.get(level, LEVELS[0.8])
    return sums.select("base", F.greatest(F.lit(0.0), F.col("base") - z * sd).alias("low"), (F.col("base") + z * sd).alias("high"))


def coverage(df: DataFrame, party: str, source: str, date: str, amount: str, top: int = 3) -> DataFrame:
    """For each party: rows, distinct sources, the latest date, and the share of the `top` largest amounts."""
    size = F.abs(amount).cast(MONEY)
    ranked = df.groupBy(party, source).agg(F.count("*").alias("n"), F.max(date).alias("d"), F.sum(size).alias("a"))
    out = ranked.groupBy(party).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_sources"), F.max("d").alias("latest"), F.sum("a").alias("a"))
    order = Window.partitionBy(party).orderBy(F.desc("size"))
    largest = df.select(party, size.alias("size")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)  # cut off on the map side
    tops = largest.groupBy(F.col(party).alias("__p")).agg(F.sum("size").alias("t"))
    share = F.col("t").cast("double") / F.col("a").cast("double")
    return out.join(tops, F.col(party).eqNullSafe(F.col("__p")), "left").select(party, "n_rows", "n_sources", "latest", F.round(share, 6).alias("top_share"))


def grouped(df: DataFrame, group: str, total: str, member: str, party: str) -> DataFrame:
    """One row for each policy: its carrier, its distinct parties in order, its size, and whether it is shared."""
    carrier = F.min(F.struct((-F.col(total)).alias("t"), F.col(member).alias("m")))
    out = df.groupBy(group).agg(carrier.alias("c"), F.array_sort(F.collect_set(party)).alias("p"), F.count("*").alias("size"))
    return out.select(group, F.col("c.m").alias("carrier"), (-F.col("c.t")).alias("total"), F.array_join("p", ",").alias("parties"), "size", (F.size("p") > 1).alias("shared"))


def coalition_totals(df: DataFrame, coalition: str, group: str, total: str, order: list[str], kind: str, kinds: dict[str, str]) -> DataFrame:
    """For each coalition the totals by kind and the number of its policies, each shared policy counted once at its largest amount."""
    one = representatives(df.select(coalition, group, total, *order, kind), [coalition, group], total, order)
    return one.groupBy(coalition).agg(*[money_sum(F.when(F.col(kind) == v, F.col(total))).alias(k) for k, v in kinds.items()], F.count("*").alias("policies"))


def per_vote(total: Column, votes: Column) -> Column:
    """Thousandths of a total for each vote; 0 where nobody voted."""
    return F.when(votes > 0, total * 1000 / votes).otherwise(F.lit(0.0))


def comparisons(df: DataFrame, row: str, amount: str, ids: str, constants: DataFrame, most: int = 3) -> DataFrame:
    """A row's amount in the units that it lists, in its order, the first `most` that are known. `constants`: constant, unit; units are positive."""
    listed = df.select(row, amount, F.posexplode(ids).alias("at", "constant")).join(constants, "constant")
    place = F.row_number().over(Window.partitionBy(row).orderBy("at"))
    return listed.withColumn("place", place).where(F.col("place") <= most).select(row, "constant", "place", F.round(F.col(amount) / F.col("unit"), 4).alias("times"))


def group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """The exact median of each group's values that are not null, from counts of its distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    of_group = Window.partitionBy(group)
    upto = counts.withColumns({"__upto": F.sum("__n").over(of_group.orderBy("__v")), "__all": F.sum("__n").over(of_group)})
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col("__v")))
    return upto.groupBy(group).agg(((at(F.floor((F.col("__all") - 1) / 2)) + at(F.floor(F.col("__all") / 2))) / 2).alias("median"))


def deviating(df: DataFrame, row: str, group: str, value: str, factor: float = 3.0) -> DataFrame:
    """Rows whose value is `factor` times the group's median or more, or that part of it or less."""
    medians = group_medians(df, group, value)
    off = (F.col(value) >= factor * F.col("median")) | (F.col(value) * factor <= F.col("median"))
    return df.join(medians, group).select(row, group, "median", off.alias("off"))


def shares_within(df: DataFrame, rank: str, cutoffs: list[int]) -> DataFrame:
    """For each cutoff how many ranks lie within it, how many beyond, and the share within: one aggregate, whatever the number of ranks."""
    rows = [F.struct(F.lit(c).alias("cutoff"), F.count_if(F.col(rank) <= c).alias("within"), F.count_if(F.col(rank) > c).alias("beyond")) for c in cutoffs]
    out = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return out.withColumn("share", F.round(F.try_divide("within", F.col("within") + F.col("beyond")), 6))
