"""Whether a row of a motion's table bears the promise that the motion is linked to: the nearest rows are measured, and an ordered table of decisions reads the measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the shared words from which a row is near.
NEAR = 2
#: Links, rows or pairs of them in a part, about. Parts of adaptive execution go by packed size, and narrow rows take many times that in a task's memory.
PART_ROWS = 500_000


def _keyed(df: DataFrame, words: str) -> DataFrame:
    """`df` with a row for each of its words as `word`, with its motion: words meet within one motion only."""
    return df.withColumn("word", F.explode(words)).withColumn("word", F.concat("word", F.lit("\u0001"), F.col("motion").cast("string")))


def table_rows(rows: DataFrame, total: str) -> DataFrame:
    """motion, row, amount, sums_up, words: a row for each row of a table."""
    sums_up = F.max(F.coalesce(F.col("name"), F.lit("")).rlike(total))
    return rows.groupBy("motion", "row").agg(F.first("amount", ignorenulls=True).alias("amount"), sums_up.alias("sums_up"), F.collect_set(F.when(F.char_length("word") >= 5, F.substring("word", 1, 5))).alias("words"))


def parts_of(links: DataFrame, asked: DataFrame, each: DataFrame) -> int:
    """In how many parts links and rows are dealt out: it grows with the links, the rows and the pairs of a link and a row that share a word. `asked`: link, motion, words. `each`: those of `table_rows`."""
    counts = [_keyed(df, "words").groupBy("word").agg(F.count("*").cast("double").alias(name)) for df, name in ((asked, "a"), (each, "b"))]
    pairs = counts[0].join(counts[1], "word").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    return int(max(pairs, links.count(), each.count())) // PART_ROWS + 1


def _asked_words(asked: DataFrame) -> DataFrame:
    return asked.where(F.char_length("word") >= 5).select("link", "motion", F.array(F.substring("word", 1, 5)).alias("words"))


def _near(asked: DataFrame, each: DataFrame, parts: int) -> DataFrame:
    """Those of `nearest_rows` with the row's amount. Pairs go through one shuffle, by link; what follows for a link finds them there."""
    left = _keyed(asked, "words").select(F.col("link").alias("left"), "word").repartition(parts, "word").distinct()
    right = _keyed(each, "words").select(F.struct("motion", "row").alias("right"), "sums_up", "amount", "word").repartition(parts, "word")
    met = left.join(right.hint("merge"), "word").repartition(parts, "left").groupBy("left", "right", "sums_up", "amount").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("left").orderBy(F.desc("overlap"), "sums_up", "right.row")
    return met.withColumn("place", F.row_number().over(order)).select(F.col("left").alias("link"), F.col("right.motion").alias("motion"), F.col("right.row").alias("row"), "overlap", "place", "amount")


def nearest_rows(asked: DataFrame, rows: DataFrame, total: str) -> DataFrame:
    """link, row, overlap, place, amount: the rows of a link's own table that share a word with what it is asked about, best first. `asked`: link, motion, word. `rows`: motion, row, name, word, amount.
    More shared words come first; of equals a row whose name matches `total`, which sums others up, comes last, then the order of the table decides. Words meet by their first five characters and within one motion only."""
    asked, each = _asked_words(asked), table_rows(rows, total)
    return _near(asked, each, parts_of(asked, asked, each))


def measured(links: DataFrame, near: DataFrame, each: DataFrame, parts: int) -> DataFrame:
    """`links` (link, motion, kind, supports, fault) with n_rows of its motion's table, n_near, and the nearest row that moves: row, amount and overlap; the first of all near rows as `first_row`."""
    sizes = each.groupBy("motion").agg(F.count("*").alias("n_rows"))
    moving = F.when(F.coalesce(F.col("amount") != 0, F.lit(False)), F.struct("place", "row", "amount", "overlap"))
    best = near.groupBy("link").agg(F.count("*").alias("n_near"), F.min(moving).alias("bears"), F.min_by("row", "place").alias("first_row"))
    sized = links.repartition(parts, "motion").join(sizes.repartition(parts, "motion"), "motion", "left")
    return sized.repartition(parts, "link").join(best, "link", "left").fillna({"n_rows": 0, "n_near": 0})


def decision() -> Column:
    """What the measurement of a link says, the first of these that holds: outcome, whether the link is withdrawn, whether the motion must be read."""
    rule = lambda name, withdraw, read: F.struct(F.lit(name).alias("outcome"), F.lit(withdraw).alias("withdraw"), F.lit(read).alias("needs_reading"))
    table = [
        (F.coalesce("fault", F.lit("")) != "", rule("unreadable", False, True)), (F.col("kind") == "tax", rule("promise is a tax", True, False)), (F.col("kind") == "rule", rule("promise is a rule", True, False)),
        (F.col("n_rows") == 0, rule("no table", True, False)), (F.col("n_near") == 0, rule("no row shares a word", False, True)), (F.col("bears").isNull(), rule("row stands still", True, False)),
        (F.coalesce("supports", F.lit(False)) & (F.col("bears.amount") < 0), rule("row goes the other way", False, True)), (F.col("bears.overlap") < NEAR, rule("weak match", False, True)),
    ]
    out = rule("bears", False, False)
    for condition, answer in reversed(table):
        out = F.when(F.coalesce(condition, F.lit(False)), answer).otherwise(out)
    return out


def decided(links: DataFrame, asked: DataFrame, rows: DataFrame, total: str) -> DataFrame:
    """link, row (the one that a decision rests on, or null), outcome, withdraw, needs_reading. `rows`: motion, row, name, word, amount; one row for each word of a table's row."""
    asked, each = _asked_words(asked), table_rows(rows, total)
    parts = parts_of(links, asked, each)
    found = measured(links, _near(asked, each, parts), each, parts).withColumn("d", decision())
    row = F.when(F.col("d.outcome").isin("bears", "weak match", "row goes the other way"), F.col("bears.row")).when(F.col("d.outcome") == "row stands still", F.col("first_row"))
    return found.select("link", row.alias("row"), "d.*")
