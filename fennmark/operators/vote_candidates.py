"""Votes that may bear on a promise: those on reports whose titles share words with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.own_text import BINDING, INCOME, demand_kind
from ..stored import stored

#: A word in more titles than this is met in pairs of such words only.
RARE = 100


def shared_words(asked: DataFrame, titles: DataFrame, left: str, right: str, words: str, rare: int = RARE) -> DataFrame:
    """left, right, hits of all pairs of rows with two words in common or more. Both sides: an id and an array of distinct words.

    Two rows that share two words share one that is rare among the titles, or two that are not. Rare words meet singly, each with `rare` titles at most; the others meet as pairs of
    words, so that no frequent word alone brings all its rows together. What met is counted on the arrays."""
    counted = titles.select(F.explode(words).alias("w")).groupBy("w").agg((F.count("*") <= rare).alias("is_rare"))

    def keys(rows: DataFrame, row: str) -> DataFrame:
        # a word that is in no title has no row in `counted`
        known = rows.select(row, F.explode(words).alias("w")).join(counted, "w")
        single = known.where("is_rare").select(row, "w", F.lit("").alias("w2"))
        frequent = known.where("NOT is_rare").groupBy(row).agg(F.array_sort(F.collect_list("w")).alias("ws"))
        each = frequent.select(row, "ws", F.posexplode("ws").alias("k", "w"))
        return single.unionByName(each.select(row, "w", F.explode(F.slice("ws", F.col("k") + 2, F.size("ws"))).alias("w2")))

    met = keys(asked, left).join(keys(titles, right), ["w", "w2"]).select(left, right).distinct()
    both = met.join(asked.withColumnRenamed(words, "a"), left).join(titles.withColumnRenamed(words, "b"), right)
    return both.select(left, right, F.size(F.array_intersect("a", "b")).alias("hits")).where("hits >= 2")


def ranked_votes(promises: DataFrame, reports: DataFrame, votes: DataFrame, most: int, rare: int = RARE) -> DataFrame:
    """promise, vote, report, hits, place: for each promise the `most` votes with the most words in common, ties by vote. `promises`: promise, words, source (the report that it was taken from, or null), parties;
    `reports`: report (unique), words; `votes`: vote, report, parties (null or empty where it is not known who voted).

    A vote without a report is left out, as is one on the promise's own source. Where both name parties they must have one in common. Votes are ranked within each report first, so no
    more than `most` of a report go on to a promise's ranking."""
    pairs = stored(shared_words(promises.select("promise", "words"), reports.select("report", "words"), "promise", "report", "words", rare), "votes-by-title")
    about = pairs.join(promises.select("promise", "source", F.col("parties").alias("ours")), "promise").where(~F.coalesce(F.col("source") == F.col("report"), F.lit(False)))
    met = about.join(votes.select("vote", "report", F.col("parties").alias("theirs")), "report")
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    fit = met.where(empty("ours") | empty("theirs") | F.coalesce(F.arrays_overlap("ours", "theirs"), F.lit(False))).select("promise", "vote", "report", "hits")
    for within in (["promise", "report"], ["promise"]):
        fit = fit.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("hits"), "vote"))).where(F.col("place") <= most)
    return fit


def motion_kinds(demands: DataFrame, motion: str, text: str) -> DataFrame:
    """motion, n, kind (matter if any demand is, else grants if any is, else frame), and whether one sets the income and binds the government to propose the law: counts of demands by kind, none gathered."""
    kind = demand_kind(F.coalesce(text, F.lit("")))
    binds = F.coalesce(F.col(text).rlike(INCOME) & F.col(text).rlike(BINDING), F.lit(False))
    found = demands.groupBy(motion).agg(F.count("*").alias("n"), F.bool_or(kind == "matter").alias("matter"), F.bool_or(kind == "grants").alias("grants"), F.bool_or(binds).alias("binding"))
    return found.select(motion, "n", F.when(F.col("matter"), "matter").when(F.col("grants"), "grants").otherwise("frame").alias("kind"), "binding")
