"""Rows of one batch that are taken in order: a row is taken unless it is too like one that was taken before it.

Which rows are alike is a graph, found by a join. What is taken is the lexicographically first independent set of that graph. It is found
in rounds: every row whose earlier likes are all left out is taken, and what is like a taken row is left out, for all rows at once. The
number of rounds is the longest chain of open questions, logarithmic in the rows for likes that do not follow the order; the rows and
edges that are still open shrink with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import stored
from .search import rare_prefixes


def like_sets(rows: DataFrame, block: list[str], tokens: str, order: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The distinct token sets of each block, each with the order of its first row (*block, set, first), and the pairs of them that are alike (`earlier`, `later`: those orders, the
    likeness). Rows with the same set are alike whatever they are, so they are one here and never meet each other; sets meet on their rarest tokens."""
    sets = stored(rows.withColumn("set", F.array_sort(F.array_distinct(tokens))).groupBy(*block, "set").agg(F.min(order).alias("first")), "sets")
    prefixes = rare_prefixes(sets.select(*block, "set"), block, least).join(sets, [*block, "set"])
    side = lambda name: prefixes.select(*block, "token", F.col("set").alias(f"{name}_set"), F.col("first").alias(name))
    met = side("earlier").join(side("later"), [*block, "token"]).where("earlier < later").drop("token").distinct()
    shared = F.size(F.array_intersect("earlier_set", "later_set"))
    likeness = shared / (F.size("earlier_set") + F.size("later_set") - shared)
    return sets, met.withColumn("likeness", likeness).where(F.col("likeness") >= least - 1e-9).select("earlier", "later", "likeness")


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, taken_by: null for nodes that are taken, else the earliest taken node that it is like. `nodes`: node, distinct; `edges`: earlier, later, with earlier < later."""
    edges = stored(edges.select("earlier", "later").distinct(), "edges")
    open_edges = edges
    blocked = edges.select(F.col("later").alias("node")).distinct()
    taken = stored(nodes.select("node").join(blocked, "node", "left_anti"), "taken")  # nothing earlier is like them
    new, waiting = taken, stored(blocked, "waiting")
    while not waiting.isEmpty():
        out = open_edges.join(new.withColumnRenamed("node", "earlier"), "earlier", "left_semi").select(F.col("later").alias("node")).distinct()
        left = waiting.join(out, "node", "left_anti")
        # edges that still count lead from one waiting row to another
        open_edges = stored(open_edges.join(left.withColumnRenamed("node", "later"), "later", "left_semi").join(left.withColumnRenamed("node", "earlier"), "earlier", "left_semi"), "edges")
        still = open_edges.select(F.col("later").alias("node")).distinct()
        new = stored(left.join(still, "node", "left_anti"), "taken")
        waiting = stored(still, "waiting")
        taken = taken.unionByName(new)
    by = edges.join(taken.withColumnRenamed("node", "earlier"), "earlier", "left_semi").groupBy(F.col("later").alias("node")).agg(F.min("earlier").alias("taken_by"))
    return nodes.select("node").join(by, "node", "left")


def accepted_in_order(rows: DataFrame, block: list[str], tokens: str, order: str, least: float) -> DataFrame:
    """The rows with `duplicate_of`: null for those that are taken, else the order of the earliest taken row of the block that they are like. `order` has a value of its own for each
    row. Of rows with one token set the first is taken or left out, and the others are always left out."""
    sets, pairs = like_sets(rows, block, tokens, order, least)
    fate = first_independent(sets.select(F.col("first").alias("node")), pairs).join(sets.withColumnRenamed("first", "node"), "node")
    keyed = rows.withColumn("set", F.array_sort(F.array_distinct(tokens)))
    same = [keyed[c].eqNullSafe(fate[c]) for c in (*block, "set")]
    condition: Column = same[0]
    for x in same[1:]:
        condition = condition & x
    later = F.when(F.col(order) != F.col("node"), F.col("node"))
    # a later copy of a set that is left out is like the same earlier row as the first one, of a set that is taken like that one
    return keyed.join(fate.select(*[fate[c] for c in (*block, "set")], "node", "taken_by"), condition).select(*[keyed[c] for c in rows.columns], F.coalesce("taken_by", later).alias("duplicate_of"))
