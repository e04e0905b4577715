"""The grid of promises and parties, and the page of a promise, as wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .votes import verdict


def session_of(day: Column) -> Column:
    """The parliamentary year of a day: from September on."""
    first = F.year(day) - (F.month(day) < 9).cast("int")
    return F.concat(first.cast("string"), F.lit("/"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def _sorted_set(column: Column | str) -> Column:
    return F.array_sort(F.collect_set(column))


def grid_rows(promises: DataFrame, links: DataFrame, actions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row for each promise with an active link: id, title, category, n_links, cells (party -> status), and the kinds, subtypes and sessions of its actions, sorted.

    `promises`: id, title, category. `links`: promise, action, subtype (its own, or null), active. `actions`: action, kind, subtype, day. `verdicts`: promise, party, in_line, against, abstained; a
    cell has one of them at least. Links and verdicts are aggregated before they meet, so no promise's links meet its verdicts."""
    known = actions.select("action", "kind", F.col("subtype").alias("own_subtype"), "day")
    facets = links.where("active").join(known, "action", "left").groupBy("promise").agg(
        F.count("*").alias("n_links"), _sorted_set("kind").alias("kinds"), _sorted_set(F.coalesce("subtype", "own_subtype")).alias("subtypes"), _sorted_set(session_of(F.col("day"))).alias("sessions"),
    )
    cell = F.struct("party", verdict(F.col("in_line"), F.col("against")).alias("status"))
    seen = verdicts.where((F.col("in_line") > 0) | (F.col("against") > 0) | (F.col("abstained") > 0)).groupBy("promise").agg(F.map_from_entries(F.array_sort(F.collect_set(cell))).alias("cells"))
    rows = promises.join(facets.withColumnRenamed("promise", "id"), "id").join(seen.withColumnRenamed("promise", "id"), "id", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select("id", "title", "category", "n_links", F.coalesce("cells", empty).alias("cells"), "kinds", "subtypes", "sessions")


def grid_totals(rows: DataFrame, n_promises: DataFrame) -> DataFrame:
    """facet, value, n: how many rows of the grid each category, kind, subtype and session has, and in all (`all`), and how many promises have none (`none`), in one pass by grouping sets.
    `n_promises` is one row with n, the number of all promises."""
    listed = lambda name: F.transform(F.col(name), lambda x: F.struct(F.lit(name[:-1]).alias("facet"), x.alias("value")))
    marks = F.concat(F.array(F.struct(F.lit("category").alias("facet"), F.col("category").alias("value"))), listed("kinds"), listed("subtypes"), listed("sessions"))
    each = rows.select("id", F.explode(marks).alias("m")).select("id", "m.facet", "m.value")
    sets = each.groupingSets([["facet", "value"], []], "facet", "value").agg(F.count_distinct("id").alias("n"), F.grouping("facet").alias("whole"))
    counts = sets.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("facet")).alias("facet"), "value", "n")
    total = counts.where("facet = 'all'").select("n")
    without = n_promises.select(F.col("n").alias("__all")).crossJoin(F.broadcast(total)).select(F.lit("none").alias("facet"), F.lit(None).cast("string").alias("value"), (F.col("__all") - F.col("n")).alias("n"))  # one row each
    return counts.unionByName(without)


def promise_pages(promises: DataFrame, links: DataFrame, actions: DataFrame, verdicts: DataFrame, corrections: DataFrame, archive: DataFrame) -> DataFrame:
    """A row for each promise: its own columns, links (its active links with their actions, by link; an action that is unknown has a null kind), verdicts (party -> status, for parties that
    acted) and corrections (those that name it, by day). `archive`: action, archive_url, for actions without an address of their own. `corrections`: promise, day, text."""
    held = actions.select("action", "kind", F.col("subtype").alias("own_subtype"), "day", F.col("archive_url").alias("own_archive"))
    met = links.where("active").join(held, "action", "left").join(archive.dropDuplicates(["action"]), "action", "left")
    entry = F.struct("link", "direction", F.coalesce("subtype", "own_subtype").alias("subtype"), "action", "kind", "day", F.coalesce("own_archive", "archive_url").alias("archived"))
    shown = met.select("promise", entry.alias("l"))
    of_promise = shown.groupBy("promise").agg(F.array_sort(F.collect_list("l")).alias("links"))
    cell = F.struct("party", verdict(F.col("in_line"), F.col("against")).alias("status"))
    judged = verdicts.where((F.col("in_line") > 0) | (F.col("against") > 0) | (F.col("abstained") > 0)).groupBy("promise").agg(F.map_from_entries(F.array_sort(F.collect_set(cell))).alias("verdicts"))
    noted = corrections.groupBy("promise").agg(F.array_sort(F.collect_list(F.struct("day", "text"))).alias("corrections"))
    out = promises
    for part in (of_promise, judged, noted):
        out = out.join(part.withColumnRenamed("promise", "id"), "id", "left")
    return out
