"""Decisions on a queue as one publication: ids, links to groups and refusals of one run, written as one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions, digest
from .links import next_ids

PUBLISHED = "id string, group_id string, quote_key string, url string, title string"
REFUSED = "queue_id bigint, reason string"


def approved(published: DataFrame, queue: DataFrame, decisions: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """What is published after these decisions, and what was refused.

    `queue`: queue_id, quote_key, url, title. `decisions`: queue_id, place (their order), link_to (a published id that says the same, or null). A row is refused if it is not in the queue,
    if what it links to is not published, if its quote of the same address is published already, or if it comes a second time. The others get ids in order. A row that links to another joins its
    group; a published row without one becomes a group of its own, named after it, in the same version."""
    first = decisions.groupBy("queue_id").agg(F.min("place").alias("first_place"))
    rows = decisions.join(first, "queue_id").join(queue.withColumn("queued", F.lit(True)), "queue_id", "left")
    targets = published.select(F.col("id").alias("link_to"), F.lit(True).alias("there"), F.coalesce("group_id", F.concat(F.lit("g-"), F.col("id"))).alias("group"))
    rows = rows.join(targets, "link_to", "left")
    known = published.select("quote_key", "url", F.lit(True).alias("known")).distinct()
    rows = rows.join(known, ["quote_key", "url"], "left")
    wrong = (
        F.when(F.col("queued").isNull(), "not in the queue").when(F.col("place") != F.col("first_place"), "decided before")
        .when(F.col("link_to").isNotNull() & F.col("there").isNull(), "linked to nothing").when(F.col("known").isNotNull(), "published before")
    )
    rows = rows.withColumn("reason", wrong)
    # of several with one quote and address the first that nothing else speaks against is published
    firsts = rows.where("reason IS NULL").groupBy("quote_key", "url").agg(F.min("place").alias("of_quote"))
    judged = rows.join(firsts, ["quote_key", "url"], "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("place") != F.col("of_quote")), "published before").otherwise(F.col("reason")))
    new = next_ids(judged.where("reason IS NULL").withColumn("bucket", F.floor(F.col("place") / 100_000)), published, "id", prefix, "bucket", ["place"])
    joined = new.where("group IS NOT NULL").select(F.col("link_to").alias("id"), F.col("group").alias("new_group")).distinct()
    old = published.join(joined, "id", "left").select("id", F.coalesce("group_id", "new_group").alias("group_id"), "quote_key", "url", "title")
    return old.unionByName(new.select("id", F.col("group").alias("group_id"), "quote_key", "url", "title")), judged.where("reason IS NOT NULL").select("queue_id", "reason")


def publish(versions: Versions, queue: DataFrame, decisions: DataFrame, prefix: str) -> int:
    """Apply decisions to the last version and write the next, with what was refused. The same decisions on the same queue a second time leave the version as it is."""
    frames = approved(versions.read("promises", PUBLISHED), queue, decisions, prefix)
    return versions.publish(dict(zip(("promises", "refused"), frames, strict=True)), digest(queue, decisions))


def take_within_budget(versions: Versions, new: DataFrame, key: str, order: list[str], budget: int, schema: str) -> DataFrame:
    """The rows of one run: the first `budget` of those that earlier runs left and those that are new, each key once and never again. What is left waits for the next run. `new` has the columns of `schema`, the key
    and the order among them. The rows of a run, what waits, and the keys taken so far are one version."""
    waiting, taken = versions.read("waiting", schema), versions.read_appended("taken", f"{key} {dict(new.dtypes)[key]}")
    every = waiting.unionByName(new).dropDuplicates([key]).join(taken.select(key).distinct(), key, "left_anti")
    now = every.orderBy(*order, key).limit(budget)
    rest = every.join(now.select(key), key, "left_anti")
    versions.publish({"run": now, "waiting": rest}, digest(new, waiting, taken), {"taken": now.select(key)})
    return versions.read("run", schema)
