"""Links between promises and actions: joins that pick, order, guard and rank them. Every aggregation combines on the map side; no group is gathered but for short ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parties that a grid sends to every task at most.
MOST_PARTIES = 10_000


def last_of(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that comes last in `order` (a later duplicate wins)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def outdated(borrowed: DataFrame, once: DataFrame, now: DataFrame, on: list[str]) -> DataFrame:
    """Borrowed rows whose lender had what was borrowed once, and no longer has it."""
    return borrowed.join(once.select(*on).distinct(), on, "left_semi").join(now.select(*on).distinct(), on, "left_anti")


def shared_words(pairs: DataFrame, a: str, b: str) -> Column:
    """How many words two arrays have in common."""
    return F.size(F.array_intersect(a, b))


def ranked_by_hits(asked: DataFrame, found: DataFrame, word: str, left: str, right: str, least: int, most: int) -> DataFrame:
    """For each `left` the `most` rows of the other side with the most words in common, `least` at least; ties by `right`. Both sides: distinct (id, word)."""
    hits = asked.join(found, word).where(F.col(left) != F.col(right)).groupBy(left, right).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    order = Window.partitionBy(left).orderBy(F.desc("hits"), right)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def in_listed_order(df: DataFrame, row: str, ids: str, other: DataFrame, other_id: str, value: str) -> DataFrame:
    """The values of an array of ids, in the array's order; ids of nothing are left out."""
    each = df.select(row, F.posexplode(ids).alias("place", other_id))
    met = each.join(other.select(other_id, value), other_id)
    return met.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias(value))


#: The least characters of a reason, and the codes of inner rules that none may cite.
LEAST_REASON, INNER_CODES = 40, r"\bb-[0-9]{4}\b|\bG[1-5]\b|\bH[1-6]\b|\bR[0-9]\b"


def move_faults(links: DataFrame, moves: DataFrame, targets: DataFrame) -> DataFrame:
    """`moves` (link, to, reason) with what speaks against each, in this order: the link is gone, it points at no promise, the new target is not active, the link points there already, the two are not in one group,
    the new target has the link's action from another link, the reason is short, the reason cites an inner code. `links`: link, target, action, active; `targets`: target, grp, live."""
    here = moves.join(links, "link", "left").join(targets.withColumnRenamed("grp", "from_grp").drop("live"), "target", "left")
    there = here.join(targets.select(F.col("target").alias("to"), F.col("grp").alias("to_grp"), "live"), "to", "left")
    holders = links.where("active").groupBy(F.col("target").alias("to"), "action").agg(F.min("link").alias("one"), F.max("link").alias("another"))
    reason = F.btrim(F.coalesce("reason", F.lit("")))
    same = F.coalesce(F.col("target") == F.col("to"), F.lit(False))
    held = F.coalesce((F.col("one") != F.col("link")) | (F.col("another") != F.col("link")), F.lit(False))
    checks = {
        "link": F.col("active"), "no promise": F.col("active").isNull() | F.col("target").isNotNull(), "target": F.col("live"), "itself": ~same, "group": F.col("from_grp") == F.col("to_grp"), "duplicate": ~held,
        "short reason": F.char_length(reason) >= LEAST_REASON, "inner code": ~reason.rlike(INNER_CODES),
    }
    faults = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
    return there.join(holders, ["to", "action"], "left").select("link", "to", faults.alias("faults"))


def clusters(df: DataFrame, key: Column, party: str) -> DataFrame:
    """For each key that is not empty: its rows, its parties, whether it is one group of several parties, and how many rows repeat a party's."""
    counts = df.where(key != "").groupBy(key.alias("key"), party).agg(F.count("*").alias("n"))
    return counts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("parties")).select("key", "n", "parties", (F.col("parties") > 1).alias("grouped"), (F.col("n") - F.col("parties")).alias("repeats"))


def universe(targets: DataFrame, parties: DataFrame, links: DataFrame, actions: DataFrame, on: list[str], action: str) -> DataFrame:
    """A row for each target with a link and each party, with the number of its links. A link whose action does not exist is an error, found before anything is computed."""
    dangling = links.join(actions.select(action).distinct(), action, "left_anti").limit(1).collect()
    if dangling:
        raise ValueError(f"a link names an action that does not exist: {dangling[0].asDict()}")
    few = parties.limit(MOST_PARTIES + 1).count() <= MOST_PARTIES
    grid = targets.join(links.select(on[0]).distinct(), on[0], "left_semi").select(on[0]).crossJoin(F.broadcast(parties.select(on[1])) if few else parties.select(on[1]))
    counts = links.groupBy(*on).agg(F.count("*").alias("links"))
    return grid.join(counts, on, "left").select(*on, F.coalesce("links", F.lit(0)).alias("links"))


def affected(corrections: DataFrame, pages: DataFrame) -> DataFrame:
    """page, correction: a correction concerns a page that it names, or whose id it names. `corrections`: correction, affects (array); `pages`: page, path, id."""
    named = corrections.select("correction", F.explode("affects").alias("name"))
    keys = pages.select("page", F.explode(F.array_distinct(F.array("path", "id"))).alias("name"))
    return keys.join(named, "name").select("page", "correction").distinct()


def people_with(people: DataFrame, promises: DataFrame, person: str, amount: Column, active: Column) -> DataFrame:
    """People with a promise at least, and the sum over their active ones."""
    sums = promises.groupBy(person).agg(F.count("*").alias("promises"), F.sum(F.when(active, amount)).alias("total"))
    return people.join(sums, person)


def ranks(df: DataFrame, groups: list[str], bucket: str, order: list) -> DataFrame:
    """`df` with `rank`: a row's number within its group. Rows are numbered within a bucket (a part of the order, such as a day) and the numbers of
    earlier buckets are added, so that a group of any size is not sorted in one task."""
    sizes = df.groupBy(*groups, bucket).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*groups, bucket, before.alias("__before"))
    inner = df.withColumn("__k", F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)))
    return inner.join(offsets, [*groups, bucket]).withColumn("rank", (F.col("__k") + F.col("__before")).cast("bigint")).drop("__k", "__before")


def next_ids(new: DataFrame, known: DataFrame, id_col: str, prefix: str, bucket: str, order: list) -> DataFrame:
    """`new` with ids that follow the highest number of `known`, in order, padded to four digits."""
    highest = known.agg(F.coalesce(F.max(F.regexp_extract(id_col, "([0-9]+)$", 1).try_cast("bigint")), F.lit(0)).alias("__top"))
    numbered = ranks(new, [], bucket, order).crossJoin(F.broadcast(highest))
    digits = (F.col("rank") + F.col("__top")).cast("string")
    return numbered.withColumn(id_col, F.concat(F.lit(prefix), F.when(F.char_length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))).drop("rank", "__top")


def first_in_batch(batch: DataFrame, snapshot: DataFrame, key: str, order: Column) -> DataFrame:
    """The rows of a batch whose key the snapshot lacks, and of those with one key only the first: what an ordered merge accepts."""
    fresh = batch.join(snapshot.select(key).distinct(), key, "left_anti")
    rest = [c for c in fresh.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*")


def appended(start: DataFrame, result: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The queue as it is now, and the rows that a run added to the one it began with and that are not in it yet."""
    new = result.join(start.select(key), key, "left_anti").join(fresh.select(key), key, "left_anti")
    return fresh.unionByName(new)


def unsettled(findings: DataFrame, receipts: DataFrame, key: str, open_receipt: Column) -> DataFrame:
    """Findings without a receipt (`missing`), and those whose receipt waits for a decision (`waiting`)."""
    state = receipts.groupBy(key).agg(F.max(open_receipt.cast("int")).alias("__open"))
    joined = findings.join(state, key, "left")
    outcome = F.when(F.col("__open").isNull(), "missing").when(F.col("__open") == 1, "waiting")
    return joined.withColumn("outcome", outcome).where("outcome IS NOT NULL").drop("__open")


def any_of(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order (null does not)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in conditions.items()]))


#: Rows in a part of what is dealt out by a key, about.
_PART_ROWS = 500_000


def dealt_by_key(*tables: tuple[DataFrame, str], rows: int) -> list[DataFrame]:
    """Each table dealt out by its key column, all in the same number of parts, which grows with `rows`: adaptive execution would join parts by their
    packed size, and groups of narrow rows take many times that in a task's memory."""
    parts = rows // _PART_ROWS + 1
    return [df.repartition(parts, column) for df, column in tables]


def tally(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """For each group its rows, and of each condition how many rows meet it, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count(F.when(c, 1)).alias(name) for name, c in conditions.items()])


def claims(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """A row for each named measurement (an aggregate that is true or false) and whether it holds; what an empty table cannot show does not hold."""
    row = df.agg(F.count("*").alias("__n"), *[c.alias(name) for name, c in named.items()])
    each = [F.struct(F.lit(name).alias("claim"), (F.coalesce(F.col(name), F.lit(False)) & (F.col("__n") > 0)).alias("holds")) for name in named]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def swedish_key(text: Column) -> Column:
    """A key that sorts Swedish letters behind z: å, ä, ö."""
    return F.translate(F.lower(text), "åäöé", "{|}e")


def seeded_sample(df: DataFrame, row: str, seed: int, n: int) -> DataFrame:
    """n rows in an order that depends on the seed and the row's id only."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string"))), row).limit(n)
