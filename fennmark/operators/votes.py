"""Roll calls: tallies, party lines, verdicts, packed rosters, grids of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PARTIES = 10_000


def tally(df: DataFrame, vote: str, party: str, outcome: str, kinds: dict[str, str]) -> DataFrame:
    """How often each party gave each outcome in each vote; `kinds` maps a column to its outcome."""
    return df.groupBy(vote, party).agg(*[F.count_if(F.col(outcome) == value).alias(name) for name, value in kinds.items()])


def strict_line(yes: Column, no: Column, abstained: Column) -> Column:
    """The outcome that more gave than each other one; null on ties."""
    return F.when((yes > no) & (yes > abstained), "yes").when((no > yes) & (no > abstained), "no").when((abstained > yes) & (abstained > no), "abstained")


def shown_line(yes: Column, no: Column, abstained: Column) -> Column:
    """The most frequent outcome, ties in the order yes, no, abstained; null if nobody voted."""
    most = F.greatest(yes, no, abstained)
    return F.when(most == 0, None).when(yes == most, "yes").when(no == most, "no").otherwise("abstained")


def verdict(for_it: Column, against: Column) -> Column:
    """Abstentions never decide."""
    return F.when((for_it > 0) & (against > 0), "both").when(for_it > 0, "in_line").when(against > 0, "against").otherwise("none")


def pack_roster(df: DataFrame, vote: str, member: str, code: str, members: DataFrame) -> DataFrame:
    """One string for each vote: a letter for each member of the stored register (member, place from 1), `-` where there is none. Of a
    member's rows in a vote the least letter counts. The register is small (a parliament) and its places are dense."""
    placed = df.join(members, member).groupBy(vote, "place").agg(F.min(code).alias("c"))
    size = members.agg(F.coalesce(F.max("place"), F.lit(0)).alias("size"))
    letters = F.map_from_entries(F.collect_list(F.struct("place", "c")))
    return placed.groupBy(vote).agg(letters.alias("m")).crossJoin(F.broadcast(size)).select(vote, F.array_join(F.transform(F.sequence(F.lit(1), "size"), lambda k: F.coalesce(F.try_element_at("m", k), F.lit("-"))), "").alias("roster"))


def unpack_roster(df: DataFrame, vote: str, roster: str, members: DataFrame, member: str) -> DataFrame:
    """The long rows of packed rosters, without the members that have none."""
    long = df.select(vote, F.posexplode(F.split(roster, "")).alias("k", "code")).where("code NOT IN ('-', '')")
    return long.join(members, F.col("k") + 1 == F.col("place")).select(vote, member, "code")


def grid(targets: DataFrame, parties: DataFrame, cells: DataFrame, keys: list[str], value: str, empty: str) -> DataFrame:
    """Every target with every party, and the cell's value or `empty`. Up to MOST_PARTIES parties go to every task; of more, Spark chooses the way."""
    few = parties.limit(MOST_PARTIES + 1).count() <= MOST_PARTIES
    return targets.crossJoin(F.broadcast(parties) if few else parties).join(cells, keys, "left").select(*keys, F.coalesce(value, F.lit(empty)).alias(value))


def deviations(ballots: DataFrame, member: str, party: str, vote: str, outcome: str, kinds: dict[str, str], absent: str) -> DataFrame:
    """For each member the votes with a party line, and those where the member, present, took another. `kinds` are yes, no and abstained."""
    lines = tally(ballots, vote, party, outcome, kinds).select(vote, party, strict_line(F.col("yes"), F.col("no"), F.col("abstained")).alias("line"))
    value = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    own = ballots.groupBy(member, party, vote).agg(F.min(outcome).alias("own")).where(F.col("own") != absent)
    both = own.join(lines.where("line IS NOT NULL"), [vote, party])
    return both.groupBy(member).agg(F.count("*").alias("n_votes"), F.count_if(F.col("own") != value[F.col("line")]).alias("n_deviating"))


def merits(voted: DataFrame, authored: DataFrame, member: str) -> DataFrame:
    """Each member's distinct targets by bucket, from votes and from what they wrote; both have the member, target and bucket."""
    rows = voted.select(member, "target", "bucket", F.lit("v").alias("via")).unionByName(authored.select(member, "target", "bucket", F.lit("a").alias("via"))).distinct()
    count = lambda c, v: F.count_if(F.col(c) == v)
    return rows.groupBy(member).agg(count("bucket", "in_line").alias("in_line"), count("bucket", "against").alias("against"), count("via", "v").alias("n_voted"), count("via", "a").alias("n_authored"))


def enrich(df: DataFrame, register: DataFrame, member: str, party: str, missing: str = "-") -> DataFrame:
    """A party that is null, empty or `missing` is taken from the register (member, known_party), and is empty if that has none."""
    lacking = F.coalesce(F.col(party).isin("", missing), F.lit(True))
    return df.join(register, member, "left").withColumn(party, F.when(lacking, F.coalesce("known_party", F.lit(""))).otherwise(F.col(party))).drop("known_party")


def stances_on(ballots: DataFrame, vote: str, party: str, outcome: str, kinds: dict[str, str]) -> DataFrame:
    """For each party, in how many votes it stood for what."""
    shown = tally(ballots, vote, party, outcome, kinds).withColumn("line", shown_line(F.col("yes"), F.col("no"), F.col("abstained")))
    return shown.groupBy(party).agg(*[F.count_if(F.col("line") == k).alias(k) for k in kinds])
