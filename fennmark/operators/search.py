"""Words of documents: postings, ranked terms, keyword search, likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_tokens


def words(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words of at least so many letters, Swedish ones among them, or digits."""
    return F.array_distinct(all_tokens(text, least))


def term_counts(df: DataFrame, doc: str, text: str, least: int = 4) -> DataFrame:
    """How often each word stands in each document."""
    return df.select(doc, F.explode(all_tokens(F.col(text), least)).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("n"))


def top_terms(counts: DataFrame, doc: str, most: int) -> DataFrame:
    """The `most` frequent terms of each document, ties by term. A document's terms are all that a window holds."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def capped_postings(pairs: DataFrame, term: str, doc: str, cap: int) -> DataFrame:
    """For each term the number of its documents and the `cap` highest ids. The cap is applied in two steps, so that a frequent term's
    ids never meet in one task."""
    part = F.pmod(F.xxhash64(doc), F.lit(64))
    order = Window.partitionBy(term, "part").orderBy(F.desc(doc))
    some = pairs.withColumn("part", part).withColumn("k", F.row_number().over(order))
    partial = some.groupBy(term, "part").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("k") <= cap, F.col(doc))).alias("ids"))
    out = partial.groupBy(term).agg(F.sum("n").alias("n_docs"), F.slice(F.sort_array(F.flatten(F.collect_list("ids")), asc=False), 1, cap).alias("ids"))
    return out.select(term, "n_docs", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def search(pairs: DataFrame, doc: str, term: str, query: list[list[str]], most: int) -> DataFrame:
    """Documents with at least one form of each query word, highest ids first."""
    forms = [(form, k) for k, word in enumerate(query) for form in word]
    number = F.create_map(*[F.lit(x) for pair in forms for x in pair])
    hits = pairs.where(F.col(term).isin([f for f, _ in forms])).groupBy(doc).agg(F.count_distinct(number[F.col(term)]).alias("found"))
    return hits.where(F.col("found") == len(query)).select(doc).orderBy(F.desc(doc)).limit(most)


def distinctive(counts: DataFrame, group: str, term: str, least: int, most: int) -> DataFrame:
    """Terms whose share in a group stands out against the share in the others (plus one), by lift. `counts`: group, term, n."""
    totals = counts.groupBy(group).agg(F.sum("n").alias("own_total"))
    every = counts.groupBy(term).agg(F.sum("n").alias("all_n"))
    grand = totals.agg(F.sum("own_total").alias("all_total"))
    lift = (F.col("n") / F.col("own_total")) / ((F.col("all_n") - F.col("n") + 1) / (F.col("all_total") - F.col("own_total") + 1))
    scored = counts.where(F.col("n") >= least).join(every, term).join(totals, group).crossJoin(F.broadcast(grand)).withColumn("lift", F.round(lift, 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), term))).where(F.col("rank") <= most).select(group, term, "n", "lift", "rank")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 where one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def rare_prefixes(sets: DataFrame, block: list[str], least: float) -> DataFrame:
    """*block, set, token: of each distinct set its rarest tokens, so many that two sets of a block with a likeness of `least` or more share one of them."""
    each = sets.select(*block, "set").distinct().select(*block, "set", F.explode("set").alias("token"))
    counts = each.groupBy(*block, "token").agg(F.count("*").alias("n"))
    ranked = each.join(counts, [*block, "token"]).groupBy(*block, "set").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("r"))
    needed = F.size("set") - F.ceil((least - 1e-6) * F.size("set")).cast("int") + 1
    return ranked.select(*block, "set", F.explode(F.slice("r", F.lit(1), needed)).alias("x")).select(*block, "set", F.col("x.token").alias("token"))


def best_match(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, tokens: str, least: float, apart: str | None = None) -> DataFrame:
    """For each left row the most similar right row of the same block with a token in common, and with another value of `apart` if that is given; the higher id
    on ties. Both have `block`, their id, `tokens` and `apart`. Likeness is computed once for each pair of distinct token sets, which meet on their rarest tokens."""
    extra = [apart] if apart else []
    keyed = lambda df: df.withColumn("set", F.array_sort(F.array_distinct(tokens)))
    lefts = keyed(left).select(*block, *extra, "set").distinct()
    rights = keyed(right).groupBy(*block, *extra, "set").agg(F.max(right_id).alias(right_id))
    prefixes = rare_prefixes(lefts.select(*block, "set").unionByName(rights.select(*block, "set")), block, least)
    named = lambda df, side: df.join(prefixes, [*block, "set"]).withColumnsRenamed({c: f"{c}_{side}" for c in (*extra, "set")})
    met = named(lefts, "left").join(named(rights, "right"), [*block, "token"])
    if apart:
        met = met.where(F.col(f"{apart}_left") != F.col(f"{apart}_right"))
    keys = [*block, *[f"{c}_left" for c in (*extra, "set")]]
    pairs = met.select(*keys, right_id, "set_right").distinct()
    shared = F.size(F.array_intersect("set_left", "set_right"))
    like = F.round(shared / (F.size("set_left") + F.size("set_right") - shared), 6)
    best = pairs.withColumn("likeness", like).where(F.col("likeness") >= least).groupBy(*keys).agg(F.max(F.struct("likeness", right_id)).alias("m"))
    back = best.select(*block, *[F.col(f"{c}_left").alias(c) for c in (*extra, "set")], F.col(f"m.{right_id}").alias(right_id), F.col("m.likeness").alias("likeness"))
    return keyed(left).select(left_id, *block, *extra, "set").join(back, [*block, *extra, "set"]).select(left_id, right_id, "likeness")


def display_forms(forms: DataFrame, stem: str, form: str) -> DataFrame:
    """For each stem its most frequent form; the shorter, then the first in binary order, on ties. Counted before it is shuffled by stem."""
    counts = forms.groupBy(stem, form).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.char_length(form).alias("size"), F.col(form).alias("form"))).alias("b")
    return counts.groupBy(stem).agg(best, F.sum("n").alias("n_all")).select(stem, F.col("b.form").alias("form"), "n_all")
