"""Gates and decisions: what is checked before a row is published, withdrawn, moved or replaced, and the rows that come of it. All are column functions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, once, verbatim_form, word_count
from .links import any_of


def decided(rules: list[tuple[str, Column]], other: str) -> Column:
    """The name of the first rule that holds, in order; a null does not hold."""
    out = F.lit(other)
    for name, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def secure_host(url: Column) -> Column:
    """The host of an https address without a port, `www.` or a closing dot; null if it is none."""
    host = F.lower(F.regexp_extract(url, "^(?i)https://([^/:?#@]+)([/?#]|$)", 1))
    return F.when(host != "", F.regexp_replace(F.regexp_replace(host, "\\.$", ""), "^www\\.", ""))


def earlier_election(url: Column, documents: str, year: int) -> Column:
    """Whether a part of the path names a document of an election before `year`: a word of `documents`, and no number of a later year beside it."""
    parts = F.split(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*(/[^?#]*)", 1), "/")
    years = lambda p: F.transform(F.regexp_extract_all(p, F.lit("(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.exists(parts, lambda p: p.rlike(documents) & F.coalesce(F.array_max(years(p)) < year, F.lit(False)))


def article_fault(url: Column, declared: Column, allowed: list[str], documents: str, year: int, candidates: Column, most: int) -> Column:
    """What rejects a whole article, the first of: its host, an earlier election, too many candidates; null if nothing does."""
    host = secure_host(url)
    ok = host.isin(*allowed) & (host == declared)
    return F.when(~F.coalesce(ok, F.lit(False)), "domain").when(earlier_election(url, documents, year), "earlier").when(F.size(candidates) > most, "crowd")


def _bare_lines(text: Column) -> Column:
    strip = lambda x: F.regexp_replace(verbatim_form(x), "[ .,;:!?]+$", "")
    return F.filter(F.transform(F.split(filled(text), "\r?\n"), strip), lambda x: x != "")


def own_line(quote: Column, text: Column) -> Column:
    """Whether the quote is a whole line of the text, once, and in no other line; closing punctuation aside."""
    q = F.regexp_replace(verbatim_form(quote), "[ .,;:!?]+$", "")
    alone = lambda q: once(_bare_lines(text), lambda lines: (F.size(F.filter(lines, lambda x: x == q)) == 1) & ~F.exists(lines, lambda x: (x != q) & F.contains(x, q)))
    return once(q, lambda q: (q != "") & alone(q))


def quote_faults(quote: Column, text: Column, own_page: Column, least: int = 5, most: int = 40, least_own: int = 2) -> Column:
    """`short`, `long` and `not verbatim`, as they apply. A shorter quote passes on the party's own page where it is a line of its own."""

    def named(q: Column) -> Column:
        words = word_count(q)
        short = (words < least) & ~(F.coalesce(own_page, F.lit(False)) & (words >= least_own) & own_line(quote, text))
        return any_of({"short": short, "long": words > most, "not verbatim": (q != "") & ~F.contains(verbatim_form(text), q)})

    return once(verbatim_form(quote), named)


def amount_faults(amount: Column, published: Column, now: Column, cap: int = 1_500_000, days: int = 548) -> Column:
    """`amount` out of bounds (a null one is none), and `date` unknown or too far from `now`."""
    bad_amount = amount.isNotNull() & ~((amount >= 0) & (amount <= cap) & ~F.isnan(amount.cast("double")))
    bad_date = published.isNull() | (F.abs(F.unix_seconds(now) - F.unix_seconds(published)) > days * 86_400)
    return any_of({"amount": bad_amount, "date": bad_date})


def candidate_faults(article: Column, schema: Column, content: Column) -> Column:
    """The failures of a candidate: its article's, else those of its schema, else those of its content."""
    return F.when(article.isNotNull(), F.array(article)).when(F.size(schema) > 0, schema).otherwise(content)


def link_faults(quote: Column, text: Column, own_text: Column, actors: Column, parties: Column, day: Column, first: str, last: str, present: dict[str, Column], least: int = 20) -> Column:
    """What speaks against a link: its quote is short, not in the source, or not in the action's own text; no party of the promise acted; its day lies outside; something is missing."""
    q = verbatim_form(quote)
    checks = {
        "short": F.char_length(q) < least, "not verbatim": ~F.contains(verbatim_form(text), q), "not own": ~F.contains(verbatim_form(own_text), q),
        "actor": ~F.arrays_overlap(actors, parties), "date": ~day.between(F.lit(first).cast("date"), F.lit(last).cast("date")),
    } | {name: c.isNull() for name, c in present.items()}
    return any_of(checks)


def quote_outcome(quote: Column, text: Column, own_text: Column, reason: Column) -> Column:
    """How a quote stands: unverifiable, not verbatim, in the action's own text, outside it with a reason, or outside."""
    q = verbatim_form(quote)
    return decided([("unverifiable", filled(text) == ""), ("not verbatim", ~F.contains(verbatim_form(text), q)), ("own text", F.contains(verbatim_form(own_text), q)), ("justified", F.btrim(filled(reason)) != "")], "outside")


def withdrawn_links(links: DataFrame, requests: DataFrame, link: str, state: str, active: str, withdrawn: str) -> tuple[DataFrame, DataFrame]:
    """The links after the requests (link, reason) that hold, and the outcome of each request: unknown, already withdrawn, no reason, done."""
    asked = requests.groupBy(link).agg(F.max("reason").alias("reason"))
    judged = asked.join(links.select(link, state), link, "left")
    outcome = decided([("unknown", F.col(state).isNull()), ("already", F.col(state) != active), ("no reason", F.btrim(filled(F.col("reason"))) == "")], "done")
    judged = judged.select(link, "reason", outcome.alias("outcome"))
    done = judged.where("outcome = 'done'").select(link, F.lit(True).alias("__done"))
    after = links.join(done, link, "left").withColumn(state, F.when(F.col("__done"), withdrawn).otherwise(F.col(state))).drop("__done")
    return after, judged


def retargeted(links: DataFrame, judged: DataFrame, link: str, target: str) -> DataFrame:
    """The links, with the new target of those moves (link, to, faults) that nothing speaks against."""
    moves = judged.where(F.size("faults") == 0).groupBy(link).agg(F.min("to").alias("__to"))
    return links.join(moves, link, "left").withColumn(target, F.coalesce("__to", target)).drop("__to")


def replaced(rows: DataFrame, swaps: DataFrame, key: str, column: str, outcomes: list[str]) -> DataFrame:
    """The rows, with the new value (key, value, outcome) of those swaps whose outcome is one of `outcomes`."""
    good = swaps.where(F.col("outcome").isin(*outcomes)).groupBy(key).agg(F.min("value").alias("__value"))
    return rows.join(good, key, "left").withColumn(column, F.coalesce("__value", column)).drop("__value")


def anchor_outcomes(wanted: DataFrame, promises: DataFrame, row: str, anchor: str) -> DataFrame:
    """row, anchor, outcome of anchors that are to be set: the anchor is missing, is the row itself, is anchored in the row already (a cycle), or is set. `promises`: row, anchor."""
    there = promises.select(F.col(row).alias(anchor), F.col(anchor).alias("__back"), F.lit(True).alias("__there"))
    rules = [("missing", F.col("__there").isNull()), ("itself", F.col(row) == F.col(anchor)), ("cycle", F.col("__back") == F.col(row))]
    return wanted.join(there, anchor, "left").select(row, anchor, decided(rules, "set").alias("outcome"))


def batch_note(df: DataFrame, day: str, amount: Column, what: str) -> DataFrame:
    """A correction record for each day: how many rows changed, and by how much in all."""
    sums = df.groupBy(day).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
    return sums.select(day, F.concat(F.col("n").cast("string"), F.lit(f" {what}, "), F.col("total").cast("string")).alias("note"))


def current_statements(df: DataFrame, keys: list[str], order: Column, live: Column) -> DataFrame:
    """The last live row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.where(live).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def change_kinds(df: DataFrame, keys: list[str], order: list[str], stance: str, condition: str) -> DataFrame:
    """Each statement with what it changes against the one before: first, flip, condition, or same."""
    before = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__s", F.lag(stance).over(before)).withColumn("__c", F.lag(condition).over(before)).withColumn("__k", F.row_number().over(before))
    kind = decided([("first", F.col("__k") == 1), ("flip", ~F.col("__s").eqNullSafe(F.col(stance))), ("condition", ~F.col("__c").eqNullSafe(F.col(condition)))], "same")
    return rows.withColumn("kind", kind).drop("__s", "__c", "__k")


def approved(queue: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows of a queue that pass all checks (true is passed), and the others with the names of those that failed."""
    judged = queue.withColumn("faults", any_of({name: ~F.coalesce(ok, F.lit(False)) for name, ok in checks.items()}))
    return judged.where(F.size("faults") == 0).drop("faults"), judged.where(F.size("faults") > 0)


def rejected(queue: DataFrame, memory: DataFrame, rejections: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The queue without the rejected rows, and the memory of rejections with those that it lacked."""
    gone = rejections.select(key, "reason").groupBy(key).agg(F.max("reason").alias("reason"))
    known = gone.join(queue.select(key).distinct(), key, "left_semi").join(memory.select(key), key, "left_anti")
    return queue.join(gone.select(key), key, "left_anti"), memory.select(key, "reason").unionByName(known)


def untested(pairs: DataFrame, tested: DataFrame, on: list[str]) -> DataFrame:
    """Pairs that have not been tested before."""
    return pairs.join(tested.select(*on).distinct(), on, "left_anti")


def spoken_outcome(seconds: Column, public: Column, held: Column, quote: Column) -> Column:
    """How a spoken source stands: no place in the recording, quoted in the public transcript, in a held one, or in none."""
    q = verbatim_form(quote)
    found = lambda t: t.isNotNull() & F.contains(verbatim_form(t), q)
    return decided([("no time", seconds.isNull()), ("public", found(public)), ("held", found(held))], "not found")


def page_age(now: Column, *dates: Column) -> Column:
    """Days since the first of the dates that is known."""
    return F.datediff(now, F.coalesce(*dates))


def date_in_address(url: Column) -> Column:
    """The day that an address names as year, month and day; null if none is real."""
    parts = F.regexp_extract(url, "((?:19|20)[0-9]{2})[/-]([0-9]{2})[/-]([0-9]{2})(?:[^0-9]|$)", 0)
    return F.try_to_date(F.translate(F.left(parts, F.lit(10)), "/", "-"), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.translate(F.left(parts, F.lit(10)), "/", "-"), F.lit("yyyy-MM-dd")))


def rationale_outcome(link_active: Column, now: Column, wanted: Column, own_text: Column, least: int = 10) -> Column:
    """What becomes of a new rationale: the link is gone, nothing is said, it is what is there already, too short, or it is set, with the ground that it rests on (the action's own text, or the report)."""
    said = F.btrim(filled(wanted))
    ground = F.when(F.contains(verbatim_form(own_text), verbatim_form(wanted)), "set: own text").otherwise("set: report")
    rules = [("gone", ~F.coalesce(link_active, F.lit(False))), ("empty", said == ""), ("same", said == F.btrim(filled(now))), ("short", F.char_length(said) < least)]
    return F.when(decided(rules, "set") == "set", ground).otherwise(decided(rules, "set"))
