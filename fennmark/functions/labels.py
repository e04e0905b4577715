"""Labels, keys and small rules of rows: dates and kinds for readers, compact ids, who acted, which words a promise stands for. All are column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, light_stem, tokens

# Swedish months.
MONTHS = "januari februari mars april maj juni juli augusti september oktober november december".split()


def long_date(day: Column) -> Column:
    """A day as it is written in Swedish."""
    months = F.array(*map(F.lit, MONTHS))
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.get(months, F.month(day) - 1), F.year(day).cast("string"))


def label(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value; the value itself where it has none."""
    out = value
    for name, text in labels.items():
        out = F.when(value == name, text).otherwise(out)
    return out


def motion_kind(subtype: Column, authors: Column) -> Column:
    """By its subtype, else by how many authors it has."""
    low = F.lower(filled(subtype))
    return F.when(F.contains(low, F.lit("parti")), "party").when(F.contains(low, F.lit("kommitt")), "committee").when(F.contains(low, F.lit("enskild")), "single").when(authors > 1, "committee").otherwise("single")


def word_shard(stem: Column) -> Column:
    """The first two letters of a stem; an underscore where they are none."""
    two = F.left(stem, F.lit(2))
    return F.when(two.rlike("^[a-zåäö]{2}$"), two).otherwise("_")


def number_shard(number: Column, size: int = 1000) -> Column:
    """A number's thousand, padded to three digits; `rest` without a number."""
    thousand = F.floor(number / size).cast("string")
    return F.when(number.isNull(), "rest").when(F.char_length(thousand) < 3, F.lpad(thousand, 3, "0")).otherwise(thousand)


def compact_id(name: Column, prefix: str) -> Column:
    """The number behind a common prefix, if the prefix and the number give the name again; null if not."""
    number = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, F.char_length(name))).try_cast("bigint")
    return F.when(F.concat(F.lit(prefix), number.cast("string")) == name, number)


def visible_committee(name: Column, parties: list[str]) -> Column:
    """The name, unless it is empty, a dash, or a party."""
    return F.when((F.btrim(filled(name)) != "") & (name != "-") & ~name.isin(*parties), name)


def acting_parties(kind: Column, voted: Column, authors: Column, other: Column, addressees: str) -> Column:
    """Who acted: in a vote the parties of its tally; in a question those of its authors (struct<name, party>) but for addressees; else the others."""
    own = F.array_sort(F.array_distinct(F.transform(F.filter(authors, lambda a: ~F.coalesce(F.lower(a["name"]).rlike(addressees), F.lit(False)) & a["party"].isNotNull()), lambda a: a["party"])))
    return F.when((kind == "vote") & (F.size(voted) > 0), voted).when(kind == "question", own).otherwise(other)


def target_id(promise: Column, stance: Column, strict: bool = True) -> Column:
    """What a link points at; without either an error if `strict`, else empty."""
    missing = F.raise_error(F.lit("a link has no target")).cast("string") if strict else F.lit("")
    return F.coalesce(promise, stance, missing)


def anchor_terms(title: Column, quote: Column, category: Column, stop_words: list[str]) -> Column:
    """The stems of what a promise says, in order, without words that say nothing."""
    words = F.filter(tokens(F.concat_ws(" ", title, quote, category)), lambda w: ~w.isin(*stop_words))
    return F.array_distinct(F.transform(words, light_stem))


def is_active(status: Column) -> Column:
    """Anything but withdrawn; an unknown status is active."""
    return ~F.coalesce(status == "withdrawn", F.lit(False))


def has_party(parties: Column, codes: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(parties, F.array(*map(F.lit, codes))), F.lit(False))


def shown_change(reviewed: Column, archive: Column) -> Column:
    """A change is shown once it is reviewed and its source is archived."""
    return F.coalesce(reviewed, F.lit(False)) & (F.btrim(filled(archive)) != "")


def objections(calculation: Column, stated: Column, own: Column, low: Column, base: Column, high: Column, kind: Column, quoted_kind: Column, reason: Column) -> dict[str, Column]:
    """What a calculation can be faulted for; nothing can where there is none. `stated`: amounts in it, `own`: the party's own amounts."""
    there = F.btrim(filled(calculation)) != ""
    rules = {
        "no amount": (base != 0) & (F.size(stated) == 0), "amount not named": (base != 0) & (F.size(stated) > 0) & ~F.array_contains(stated, base),
        "own number bypassed": (F.size(own) > 0) & ~F.array_contains(own, base), "nought without reason": (base == 0) & (F.btrim(filled(reason)) == ""),
        "span without base": ~base.between(low, high), "span without width": (base != 0) & (low == high), "kind differs": kind != quoted_kind,
    }
    return {name: there & F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def breach(active: Column, claims_anchor: Column, anchors: Column, group: Column) -> Column:
    """An active promise that says its amount is borrowed, with no anchor and no group."""
    return active & claims_anchor & (F.coalesce(F.size(anchors), F.lit(0)) <= 0) & group.isNull()


def borrowed(sentence: Column, anchor_words: str, names: dict[str, str], own: Column) -> Column:
    """The parties, other than the own one, that a sentence with an anchor word names."""
    named = F.array_compact(F.array(*[F.when(sentence.rlike(f"(?i){name}"), code) for name, code in names.items()]))
    return F.when(sentence.rlike(anchor_words), F.filter(named, lambda p: p != own)).otherwise(F.array().cast("array<string>"))


def person(text: Column, roles: str, excluded: str) -> Column:
    """name and role of `Role Name Name` or `Name Name, role`; null where neither is there or an excluded word is."""
    name = "([A-ZÅÄÖ][\\p{L}-]+(?: [A-ZÅÄÖ][\\p{L}-]+)+)"
    first, second = f"(?i:({roles})) {name}", f"{name}, (?i:({roles}))"
    by_first = F.struct(F.regexp_extract(text, first, 2).alias("name"), F.lower(F.regexp_extract(text, first, 1)).alias("role"))
    by_second = F.struct(F.regexp_extract(text, second, 1).alias("name"), F.lower(F.regexp_extract(text, second, 2)).alias("role"))
    return F.when(~text.rlike(excluded), F.when(text.rlike(first), by_first).when(text.rlike(second), by_second))


def normalised_codes(codes: Column) -> Column:
    """Codes trimmed and in lower case, distinct, empty ones gone; a null is none."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.lower(F.btrim(c))), lambda c: c != ""))


def summary_sentence(stated: Column, cells: Column, parties: Column) -> Column:
    """A fixed sentence with its counts; another where nothing is stated."""
    return F.when(stated == 0, "Inget parti har svarat.").otherwise(F.format_string("%d av %d svar är givna, av %d partier.", stated, cells, parties))


def action_of(kind: Column, kinds: dict[str, str], number: Column, day: Column, authors: Column) -> Column:
    """A document as an action: its kind, the names of its authors, and their parties, distinct and in order. Null for an unknown kind, or without a number or a day."""
    known = label(kind, kinds)
    named = F.filter(authors, lambda a: F.btrim(filled(a["name"])) != "")
    parties = F.array_sort(F.array_distinct(F.transform(F.filter(named, lambda a: a["party"].isNotNull()), lambda a: F.lower(a["party"]))))
    action = F.struct(known.alias("kind"), number.alias("number"), day.alias("day"), F.transform(named, lambda a: F.btrim(a["name"])).alias("names"), parties.alias("parties"))
    return F.when(kind.isin(*kinds) & number.isNotNull() & day.isNotNull(), action)


def alert_text(rows: Column, what: Column, most: Column, last: Column) -> Column:
    """A line of a report: how many rows of what, the largest value, the last day."""
    return F.concat_ws(" ", rows.cast("string"), what, F.lit("highest"), most.cast("string"), F.lit("last"), last.cast("string"))
