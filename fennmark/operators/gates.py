"""Gates: named conditions that a row must meet, collected as an array of failures; and the text functions that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quote_key


def failures(gates: dict[str, Column]) -> Column:
    """The names of the gates whose condition is not true (null counts as not met), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in gates.items()]))


def collapsed(text: Column) -> Column:
    """White space of any length is one space; none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def word_count(text: Column) -> Column:
    return F.when(collapsed(text) == "", 0).otherwise(F.size(F.split(collapsed(text), " ")))


def fingerprint(text: Column) -> Column:
    """Lower-case letters, Swedish ones among them, and digits only; null for a null."""
    return F.when(text.isNotNull(), quote_key(text))


def host(url: Column) -> Column:
    """The host of an address without port, `www.` and closing dot; null if it is none."""
    found = F.lower(F.regexp_extract(url, "^https?://([^/:?#]+)", 1))
    return F.when(found != "", F.regexp_replace(F.regexp_replace(found, "\\.$", ""), "^www\\.", ""))


def first_class(text: Column, classes: dict[str, str], other: str) -> Column:
    """The first class whose pattern is found."""
    out = F.lit(other)
    for name, pattern in reversed(classes.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def crowded(df: DataFrame, group: str, most: int) -> DataFrame:
    """Rows of groups with more than `most` rows; the counts are joined, no group is gathered."""
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size")).where(F.col("group_size") > most)
    return df.join(sizes, group)


def page_links(df: DataFrame, page: str, html: str) -> DataFrame:
    """The distinct addresses in a page's href attributes."""
    return df.select(page, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("link")).distinct()


def html_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return collapsed(F.regexp_replace(bare, "<[^>]*>", " "))


def all_classes(text: Column, classes: dict[str, str]) -> Column:
    """The names of all classes whose pattern is found, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), name) for name, pattern in classes.items()]))


def has_facets(facets: dict[str, str]) -> Column:
    """Every chosen value is one of the space-separated tokens of its attribute."""
    out = F.lit(True)
    for attribute, value in facets.items():
        out = out & F.coalesce(F.array_contains(F.split(attribute, " "), value), F.lit(False))
    return out


def suggestions(df: DataFrame, row: str, text: str, typed: str, most: int = 12) -> DataFrame:
    """The first rows, by id, that hold every typed word."""
    holds = [F.contains(F.lower(text), F.lit(w)) for w in typed.lower().split()]
    return df.where(F.forall(F.array(*holds), lambda x: x) if holds else F.lit(False)).select(row).orderBy(row).limit(most)


def owner_of_host(df: DataFrame, row: str, host_name: str, domains: DataFrame) -> DataFrame:
    """The first owner, in list order, whose domain is the host or ends it after a dot. `domains`: domain, place, owner.
    A host's endings are exploded, so this is an equality join."""
    parts = F.split(host_name, "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(".", F.slice(parts, k, F.size(parts))))
    met = df.where(F.col(host_name).isNotNull()).select(row, F.explode(ends).alias("domain")).join(domains, "domain")
    return met.groupBy(row).agg(F.min(F.struct("place", "owner")).alias("o")).select(row, F.col("o.owner").alias("owner"))


def passage(text: Column, anchor: str, reach: int = 120) -> Column:
    """The sentence round the first `anchor`, no further than `reach` characters to either side; null where it does not stand."""
    at = F.instr(text, F.lit(anchor))
    end = at + len(anchor)
    before = F.substring(text, F.greatest(at - reach, F.lit(1)), at - F.greatest(at - reach, F.lit(1)))
    after = F.substring(text, end, F.lit(reach))
    cut_before = F.regexp_extract(before, "[^.!?\n]*$", 0)
    cut_after = F.regexp_extract(after, "^[^.!?\n]*[.!?]?", 0)
    return F.when(at > 0, F.btrim(F.concat(cut_before, F.lit(anchor), cut_after)))
