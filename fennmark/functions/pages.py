"""When a page was changed or published, by what its HTML says of itself. All are column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, once

# Where pages say when they were changed and published, in the order in which they are believed.
CHANGED_META, CHANGED_FIELD = ("article:modified_time", "og:updated_time"), "dateModified"
PUBLISHED_META, PUBLISHED_FIELD = ("article:published_time",), "datePublished"
CHANGED_TIME = r"""class="[^"]*\bupdated\b[^"]*"|aria-label="[Uu]ppdaterad\""""
VISIBLE = r"[Ss]enast uppdaterad:?\s*(?:([0-9]{4}-[0-9]{2}-[0-9]{2})|([0-9]{2})\.([0-9]{2})\.([0-9]{4}))"
IN_ADDRESS = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'(?i)\s{name}="([^"]*)"', 1)


def _moment(text: Column) -> Column:
    """The moment that a text begins with, year first; null if it names none. Without an offset it is in the session's zone."""
    return F.when(text.rlike("^ *[0-9]{4}"), F.btrim(text).try_cast("timestamp"))


def _first(moments: Column) -> Column:
    return F.get(F.filter(moments, lambda x: x.isNotNull()), 0)


def _meta(tags: Column, name: str) -> Column:
    """The content of the first `meta` tag with this property, whichever attribute comes first."""
    return _attribute(F.get(F.filter(tags, lambda x: (F.lower(_attribute(x, "property")) == name) & (_attribute(x, "content") != "")), 0), "content")


def _field(html: Column, name: str) -> Column:
    """The first value of a field in the page's structured data."""
    return F.regexp_extract(html, rf'(?i)"{name}"\s*:\s*"([^"]+)"', 1)


def _noon(day: Column) -> Column:
    return F.when(day != "", F.concat(day, F.lit(" 12:00:00")).try_cast("timestamp"))


def change_date(html: Column) -> Column:
    """When a page says that it was changed: in its `meta` tags, its structured data, a `time` tag that is marked as the time of a change, its visible text. The first of these that is a date counts."""
    page = filled(html)
    tags, times = F.regexp_extract_all(page, F.lit("(?i)<meta[^>]+>"), F.lit(0)), F.regexp_extract_all(page, F.lit("(?i)<time[^>]*>"), F.lit(0))
    named = once(tags, lambda x: F.array(*[_moment(_meta(x, name)) for name in CHANGED_META]))
    marked = F.transform(F.filter(times, lambda x: x.rlike(CHANGED_TIME)), lambda x: _moment(_attribute(x, "datetime")))
    part = lambda k: F.regexp_extract(page, VISIBLE, k)
    seen = _noon(F.when(part(1) != "", part(1)).otherwise(F.concat_ws("-", part(4), part(3), part(2))))
    return F.coalesce(_first(named), _moment(_field(page, CHANGED_FIELD)), _first(marked), seen)


def page_date(html: Column) -> Column:
    """When a page was last changed or, if it does not say so, published."""
    page = filled(html)
    tags = F.regexp_extract_all(page, F.lit("(?i)<meta[^>]+>"), F.lit(0))
    named = once(tags, lambda x: F.array(*[_moment(_meta(x, name)) for name in PUBLISHED_META]))
    time = F.regexp_extract(page, '(?i)<time[^>]+datetime="([^"]+)"', 1)
    return F.coalesce(change_date(html), _first(named), _moment(_field(page, PUBLISHED_FIELD)), _moment(time))


def address_date(url: Column) -> Column:
    """Noon of the day in an address."""
    return _noon(F.regexp_extract(filled(url), IN_ADDRESS, 1))


def article_date(html: Column, url: Column, fetched: Column) -> Column:
    """The date of an article: of its page, else of its address, else when it was fetched."""
    return F.coalesce(page_date(html), address_date(url), fetched)
