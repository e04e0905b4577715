"""Which parts of a document are the action itself, so that a quote from its reasons is told from one of what it asks or decides. All are column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, once, verbatim_form

# The wordings of parliament's demands, decisions and questions, the headings around a summary, and the least length of a question.
GRANTS = r"(?iu)anvisar\s+anslagen"
INCOME = r"(?iu)godkänner beräkningen av inkomsterna"
BINDING = r"(?iu)återkomma med lagförslag i överensstämmelse med"
FRAME = r"(?iu)riktlinjer för den ekonomiska politiken|fastställ\w*\s+utgiftstaket|fördelning(?:en)? av utgifter på utgiftsområden|preliminära beräkningen av inkomster"
ADOPTS = r"(?iu)\bRiksdagen\s+(?:antar|godkänner|bifaller|anvisar|bemyndigar|fastställer|beslutar)\b"
SUMMARY = r"(?su)\bSammanfattning\b(.*?)\bUtskottets förslag till riksdagsbeslut\b"
LEAD = r"(?=[fF])(?iu)\b(?:fråga|frågar|frågor)\b[^:?!]{0,140}:"
LEAST_QUESTION = 40
QUESTION_KINDS = ("interpellation", "skriftlig_fraga")
#: What the action's own text is made of.
DECISION, DEMANDS, QUESTIONS = "decision", "demands", "questions"
_BLANKS = " \n\r\t"


def demand_kind(demand: Column) -> Column:
    """grants, income, frame or matter: what a motion's demand is about. One that no wording is known of is a matter, to be read."""
    return F.when(demand.rlike(GRANTS), "grants").when(demand.rlike(INCOME), "income").when(demand.rlike(FRAME), "frame").otherwise("matter")


def motion_kind(demands: Column) -> Column:
    """none, matter (any demand is), grants (else, if any demand is) or frame: how a motion with these demands is treated. A null list is empty."""

    def named(kinds: Column) -> Column:
        return F.when(F.size(kinds) == 0, "none").when(F.array_contains(kinds, "matter"), "matter").when(F.array_contains(kinds, "grants"), "grants").otherwise("frame")

    return once(F.transform(_listed(demands), demand_kind), named)


def binding_income(demands: Column) -> Column:
    """Whether a demand sets the income and binds the government to propose the law for it."""
    return F.exists(_listed(demands), lambda d: d.rlike(INCOME) & d.rlike(BINDING))


def _listed(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def summary(text: Column) -> Column:
    """What a report says between its summary's heading and the proposal's; null if that is nothing."""
    return F.nullif(F.btrim(F.regexp_extract(filled(text), SUMMARY, 1), F.lit(_BLANKS)), F.lit(""))


def question_texts(text: Column) -> Column:
    """The questions that a document asks, in order: what ends with a question mark behind the last lead-in (words for asking, up to a colon). Without a lead-in, a question
    begins behind the last end of a sentence before it. Shorter ones are phrases."""
    text = filled(text)

    def asked(tail: Column, led: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(tail, F.lit("([^?]+[?])"), F.lit(1)), lambda q: F.btrim(q, F.lit(_BLANKS)))
        alone = lambda q: F.btrim(F.regexp_replace(q, r"^[\s\S]*(?<=[.:!?])\s+", ""), F.lit(_BLANKS))
        return F.filter(F.transform(pieces, lambda q: F.when(led, q).otherwise(alone(q))), lambda q: F.char_length(q) >= LEAST_QUESTION)

    return once(F.element_at(F.split(text, LEAD), -1), lambda tail: asked(tail, text.rlike(LEAD)))


def own_text(decision: Column, demands: Column, text: Column, kind: Column) -> Column:
    """struct<sort, parts, body_open>, or null where the action's own text is not known (then only the whole text can be asked).

    A decision goes first: its wording, and the report's summary where it adopts something. Then a motion's demands, with the whole text where they do nothing but grant money as a
    table says. Then, for the kinds of documents that ask, their questions, if any can be told."""
    text = F.nullif(text, F.lit(""))

    def made(sort: str, parts: Column, is_open: Column) -> Column:
        return F.struct(F.lit(sort).alias("sort"), parts.alias("parts"), is_open.alias("body_open"))

    more = F.when(decision.rlike(ADOPTS), summary(text))
    decided = made(DECISION, F.array_compact(F.array(decision, more)), F.lit(False))
    opened = (motion_kind(demands) == "grants") & text.isNotNull()
    demanded = made(DEMANDS, F.when(opened, F.concat(demands, F.array(text))).otherwise(demands), opened)
    asked = once(question_texts(text), lambda q: F.when(F.size(q) > 0, made(QUESTIONS, q, F.lit(False))))
    return F.when(decision.isNotNull(), decided).when(F.size(_listed(demands)) > 0, demanded).when(kind.isin(*QUESTION_KINDS) & text.isNotNull(), asked)


def stands_in(quote: Column, own: Column) -> Column:
    """Whether one of the parts holds the quote; null where the own text is not known or the quote is empty."""
    known = own.isNotNull() & (F.size(own["parts"]) > 0)
    return once(verbatim_form(quote), lambda q: F.when(known & (q != ""), F.exists(own["parts"], lambda p: F.contains(verbatim_form(p), q))))
