"""Gates of statements: what an article's statements on a closed list of questions must meet before they are taken.

An article is judged first: its host, and that no party has too many statements in it. Its fault is that of all its statements. Then each statement is judged: by its schema,
and if that holds by its question, its quote and its day, with all faults named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, once, trimmed_quote, verbatim_form, word_count
from .links import any_of
from .reviews import secure_host

# The codes of parties and positions, the bounds of a statement's fields, of its quote and of its day, and the statements of one party in an article.
PARTIES = ("s", "m", "sd", "c", "v", "kd", "l", "mp")
POSITIONS = ("ja", "nej", "villkorat")
CONDITIONAL, LIVE = "villkorat", "aktiv"
QUESTION_CHARS, NOTE_CHARS, QUOTE_CHARS, NAME_CHARS = (4, 80), 300, (10, 600), (2, 100)
LEAST_WORDS, MOST_WORDS, WINDOW_DAYS, MOST_A_PARTY = 5, 40, 548, 3


def tidied(statements: DataFrame) -> DataFrame:
    """Statements with party and position in lower case without blanks at the ends, and quotes cut to the words that they may have."""
    plain = lambda c: F.btrim(F.lower(c), F.lit(" \n\r\t"))
    return statements.withColumns({"party": plain(F.col("party")), "position": plain(F.col("position")), "quote": trimmed_quote(F.col("quote"), MOST_WORDS)})


def _within(text: Column, bounds: tuple[int, int]) -> Column:
    return F.coalesce(F.char_length(text).between(*bounds), F.lit(False))


def schema_faults(question: Column, party: Column, position: Column, note: Column, quote: Column, name: Column, role: Column) -> Column:
    """The fields that break the schema. A note may be null, and so may a person: name and role are both null then."""
    person = (name.isNull() & role.isNull()) | (_within(name, NAME_CHARS) & _within(role, NAME_CHARS))
    return any_of({
        "question": ~_within(question, QUESTION_CHARS), "party": ~F.coalesce(party.isin(*PARTIES), F.lit(False)), "position": ~F.coalesce(position.isin(*POSITIONS), F.lit(False)),
        "note": F.coalesce(F.char_length(note) > NOTE_CHARS, F.lit(False)), "quote": ~_within(quote, QUOTE_CHARS), "person": ~person,
    })


def judged(statements: DataFrame, articles: DataFrame, questions: DataFrame, allowed: list[str], now: Column) -> DataFrame:
    """The statements with `gate` (the first gate that rejects: article, schema or content; null if none does) and `faults`. `statements`: statement, article, question, party, position, note, quote, name,
    role; `articles`: article (unique), url, declared, text, published (a timestamp; null where it cannot be read); `questions`: question (unique), state.

    Statements of one article and party are counted, not gathered, and articles joined by their ids, so that a long list of statements on one article is no group in one task. A null party
    is a party of its own in these counts. A statement whose article is missing fails by its domain."""
    crowds = statements.groupBy("article", "party").agg(F.count("*").alias("n")).groupBy("article").agg(F.max("n").alias("most"))
    declared = F.regexp_replace("declared", "^www\\.", "")
    host = secure_host(F.col("url"))
    texts = articles.join(crowds, "article").select(
        "article", verbatim_form(F.col("text")).alias("form"), "published",
        F.when(~F.coalesce(host.isin(*allowed) & (host == declared), F.lit(False)), "domain").when(F.col("most") > MOST_A_PARTY, "crowd").alias("fault"), F.lit(True).alias("there"),
    )
    rows = statements.join(texts, "article", "left").join(questions.select("question", F.coalesce("state", F.lit("")).alias("state")), "question", "left")
    schema = schema_faults(*[F.col(c) for c in ("question", "party", "position", "note", "quote", "name", "role")])
    age = F.abs(F.unix_seconds(now) - F.unix_seconds("published"))

    def content(quote: Column) -> Column:
        words = word_count(quote)
        return any_of({
            "unknown question": F.col("state").isNull(), "question not live": F.col("state") != LIVE, "no condition": (F.col("position") == CONDITIONAL) & (filled(F.col("note")) == ""),
            "short": words < LEAST_WORDS, "long": words > MOST_WORDS, "not verbatim": words.between(LEAST_WORDS, MOST_WORDS) & ~F.contains(F.col("form"), quote),
            "no date": F.col("published").isNull(), "date": age > WINDOW_DAYS * 86_400,
        })

    article = F.coalesce("fault", F.when(F.col("there").isNull(), "domain"))
    rows = rows.withColumns({"article_fault": article, "schema_faults": schema, "content_faults": once(verbatim_form(F.col("quote")), content)})
    faults = F.when(F.col("article_fault").isNotNull(), F.array("article_fault")).when(F.size("schema_faults") > 0, F.col("schema_faults")).otherwise(F.col("content_faults"))
    gate = F.when(F.col("article_fault").isNotNull(), "article").when(F.size("schema_faults") > 0, "schema").when(F.size("content_faults") > 0, "content")
    return rows.select(*statements.columns, gate.alias("gate"), faults.alias("faults"))


def taken(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of judged statements, those that pass, and those that go to review with their faults; each is in one of the two."""
    return rows.where("gate IS NULL").drop("gate", "faults"), rows.where("gate IS NOT NULL")
