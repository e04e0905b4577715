"""Queries on the stored index of words, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.stemming import VOWELS
from .functions.text import NOT_KEPT
from .operators import search, word_index
from .registry import query
from .stored import work_folder

_LETTERS = NOT_KEPT.replace("[^", "[")
_WORDS = f"(SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(nfc_normalize(text)), '{_LETTERS}+')) AS term FROM documents)"
_ENDINGS = "(an|en|et)$"
_SQL_FORMS = f"""list_sort(list_distinct(list_filter(list_concat(b, list_transform(list_filter(b, lambda y: NOT regexp_matches(y, '{_ENDINGS}')),
    lambda y: CASE WHEN y LIKE '%a' THEN y || 'n' WHEN y <> '' AND NOT regexp_matches(y, '[{VOWELS}]$') THEN y || 'et' END)), lambda y: length(y) >= 2)))"""
_SQL_BASES = "list_filter([w, CASE WHEN w LIKE '%an' THEN left(w, length(w) - 1) END, CASE WHEN w LIKE '%et' THEN left(w, length(w) - 2) END, CASE WHEN w LIKE '%en' THEN left(w, length(w) - 2) END], lambda y: y IS NOT NULL)"


@query(f"""SELECT w AS word, array_to_string({_SQL_FORMS}, ',') AS forms FROM (SELECT w, {_SQL_BASES} AS b FROM (SELECT DISTINCT term AS w FROM {_WORDS}))""")
def search_forms(t):
    words = t("documents").select(F.explode(search.words(F.col("text"), 1)).alias("word")).distinct()
    return words.select("word", F.array_join(word_index.search_forms(F.col("word")), ",").alias("forms"))


def _index(t) -> str:
    """An index of all words of four letters or more, with a bit for the document's language."""
    docs = t("documents")
    spark = docs.sparkSession
    path = work_folder(spark, "word-index")
    bit = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).otherwise(4)
    word_index.write_index(docs.select("doc_id", bit.alias("mask"), F.explode(search.words(F.col("text"))).alias("term")), path, "doc_id", F.col("mask"))
    return path


def _sql_hits(word: str) -> str:
    return f"SELECT doc_id FROM {_WORDS} WHERE length(term) >= 4 AND term IN (SELECT unnest({_SQL_FORMS}) FROM (SELECT w, {_SQL_BASES} AS b FROM (SELECT '{word}' AS w)))"


_QUESTION = ["that", "with"]
_HITS = " INTERSECT ".join(_sql_hits(w) for w in _QUESTION)


@query(f"""WITH h AS ({_HITS}), m AS (SELECT doc_id FROM h JOIN documents USING (doc_id) WHERE lang = 'en' OR lang NOT IN ('en', 'de'))
    SELECT doc_id AS doc, (SELECT count(*) FROM m) AS n_all FROM m ORDER BY doc_id DESC LIMIT 60""")
def indexed_search(t):
    return word_index.search(t("documents").sparkSession, _index(t), _QUESTION, wanted=5, stems=False)


_EXAMPLES = ["that", "with", "under", "nothing", "people", "avec"]


@query(" UNION ALL ".join(f"SELECT '{w}' AS example, source, count(*) AS n FROM ({_sql_hits(w)}) JOIN documents USING (doc_id) GROUP BY source" for w in _EXAMPLES).replace("SELECT doc_id FROM", "SELECT DISTINCT doc_id FROM"))
def indexed_example_counts(t):
    docs = t("documents")
    return word_index.counts_by_kind(docs.sparkSession, _index(t), _EXAMPLES, docs, "doc_id", "source", stems=False)


_TOPIC = f"""WITH v AS (SELECT DISTINCT o_orderkey AS vote, o_orderdate AS day FROM ({_sql_hits('that')}) JOIN orders ON o_custkey = doc_id)"""


def _topic(t):
    hits = word_index.matches(t("documents").sparkSession, _index(t), ["that"], stems=False)
    reports = t("orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("vote"), F.col("o_orderdate").alias("day"))
    ballots = t("lineitem").select(F.col("l_orderkey").alias("vote"), F.concat(F.lit("P"), F.col("l_linenumber")).alias("party"), F.col("l_returnflag").alias("choice"))
    return word_index.votes_on_topic(hits, reports, ballots, ["P1", "P2", "P3"])


@query(f"""{_TOPIC}, n AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey IN (SELECT vote FROM v) GROUP BY ALL),
    l AS (SELECT l_linenumber, first(l_returnflag ORDER BY n DESC, l_returnflag) AS choice FROM n GROUP BY l_orderkey, l_linenumber) SELECT 'P' || l_linenumber AS party, choice, count(*) AS votes FROM l GROUP BY ALL""")
def topic_votes(t):
    return _topic(t)[0]


@query(f"{_TOPIC} SELECT vote, day FROM v ORDER BY day DESC, vote DESC LIMIT 12")
def newest_topic_votes(t):
    return _topic(t)[1]
