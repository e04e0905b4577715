"""A stored index of the words of documents, and search in it.

The index is a table of postings (term, doc, and a mask of groups if asked for), partitioned by the first two letters of the term and
sorted within. It is written once; a search reads the partitions of its own terms only. Postings are shuffled once, by shard and a hash of the
document, so a shard, and a term of many documents, is spread over tasks and files.

A word is searched in all its near forms: as written, without its definite ending, and with one behind either. Documents must have a form
of every word. Counts are of all documents that match, beside the few that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stop_words
from ..functions.labels import word_shard
from ..functions.stemming import VOWELS, stemmed
from ..functions.text import terms

# Definite endings, and how much of each goes when the word is made indefinite. How many terms stand for a document, how many documents are shown.
DEFINITE_ENDINGS = {"an": 1, "et": 2, "en": 2}
TERMS, SHOWN = 40, 60
#: Parts that a shard is dealt in.
SALTS = 4


def search_forms(word: Column) -> Column:
    """The near forms of a lower-case word, sorted: the word, the word without each definite ending that it has, and each of those with the definite
    ending that its last letter takes. No ending is put behind another one."""
    shorter = [F.when(word.endswith(e), F.left(word, F.char_length(word) - n)) for e, n in DEFINITE_ENDINGS.items()]
    bases = F.array_compact(F.array(word, *shorter))
    bare = F.filter(bases, lambda b: ~b.rlike(f"({'|'.join(DEFINITE_ENDINGS)})$"))
    longer = F.transform(bare, lambda b: F.when(b.endswith("a"), F.concat(b, F.lit("n"))).when(~b.rlike(f"[{VOWELS}]$") & (b != ""), F.concat(b, F.lit("et"))))
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(F.concat(bases, longer)), lambda f: F.char_length(f) >= 2)))


def document_terms(docs: DataFrame, doc: str, text: str, most: int = TERMS, stems: bool = True) -> DataFrame:
    """doc, term, n, rank: the `most` frequent terms of each document, the first in the alphabet of equal ones. Words of the stop lists and numbers are no terms; words
    are counted by stem. Each distinct word of a document is stemmed once a task, and what is shuffled is a row for each distinct word of a document."""
    excluded = {w for x in (stop_words.STOP_WORDS, stop_words.FORMULA_WORDS, stop_words.EMPTY_WORDS, stop_words.PARTY_NAMES) for w in x}
    kept = F.filter(terms(F.col(text), stop_words.STOP_WORDS), lambda w: ~w.isin(*sorted(excluded)) & ~w.rlike("^[0-9]+$"))
    counts = docs.select(doc, F.explode(kept).alias("word")).groupBy(doc, "word").agg(F.count("*").alias("n"))
    counted = counts.select(doc, (stemmed(F.col("word")) if stems else F.col("word")).alias("term"), "n").groupBy(doc, "term").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)


def write_index(postings: DataFrame, path: str, doc: str, mask: Column | None = None) -> None:
    """Write distinct (term, doc) with `mask`, bits of the groups a document belongs to."""
    rows = postings.select(word_shard(F.col("term")).alias("shard"), "term", F.col(doc).alias("doc"), (F.lit(0) if mask is None else mask).cast("bigint").alias("mask"))
    order, salt = ["shard", "term", "doc"], F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt")
    dealt = rows.select("*", salt).repartition("shard", "salt")
    first = F.row_number().over(Window.partitionBy(*order, "salt").orderBy(F.desc("mask")))  # in the order in which the rows are written
    dealt.withColumn("k", first).where("k = 1").select(*order, "mask").write.mode("overwrite").partitionBy("shard").parquet(path)


def query_terms(spark: SparkSession, words: list[str], stems: bool = True) -> dict[str, list[str]]:
    """The terms that each word of a question is searched as."""
    rows = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string").select("word", F.explode(search_forms(F.lower("word"))).alias("form"))
    found = rows.select("word", (stemmed(F.col("form")) if stems else F.col("form")).alias("term")).collect()
    return {w: sorted({r.term for r in found if r.word == w}) for w in dict.fromkeys(words)}


def postings_of(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """term, doc, mask of these terms; only their shards are read."""
    schema = "term string, doc bigint, mask bigint, shard string"
    shards = [r.s for r in spark.createDataFrame([(t,) for t in asked], "t string").select(word_shard(F.col("t")).alias("s")).distinct().collect()] if asked else []
    return spark.read.schema(schema).parquet(path).where(F.col("shard").isin(shards) & F.col("term").isin(asked)).select("term", "doc", "mask")


def matches(spark: SparkSession, path: str, words: list[str], wanted: int = 0, stems: bool = True) -> DataFrame:
    """doc, mask of the documents with a form of every word and, if `wanted` has bits, with one of those in their mask. No word, no document."""
    forms = query_terms(spark, words, stems)
    of_word = [F.when(F.col("term").isin(v), F.lit(k)) for k, v in enumerate(forms.values())]
    rows = postings_of(spark, path, sorted({t for v in forms.values() for t in v}))
    found = rows.select("doc", "mask", F.explode(F.array_compact(F.array(*of_word)) if of_word else F.array().cast("array<int>")).alias("word"))
    every = found.groupBy("doc").agg(F.max("mask").alias("mask"), F.count_distinct("word").alias("n")).where(F.col("n") == len(forms))
    return (every.where(F.col("mask").bitwiseAND(wanted) != 0) if wanted else every).select("doc", "mask")


def search(spark: SparkSession, path: str, words: list[str], wanted: int = 0, most: int = SHOWN, stems: bool = True) -> DataFrame:
    """doc, n_all: the `most` highest documents that match, each with the number of all that do."""
    found = matches(spark, path, words, wanted, stems)
    count = found.agg(F.count("*").alias("n_all"))
    return found.select("doc").orderBy(F.desc("doc")).limit(most).crossJoin(F.broadcast(count))  # one row


def counts_by_kind(spark: SparkSession, path: str, examples: list[str], kinds: DataFrame, doc: str, kind: str, stems: bool = True) -> DataFrame:
    """example, kind, n: how many documents of each kind have a form of an example word. All examples are looked up in one pass over their shards."""
    forms = query_terms(spark, examples, stems)
    asked = spark.createDataFrame([(w, t) for w, v in forms.items() for t in v], "example string, term string")
    hits = postings_of(spark, path, sorted({t for v in forms.values() for t in v})).join(F.broadcast(asked), "term").select("example", "doc").distinct()
    return hits.join(kinds.select(F.col(doc).alias("doc"), kind), "doc").groupBy("example", kind).agg(F.count("*").alias("n"))


def votes_on_topic(hits: DataFrame, reports: DataFrame, ballots: DataFrame, parties: list[str], newest: int = 12) -> tuple[DataFrame, DataFrame]:
    """What parties voted on the reports that a search hit. `hits`: doc. `reports`: doc, vote, day. `ballots`: vote, party, choice (rows of members).

    The first table is party, choice, votes: in how many votes a party's plurality chose so (equal ones: the first in the alphabet), with parties beyond `parties`
    left out; the second is vote, day of the `newest` votes."""
    votes = hits.select("doc").distinct().join(reports, "doc").select("vote", "day").distinct()
    tally = ballots.where(F.col("party").isin(parties)).join(votes.select("vote").distinct(), "vote").groupBy("vote", "party", "choice").agg(F.count("*").alias("n"))
    line = tally.groupBy("vote", "party").agg(F.min(F.struct((-F.col("n")).alias("n"), "choice")).alias("x")).select("vote", "party", "x.choice")
    return line.groupBy("party", "choice").agg(F.count("*").alias("votes")), votes.orderBy(F.desc("day"), F.desc("vote")).limit(newest)
