"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, jaccard, negatives, periodic_runs, pseudo_likelihood, quality, secrets, suffixes, token_counts, token_files, warc
from .shared import new_folder, table


#: Vocabulary files, which lie at the same place on every machine; a parameter of the operators.
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


#: The rounds of edits of op7: a mask over every run of four or more digits, then one over every word of twelve or more letters.
ROUNDS = [("[0-9]{4,}", "<number>"), ("[\\p{L}]{12,}", "<word>")]


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = [lambda text, pattern=pattern, mask=mask: token_counts.masks(text, pattern, mask) for pattern, mask in ROUNDS]
    return token_counts.count_with_edits(table(spark, sf_dir, "documents"), rounds, BYTE_BPE)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("squared_distance")


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False, with_text=False)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"), text_col=periodic_runs.with_periodic_ends("doc_id", "text"), with_runs=False, with_text=False)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(table(spark, sf_dir, "documents"), new_folder(spark, "token-files"), WORD_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op7_token_counts": op7_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op3_warc_normaliser": op3_warc_normaliser,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}
_ESCAPES = r"(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<image>|<audio>|<document>|<file>)"

ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM (SELECT * FROM r WHERE vec_id % 100 = 0) a JOIN r b ON a.vec_id <> b.vec_id),
        p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER best <= 10""",
    "op10_chat_formatting": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            sum(8 + length(regexp_replace(regexp_replace(role, '{_ESCAPES}', '#\\1', 'g'), chr(10), '##', 'g'))
                + length(regexp_replace(text, '{_ESCAPES}', '#\\1', 'g')))::BIGINT AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op3_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
            bits AS (SELECT page_id, html, ('0x' || substr(h, 1, 10))::BIGINT AS a, ('0x' || substr(h, 11, 10))::BIGINT AS b,
                ('0x' || substr(h, 21, 10))::BIGINT AS c, ('0x' || substr(h, 31, 10))::BIGINT AS d,
                min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (1 + (((CASE k // 8 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END) >> (35 - 5 * (k % 8))::INT) & 31))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM bits""",
}
