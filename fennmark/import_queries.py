"""Queries on the import of a catalogue, each with its SQL. A record says the first eight words of a benchmark item, once for each of the sources of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.text import filled
from .operators import imports
from .registry import query
from .text_queries import _sql_verbatim

_PARTIES = {"Alpha": "a", "Beta": "b", "Gamma": "c"}
_SOURCES = 20


def _flow(t):
    item = t("benchmark").select("item_id", F.array_join(F.slice(F.split(F.btrim(F.regexp_replace(filled(F.col("text")), "[ \t\n\r]+", " ")), " "), 1, 8), " ").alias("quote"), F.explode(F.sequence(F.lit(0), F.lit(_SOURCES - 1))).alias("k"))
    key = F.col("item_id") * _SOURCES + F.col("k")
    records = item.select(
        key.alias("rec"), F.element_at(F.array(*map(F.lit, [*_PARTIES, "nobody"])), (key % 13 % 4 + 1).cast("int")).alias("party_name"), "quote",
        F.when(key % 7 == 0, F.concat(F.lit("https://youtu.be/src"), F.col("k"))).otherwise(F.concat(F.lit("https://www.src"), F.col("k"), F.lit(".se/a"))).alias("url"),
        F.concat(F.lit("t"), F.md5("quote")).alias("title"), F.lit("x").alias("category"), F.when(key % 11 == 0, "soon").otherwise("2024-01-10").alias("day"), F.when(key % 17 == 0, 2e6).alias("amount"),
    )
    documents = t("documents").where("source IS NOT NULL").select("source", "text")
    texts = documents.withColumn("source", F.concat("source", F.lit(".se"))).unionByName(documents)
    existing = item.where("item_id % 10 = 3 AND k = 0").select("item_id", F.concat(F.lit("u"), F.md5("quote")).alias("title"), F.lit("x").alias("category"), "quote").withColumnRenamed("item_id", "id")
    return imports.imported(records, texts, existing, [f"src{k}.se" for k in range(_SOURCES)], _PARTIES, F.lit("2024-02-01").cast("date"))


_FINGER = "regexp_replace(lower(nfc_normalize(quote)), '[^a-z0-9åäöéèü]', '', 'g')"
_LOOSE = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SQL = f"""WITH q AS (SELECT item_id, array_to_string(list_slice(string_split(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')), ' '), 1, 8), ' ') AS quote FROM benchmark),
    r AS (SELECT item_id, quote, k, item_id * {_SOURCES} + k AS rec FROM q, range({_SOURCES}) x(k)),
    v AS (SELECT *, {_sql_verbatim('quote')} AS form, rec % 7 = 0 AS spoken, [{', '.join(f"'{c}'" for c in _PARTIES.values())}, NULL][rec % 13 % 4 + 1] AS party FROM r),
    d AS (SELECT source, {_sql_verbatim('text')} AS form, {_LOOSE.format('text')} AS loose FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
    h AS (SELECT DISTINCT rec FROM v JOIN d ON d.source = 'src' || k AND CASE WHEN spoken THEN contains(d.loose, {_LOOSE.format('quote')}) ELSE contains(d.form, v.form) END WHERE v.form <> ''),
    f AS (SELECT v.*, CASE WHEN party IS NULL THEN ['party'] ELSE list_filter([CASE WHEN len(string_split(form, ' ')) < 5 OR form = '' THEN 'short' END,
        CASE WHEN spoken AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = 'src' || k AND trim(x.text) <> '') THEN 'no transcript' WHEN h.rec IS NULL THEN 'not verbatim' END,
        CASE WHEN v.rec % 17 = 0 THEN 'amount' END, CASE WHEN v.rec % 11 = 0 THEN 'no date' END], lambda x: x IS NOT NULL) END AS faults FROM v LEFT JOIN h ON h.rec = v.rec),
    p AS (SELECT *, min(rec) OVER (PARTITION BY form, party) AS first, first(quote) OVER (PARTITION BY form ORDER BY rec) AS lead FROM f WHERE len(faults) = 0),
    n AS (SELECT form, count(DISTINCT party) AS n FROM p GROUP BY form),
    e AS (SELECT item_id AS id, quote FROM q WHERE item_id % 10 = 3),
    o AS (SELECT p.rec, p.party, CASE WHEN n > 1 THEN 'g-t' || md5(lead) END AS group_id, n = 1 AND rec <> first AS repeated,
        CASE WHEN NOT (n = 1 AND rec <> first) THEN (SELECT min(e.id) FROM e WHERE {_FINGER.replace('quote', 'e.quote')} = {_FINGER.replace('quote', 'p.quote')} AND length({_FINGER.replace('quote', 'p.quote')}) >= 30) END AS dup FROM p JOIN n USING (form))"""


@query(f"{_SQL} SELECT rec, party, group_id FROM o WHERE NOT repeated AND dup IS NULL")
def imported_rows(t):
    return _flow(t)["published"]


@query(f"""{_SQL}, w AS (SELECT rec, array_to_string(faults, ',') AS reasons, NULL::BIGINT AS duplicate_of FROM f WHERE len(faults) > 0 UNION ALL SELECT rec, CASE WHEN repeated THEN 'repeated' ELSE 'duplicate' END, dup FROM o WHERE repeated OR dup IS NOT NULL) SELECT * FROM w""")
def import_reviews(t):
    return _flow(t)["review"].withColumn("reasons", F.array_join("reasons", ","))


@query(f"""{_SQL}, w AS (SELECT unnest(faults) AS outcome FROM f UNION ALL SELECT CASE WHEN repeated THEN 'repeated' WHEN dup IS NOT NULL THEN 'duplicate' ELSE 'published' END FROM o) SELECT outcome, count(*) AS n FROM w GROUP BY outcome""")
def import_counts(t):
    return _flow(t)["counts"]
