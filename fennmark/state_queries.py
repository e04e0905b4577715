"""Queries on streams with state and on tables in versions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import publication
from .registry import query
from .sources.versions import Versions
from .stored import work_folder
from .streaming import attempts


def _runs(t) -> DataFrame:
    """Two runs of the stream of attempts: the events before the 20th, then all of them as new files."""
    events = t("events")
    spark = events.sparkSession
    folder = work_folder(spark, "attempts")
    outcome = F.when(F.col("event_type") == "purchase", attempts.DONE).when(F.col("event_type") == "click", attempts.UNANSWERED).otherwise("no copy")
    rows = events.select(F.concat_ws("-", "user_id", F.col("event_id") % 5).alias("key"), "ts", outcome.alias("outcome"))
    schema = rows.schema
    for early in (True, False):
        rows.where((F.to_date("ts") < "2024-01-20") == early).write.mode("append").parquet(f"{folder}/source")
        attempts.run(spark.readStream.schema(schema).parquet(f"{folder}/source"), folder)
    return attempts.rows_of(spark, folder)


_ATTEMPTS = """WITH e AS (SELECT user_id || '-' || (event_id % 5) AS key, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'unanswered' ELSE 'no copy' END AS outcome FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, outcome) AS k FROM e), f AS (SELECT key, min(k) AS k FROM d WHERE outcome = 'done' GROUP BY key),
    s AS (SELECT d.*, CASE WHEN d.k > f.k THEN 'repeat' WHEN outcome = 'done' THEN 'new' WHEN outcome = 'unanswered' THEN 'waiting' ELSE 'answered' END AS kind, min(ts) OVER (PARTITION BY d.key) AS first FROM d LEFT JOIN f ON d.key = f.key)"""


@query(f"{_ATTEMPTS} SELECT key, kind, count(*) AS n, min(epoch_us(ts)) AS since FROM s GROUP BY key, kind")
def attempt_kinds(t):
    return _runs(t).groupBy("key", "kind").agg(F.count("*").alias("n"), F.min("ts").alias("since"))


@query(f"""{_ATTEMPTS}, l AS (SELECT * FROM s WHERE kind <> 'repeat' QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1)
    SELECT key, epoch_us(first) AS first, epoch_us(ts) AS latest, k AS attempts, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(first))::DOUBLE / 86400000000) > 14 AS blocked FROM l WHERE kind = 'waiting'""")
def waiting_keys(t):
    return attempts.waiting(_runs(t), "2024-01-31 00:00:00")


_ID = "'P-' || CASE WHEN length(p_partkey::VARCHAR) < 4 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END"
_OLD, _QUEUED = "p_size % 3 = 0", "p_size % 3 = 1"


def _published(t) -> Versions:
    part = t("part")
    spark = part.sparkSession
    versions = Versions(spark, work_folder(spark, "publication"))
    number = F.col("p_partkey").cast("string")
    rows = part.withColumn("id", F.concat(F.lit("P-"), F.when(F.char_length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)))
    rows = rows.select("*", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("quote_key"), F.col("p_brand").alias("url"), F.col("p_name").alias("title"))
    versions.publish({"promises": rows.where(_OLD).select("id", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("g-"), "p_brand")).alias("group_id"), "quote_key", "url", "title")}, "start")
    queue = rows.where(_QUEUED).select(F.col("p_partkey").alias("queue_id"), "quote_key", "url", "title")
    target = F.concat(F.lit("P-"), F.lpad((F.col("p_partkey") - 1).cast("string"), 4, "0"))
    decisions = rows.where("p_size % 3 <> 0 AND p_size % 7 <> 0").select(F.col("p_partkey").alias("queue_id"), F.col("p_partkey").alias("place"), F.when(F.col("p_size") % 2 == 0, target).alias("link_to"))
    publication.publish(versions, queue, decisions, "P-")
    return versions


_PUBLICATION = f"""WITH r AS (SELECT *, {_ID} AS id, string_split(p_name, ' ')[1] AS q FROM part), old AS (SELECT id, CASE WHEN p_size % 2 = 0 THEN 'g-' || p_brand END AS g, q, p_brand, p_name FROM r WHERE {_OLD}),
    d AS (SELECT r.*, CASE WHEN p_size % 2 = 0 THEN 'P-' || CASE WHEN p_partkey - 1 < 10000 THEN lpad((p_partkey - 1)::VARCHAR, 4, '0') ELSE left((p_partkey - 1)::VARCHAR, 4) END END AS link_to FROM r WHERE p_size % 3 <> 0 AND p_size % 7 <> 0),
    j AS (SELECT d.*, coalesce(o.g, 'g-' || o.id) AS grp, CASE WHEN NOT ({_QUEUED}) THEN 'not in the queue' WHEN link_to IS NOT NULL AND o.id IS NULL THEN 'linked to nothing'
        WHEN EXISTS (SELECT 1 FROM old x WHERE x.q = d.q AND x.p_brand = d.p_brand) THEN 'published before' END AS reason FROM d LEFT JOIN old o ON o.id = link_to),
    f AS (SELECT *, CASE WHEN reason IS NULL AND p_partkey > min(p_partkey) FILTER (reason IS NULL) OVER (PARTITION BY q, p_brand) THEN 'published before' ELSE reason END AS final FROM j),
    n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) + (SELECT max(substr(id, 3)::BIGINT) FROM old) AS k FROM f WHERE final IS NULL)"""


@query(f"""{_PUBLICATION} SELECT id, coalesce(g, (SELECT min(grp) FROM n WHERE link_to = old.id)) AS group_id, q AS quote_key, p_brand AS url, p_name AS title FROM old
    UNION ALL SELECT 'P-' || CASE WHEN length(k::VARCHAR) < 4 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END, grp, q, p_brand, p_name FROM n""")
def published_rows(t):
    return _published(t).read("promises", publication.PUBLISHED)


@query(f"{_PUBLICATION} SELECT p_partkey AS queue_id, final AS reason FROM f WHERE final IS NOT NULL")
def refused_rows(t):
    return _published(t).read("refused", publication.REFUSED)


@query("""SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P') WHERE k > 120 AND k <= 240""")
def second_run_of_budget(t):
    rows = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    spark = rows.sparkSession
    versions = Versions(spark, work_folder(spark, "budget"))
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    publication.take_within_budget(versions, rows, "o_orderkey", ["o_orderdate"], 120, schema)
    return publication.take_within_budget(versions, rows, "o_orderkey", ["o_orderdate"], 120, schema)
