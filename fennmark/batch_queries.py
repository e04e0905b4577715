"""Queries on batches of rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import batches
from .registry import query


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_brand, list_distinct(string_split(p_name, ' ')) AS w FROM part),
    e AS (SELECT b.id, list(a.id ORDER BY a.id) AS earlier FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id < b.id
        WHERE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w)) >= 0.3 - 1e-9 GROUP BY b.id),
    n AS (SELECT p.id, p_brand, coalesce(earlier, []) AS earlier, row_number() OVER (PARTITION BY p_brand ORDER BY p.id) AS k FROM p LEFT JOIN e ON p.id = e.id),
    r AS (SELECT p_brand, 0::BIGINT AS k, []::BIGINT[] AS taken FROM p GROUP BY p_brand
        UNION ALL SELECT n.p_brand, n.k, CASE WHEN len(list_intersect(n.earlier, r.taken)) > 0 THEN r.taken ELSE list_append(r.taken, n.id) END FROM r JOIN n ON n.p_brand = r.p_brand AND n.k = r.k + 1),
    f AS (SELECT p_brand, max_by(taken, k) AS taken FROM r GROUP BY p_brand)
    SELECT n.id AS p_partkey, list_min(list_intersect(n.earlier, f.taken)) AS duplicate_of FROM n JOIN f ON n.p_brand = f.p_brand""")
def accepted_in_batch(t):
    rows = t("part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("words"))
    return batches.accepted_in_order(rows, ["p_brand"], "words", "p_partkey", 0.3).select("p_partkey", "duplicate_of")
