"""Queries on links, counters and registries, each with its SQL. Orders stand for promises, line items for links, parts for actions, suppliers for parties, customers for people."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as forms
from .operators import links
from .registry import query


def _active():
    return F.col("l_linestatus") == "O"


@query("""WITH r AS (SELECT l_partkey, arg_max((l_orderkey, l_linenumber), (l_shipdate, l_orderkey, l_linenumber)) AS x FROM lineitem GROUP BY l_partkey)
    SELECT p_partkey, p_name, x[1] AS l_orderkey, x[2] AS l_linenumber FROM part JOIN r ON p_partkey = l_partkey""")
def report_votes(t):
    last = links.last_of(t("lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber"), ["l_partkey"], F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    return t("part").join(last, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, l_quantity) IN (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'F')
    AND (l_suppkey, l_quantity) NOT IN (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'O')""")
def outdated_anchors(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_linestatus")
    return links.outdated(rows, rows.where(~_active()), rows.where(_active()), ["l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber")


@query("""WITH c AS (SELECT l_orderkey AS changed, l_suppkey, l_quantity, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linenumber = 1),
    b AS (SELECT l_orderkey AS borrower, l_suppkey, l_quantity, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A')
    SELECT changed, borrower, len(list_intersect(string_split(c.p_name, ' '), string_split(b.p_name, ' ')))::INT AS hits FROM c JOIN b USING (l_suppkey, l_quantity) WHERE changed <> borrower""")
def anchor_dependents(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_quantity", F.split("p_name", " ").alias("words"))
    changed = rows.where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_orderkey").alias("changed"), "l_suppkey", "l_quantity", F.col("words").alias("w"))
    pairs = changed.join(rows.where("l_returnflag = 'A'").withColumnRenamed("l_orderkey", "borrower"), ["l_suppkey", "l_quantity"]).where("changed != borrower")
    return pairs.select("changed", "borrower", links.shared_words(pairs, "w", "words").alias("hits"))


@query(f"""WITH w AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(nfc_normalize(text)), '{forms.NOT_KEPT}+')) AS w FROM benchmark), w2 AS (SELECT * FROM w WHERE length(w) > 2),
    h AS (SELECT a.item_id AS item, b.item_id AS other, count(*) AS hits FROM w2 a JOIN w2 b ON a.w = b.w AND a.item_id <> b.item_id GROUP BY ALL HAVING count(*) >= 2)
    SELECT item, other, hits, row_number() OVER (PARTITION BY item ORDER BY hits DESC, other)::INT AS place FROM h QUALIFY place <= 3""")
def vote_candidates(t):
    words = t("benchmark").select("item_id", F.explode(forms.tokens(F.col("text"))).alias("w"))
    return links.ranked_by_hits(words.withColumnRenamed("item_id", "item"), words.withColumnRenamed("item_id", "other"), "w", "item", "other", 2, 3)


@query("""WITH e AS (SELECT p_partkey AS id, unnest([p_partkey + 7, p_partkey + 2, p_partkey + 5]) AS other, unnest([0, 1, 2]) AS place FROM part)
    SELECT id, string_agg(p_name, '|' ORDER BY place) AS names FROM e JOIN part ON other = p_partkey GROUP BY id""")
def anchors_in_order(t):
    ids = t("part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_partkey") + 7, F.col("p_partkey") + 2, F.col("p_partkey") + 5).alias("anchors"))
    return links.in_listed_order(ids, "id", "anchors", t("part").withColumnRenamed("p_partkey", "other"), "other", "p_name").select("id", F.array_join("p_name", "|").alias("names"))


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS link, min(l_orderkey) AS target, min(l_partkey) AS action, bool_and(l_linestatus = 'O') AS active FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS target, o_custkey % 50 AS grp, o_orderstatus <> 'F' AS live FROM orders), m AS (SELECT link, CASE WHEN link % 9 = 0 THEN target ELSE target + 1 END AS too, CASE WHEN link % 5 = 0 THEN 'G3 says so' ELSE repeat('because ', 8) END AS reason FROM l),
    j AS (SELECT m.link, too, l.active, a.grp AS g1, b.grp AS g2, b.live, l.target, reason, EXISTS (SELECT 1 FROM l h WHERE h.active AND h.target = too AND h.action = l.action AND h.link <> l.link) AS held FROM m JOIN l USING (link) LEFT JOIN o a ON a.target = l.target LEFT JOIN o b ON b.target = too)
    SELECT link, too, array_to_string(list_filter([CASE WHEN NOT coalesce(active, false) THEN 'link' END, CASE WHEN NOT coalesce(live, false) THEN 'target' END, CASE WHEN target = too THEN 'itself' END, CASE WHEN NOT coalesce(g1 = g2, false) THEN 'group' END, CASE WHEN held THEN 'duplicate' END, CASE WHEN length(trim(reason)) < 40 THEN 'short reason' END, CASE WHEN reason LIKE 'G3%' THEN 'inner code' END], lambda x: x IS NOT NULL), ',') AS faults FROM j""")
def group_moves(t):
    rows = t("lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link")).agg(F.min("l_orderkey").alias("target"), F.min("l_partkey").alias("action"), F.bool_and(_active()).alias("active"))
    targets = t("orders").select(F.col("o_orderkey").alias("target"), (F.col("o_custkey") % 50).alias("grp"), (F.col("o_orderstatus") != "F").alias("live"))
    reason = F.when(F.col("link") % 5 == 0, "G3 says so").otherwise(F.repeat(F.lit("because "), F.lit(8)))
    moves = rows.select("link", F.when(F.col("link") % 9 == 0, F.col("target")).otherwise(F.col("target") + 1).alias("to"), reason.alias("reason"))
    return links.move_faults(rows, moves, targets).select("link", F.col("to").alias("too"), F.array_join("faults", ",").alias("faults"))


@query(f"""WITH k AS (SELECT regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '{forms.NOT_KEPT}', '', 'g') AS k, source FROM documents)
    SELECT md5(k) AS key, count(*) AS n, count(DISTINCT source) + max((source IS NULL)::INT) AS parties, count(DISTINCT source) + max((source IS NULL)::INT) > 1 AS grouped, count(*) - (count(DISTINCT source) + max((source IS NULL)::INT)) AS repeats FROM k WHERE k <> '' GROUP BY k""")
def import_clusters(t):
    return links.clusters(t("documents"), forms.quote_key(F.col("text")), "source").withColumn("key", F.md5("key"))


@query("""SELECT l_partkey, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS direction, max(l_orderkey) AS target FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey""")
def weighed_map(t):
    rows = t("lineitem").where(_active()).select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return links.last_of(rows, ["l_partkey"], F.struct("l_orderkey", "l_linenumber", "l_returnflag")).select("l_partkey", F.col("l_returnflag").alias("direction"), F.col("l_orderkey").alias("target"))


@query("""WITH t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT l_partkey, s_nationkey, count(*) AS links FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT t.l_partkey, n_nationkey AS s_nationkey, coalesce(links, 0) AS links FROM t CROSS JOIN nation LEFT JOIN c ON c.l_partkey = t.l_partkey AND s_nationkey = n_nationkey""")
def verdict_universe(t):
    some = t("lineitem").where("l_returnflag = 'R'").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_nationkey")
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"))
    return links.universe(parts, t("nation").select(F.col("n_nationkey").alias("s_nationkey")), some, parts, ["l_partkey", "s_nationkey"], "l_partkey")


@query("""WITH c AS (SELECT p_partkey AS correction, unnest(list_distinct(['/part/' || (p_partkey + 1), (p_partkey * 3)::VARCHAR])) AS name FROM part WHERE p_size > 25),
    p AS (SELECT p_partkey AS page, unnest(['/part/' || p_partkey, p_partkey::VARCHAR]) AS name FROM part) SELECT DISTINCT page, correction FROM p JOIN c USING (name)""")
def corrections_of_pages(t):
    key = F.col("p_partkey")
    named = t("part").where("p_size > 25").select(key.alias("correction"), F.array(F.concat(F.lit("/part/"), (key + 1).cast("string")), (key * 3).cast("string")).alias("affects"))
    return links.affected(named, t("part").select(key.alias("page"), F.concat(F.lit("/part/"), key.cast("string")).alias("path"), key.cast("string").alias("id")))


@query("""SELECT c_custkey, c_name, count(*) AS promises, (sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus <> 'F'))::DOUBLE AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def people_with_promises(t):
    promises = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    out = links.people_with(t("customer").select("c_custkey", "c_name"), promises, "c_custkey", F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus") != "F")
    return out.withColumn("total", F.col("total").cast("double"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events""")
def ranks_by_day(t):
    return links.ranks(t("events").withColumn("day", F.to_date("ts")), ["event_type"], "day", ["ts", "event_id"]).select("event_id", "rank")


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) + (SELECT max(regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT) FROM supplier) AS k, o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT o_orderkey, 'P-' || CASE WHEN length(k::VARCHAR) < 4 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS s_name FROM n""")
def next_promise_ids(t):
    new = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"))
    return links.next_ids(new, t("supplier"), "s_name", "P-", "day", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "s_name")


@query("""SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY l_partkey""")
def first_of_batch(t):
    rows = t("lineitem").select("l_partkey", "l_orderkey", "l_returnflag")
    return links.first_in_batch(rows.where("l_returnflag = 'N'"), rows.where("l_returnflag = 'A'"), "l_partkey", F.col("l_orderkey")).select("l_partkey", "l_orderkey")


@query("""WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o_orderkey FROM f
    UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT * FROM s) AND o_orderkey NOT IN (SELECT * FROM f)""")
def queue_with_new_rows(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return links.appended(rows.where("o_orderstatus = 'F'"), rows, rows.where("o_orderpriority = '1-URGENT'"), "o_orderkey").select("o_orderkey")


@query("""WITH r AS (SELECT l_orderkey, max((l_linestatus = 'O')::INT) AS o FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN o IS NULL THEN 'missing' ELSE 'waiting' END AS outcome FROM orders LEFT JOIN r ON l_orderkey = o_orderkey WHERE o IS NULL OR o = 1""")
def unsettled_findings(t):
    receipts = t("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return links.unsettled(t("orders").select("o_orderkey"), receipts, "o_orderkey", F.col("l_linestatus") == "O")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5""")
def same_party_lists(t):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").where("o_orderstatus <> 'F'").withColumn("k", F.row_number().over(order)).where("k <= 5").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT o_orderkey, translate(lower(o_orderpriority || 'ÅÄÖé'), 'åäöé', '{|}e') AS key FROM orders""")
def swedish_keys(t):
    return t("orders").select("o_orderkey", links.swedish_key(F.concat("o_orderpriority", F.lit("ÅÄÖé"))).alias("key"))


@query("""SELECT p_partkey FROM part ORDER BY md5('17:' || p_partkey), p_partkey LIMIT 100""")
def seeded_samples(t):
    return links.seeded_sample(t("part").select("p_partkey"), "p_partkey", 17, 100)


# --- counters


@query("""SELECT l_orderkey, count(*) AS links, count(DISTINCT l_returnflag) AS kinds, count(DISTINCT l_suppkey) AS parties, count(DISTINCT CASE WHEN month(l_shipdate) >= 9 THEN year(l_shipdate) ELSE year(l_shipdate) - 1 END) AS sessions FROM lineitem GROUP BY l_orderkey""")
def grid_summary(t):
    rows = t("lineitem").select("l_orderkey", "l_returnflag", "l_suppkey", (F.year("l_shipdate") - (F.month("l_shipdate") < 9).cast("int")).alias("session"))
    distinct = [F.size(F.collect_set(c)).cast("bigint").alias(name) for c, name in (("l_returnflag", "kinds"), ("l_suppkey", "parties"), ("session", "sessions"))]
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("links"), *distinct)


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) || '/' || right((year(o_orderdate) + 1)::VARCHAR, 2) ELSE (year(o_orderdate) - 1) || '/' || right(year(o_orderdate)::VARCHAR, 2) END AS session FROM orders""")
def sessions_of_dates(t):
    first = F.year("o_orderdate") - (F.month("o_orderdate") < 9).cast("int")
    return t("orders").select("o_orderkey", F.concat(first.cast("string"), F.lit("/"), F.right((first + 1).cast("string"), F.lit(2))).alias("session"))


@query("""SELECT s_nationkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS kept, count(*) FILTER (l_returnflag = 'R') AS broken, count(*) FILTER (l_linestatus = 'O') AS active,
    round(100.0::DOUBLE * count(*) FILTER (l_returnflag = 'A') / count(*)) AS percent FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""")
def party_page_counters(t):
    rows = t("lineitem").join(F.broadcast(t("supplier")) if t("supplier").count() <= 500_000 else t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = links.tally(rows, ["s_nationkey"], {"kept": F.col("l_returnflag") == "A", "broken": F.col("l_returnflag") == "R", "active": _active()})
    return out.withColumn("percent", F.round(100.0 * F.col("kept") / F.col("n")))


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS absent, count(*) FILTER (o_orderstatus = 'O') AS yes, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P') AS deviations FROM orders GROUP BY o_custkey""")
def member_page_counters(t):
    status = F.col("o_orderstatus")
    return links.tally(t("orders"), ["o_custkey"], {"absent": status == "F", "yes": status == "O", "deviations": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (status == "P")})


@query("""WITH s AS (SELECT event_type, user_id, count(*) AS n, count(DISTINCT value > 10) AS kinds FROM events GROUP BY ALL), p AS (SELECT count(DISTINCT user_id) AS p FROM events)
    SELECT event_type, count(*) AS stated, min(p) AS cells, count(*) FILTER (kinds > 1) AS changes FROM s, p GROUP BY event_type""")
def issue_counts(t):
    e = t("events")
    cells = e.groupBy("event_type", "user_id").agg(F.min(F.col("value") > 10).alias("a"), F.max(F.col("value") > 10).alias("b"))
    parties = e.select("user_id").distinct().agg(F.count("*").alias("cells"))
    counted = cells.groupBy("event_type").agg(F.count("user_id").alias("stated"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("changes"))
    return counted.crossJoin(F.broadcast(parties)).select("event_type", "stated", "cells", "changes")


@query("""SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(DISTINCT regexp_replace(url, '/+$', '')) AS pages FROM pages GROUP BY 1""")
def page_coverage(t):
    urls = t("pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), F.regexp_replace("url", "/+$", "").alias("u")).distinct()
    return urls.groupBy("host").agg(F.count("u").alias("pages"))


@query("""SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS unknown, count(*) FILTER (event_type = 'error') > 0.5 * count(*) AS broken FROM events""")
def sweep_tally(t):
    return t("events").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("unknown")).withColumn("broken", F.col("unknown") > 0.5 * F.col("n"))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS own_text, count(*) FILTER (l_linestatus <> 'O') AS without FROM lineitem GROUP BY l_returnflag""")
def class_crosstab(t):
    return links.tally(t("lineitem"), ["l_returnflag"], {"own_text": _active(), "without": ~_active()})


_CHECKS = {"missing": "l_tax = 0", "level": "l_discount >= 0.1", "span": "l_quantity > 45", "kind": "l_returnflag = 'R' AND l_linestatus = 'O'"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(DISTINCT l_orderkey) AS promises FROM lineitem WHERE {v} HAVING count(*) > 0" for k, v in _CHECKS.items()))
def objections_per_check(t):
    found = links.any_of({k: F.expr(v) for k, v in _CHECKS.items()})
    return t("lineitem").select("l_orderkey", F.explode(found).alias("check")).distinct().groupBy("check").agg(F.count("*").alias("promises"))


@query("""SELECT o_custkey, count(*) AS members, count(DISTINCT CASE WHEN o_totalprice <> 0 THEN floor(o_totalprice / 100000) END) AS totals FROM orders GROUP BY o_custkey HAVING members = 1 OR totals > 1""")
def group_faults(t):
    level = F.when(F.col("o_totalprice") != 0, F.floor(F.col("o_totalprice") / 100000))
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("members"), F.size(F.collect_set(level)).cast("bigint").alias("totals")).where("members = 1 OR totals > 1")


@query("""SELECT l_orderkey, l_suppkey, count(*) AS verdicts FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL HAVING count(*) >= 2""")
def verdict_duplicates(t):
    return t("lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("verdicts")).where("verdicts >= 2")


@query("""SELECT count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority LIKE '%-%') AS with_words, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 100000) AS testable FROM orders""")
def anchor_coverage(t):
    active = F.col("o_orderstatus") != "F"
    return t("orders").agg(*[F.count(F.when(c, 1)).alias(k) for k, c in {"active": active, "with_words": active & F.contains("o_orderpriority", F.lit("-")), "testable": active & (F.col("o_totalprice") > 100000)}.items()])


@query("""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linestatus = 'O') > 0 AND count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'R') = 0""")
def targets_left_empty(t):
    left = links.tally(t("lineitem"), ["l_orderkey"], {"before": _active(), "after": _active() & (F.col("l_returnflag") != "R")})
    return left.where("before > 0 AND after = 0").select("l_orderkey")


@query("""SELECT l_orderkey, count(DISTINCT l_partkey) AS tested FROM lineitem GROUP BY l_orderkey""")
def tested_per_target(t):
    return t("lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.count("*").alias("tested"))


@query("""SELECT lang, count(*) AS n, count(quality) AS reviewed, round(count(quality)::DOUBLE / count(*), 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def review_coverage(t):
    both = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("reviewed")).withColumn("share", F.round(F.col("reviewed") / F.col("n"), 6))


@query("""SELECT unnest(['all positive', 'some urgent', 'most open', 'none above a billion']) AS claim, unnest([min(o_totalprice) > 0 AND count(*) > 0, bool_or(o_orderpriority = '1-URGENT') AND count(*) > 0,
    count(*) FILTER (o_orderstatus = 'O') > 0.5 * count(*) AND count(*) > 0, max(o_totalprice) < 1e9 AND count(*) > 0]) AS holds FROM orders""")
def claims_registry(t):
    named = {"all positive": F.min("o_totalprice") > 0, "some urgent": F.bool_or(F.col("o_orderpriority") == "1-URGENT"), "most open": F.count(F.when(F.col("o_orderstatus") == "O", 1)) > 0.5 * F.count("*"), "none above a billion": F.max("o_totalprice") < 1e9}
    return links.claims(t("orders"), named)


@query("""SELECT strftime(o_orderdate, '%G-%V') AS week, count(*) AS added, count(*) FILTER (o_orderstatus <> 'F') AS plain FROM orders GROUP BY 1""")
def weekly_rows(t):
    day = F.col("o_orderdate")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return t("orders").groupBy(week.alias("week")).agg(F.count("*").alias("added"), F.count(F.when(F.col("o_orderstatus") != "F", 1)).alias("plain"))


@query("""SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS party, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS district FROM orders GROUP BY o_custkey""")
def last_seen_party(t):
    order = F.struct("o_orderdate", "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", order).alias("party"), F.min_by("o_orderstatus", order).alias("district"))


@query("""SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def first_votes(t):
    return t("events").groupBy("user_id", "event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("value"))


@query("""WITH g AS (SELECT o_custkey, arg_max(o_totalprice, (o_totalprice, -o_orderkey)) AS net FROM orders GROUP BY o_custkey) SELECT o_custkey, net FROM g ORDER BY net DESC, o_custkey LIMIT 10""")
def top_policies(t):
    return t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("net")).orderBy(F.desc("net"), "o_custkey").limit(10)
