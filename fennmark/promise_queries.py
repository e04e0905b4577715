"""Queries on the grid, the pages of promises and the rows that bear them, each with its SQL. Orders stand for promises, line items for links, parts for actions and suppliers' nations for parties."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import bearers, promise_pages
from .operators.links import dealt_by_key
from .registry import query


def _tables(t) -> dict:
    items = t("lineitem").withColumn("link", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    sides = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("promise"), F.concat(F.lit("N"), "s_nationkey").alias("party"))
    count = lambda flag: F.count(F.when(F.col("l_returnflag") == flag, 1))
    return {
        "promises": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("category")),
        "links": items.select(F.col("l_orderkey").alias("promise"), "link", F.col("l_partkey").alias("action"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("subtype"), (F.col("l_quantity") > 10).alias("active"), F.col("l_returnflag").alias("direction")),
        "actions": t("part").where("p_size % 4 <> 0").select(F.col("p_partkey").alias("action"), F.col("p_type").alias("kind"), F.col("p_brand").alias("subtype"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_size") * 40).cast("int")).alias("day"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("archive_url")),
        "verdicts": sides.agg(count("A").alias("in_line"), count("R").alias("against"), F.count(F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 25), 1)).alias("abstained")),
    }


_DAY = "(DATE '2020-01-01' + (p_size * 40)::INT)"
_SESSION = f"CASE WHEN month({_DAY}) >= 9 THEN year({_DAY}) ELSE year({_DAY}) - 1 END"
_SQL = f"""WITH a AS (SELECT p_partkey AS action, p_type AS kind, p_brand AS sub, {_DAY} AS day, {_SESSION} AS s, CASE WHEN p_size % 3 = 0 THEN p_name END AS url FROM part WHERE p_size % 4 <> 0),
    l AS (SELECT l_orderkey AS id, l_orderkey * 10 + l_linenumber AS link, l_partkey AS action, CASE WHEN l_tax > 0.04 THEN l_linestatus END AS sub, l_returnflag AS direction FROM lineitem WHERE l_quantity > 10),
    f AS (SELECT id, count(*) AS n_links, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds, list_sort(list(DISTINCT coalesce(l.sub, a.sub)) FILTER (coalesce(l.sub, a.sub) IS NOT NULL)) AS subtypes,
        list_sort(list(DISTINCT s || '/' || lpad(((s + 1) % 100)::VARCHAR, 2, '0')) FILTER (s IS NOT NULL)) AS sessions FROM l LEFT JOIN a ON l.action = a.action GROUP BY id),
    v AS (SELECT l_orderkey AS id, 'N' || s_nationkey AS party, count(*) FILTER (l_returnflag = 'A') AS i, count(*) FILTER (l_returnflag = 'R') AS g, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 25) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    c AS (SELECT id, string_agg(party || '=' || CASE WHEN i > 0 AND g > 0 THEN 'both' WHEN i > 0 THEN 'in_line' WHEN g > 0 THEN 'against' ELSE 'none' END, ';' ORDER BY party) AS cells FROM v WHERE i > 0 OR g > 0 OR n > 0 GROUP BY id),
    g AS (SELECT o_orderkey AS id, o_orderpriority AS title, 'c' || (o_custkey % 7) AS category, n_links, coalesce(cells, '') AS cells, coalesce(kinds, []) AS kinds, coalesce(subtypes, []) AS subtypes, coalesce(sessions, []) AS sessions FROM orders JOIN f ON f.id = o_orderkey LEFT JOIN c ON c.id = o_orderkey)"""


def _grid(t):
    x = _tables(t)
    return promise_pages.grid_rows(x["promises"], x["links"], x["actions"], x["verdicts"])


def _written(cells: str):
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(cells)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"), F.lit(""))


@query(f"{_SQL} SELECT id, title, category, n_links, cells, array_to_string(kinds, ',') AS kinds, array_to_string(subtypes, ',') AS subtypes, array_to_string(sessions, ',') AS sessions FROM g")
def grid_of_promises(t):
    return _grid(t).select("id", "title", "category", "n_links", _written("cells").alias("cells"), *[F.array_join(c, ",").alias(c) for c in ("kinds", "subtypes", "sessions")])


@query(f"""{_SQL}, m AS (SELECT id, 'category' AS facet, category AS value FROM g UNION ALL SELECT id, 'kind', unnest(kinds) FROM g UNION ALL SELECT id, 'subtype', unnest(subtypes) FROM g UNION ALL SELECT id, 'session', unnest(sessions) FROM g)
    SELECT facet, value, count(DISTINCT id) AS n FROM m GROUP BY ALL UNION ALL SELECT 'all', NULL, count(*) FROM g UNION ALL SELECT 'none', NULL, (SELECT count(*) FROM orders) - (SELECT count(*) FROM g)""")
def grid_facets(t):
    return promise_pages.grid_totals(_grid(t), t("orders").agg(F.count("*").alias("n")))


@query(f"""{_SQL}, k AS (SELECT id, string_agg(concat_ws(':', link, direction, coalesce(l.sub, a.sub), l.action, kind, day, coalesce(url, CASE WHEN l.action % 2 = 0 THEN 'w' || l.action END)), '|' ORDER BY link, direction, coalesce(l.sub, a.sub) NULLS FIRST, l.action) AS links FROM l LEFT JOIN a ON l.action = a.action GROUP BY id),
    e AS (SELECT user_id AS id, string_agg(event_type, ',' ORDER BY ts, event_type) AS notes FROM events WHERE event_type = 'purchase' OR event_type = 'click' GROUP BY user_id)
    SELECT o_orderkey AS id, coalesce(links, '') AS links, coalesce(cells, '') AS verdicts, coalesce(notes, '') AS corrections FROM orders LEFT JOIN k ON k.id = o_orderkey LEFT JOIN c ON c.id = o_orderkey LEFT JOIN e ON e.id = o_orderkey""")
def pages_of_promises(t):
    x = _tables(t)
    corrections = t("events").where("event_type IN ('purchase', 'click')").select(F.col("user_id").alias("promise"), F.col("ts").alias("day"), F.col("event_type").alias("text"))
    archive = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("action"), F.concat(F.lit("w"), "p_partkey").alias("archive_url"))
    pages = promise_pages.promise_pages(x["promises"], x["links"], x["actions"], x["verdicts"], corrections, archive)
    one = lambda e: F.concat_ws(":", *[e[c].cast("string") for c in ("link", "direction", "subtype", "action", "kind", "day", "archived")])
    text = lambda c, use: F.coalesce(F.array_join(F.transform(c, use), "|" if c == "links" else ","), F.lit(""))
    return pages.select("id", text("links", one).alias("links"), _written("verdicts").alias("verdicts"), text("corrections", lambda e: e["text"]).alias("corrections"))


_AMOUNT = "CASE WHEN l_tax < 0.02 THEN 0 WHEN l_tax < 0.04 THEN NULL WHEN l_discount < 0.05 THEN -l_quantity ELSE l_quantity END"


@query(f"""WITH k AS (SELECT o_orderkey AS link, o_custkey AS motion, CASE o_orderkey % 9 WHEN 0 THEN 'tax' WHEN 1 THEN 'rule' ELSE 'grant' END AS kind, o_orderstatus = 'O' AS supports, CASE WHEN o_orderkey % 13 = 0 THEN 'broken' END AS fault, o_orderkey FROM orders),
    w AS (SELECT DISTINCT link, motion, left(unnest(string_split(p_name, ' ')), 5) AS p, FROM k JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
    r AS (SELECT l_suppkey AS motion, l_partkey AS row, first({_AMOUNT} ORDER BY {_AMOUNT}) AS amount, any_value(p_name) AS name, any_value(p_type) = 'ECONOMY' AS sums FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    x AS (SELECT DISTINCT motion, row, left(unnest(string_split(name, ' ')), 5) AS p FROM r),
    n AS (SELECT link, r.motion, r.row, amount, overlap, row_number() OVER (PARTITION BY link ORDER BY overlap DESC, sums, r.row) AS place FROM (SELECT link, w.motion, x.row, count(*) AS overlap FROM w JOIN x ON w.motion = x.motion AND w.p = x.p AND length(w.p) = 5 GROUP BY ALL) y JOIN r ON r.motion = y.motion AND r.row = y.row),
    b AS (SELECT link, count(*) AS n_near, min(place) FILTER (amount <> 0) AS place, arg_min(row, place) AS first_row FROM n GROUP BY link),
    m AS (SELECT k.*, coalesce((SELECT count(*) FROM r WHERE r.motion = k.motion), 0) AS n_rows, coalesce(n_near, 0) AS n_near, first_row, n.row, n.amount, n.overlap FROM k LEFT JOIN b ON b.link = k.link LEFT JOIN n ON n.link = k.link AND n.place = b.place),
    d AS (SELECT *, CASE WHEN fault IS NOT NULL THEN 'unreadable' WHEN kind = 'tax' THEN 'promise is a tax' WHEN kind = 'rule' THEN 'promise is a rule' WHEN n_rows = 0 THEN 'no table' WHEN n_near = 0 THEN 'no row shares a word' WHEN row IS NULL THEN 'row stands still'
        WHEN supports AND amount < 0 THEN 'row goes the other way' WHEN overlap < 2 THEN 'weak match' ELSE 'bears' END AS outcome FROM m)
    SELECT link, CASE WHEN outcome IN ('bears', 'weak match', 'row goes the other way') THEN row WHEN outcome = 'row stands still' THEN first_row END AS row, outcome, outcome IN ('promise is a tax', 'promise is a rule', 'no table', 'row stands still') AS withdraw,
        outcome IN ('unreadable', 'no row shares a word', 'row goes the other way', 'weak match') AS needs_reading FROM d""")
def bearing_rows(t):
    n_parts = t("part").count()
    order = t("orders")
    kind = F.when(F.col("o_orderkey") % 9 == 0, "tax").when(F.col("o_orderkey") % 9 == 1, "rule").otherwise("grant")
    links = order.select(F.col("o_orderkey").alias("link"), F.col("o_custkey").alias("motion"), kind.alias("kind"), (F.col("o_orderstatus") == "O").alias("supports"), F.when(F.col("o_orderkey") % 13 == 0, "broken").alias("fault"))
    order, part = dealt_by_key((order.withColumn("part", F.col("o_orderkey") % n_parts), "part"), (t("part"), "p_partkey"), rows=order.count())
    asked = order.join(part, F.col("p_partkey") == F.col("part")).select(F.col("o_orderkey").alias("link"), F.col("o_custkey").alias("motion"), F.explode(F.split("p_name", " ")).alias("word"))
    lines, part = dealt_by_key((t("lineitem").withColumn("a", F.expr(_AMOUNT)).select("l_suppkey", "l_partkey", "a"), "l_partkey"), (t("part"), "p_partkey"), rows=t("lineitem").count())
    items = lines.groupBy(F.col("l_suppkey").alias("motion"), F.col("l_partkey").alias("row")).agg(F.min("a").alias("amount"))
    rows = items.join(part, F.col("row") == F.col("p_partkey")).select("motion", "row", F.col("p_type").alias("name"), "amount", F.explode(F.split("p_name", " ")).alias("word"))
    return bearers.decided(links, asked, rows, "^ECONOMY$")
