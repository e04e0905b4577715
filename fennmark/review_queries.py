"""Queries on gates, decisions and page tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import money
from .operators import links, reviews
from .registry import query
from .sources import tables
from .text_queries import _sql_verbatim

_ALLOWED = [f"src{k}.example" for k in range(12)]
_DOCUMENTS, _YEAR = "(manifest|budget)", 2026
_V = _sql_verbatim


def _articles(t):
    """Documents as articles: an address made of their source, and three candidate quotes."""
    d = t("documents").where("text IS NOT NULL AND source IS NOT NULL")
    key, lines = F.col("doc_id"), F.split("text", "\n")
    scheme = F.when(key % 11 == 0, "http://").otherwise("https://www.")
    path = F.when(key % 7 == 0, "/a/manifest-2022/x").when(key % 7 == 1, "/budget-2025-2026").otherwise("/manifest/9920220")
    url = F.concat(scheme, "source", F.when(key % 13 == 0, ".example:8080").otherwise(".example"), path)
    quotes = F.array(lines[0], F.element_at(lines, -1), F.lit("which stands nowhere in any text"))
    declared = F.concat("source", F.when(key % 17 == 0, ".other").otherwise(".example"))
    return d.select("doc_id", "text", url.alias("url"), declared.alias("declared"), F.when(key % 19 == 0, F.array_repeat(F.lit("x"), 6)).otherwise(quotes).alias("quotes"), "n_chars")


_ARTICLES = """SELECT doc_id, text, n_chars, CASE WHEN doc_id % 11 = 0 THEN 'http://' ELSE 'https://www.' END || source || CASE WHEN doc_id % 13 = 0 THEN '.example:8080' ELSE '.example' END
    || CASE doc_id % 7 WHEN 0 THEN '/a/manifest-2022/x' WHEN 1 THEN '/budget-2025-2026' ELSE '/manifest/9920220' END AS url, source || CASE WHEN doc_id % 17 = 0 THEN '.other' ELSE '.example' END AS declared,
    CASE WHEN doc_id % 19 = 0 THEN ['x', 'x', 'x', 'x', 'x', 'x'] ELSE [string_split(text, chr(10))[1], string_split(text, chr(10))[-1], 'which stands nowhere in any text'] END AS quotes FROM documents WHERE text IS NOT NULL AND source IS NOT NULL"""
_HOST = "regexp_replace(regexp_extract(url, '^https://([^/:?#@]+)([/?#]|$)', 1), '^www\\.', '')"
_FAULT = f"""CASE WHEN {_HOST} = '' OR {_HOST} NOT IN ({", ".join(repr(x) for x in _ALLOWED)}) OR {_HOST} <> declared THEN 'domain' WHEN url LIKE '%/manifest-2022/%' THEN 'earlier' WHEN len(quotes) > 5 THEN 'crowd' END"""


@query(f"SELECT doc_id, {_FAULT} AS fault FROM ({_ARTICLES})")
def article_faults(t):
    return _articles(t).select("doc_id", reviews.article_fault(F.col("url"), F.col("declared"), _ALLOWED, _DOCUMENTS, _YEAR, F.col("quotes"), 5).alias("fault"))


_NAMES = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"
_STRIP = "regexp_replace({}, '[ .,;:!?]+$', '')"
_LINES = f"list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda y: {_STRIP.format(_V('y'))}), lambda y: y <> '')"
_CONTENT = _NAMES.format("CASE WHEN words < 5 AND NOT (own AND words >= 2 AND coalesce(alone, false)) THEN 'short' END, CASE WHEN words > 40 THEN 'long' END, CASE WHEN q <> '' AND NOT contains(form, q) THEN 'not verbatim' END, CASE WHEN n_chars * 100 > 1500000 THEN 'amount' END, CASE WHEN abs(days) > 548 THEN 'date' END")


@query(f"""WITH a AS ({_ARTICLES}), c AS (SELECT *, {_FAULT} AS fault, {_V('text')} AS form, {_LINES} AS lines, unnest(quotes) AS quote, unnest(range(len(quotes))) AS k FROM a),
    q AS (SELECT *, {_V('quote')} AS q, {_STRIP.format(_V('quote'))} AS s, doc_id % 2 = 0 AS own, doc_id % 1000 - 300 AS days FROM c),
    w AS (SELECT *, CASE WHEN q = '' THEN 0 ELSE len(string_split(q, ' ')) END AS words, s <> '' AND len(list_filter(lines, lambda x: x = s)) = 1 AND len(list_filter(lines, lambda x: x <> s AND contains(x, s))) = 0 AS alone FROM q)
    SELECT doc_id, k::INT AS k, CASE WHEN fault IS NOT NULL THEN fault WHEN quote = '' THEN 'empty' ELSE {_CONTENT} END AS faults FROM w""")
def gate_chain(t):
    article = reviews.article_fault(F.col("url"), F.col("declared"), _ALLOWED, _DOCUMENTS, _YEAR, F.col("quotes"), 5)
    now = F.lit("2026-08-01").cast("timestamp")
    published = F.when(F.lit(True), F.timestamp_seconds(F.unix_seconds(now) - (F.col("doc_id") % 1000 - 300) * 86_400))
    each = _articles(t).withColumn("fault", article).select("doc_id", "text", "n_chars", "fault", F.posexplode("quotes").alias("k", "quote"))
    content = F.concat(reviews.quote_faults(F.col("quote"), F.col("text"), F.col("doc_id") % 2 == 0), reviews.amount_faults(F.col("n_chars") * 100, published, now))
    faults = reviews.candidate_faults(F.col("fault"), links.any_of({"empty": F.col("quote") == ""}), content)
    return each.select("doc_id", "k", F.array_join(faults, ",").alias("faults"))


@query(f"""WITH r AS (SELECT doc_id, {_V('text')} AS form, {_V("string_split(text, chr(10))[1]")} AS own, {_V("string_split(text, chr(10))[-1]")} AS q, source, lang, doc_id FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, {_NAMES.format("CASE WHEN length(q) < 20 THEN 'short' END, CASE WHEN NOT contains(form, q) THEN 'not verbatim' END, CASE WHEN NOT contains(own, q) THEN 'not own' END, CASE WHEN NOT (source IN ('src0', 'src1') OR lang = 'de') THEN 'actor' END, CASE WHEN doc_id % 1000 > 500 THEN 'date' END, CASE WHEN doc_id % 5 = 0 THEN 'method' END")} AS faults FROM r""")
def link_gates(t):
    d = t("documents").where("text IS NOT NULL")
    lines = F.split("text", "\n")
    day = F.date_add(F.lit("2022-09-11").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    actors = F.array_compact(F.array("source", "lang"))
    faults = reviews.link_faults(F.element_at(lines, -1), F.col("text"), lines[0], actors, F.array(F.lit("src0"), F.lit("src1"), F.lit("de")), day, "2022-09-11", "2024-01-24", {"method": F.when(F.col("doc_id") % 5 != 0, 1)})
    return d.select("doc_id", F.array_join(faults, ",").alias("faults"))


@query(f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS text, {_V("coalesce(text, '')")} AS form, {_V("string_split(coalesce(text, ''), chr(10))[1]")} AS own, {_V("CASE WHEN doc_id % 6 = 0 THEN 'nowhere at all' ELSE string_split(coalesce(text, ''), chr(10))[-1] END")} AS q FROM documents)
    SELECT doc_id, CASE WHEN text = '' THEN 'unverifiable' WHEN NOT contains(form, q) THEN 'not verbatim' WHEN contains(own, q) THEN 'own text' WHEN doc_id % 4 = 0 THEN 'justified' ELSE 'outside' END AS outcome FROM r""")
def quote_outcomes(t):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    quote = F.when(F.col("doc_id") % 6 == 0, "nowhere at all").otherwise(F.element_at(lines, -1))
    return t("documents").select("doc_id", reviews.quote_outcome(quote, F.col("text"), lines[0], F.when(F.col("doc_id") % 4 == 0, "stands in the table").otherwise(" ")).alias("outcome"))


@query("""WITH l AS (SELECT l_partkey, min(l_linestatus) AS s FROM lineitem GROUP BY 1), q AS (SELECT p_partkey + 100 AS l_partkey, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_name END AS reason FROM part),
    j AS (SELECT q.l_partkey, CASE WHEN s IS NULL THEN 'unknown' WHEN s <> 'O' THEN 'already' WHEN trim(reason) = '' THEN 'no reason' ELSE 'done' END AS outcome FROM q LEFT JOIN l USING (l_partkey))
    SELECT l_partkey, outcome, CASE WHEN outcome = 'done' THEN 'W' ELSE s END AS state FROM j LEFT JOIN l USING (l_partkey)""")
def link_withdrawals(t):
    held = t("lineitem").groupBy("l_partkey").agg(F.min("l_linestatus").alias("state"))
    asked = t("part").select((F.col("p_partkey") + 100).alias("l_partkey"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_name")).alias("reason"))
    after, judged = reviews.withdrawn_links(held, asked, "l_partkey", "state", "O", "W")
    return judged.select("l_partkey", "outcome").join(after, "l_partkey", "left")


@query("""WITH l AS (SELECT o_orderkey AS link, o_custkey AS target FROM orders), m AS (SELECT o_orderkey AS link, o_custkey + 1 AS too FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000)
    SELECT link, coalesce(too, target) AS target FROM l LEFT JOIN m USING (link)""")
def retargeted_links(t):
    rows = t("orders").select(F.col("o_orderkey").alias("link"), F.col("o_custkey").alias("target"))
    moves = t("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("link"), (F.col("o_custkey") + 1).alias("to"), links.any_of({"small": F.col("o_totalprice") <= 200000}).alias("faults"))
    return reviews.retargeted(rows, moves, "link", "target")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_type IN ('ECONOMY', 'SMALL') THEN upper(p_name) ELSE p_name END AS p_name FROM part""")
def swapped_quotes(t):
    swaps = t("part").where("p_size % 3 = 0").select("p_partkey", F.upper("p_name").alias("value"), F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "own text").otherwise("outside").alias("outcome"))
    return reviews.replaced(t("part").select("p_partkey", "p_name"), swaps, "p_partkey", "p_name", ["own text", "justified"])


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 END AS anchor FROM part), w AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_partkey WHEN p_size % 5 = 1 THEN -1 ELSE p_partkey - 1 END AS anchor FROM part)
    SELECT w.p_partkey, w.anchor, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN w.anchor = w.p_partkey THEN 'itself' WHEN b.anchor = w.p_partkey THEN 'cycle' ELSE 'set' END AS outcome FROM w LEFT JOIN p b ON b.p_partkey = w.anchor""")
def anchor_passes(t):
    key = F.col("p_partkey")
    promises = t("part").select("p_partkey", F.when(key % 2 == 0, key + 1).alias("anchor"))
    wanted = t("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, key).when(F.col("p_size") % 5 == 1, F.lit(-1)).otherwise(key - 1).alias("anchor"))
    return reviews.anchor_outcomes(wanted, promises, "p_partkey", "anchor")


@query("""SELECT o_orderdate::DATE::VARCHAR AS day, count(*) || ' quotes swapped, ' || sum(o_totalprice::DECIMAL(18,2)) AS note FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
def correction_records(t):
    rows = t("orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return reviews.batch_note(rows, "day", F.col("amount"), "quotes swapped")


_OUTCOMES = {"no row": "l_tax = 0", "sign differs": "l_discount > 0.08", "too small": "l_quantity < 5", "carries": "l_returnflag = 'A'", "carries in part": "l_returnflag = 'R' AND l_quantity > 30", "revenue": "l_linestatus = 'F' AND l_quantity > 20"}


@query(f"SELECT l_orderkey, l_linenumber, CASE {' '.join(f'''WHEN {v} THEN '{k}' ''' for k, v in _OUTCOMES.items())} ELSE 'open' END AS outcome FROM lineitem")
def carrier_decisions(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", reviews.decided([(k, F.expr(v)) for k, v in _OUTCOMES.items()], "open").alias("outcome"))


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events WHERE value > 5 GROUP BY ALL""")
def current_stances(t):
    rows = t("events").select("user_id", "event_type", "value", "ts", "event_id")
    return reviews.current_statements(rows, ["user_id", "event_type"], F.struct("ts", "event_id"), F.col("value") > 5).select("user_id", "event_type", "value", "ts")


@query("""WITH e AS (SELECT *, value > 10 AS s, event_type = 'click' AS c FROM events), p AS (SELECT *, lag(s) OVER w AS ps, lag(c) OVER w AS pc, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN k = 1 THEN 'first' WHEN ps IS DISTINCT FROM s THEN 'flip' WHEN pc IS DISTINCT FROM c THEN 'condition' ELSE 'same' END AS kind FROM p""")
def stance_changes(t):
    rows = t("events").withColumns({"stance": F.col("value") > 10, "condition": F.col("event_type") == "click"})
    return reviews.change_kinds(rows, ["user_id"], ["ts", "event_id"], "stance", "condition").select("event_id", "kind")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice > 100000 THEN 'amount' END, CASE WHEN NOT o_orderpriority <> '5-LOW' THEN 'source' END], lambda x: x IS NOT NULL), ',') AS faults FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderpriority <> '5-LOW')
    UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> '5-LOW'""")
def approvals(t):
    good, bad = reviews.approved(t("orders"), {"amount": F.col("o_totalprice") > 100000, "source": F.col("o_orderpriority") != "5-LOW"})
    return good.select("o_orderkey", F.lit("").alias("faults")).unionByName(bad.select("o_orderkey", F.array_join("faults", ",").alias("faults")))


@query("""WITH q AS (SELECT p_partkey FROM part WHERE p_size > 10), r AS (SELECT p_partkey, p_type AS reason FROM part WHERE p_size % 4 = 0), m AS (SELECT p_partkey, p_name AS reason FROM part WHERE p_size = 12)
    SELECT 'queue' AS kind, p_partkey, NULL AS reason FROM q WHERE p_partkey NOT IN (SELECT p_partkey FROM r)
    UNION ALL SELECT 'memory', * FROM m UNION ALL SELECT 'memory', * FROM r WHERE p_partkey IN (SELECT * FROM q) AND p_partkey NOT IN (SELECT p_partkey FROM m)""")
def rejections(t):
    p = t("part")
    queue, memory = reviews.rejected(p.where("p_size > 10").select("p_partkey"), p.where("p_size = 12").select("p_partkey", F.col("p_name").alias("reason")), p.where("p_size % 4 = 0").select("p_partkey", F.col("p_type").alias("reason")), "p_partkey")
    kinds = queue.select(F.lit("queue").alias("kind"), "p_partkey", F.lit(None).cast("string").alias("reason"))
    return kinds.unionByName(memory.select(F.lit("memory").alias("kind"), "p_partkey", "reason"))


@query("""SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N' AND (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N')""")
def untested_pairs(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return reviews.untested(rows.where("l_returnflag = 'N'").select("l_orderkey", "l_partkey").distinct(), rows.where("l_returnflag <> 'N'"), ["l_orderkey", "l_partkey"])


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no time' WHEN p_size % 2 = 0 AND contains(p_name, 'ring') THEN 'public' WHEN contains(p_type, 'ring') OR contains(p_brand || ' ' || p_name, 'ring') THEN 'held' ELSE 'not found' END AS outcome FROM part""")
def spoken_sources(t):
    seconds = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    outcome = reviews.spoken_outcome(seconds, F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.concat_ws(" ", "p_brand", "p_name"), F.lit("ring"))
    return t("part").select("p_partkey", outcome.alias("outcome"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS day, date_diff('day', CASE WHEN o_orderkey % 3 = 0 THEN DATE '1999-12-31' ELSE o_orderdate::DATE END, DATE '2026-08-01') ::INT AS age FROM orders""")
def page_ages(t):
    sep = F.when(F.col("o_orderkey") % 2 == 0, "/").otherwise("-")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, "2024-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    url = F.concat(F.lit("https://x.example/news/"), F.regexp_replace(stamp, "-", "#"), F.lit("/a"))
    url = F.when(sep == "/", F.replace(url, F.lit("#"), F.lit("/"))).otherwise(F.replace(url, F.lit("#"), F.lit("-")))
    day = reviews.date_in_address(url)
    return t("orders").select("o_orderkey", day.cast("string").alias("day"), reviews.page_age(F.lit("2026-08-01").cast("date"), day, F.lit("1999-12-31").cast("date")).alias("age"))


def _page_of_rows(t, kind: str):
    """An order's line items as the rows of an HTML table."""
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    amount = F.when(F.col("l_linenumber") == 1, "±0").otherwise(F.concat(F.when(F.col("l_tax") > 0.04, "−").otherwise(""), money.grouped(F.floor("l_extendedprice"), " ")))
    first = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), (F.col("l_suppkey") % 100).cast("string")) if kind == "appropriation" else F.concat((F.col("l_suppkey") % 9000 + 1000).cast("string"), F.lit(" name"))
    row = F.concat(F.lit("<tr>"), cell(first), cell(F.lit("12")), cell(F.concat(F.lit("Row&nbsp;&amp; <b>bo­"), F.col("l_partkey").cast("string"), F.lit("</b>"))), cell(amount), cell(F.lit("1")), F.lit("</tr>"))
    rows = t("lineitem").select("l_orderkey", row.alias("row")).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("row")), "").alias("rows"))
    head = "<tr><th>Inkomsttitel</th><th>x</th><th>Regeringens förslag</th><th>Avvikelse</th><th>y</th></tr><tr><td>Total</td><td>5</td></tr>"
    return rows.select("l_orderkey", F.concat(F.lit(f"<p><table class='a'>{head}"), "rows", F.lit("</table><table><tr><td>1:1</td><td>no header</td></tr></table>")).alias("html"))


_AMOUNT = "CASE WHEN l_linenumber = 1 THEN 0 ELSE CASE WHEN l_tax > 0.04 THEN -1 ELSE 1 END * floor(l_extendedprice) END::DOUBLE"


@query(f"""SELECT l_orderkey, l_linenumber || ':' || (l_suppkey % 100) AS key, 'Row & bo' || l_partkey AS name, {_AMOUNT} AS amount FROM lineitem""")
def appropriation_rows(t):
    return tables.keyed_rows(_page_of_rows(t, "appropriation"), "l_orderkey", F.col("html"), "^[0-9]{1,2}:[0-9]{1,2}", "avvikelse")


@query(f"""SELECT l_orderkey, (l_suppkey % 9000 + 1000) || ' name' AS key, 'Row & bo' || l_partkey AS name, {_AMOUNT} AS amount FROM lineitem""")
def revenue_rows(t):
    return tables.keyed_rows(_page_of_rows(t, "revenue"), "l_orderkey", F.col("html"), "^[0-9]{4} ", "avvikelse", ("inkomsttitel", "regeringens förslag"))


@query("""SELECT l_partkey, arg_max(l_returnflag, (l_suppkey, l_orderkey, l_returnflag)) AS value FROM lineitem GROUP BY l_partkey""")
def shards_merged(t):
    rows = t("lineitem").select("l_partkey", F.col("l_returnflag").alias("value"), F.struct("l_suppkey", "l_orderkey", "l_returnflag").alias("file"))
    return tables.merged_shards(rows, "l_partkey", "value", "file")


@query("""SELECT p_partkey FROM part WHERE NOT coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END, false)""")
def unarchived_rows(t):
    return tables.unarchived(t("part").withColumn("archived", F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3 == 1))).select("p_partkey")
