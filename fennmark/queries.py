"""The library's own operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch_queries, claim_queries, import_queries, index_queries, label_queries, link_queries, matching_queries, money_queries, page_queries, promise_queries, review_queries, stance_queries, state_queries, statement_queries, text_queries  # noqa: F401  (register their queries)
from .functions import amounts
from .functions.text import NOT_KEPT
from .operators import gates, history, links, mutations, policy, search, votes
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .streaming import seen


def _orders_by_nation(t) -> DataFrame:
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))


_ORDERS_BY_NATION = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("""SELECT o_orderkey, round((CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) * o_totalprice
    * (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 4 ELSE 1 END), 2) AS net FROM orders""")
def term_total(t):
    total = policy.term_total(F.col("o_totalprice"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return t("orders").select("o_orderkey", F.round(policy.signed(total, F.col("o_orderstatus") == "F"), 2).alias("net"))


@query("""SELECT l_orderkey, l_extendedprice, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER
    (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1""")
def policy_representative(t):
    return policy.representatives(t("lineitem").select("l_orderkey", "l_extendedprice", "l_partkey", "l_suppkey"), ["l_orderkey"], "l_extendedprice", ["l_partkey", "l_suppkey"])


@query(f"""SELECT n_name, sum(m)::DOUBLE AS total, count(*) AS policies FROM (SELECT n_name, o_custkey, max(o_totalprice)::DECIMAL(18,2) AS m
    FROM {_ORDERS_BY_NATION} GROUP BY ALL) GROUP BY n_name""")
def policy_totals_by_party(t):
    one = policy.representatives(_orders_by_nation(t).select("n_name", "o_custkey", "o_totalprice", "o_orderkey"), ["n_name", "o_custkey"], "o_totalprice", ["o_orderkey"])
    return one.groupBy("n_name").agg(policy.money_sum(F.col("o_totalprice")).alias("total"), F.count("*").alias("policies"))


@query("""WITH r AS (SELECT arg_max(o_orderstatus, (o_totalprice, -o_orderkey)) AS s, max(o_totalprice)::DECIMAL(18,2) AS m FROM orders GROUP BY o_custkey)
    SELECT coalesce(sum(m) FILTER (s = 'O'), 0)::DOUBLE AS gross, coalesce(sum(m) FILTER (s = 'F'), 0)::DOUBLE AS saving,
    (coalesce(sum(m) FILTER (s = 'O'), 0) - coalesce(sum(m) FILTER (s = 'F'), 0))::DOUBLE AS gap FROM r""")
def gross_saving_gap(t):
    one = policy.representatives(t("orders").select("o_custkey", "o_totalprice", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_totalprice", ["o_orderkey"])
    part = lambda s: policy.money_sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return one.agg(part("O").alias("gross"), part("F").alias("saving")).withColumn("gap", (F.col("gross").cast("decimal(28,2)") - F.col("saving").cast("decimal(28,2)")).cast("double"))


@query("""WITH x AS (SELECT l_extendedprice AS b, l_extendedprice * 0.8::DOUBLE AS a, l_extendedprice * 1.2::DOUBLE AS c FROM lineitem),
    v AS (SELECT b, greatest(0, (a*a + b*b + c*c - a*b - a*c - b*c) / 18) AS v FROM x),
    s AS (SELECT sum(b::DECIMAL(18,2))::DOUBLE AS base, sqrt(0.7::DOUBLE * sum(v) + 0.3::DOUBLE * sum(sqrt(v)) * sum(sqrt(v))) AS sd FROM v)
    SELECT base, round(greatest(0, base - 1.2816::DOUBLE * sd), 0) AS low, round(base + 1.2816::DOUBLE * sd, 0) AS high FROM s""")
def interval_total(t):
    p = F.col("l_extendedprice")
    return policy.interval(t("lineitem"), p * 0.8, p, p * 1.2).select("base", F.round("low", 0).alias("low"), F.round("high", 0).alias("high"))


@query("""SELECT p_type, sum(m)::DOUBLE AS total, count(*) AS n FROM (SELECT p_type, p_brand, max(p_retailprice)::DECIMAL(18,2) AS m FROM part GROUP BY ALL) GROUP BY p_type""")
def category_breakdown(t):
    one = policy.representatives(t("part").select("p_type", "p_brand", "p_retailprice", "p_partkey"), ["p_type", "p_brand"], "p_retailprice", ["p_partkey"])
    return one.groupBy("p_type").agg(policy.money_sum(F.col("p_retailprice")).alias("total"), F.count("*").alias("n"))


@query(f"""SELECT n_regionkey, o_orderpriority, min(o_totalprice) AS least, max(o_totalprice) AS most,
    string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS parties FROM {_ORDERS_BY_NATION} GROUP BY ALL HAVING min(o_totalprice) <> max(o_totalprice)""")
def coalition_group_notes(t):
    out = _orders_by_nation(t).groupBy("n_regionkey", "o_orderpriority").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("parties"))
    return out.where("least <> most")


@query("""WITH x AS (SELECT s_nationkey, l_suppkey, l_shipdate, l_extendedprice::DECIMAL(18,2) AS p, row_number() OVER (PARTITION BY s_nationkey ORDER BY l_extendedprice DESC) AS k
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT s_nationkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_sources, max(l_shipdate) AS latest,
    round(sum(p) FILTER (k <= 3)::DOUBLE / sum(p)::DOUBLE, 6) AS top_share FROM x GROUP BY s_nationkey""")
def party_coverage(t):
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return policy.coverage(rows.select("s_nationkey", "l_suppkey", "l_shipdate", "l_extendedprice"), "s_nationkey", "l_suppkey", "l_shipdate", "l_extendedprice")


@query(f"""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS carrier, max(o_totalprice) AS total,
    string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS parties, count(*) AS size, count(DISTINCT o_orderpriority) > 1 AS shared FROM orders GROUP BY o_custkey""")
def grouped_policies(t):
    return policy.grouped(t("orders"), "o_custkey", "o_totalprice", "o_orderkey", "o_orderpriority")


_KINDS = {"yes": "A", "no": "N", "abstained": "R"}
_TALLY = """(SELECT l_orderkey, s_nationkey, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'N') AS no,
    count(*) FILTER (l_returnflag = 'R') AS abstained FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _tally(t) -> DataFrame:
    return votes.tally(t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")), "l_orderkey", "s_nationkey", "l_returnflag", _KINDS)


@query(f"SELECT * FROM {_TALLY}")
def vote_tally(t):
    return _tally(t)


@query(f"""SELECT l_orderkey, s_nationkey, CASE WHEN yes > no AND yes > abstained THEN 'yes' WHEN no > yes AND no > abstained THEN 'no'
    WHEN abstained > yes AND abstained > no THEN 'abstained' END AS line FROM {_TALLY}""")
def party_line(t):
    return _tally(t).select("l_orderkey", "s_nationkey", votes.strict_line(*map(F.col, _KINDS)).alias("line"))


@query(f"""SELECT l_orderkey, s_nationkey, CASE WHEN yes >= no AND yes >= abstained THEN 'yes' WHEN no >= abstained THEN 'no' ELSE 'abstained' END AS line FROM {_TALLY}""")
def party_stance(t):
    return _tally(t).select("l_orderkey", "s_nationkey", votes.shown_line(*map(F.col, _KINDS)).alias("line"))


@query("""SELECT p_brand, s_nationkey, count(*) FILTER (l_returnflag = 'A') AS in_line, count(*) FILTER (l_returnflag = 'N') AS against,
    CASE WHEN in_line > 0 AND against > 0 THEN 'both' WHEN in_line > 0 THEN 'in_line' WHEN against > 0 THEN 'against' ELSE 'none' END AS status
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def verdicts(t):
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return votes.tally(rows, "p_brand", "s_nationkey", "l_returnflag", {"in_line": "A", "against": "N"}).withColumn("status", votes.verdict(F.col("in_line"), F.col("against")))


def _register(t) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") + 1).alias("place"))


@query(f"""WITH c AS (SELECT l_orderkey, s_nationkey, min(l_returnflag) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    o AS (SELECT DISTINCT l_orderkey FROM c)
    SELECT o.l_orderkey, string_agg(coalesce(c, '-'), '' ORDER BY n_nationkey) AS roster FROM o CROSS JOIN nation LEFT JOIN c ON c.l_orderkey = o.l_orderkey AND s_nationkey = n_nationkey GROUP BY ALL""")
def roster_pack(t):
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return votes.pack_roster(rows, "l_orderkey", "s_nationkey", "l_returnflag", _register(t))


@query("SELECT l_orderkey, s_nationkey, min(l_returnflag) AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def roster_unpack(t):
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return votes.unpack_roster(votes.pack_roster(rows, "l_orderkey", "s_nationkey", "l_returnflag", _register(t)), "l_orderkey", "roster", _register(t), "s_nationkey")


@query("""SELECT u.user_id, k.event_type, coalesce(m, 'no clear position') AS latest FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) k
    LEFT JOIN (SELECT user_id, event_type, CASE WHEN count(*) > 2 THEN 'often' ELSE 'seldom' END AS m FROM events GROUP BY ALL) e ON e.user_id = u.user_id AND e.event_type = k.event_type""")
def stance_grid(t):
    cells = t("events").groupBy("user_id", "event_type").agg(F.when(F.count("*") > 2, "often").otherwise("seldom").alias("latest"))
    return votes.grid(t("events").select("user_id").distinct(), t("events").select("event_type").distinct(), cells, ["user_id", "event_type"], "latest", "no clear position")


@query("""WITH k AS (SELECT md5(text) AS key, doc_id FROM documents) SELECT key, min(doc_id) AS doc_id FROM k WHERE doc_id % 2 = 1 AND key NOT IN (SELECT key FROM k WHERE doc_id % 2 = 0) GROUP BY key""")
def anti_seen(t):
    docs = t("documents").select("doc_id", "text")
    seen = docs.where("doc_id % 2 = 0").select(F.md5("text").alias("key"))
    return history.unseen(docs.where("doc_id % 2 = 1"), seen, F.md5("text"), "doc_id")


@query("""SELECT l_orderkey, CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE 'withdrawn' END AS why, count(*) AS n FROM lineitem
    LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL OR o_orderstatus = 'F' GROUP BY ALL""")
def homeless_links(t):
    targets = t("orders").where("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderstatus")
    joined = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).join(targets, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    why = F.when(F.col("o_orderkey").isNull(), "missing").when(F.col("o_orderstatus") == "F", "withdrawn")
    return joined.select("l_orderkey", why.alias("why"), "n").where("why IS NOT NULL")


@query("""WITH o AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey, p_name, p_size + (p_partkey % 3 = 0)::INT AS p_size FROM part WHERE p_partkey % 7 <> 0)
    SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN 'missing' WHEN o.p_partkey IS NULL THEN 'left_over' ELSE 'changed' END AS kind
    FROM o FULL JOIN n ON o.p_partkey = n.p_partkey WHERE n.p_partkey IS NULL OR o.p_partkey IS NULL OR o.p_size <> n.p_size""")
def copy_diff(t):
    part = t("part").select("p_partkey", "p_name", "p_size")
    new = part.where("p_partkey % 7 <> 0").withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 3 == 0).cast("int"))
    return history.copy_difference(part.where("p_partkey % 5 <> 0"), new, "p_partkey", ["p_name", "p_size"])


@query("""SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, p_retailprice + 1 FROM part WHERE p_partkey % 2 = 0""")
def upsert_last(t):
    part = t("part").select("p_partkey", "p_retailprice")
    return history.upsert(part, part.where("p_partkey % 2 = 0").withColumn("p_retailprice", F.col("p_retailprice") + 1), "p_partkey")


@query("""SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_retailprice + 1 FROM part WHERE p_partkey % 3 = 0""")
def insert_first(t):
    part = t("part").select("p_partkey", "p_retailprice")
    return history.insert_new(part.where("p_partkey % 3 <> 0"), part.withColumn("p_retailprice", F.col("p_retailprice") + 1), "p_partkey")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (true) * 0 + arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def rejection_memory(t):
    return history.latest(t("events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_type", "event_id")


@query("""SELECT event_id, user_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type""")
def change_view(t):
    return history.changes(t("events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "before", "event_type")


@query("""SELECT user_id, event_type, min(ts) AS first, max(ts) AS latest, count(*) AS attempts,
    floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(ts)))::DOUBLE / 86400000000) > 14 AS overdue FROM events GROUP BY ALL""")
def retry_state(t):
    return history.retry_state(t("events"), ["user_id", "event_type"], "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 14)


@query("""SELECT isoyear(ts) AS year, week(ts) AS week, count(*) AS n FROM events GROUP BY ALL""")
def iso_week_added(t):
    return t("events").groupBy(F.extract(F.lit("YEAROFWEEK"), "ts").cast("bigint").alias("year"), F.weekofyear("ts").cast("bigint").alias("week")).agg(F.count("*").alias("n"))


@query("""SELECT gate, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT length(text) >= 200 THEN 'short' END, CASE WHEN NOT lang IN ('en', 'de') THEN 'language' END,
    CASE WHEN NOT contains(text, ' ') THEN 'one_word' END], lambda x: x IS NOT NULL)) AS gate FROM documents) GROUP BY gate""")
def gate_failures(t):
    text = F.col("text")
    failed = gates.failures({"short": F.char_length(text) >= 200, "language": F.col("lang").isin("en", "de"), "one_word": F.contains(text, F.lit(" "))})
    return t("documents").select(F.explode(failed).alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, group_size FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS group_size FROM documents) WHERE group_size > 45")
def bomb_guard(t):
    return gates.crowded(t("documents").select("doc_id", "source"), "source", 45).select("doc_id", "source", "group_size")


@query("""SELECT page_id, CASE WHEN h <> '' THEN regexp_replace(regexp_replace(h, '\\.$', ''), '^www\\.', '') END AS host
    FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages)""")
def page_hosts(t):
    return t("pages").select("page_id", gates.host(F.col("url")).alias("host"))


@query("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def page_links(t):
    return gates.page_links(t("pages"), "page_id", "html")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'),
    '<[^>]*>', ' ', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text FROM pages""")
def html_text(t):
    return t("pages").select("page_id", gates.html_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN 'amount' WHEN regexp_matches(text, '[?]') THEN 'question' ELSE 'substance' END AS class FROM documents""")
def claim_class(t):
    return t("documents").select("doc_id", gates.first_class(F.col("text"), {"amount": "[0-9]{4,}", "question": "[?]"}, "substance").alias("class"))


_TERMS = f"(SELECT doc_id, source, unnest(regexp_extract_all(lower(nfc_normalize(text)), '{NOT_KEPT.replace('[^', '[')}+')) AS term FROM documents)"


@query(f"""SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank
    FROM (SELECT doc_id, term, count(*) AS n FROM {_TERMS} WHERE length(term) >= 4 GROUP BY ALL)) WHERE rank <= 40""")
def top_terms(t):
    return search.top_terms(search.term_counts(t("documents"), "doc_id", "text"), "doc_id", 40)


@query(f"""SELECT term, count(*) AS n_docs, array_to_string(list_slice(list(doc_id ORDER BY doc_id DESC), 1, 300), ',') AS ids
    FROM (SELECT DISTINCT doc_id, term FROM {_TERMS} WHERE length(term) >= 4) GROUP BY term""")
def postings_capped(t):
    return search.capped_postings(t("documents").select("doc_id", F.explode(search.words(F.col("text"))).alias("term")), "term", "doc_id", 300)


@query(f"""SELECT doc_id FROM {_TERMS} WHERE term IN ('with', 'avec', 'that') GROUP BY doc_id HAVING bool_or(term IN ('with', 'avec')) AND bool_or(term = 'that') ORDER BY doc_id DESC LIMIT 60""")
def search_and_or(t):
    question = [["with", "avec"], ["that"]]
    asked = F.array_intersect(search.words(F.col("text")), F.array(*[F.lit(x) for word in question for x in word]))
    return search.search(t("documents").select("doc_id", F.explode(asked).alias("term")), "doc_id", "term", question, 60)


@query(f"""WITH c AS (SELECT source, term, count(*) AS n FROM {_TERMS} WHERE length(term) >= 4 GROUP BY ALL),
    x AS (SELECT source, term, n, sum(n) OVER (PARTITION BY source) AS o, sum(n) OVER (PARTITION BY term) AS a, sum(n) OVER () AS g FROM c),
    s AS (SELECT source, term, n, round((n / o::DOUBLE) / ((a - n + 1)::DOUBLE / (g - o + 1)::DOUBLE), 6) AS lift FROM x WHERE n >= 5)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lift DESC, term) AS rank FROM s) WHERE rank <= 18""")
def distinctive_words(t):
    counts = search.term_counts(t("documents"), "source", "text")
    return search.distinctive(counts, "source", "term", 5, 18)


@query("""SELECT p_type, s[len(s) // 2 + 1] AS upper_median FROM (SELECT p_type, list(p_size ORDER BY p_size) AS s FROM part GROUP BY p_type)""")
def upper_median(t):
    counts = t("part").groupBy("p_type", "p_size").agg(F.count("*").alias("n"))
    sizes = F.array_sort(F.collect_list(F.struct("p_size", "n")))
    walk = lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.when((a["left"] >= 0) & (a["left"] < x["n"]), x["p_size"]).otherwise(a["at"]).alias("at"))
    half = F.floor(F.sum("n") / 2)
    out = counts.groupBy("p_type").agg(sizes.alias("s"), half.alias("half"))
    return out.select("p_type", F.aggregate("s", F.struct(F.col("half").alias("left"), F.lit(None).cast("int").alias("at")), walk, lambda a: a["at"]).alias("upper_median"))


@query("""SELECT doc_id, substr(sha256('{"doc_id":' || coalesce(doc_id::VARCHAR, 'null') || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}'), 1, 12) AS key FROM documents""")
def canonical_hash(t):
    return t("documents").select("doc_id", F.substring(F.sha2(history.canonical_json("doc_id", "lang", "source"), 256), 1, 12).alias("key"))


@query("SELECT l_partkey, bit_or(1::BIGINT << s_nationkey) AS mask FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey")
def party_mask(t):
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("l_partkey").agg(F.bit_or(F.expr("shiftleft(1L, s_nationkey)")).alias("mask"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) + length(event_type) AS turn FROM events""")
def interleave_order(t):
    ranked = links.ranks(t("events").select("event_id", "event_type", "value", F.floor(F.col("value") / 2).alias("part")), ["event_type"], "part", ["value", "event_id"])
    return ranked.select("event_id", (F.col("rank") + F.char_length("event_type")).alias("turn"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def seen_stream(t):
    frame = t("events")
    return seen.seen_keys(frame.sparkSession, t.path("events"), ["user_id", "event_type"])


@query("""SELECT doc_id, list_sum(list_transform(list_filter(regexp_split_to_array(text, '[^0-9A-Za-z]+'), lambda w: regexp_full_match(w, '[0-9]{1,9}')), lambda w: w::BIGINT))::BIGINT AS total,
    len(list_filter(regexp_split_to_array(text, '[^0-9A-Za-z]+'), lambda w: regexp_full_match(w, '[0-9]{1,9}'))) AS n FROM documents WHERE n > 0""")
def amounts_extract(t):
    found = t("documents").select("doc_id", amounts.numbers(F.col("text")).alias("x")).where(F.size("x") > 0)
    return found.select("doc_id", F.aggregate("x", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("x").cast("bigint").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 AND o_orderstatus <> 'F' AND length(o_orderpriority) * 4 >= 40 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def withdraw_validated(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    asked = t("orders").where("o_orderkey % 11 = 0").select("o_orderkey", F.repeat("o_orderpriority", F.lit(4)).alias("reason"))
    return mutations.withdraw(orders, asked, "o_orderkey", "o_orderstatus", "F")
