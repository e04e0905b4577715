"""More of the library's operators on the driver's tables: coalitions, members, likeness, search, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import amounts, stemming
from .functions.text import NOT_KEPT
from .operators import gates, history, links, matching, policy, search, votes
from .registry import query
from .stored import stored

_KINDS = {"yes": "A", "no": "N", "abstained": "R"}
_NATION_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_BALLOTS = "lineitem JOIN supplier ON l_suppkey = s_suppkey"


def _nation_orders(t) -> DataFrame:
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def _ballots(t) -> DataFrame:
    return t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))


def _words(t, table: str, row: str, name: str, word: str, least: int = 4) -> DataFrame:
    """Distinct pairs of row and lower-case word."""
    return t(table).select(F.col(row).alias(name), F.explode(search.words(F.col("text"), least)).alias(word))


_LETTERS = NOT_KEPT.replace("[^", "[")


def _words_sql(table: str, row: str, name: str, word: str, least: int = 4) -> str:
    return f"(SELECT DISTINCT * FROM (SELECT {row} AS {name}, unnest(regexp_extract_all(lower(nfc_normalize(text)), '{_LETTERS}+')) AS {word} FROM {table}) WHERE length({word}) >= {least})"


# Policies


@query(f"""WITH r AS (SELECT n_regionkey, o_custkey % 50 AS g, arg_max(o_orderstatus, (o_totalprice, -o_orderkey)) AS s, max(o_totalprice)::DECIMAL(18,2) AS m FROM {_NATION_ORDERS} GROUP BY ALL)
    SELECT n_regionkey, coalesce(sum(m) FILTER (s = 'O'), 0)::DOUBLE AS cost, coalesce(sum(m) FILTER (s = 'F'), 0)::DOUBLE AS saving, count(*) AS policies FROM r GROUP BY ALL""")
def coalition_totals(t):
    rows = _nation_orders(t).withColumn("g", F.col("o_custkey") % 50)
    return policy.coalition_totals(rows, "n_regionkey", "g", "o_totalprice", ["o_orderkey"], "o_orderstatus", {"cost": "O", "saving": "F"})


@query(f"SELECT n_nationkey, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE * 1000 / count(DISTINCT o_custkey), 4) AS per_vote FROM {_NATION_ORDERS} GROUP BY ALL")
def per_vote(t):
    sums = _nation_orders(t).groupBy("n_nationkey").agg(policy.money_sum(F.col("o_totalprice")).alias("total"), F.count_distinct("o_custkey").alias("votes"))
    return sums.select("n_nationkey", F.round(policy.per_vote(F.col("total"), F.col("votes")), 4).alias("per_vote"))


@query("""WITH l AS (SELECT p_partkey, p_retailprice, unnest(range(5)) AS pos, p_size % 5 + unnest(range(5)) AS constant FROM part),
    k AS (SELECT p_partkey, constant, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS place, round(p_retailprice / (r_regionkey + 7), 4) AS times FROM l JOIN region ON constant = r_regionkey AND r_regionkey > 0)
    SELECT * FROM k WHERE place <= 3""")
def comparisons_top3(t):
    parts = t("part").select("p_partkey", "p_retailprice", F.sequence(F.col("p_size") % 5, F.col("p_size") % 5 + 4).alias("ids"))
    units = t("region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("constant"), (F.col("r_regionkey") + 7).alias("unit"))
    return policy.comparisons(parts, "p_partkey", "p_retailprice", "ids", units)


@query("""SELECT l_partkey, l_linenumber, round(median, 6) AS median, l_quantity >= 3 * median OR l_quantity * 3 <= median AS off
    FROM (SELECT *, median(l_quantity) OVER (PARTITION BY l_linenumber) AS median FROM (SELECT l_partkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))""")
def median_deviation(t):
    rows = t("lineitem").groupBy("l_partkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return policy.deviating(rows, "l_partkey", "l_linenumber", "q").withColumn("median", F.round("median", 6))


@query("""WITH r AS (SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
    SELECT c AS cutoff, count(*) FILTER (rank <= c) AS within, count(*) FILTER (rank > c) AS beyond, round(count(*) FILTER (rank <= c) / count(*), 6) AS share
    FROM r, (SELECT unnest([1, 3, 5, 8, 20, 50]) AS c) GROUP BY c""")
def rank_histogram(t):
    priced = t("part").select("p_partkey", "p_brand", (-F.col("p_retailprice")).alias("price"), F.floor(-F.col("p_retailprice") / 100).alias("hundred"))
    ranks = links.ranks(priced, ["p_brand"], "hundred", ["price", "p_partkey"])
    return policy.shares_within(ranks, "rank", [1, 3, 5, 8, 20, 50])


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS withdrawn, count(DISTINCT o_custkey) AS sources, max(o_orderdate) AS latest,
    round(count(*) FILTER (o_totalprice > 100000) / count(*), 6) AS large_share FROM orders""")
def kpi_row(t):
    n = F.count("*")
    return t("orders").agg(
        n.alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("withdrawn"), F.count_distinct("o_custkey").alias("sources"),
        F.max("o_orderdate").alias("latest"), F.round(F.try_divide(F.count_if(F.col("o_totalprice") > 100000), n), 6).alias("large_share"),
    )


# Votes


@query(f"""WITH b AS (SELECT p_brand AS vote, s_nationkey, l_suppkey, l_returnflag AS o FROM {_BALLOTS} JOIN part ON l_partkey = p_partkey),
    y AS (SELECT vote, s_nationkey, count(*) FILTER (o = 'A') AS a, count(*) FILTER (o = 'N') AS n, count(*) FILTER (o = 'R') AS r FROM b GROUP BY ALL),
    l AS (SELECT vote, s_nationkey, CASE WHEN a > n AND a > r THEN 'A' WHEN n > a AND n > r THEN 'N' WHEN r > a AND r > n THEN 'R' END AS line FROM y),
    m AS (SELECT l_suppkey, s_nationkey, vote, min(o) AS own FROM b GROUP BY ALL HAVING min(o) <> 'R')
    SELECT l_suppkey, count(*) AS n_votes, count(*) FILTER (own <> line) AS n_deviating FROM m JOIN l USING (vote, s_nationkey) WHERE line IS NOT NULL GROUP BY ALL""")
def member_deviation(t):
    rows = _ballots(t).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return votes.deviations(rows, "l_suppkey", "s_nationkey", "p_brand", "l_returnflag", _KINDS, "R")


@query("""WITH r AS (SELECT DISTINCT l_suppkey, l_orderkey AS target, CASE l_returnflag WHEN 'A' THEN 'in_line' WHEN 'N' THEN 'against' ELSE 'other' END AS bucket, 'v' AS via FROM lineitem
    UNION ALL SELECT DISTINCT l_suppkey, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'in_line' ELSE 'against' END, 'a' FROM lineitem WHERE l_linenumber = 1)
    SELECT l_suppkey, count(*) FILTER (bucket = 'in_line') AS in_line, count(*) FILTER (bucket = 'against') AS against, count(*) FILTER (via = 'v') AS n_voted, count(*) FILTER (via = 'a') AS n_authored FROM r GROUP BY ALL""")
def member_merit(t):
    lines = t("lineitem")
    bucket = F.when(F.col("l_returnflag") == "A", "in_line").when(F.col("l_returnflag") == "N", "against").otherwise("other")
    voted = lines.select("l_suppkey", F.col("l_orderkey").alias("target"), bucket.alias("bucket"))
    authored = lines.where("l_linenumber = 1").select("l_suppkey", F.col("l_partkey").alias("target"), F.when(F.col("l_partkey") % 2 == 0, "in_line").otherwise("against").alias("bucket"))
    return votes.merits(voted, authored, "l_suppkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_mktsegment IS NULL OR c_mktsegment = '' THEN coalesce(n_name, '') ELSE c_mktsegment END AS party
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON c_nationkey = n_nationkey""")
def enrich_left(t):
    rows = t("customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "-").otherwise(F.col("c_mktsegment")).alias("party"))
    register = t("nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("known_party"))
    return votes.enrich(rows, register, "c_nationkey", "party").select("c_custkey", "party")


@query(f"""WITH y AS (SELECT l_orderkey, s_nationkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r
    FROM {_BALLOTS} JOIN part ON l_partkey = p_partkey AND contains(p_name, 'ring') GROUP BY ALL),
    l AS (SELECT s_nationkey, CASE WHEN a + n + r = 0 THEN NULL WHEN a >= n AND a >= r THEN 'yes' WHEN n >= r THEN 'no' ELSE 'abstained' END AS line FROM y)
    SELECT s_nationkey, count(*) FILTER (line = 'yes') AS yes, count(*) FILTER (line = 'no') AS no, count(*) FILTER (line = 'abstained') AS abstained FROM l GROUP BY ALL""")
def votes_on_topic(t):
    topic = t("part").where(F.contains("p_name", F.lit("ring"))).select("p_partkey")
    return votes.stances_on(_ballots(t).join(topic, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "s_nationkey", "l_returnflag", _KINDS)


# History


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) WHERE bad GROUP BY ALL")
def chronology_check(t):
    return history.out_of_order(t("events"), "user_id", "event_id", "value")


@query("""WITH d AS (SELECT doc_id, source || '::' || substr(text, 1, 12) AS title, regexp_replace(lower(nfc_normalize(text)), '[^a-z0-9åäöéèü]', '', 'g') AS quote FROM documents),
    done AS (SELECT * FROM d WHERE doc_id % 2 = 0 OR doc_id % 5 = 0)
    SELECT doc_id FROM d WHERE doc_id % 2 = 1 AND doc_id % 5 <> 0 AND title NOT IN (SELECT title FROM done) AND NOT (length(quote) >= 30 AND quote IN (SELECT quote FROM done WHERE length(quote) >= 30))""")
def resolved_anti(t):
    docs = t("documents").select("doc_id", "source", "text")
    even, fifth = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0 AND doc_id % 5 = 0")
    title, quote = F.concat_ws("::", "source", F.substring("text", 1, 12)), gates.fingerprint(F.col("text"))
    return history.unresolved(docs.where("doc_id % 2 = 1 AND doc_id % 5 <> 0"), even, fifth, title, quote).select("doc_id")


@query("""WITH p AS (SELECT p_partkey, (p_size % 7 + 1)::INT AS a, (p_size % 7 + 3)::INT AS b, p_size::INT AS c FROM part),
    k AS (SELECT DISTINCT p_partkey, unnest(list_concat(range(a, b + 1), [c])) AS claim FROM p)
    SELECT p_partkey, claim, count(*) AS n FROM k JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = claim GROUP BY ALL""")
def rejected_lineage(t):
    text = F.concat((F.col("p_size") % 7 + 1).cast("string"), F.lit("-"), (F.col("p_size") % 7 + 3).cast("string"), F.lit(", "), F.col("p_size").cast("string"))
    claims = t("part").select("p_partkey", F.explode(F.transform(amounts.claim_numbers(text), lambda k: k.cast("bigint"))).alias("claim"))
    lines = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").cast("bigint").alias("claim"))
    claims, lines = links.dealt_by_key((claims, "p_partkey"), (lines, "p_partkey"), rows=t("lineitem").count())
    return claims.join(lines.groupBy("p_partkey", "claim").agg(F.count("*").alias("n")), ["p_partkey", "claim"])


# Likeness


@query("""WITH p AS (SELECT p_partkey, p_type, p_brand, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM part),
    l AS (SELECT DISTINCT p_type, p_brand, w FROM p), r AS (SELECT p_type, p_brand, w, max(p_partkey) AS other FROM p GROUP BY ALL),
    x AS (SELECT l.*, other, round(len(list_intersect(l.w, r.w))::DOUBLE / len(list_distinct(l.w || r.w)), 6) AS likeness FROM l JOIN r ON l.p_type = r.p_type AND l.p_brand <> r.p_brand),
    b AS (SELECT p_type, p_brand, w, arg_max(other, (likeness, other)) AS other, max(likeness) AS likeness FROM x WHERE likeness >= 0.35 GROUP BY ALL)
    SELECT p_partkey AS part, other, likeness FROM p JOIN b USING (p_type, p_brand, w)""")
def cross_party_dup(t):
    part = t("part").select("p_partkey", "p_type", "p_brand", F.split("p_name", " ").alias("w"))
    return search.best_match(part.withColumnRenamed("p_partkey", "part"), part.withColumnRenamed("p_partkey", "other"), ["p_type"], "part", "other", "w", 0.35, apart="p_brand")


@query("""WITH a AS (SELECT doc_id, regexp_replace(lower(nfc_normalize(text)), '[^a-z0-9åäöéèü]', '', 'g') AS f FROM documents), b AS (SELECT item_id, regexp_replace(lower(nfc_normalize(text)), '[^a-z0-9åäöéèü]', '', 'g') AS f FROM benchmark)
    SELECT doc_id, min(item_id) AS item_id FROM a JOIN b ON length(a.f) >= 30 AND length(b.f) >= 30 AND length(a.f) <= 2 * length(b.f)
    AND length(b.f) <= 2 * length(a.f) AND (contains(a.f, b.f) OR contains(b.f, a.f)) GROUP BY doc_id""")
def quote_dup(t):
    found = matching.quote_duplicates(t("documents").select(F.col("doc_id").alias("left"), "text"), t("benchmark").select(F.col("item_id").alias("right"), "text"))
    return found.select(F.col("left").alias("doc_id"), F.col("right").alias("item_id"))


_TOKENS_SQL = """(SELECT DISTINCT doc_id, lang, kind, token FROM (SELECT doc_id, lang, 'pair' AS kind, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS token
    FROM (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4) AS w FROM documents)
    UNION ALL SELECT doc_id, lang, 'number', unnest(regexp_extract_all(lower(text), '[0-9]+ [a-z]{3,6}')) FROM documents))"""


def _policy_tokens(t) -> DataFrame:
    """doc_id, lang, kind, token. A text's words are found once: an expression within `bigrams` would be read anew for each use."""
    docs = t("documents").select("doc_id", "lang", F.lower("text").alias("low"))
    found = lambda pattern: F.array_distinct(F.regexp_extract_all("low", F.lit(f"({pattern})"), 1))
    words = docs.select("doc_id", "lang", F.regexp_extract_all("low", F.lit("([a-z]{4,})"), 1).alias("words"))
    pairs = words.select("doc_id", "lang", F.lit("pair").alias("kind"), F.explode(matching.bigrams(F.col("words"))).alias("token"))
    return pairs.unionByName(docs.select("doc_id", "lang", F.lit("number").alias("kind"), F.explode(found("[0-9]+ [a-z]{3,6}")).alias("token")))


@query(f"""WITH t AS {_TOKENS_SQL}, e AS (SELECT *, count(*) OVER (PARTITION BY kind, token) AS df FROM t),
    x AS (SELECT c.doc_id AS candidate, e.doc_id AS existing, sum(CASE e.kind WHEN 'number' THEN 3 ELSE 2 END)::BIGINT AS score FROM t c JOIN e USING (lang, kind, token)
    WHERE c.doc_id <> e.doc_id AND df - 1 <= CASE e.kind WHEN 'number' THEN 3 ELSE 2 END GROUP BY ALL HAVING sum(CASE e.kind WHEN 'number' THEN 3 ELSE 2 END) >= 3)
    SELECT candidate, arg_max(existing, (score, -existing)) AS existing, max(score) AS score FROM x GROUP BY candidate""")
def policy_dup(t):
    tokens = _policy_tokens(t)
    return matching.shared_weight(tokens.withColumnRenamed("doc_id", "candidate"), tokens.withColumnRenamed("doc_id", "existing"), ["lang"], {"number": (3, 3), "pair": (2, 2)}, 3, itself=True)


@query("""WITH p AS (SELECT p_partkey, p_type, list_distinct(string_split(p_name, ' ')) AS w FROM part),
    x AS (SELECT a.p_partkey, b.p_partkey AS other, list_intersect(a.w, b.w) AS i, len(list_distinct(a.w || b.w)) AS u FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey),
    s AS (SELECT p_partkey, other, round(len(i)::DOUBLE / u + CASE WHEN len(list_filter(i, lambda w: length(w) >= 6)) > 0 THEN 0.5 ELSE 0 END, 6) AS score FROM x)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 5""")
def comparables_topk(t):
    return matching.comparables(t("part").select("p_partkey", "p_type", F.split("p_name", " ").alias("w")), "p_type", "p_partkey", "w", 5, long=6)


_RARE = 25


@query(f"""WITH w AS {_words_sql("documents", "doc_id", "id", "word")}, r AS (SELECT id, word FROM (SELECT *, count(*) OVER (PARTITION BY word) AS df FROM w WHERE length(word) >= 7) WHERE df <= {_RARE}),
    p AS (SELECT DISTINCT a.id AS "left", b.id AS "right" FROM r a JOIN r b USING (word) JOIN documents x ON a.id = x.doc_id JOIN documents y ON b.id = y.doc_id
        WHERE x.lang = y.lang AND x.source <> y.source),
    n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
    s AS (SELECT p."left", p."right", count(*) AS shared FROM p JOIN w a ON a.id = p."left" JOIN w b ON b.id = p."right" AND a.word = b.word GROUP BY ALL),
    l AS (SELECT s."left", s."right", round(shared::DOUBLE / (x.n + y.n - shared), 6) AS likeness FROM s JOIN n x ON x.id = s."left" JOIN n y ON y.id = s."right")
    SELECT "left", arg_max("right", (likeness, -"right")) AS "right", max(likeness) AS likeness FROM l WHERE likeness >= 0.25 GROUP BY "left" """)
def parity_best_match(t):
    docs = stored(t("documents").select(F.col("doc_id").alias("id"), "lang", "source", search.words(F.col("text")).alias("words")), "words")  # they are read four times
    long = docs.select("id", "lang", "source", F.size("words").alias("n"), F.explode(F.filter("words", lambda w: F.char_length(w) >= 7)).alias("word"))
    rare = matching.rare_tokens(long, "id", "word", _RARE, "lang", "source", "n")
    return matching.parity(docs, docs, "lang", "source", rare, itself=True)


@query(f"""WITH a AS {_words_sql("benchmark", "item_id", "row", "word", 6)}, m AS (SELECT DISTINCT source AS "group", doc_id, w.word FROM {_words_sql("documents", "doc_id", "id", "word", 6)} w JOIN documents ON id = doc_id),
    g AS (SELECT "group", word FROM m GROUP BY ALL HAVING count(*) >= 2), x AS (SELECT row, "group", count(*) AS overlap FROM a JOIN g USING (word) GROUP BY ALL HAVING count(*) >= 3)
    SELECT row, "group", overlap, round(overlap::DOUBLE / least((SELECT count(*) FROM a WHERE a.row = x.row), (SELECT count(*) FROM g WHERE g."group" = x."group")), 6) AS score FROM x""")
def ungrouped_twins(t):
    members = t("documents").select(F.col("source").alias("group"), F.col("doc_id").alias("member"), F.explode(search.words(F.col("text"), 6)).alias("word"))
    return matching.twins(_words(t, "benchmark", "item_id", "row", "word", 6), members)


@query(f"""WITH a AS {_words_sql("benchmark", "item_id", "item_id", "word", 5)}, b AS (SELECT DISTINCT doc_id, substr(word, 1, 5) AS p FROM {_words_sql("documents", "doc_id", "doc_id", "word", 5)}),
    x AS (SELECT item_id, doc_id, count(*) AS overlap FROM a JOIN b ON substr(word, 1, 5) = p GROUP BY ALL)
    SELECT item_id, arg_max(doc_id, (overlap, -doc_id)) AS doc_id, max(overlap) AS overlap FROM x GROUP BY ALL""")
def prefix_overlap(t):
    docs = t("documents").select(F.col("doc_id").alias("right"), search.words(F.col("text"), 5).alias("words"))
    pairs = matching.prefix_overlap(_words(t, "benchmark", "item_id", "left", "word", 5), docs)
    best = pairs.groupBy("left").agg(F.max(F.struct("overlap", (-F.col("right")).alias("id"))).alias("b"))
    return best.select(F.col("left").alias("item_id"), (-F.col("b.id")).alias("doc_id"), F.col("b.overlap").alias("overlap"))


@query(f"""WITH q AS {_words_sql("benchmark", "item_id", "asked", "term")}, d AS {_words_sql("documents", "doc_id", "doc", "term")}, h AS (SELECT DISTINCT doc, term FROM
    (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(nfc_normalize(substr(text, 1, 80))), '{_LETTERS}+')) AS term FROM documents) WHERE length(term) >= 4),
    i AS (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS w FROM d GROUP BY term),
    x AS (SELECT asked, doc, w, 0 AS hit FROM q JOIN i USING (term) JOIN d USING (term) UNION ALL SELECT asked, doc, 0, 1 FROM q JOIN h USING (term)),
    s AS (SELECT asked, doc, sum(hit)::BIGINT AS hits, round(sum(w), 4) AS weight FROM x GROUP BY ALL)
    SELECT asked, doc, hits, score, rank FROM (SELECT *, round(weight + hits, 4) AS score, row_number() OVER (PARTITION BY asked ORDER BY round(weight + hits, 4) DESC, doc) AS rank FROM s WHERE hits >= 2 OR weight >= 9)
    WHERE rank <= 8""")
def ranked_candidates(t):
    terms = lambda text: t("documents").select(F.col("doc_id").alias("doc"), search.words(text).alias("terms"))
    return matching.ranked_candidates(_words(t, "benchmark", "item_id", "asked", "term"), terms(F.substring("text", 1, 80)), terms(F.col("text")), t("documents").count())


# Gates and search


@query("""WITH b AS (SELECT item_id, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, lower(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS t FROM documents)
    SELECT item_id AS quote, doc_id AS doc FROM b JOIN d ON contains(t, lower(q)) WHERE len(string_split(q, ' ')) BETWEEN 5 AND 40""")
def verbatim_gate(t):
    return matching.verbatim(t("benchmark").select(F.col("item_id").alias("quote"), "text"), t("documents").select(F.col("doc_id").alias("doc"), "text"))


_REASONS = {"number": "[0-9]{3,}", "question": "[?]", "list": "(^|\\n)- ", "shout": "[A-Z]{4,}"}


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN 'number' END, CASE WHEN regexp_matches(text, '[?]') THEN 'question' END,
    CASE WHEN regexp_matches(text, '(^|\\n)- ') THEN 'list' END, CASE WHEN regexp_matches(text, '[A-Z]{4,}') THEN 'shout' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def zero_reasons(t):
    return t("documents").select("doc_id", F.array_join(gates.all_classes(F.col("text"), _REASONS), ",").alias("reasons"))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') AND list_contains(string_split(p_type, ' '), 'PROMO')")
def facet_filter(t):
    return t("part").where(gates.has_facets({"p_name": "ring", "p_type": "PROMO"})).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'rin') AND contains(lower(p_name), 'hot') ORDER BY p_partkey LIMIT 12")
def autocomplete(t):
    return gates.suggestions(t("part"), "p_partkey", F.col("p_name"), "Rin hot")


_OWNERS = [("ththan.example.net", 1, "a"), ("example.net", 2, "b"), ("example.com", 3, "c")]


@query("""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS h FROM pages)
    SELECT page_id, CASE WHEN h = 'ththan.example.net' OR ends_with(h, '.ththan.example.net') THEN 'a' WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 'b' ELSE 'c' END AS owner
    FROM h WHERE h IN ('example.net', 'example.com') OR ends_with(h, '.example.net') OR ends_with(h, '.example.com')""")
def domain_suffix(t):
    pages = t("pages").select("page_id", gates.host(F.col("url")).alias("host"))
    owners = pages.sparkSession.createDataFrame(_OWNERS, "domain string, place int, owner string")
    return gates.owner_of_host(pages, "page_id", "host", owners)


@query("""WITH p AS (SELECT doc_id, text, instr(text, ' that ') AS k FROM documents), x AS (SELECT doc_id, k, substr(text, greatest(k - 120, 1), k - greatest(k - 120, 1)) AS b, substr(text, k + 6, 120) AS a FROM p)
    SELECT doc_id, CASE WHEN k > 0 THEN trim(regexp_extract(b, '[^.!?\\n]*$') || ' that ' || regexp_extract(a, '^[^.!?\\n]*[.!?]?')) END AS passage FROM x""")
def passage_window(t):
    return t("documents").select("doc_id", gates.passage(F.col("text"), " that ").alias("passage"))


@query("""WITH f AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS form FROM documents), c AS (SELECT lower(form) AS stem, form, count(*) AS n FROM f GROUP BY ALL)
    SELECT stem, arg_min(form, (-n, length(form), form)) AS form, sum(n)::BIGINT AS n_all FROM c GROUP BY stem""")
def display_form(t):
    forms = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), 1)).alias("form"))
    return search.display_forms(forms.withColumn("stem", F.lower("form")), "stem", "form")


@query(None)
def stems_sv(t):
    words = t("documents").select("doc_id", F.explode(F.array_distinct(stemming.lower_words(F.col("text")))).alias("word"))
    return stemming.with_stems(words, "word").groupBy("stem").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("word").alias("n_forms"))


@query("""WITH p AS (SELECT p_partkey, p_brand, list_distinct(string_split(p_name, ' ')) AS w FROM part),
    x AS (SELECT a.p_partkey AS part, b.p_partkey AS other, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w)), 6) AS likeness
    FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)
    SELECT part, arg_max(other, (likeness, other)) AS other, max(likeness) AS likeness FROM x WHERE likeness >= 0.3 GROUP BY part""")
def title_dup(t):
    part = t("part").select("p_partkey", "p_brand", F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("w"))
    named = part.withColumn("title", F.concat_ws(" ", "w"))
    sizes = named.groupBy("p_brand", "title").agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))
    kept = named.join(sizes, ["p_brand", "title"])
    before = kept.where(F.col("p_partkey") < F.col("last")).groupBy("p_brand", "title").agg(F.max("p_partkey").alias("before"))
    equal = kept.where("n > 1").join(before, ["p_brand", "title"])
    equal = equal.select(F.col("p_partkey").alias("part"), F.when(F.col("p_partkey") == F.col("last"), F.col("before")).otherwise(F.col("last")).alias("other"), F.lit(1.0).alias("likeness"))
    alone = kept.where("n = 1").select(F.col("p_partkey").alias("part"), "p_brand", "w", "title")
    unlike = search.best_match(alone, named.withColumnRenamed("p_partkey", "other"), ["p_brand"], "part", "other", "w", 0.3, apart="title")
    return equal.unionByName(unlike.select("part", "other", "likeness"))


