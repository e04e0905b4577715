"""Queries on labels, keys and small rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import labels
from .functions import text as forms
from .operators import links, reviews, word_index
from .registry import query

_MONTHS = ", ".join(f"'{m}'" for m in labels.MONTHS)


@query(f"""SELECT o_orderkey, day(o_orderdate) || ' ' || [{_MONTHS}][month(o_orderdate)] || ' ' || year(o_orderdate) AS day, CASE o_orderstatus WHEN 'O' THEN 'öppen' WHEN 'F' THEN 'stängd' ELSE o_orderstatus END AS status FROM orders""")
def order_labels(t):
    return t("orders").select("o_orderkey", labels.long_date(F.col("o_orderdate")).alias("day"), labels.label(F.col("o_orderstatus"), {"O": "öppen", "F": "stängd"}).alias("status"))


@query("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%parti%' THEN 'party' WHEN lower(p_type) LIKE '%kommitt%' THEN 'committee' WHEN lower(p_type) LIKE '%enskild%' THEN 'single' WHEN p_size % 4 > 1 THEN 'committee' ELSE 'single' END AS kind,
    CASE WHEN regexp_matches(left(p_name, 2), '^[a-zåäö]{2}$') THEN left(p_name, 2) ELSE '_' END AS words, CASE WHEN p_size = 7 THEN 'rest' ELSE lpad((p_partkey // 100)::VARCHAR, greatest(3, length((p_partkey // 100)::VARCHAR))::INT, '0') END AS numbers,
    CASE WHEN 'Brand#' || try_cast(substr(p_brand, 7) AS BIGINT)::VARCHAR = p_brand THEN try_cast(substr(p_brand, 7) AS BIGINT) END AS number, CASE WHEN p_type NOT IN ('SMALL', 'LARGE') THEN p_type END AS committee FROM part""")
def part_keys(t):
    number = F.when(F.col("p_size") != 7, F.col("p_partkey"))
    return t("part").select(
        "p_partkey", labels.motion_kind(F.col("p_type"), F.col("p_size") % 4).alias("kind"), labels.word_shard(F.col("p_name")).alias("words"), labels.number_shard(number, 100).alias("numbers"),
        labels.compact_id(F.col("p_brand"), "Brand#").alias("number"), labels.visible_committee(F.col("p_type"), ["SMALL", "LARGE"]).alias("committee"),
    )


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN array_to_string(list_sort(list_distinct(CASE WHEN contains(p_name, 'ring') THEN [p_type] ELSE [p_type, p_brand] END)), ',') ELSE 'other' END AS actors,
    coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, CASE WHEN p_size % 5 = 0 THEN p_type END, '') AS target FROM part""")
def actors_and_targets(t):
    kind = F.when(F.col("p_size") % 3 == 0, "vote").when(F.col("p_size") % 3 == 1, "question").otherwise("motion")
    who = lambda name, party: F.struct(name.alias("name"), party.alias("party"))
    authors = F.array(who(F.lit("A"), F.col("p_type")), who(F.col("p_name"), F.col("p_brand")))
    actors = labels.acting_parties(kind, F.array("p_brand"), authors, F.array(F.lit("other")), "ring")
    target = labels.target_id(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.when(F.col("p_size") % 5 == 0, F.col("p_type")), strict=False)
    return t("part").select("p_partkey", F.array_join(actors, ",").alias("actors"), target.alias("target"))


_STEM = " ".join(f"WHEN x LIKE '%{e}' AND length(x) >= {4 + len(e)} THEN left(x, length(x) - {len(e)})" for e in forms.LIGHT_ENDINGS)


@query(f"""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(nfc_normalize(text)), '{forms.NOT_KEPT}+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and'))) AS w FROM benchmark)
    SELECT item_id, len(list_distinct(list_transform(w, lambda x: CASE {_STEM} ELSE x END)))::INT AS terms FROM w""")
def anchor_term_counts(t):
    empty = F.lit("")
    return t("benchmark").select("item_id", F.size(labels.anchor_terms(empty, F.col("text"), empty, ["the", "and"])).alias("terms"))


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS of_party, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS shown,
    count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 200000 AND o_orderpriority = '5-LOW') AS breaches FROM orders GROUP BY o_custkey""")
def promise_rules(t):
    status = labels.label(F.col("o_orderstatus"), {"F": "withdrawn"})
    active = labels.is_active(status)
    archive = F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority"))
    none = F.array().cast("array<string>")
    rules = {
        "active": active, "of_party": labels.has_party(F.array("o_orderpriority"), ["1-URGENT", "2-HIGH"]), "shown": labels.shown_change(F.col("o_orderstatus") == "O", archive),
        "breaches": labels.breach(active, F.col("o_totalprice") > 200000, none, F.when(F.col("o_orderpriority") != "5-LOW", 1)),
    }
    return links.tally(t("orders"), ["o_custkey"], rules)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS b, CASE WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END AS base, l_quantity * 1000 AS low, l_quantity * 2000 AS high FROM lineitem WHERE l_returnflag <> 'N')
    SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN base <> 0 AND low > 20000 AND base <> high THEN 'amount not named' END, CASE WHEN base <> 0 AND low <= 20000 THEN 'no amount' END, CASE WHEN high > 60000 AND base <> high THEN 'own number bypassed' END,
    CASE WHEN base = 0 AND b > 30000 THEN 'nought without reason' END, CASE WHEN NOT base BETWEEN low AND high THEN 'span without base' END, CASE WHEN base <> 0 AND low = high THEN 'span without width' END], lambda y: y IS NOT NULL), ',') AS found FROM x""")
def calculation_objections(t):
    base = F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice"))
    low, high = F.col("l_quantity") * 1000, F.col("l_quantity") * 2000
    none = F.array().cast("array<double>")
    rules = labels.objections(F.lit("a sum"), F.when(low > 20000, F.array(high)).otherwise(none), F.when(high > 60000, F.array(high)).otherwise(none), low, base, high, F.lit("reform"), F.lit("reform"), F.when(F.col("l_extendedprice") <= 30000, F.lit("a rule")))
    order = ["amount not named", "no amount", "own number bypassed", "nought without reason", "span without base", "span without width"]
    return t("lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", F.array_join(links.any_of({k: rules[k] for k in order}), ",").alias("found"))


@query("""WITH s AS (SELECT o_orderkey, 'samma belopp som nation_' || (o_custkey % 25) || ' och Nation_' || (o_orderkey % 25) || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ', ankrat' END AS s, 'N' || (o_custkey % 25) AS own FROM orders)
    SELECT o_orderkey, array_to_string(list_filter(list_transform(range(25), lambda k: CASE WHEN regexp_matches(s, '(?i)nation_' || k || '\\b') AND 'N' || k <> own THEN 'N' || k END), lambda x: x IS NOT NULL AND s LIKE '%ankrat%'), ',') AS lenders FROM s""")
def borrowed_anchors(t):
    number = (F.col("o_custkey") % 25).cast("string")
    said = F.concat(F.lit("samma belopp som nation_"), number, F.lit(" och Nation_"), (F.col("o_orderkey") % 25).cast("string"), F.when(F.col("o_orderstatus") == "F", "").otherwise(", ankrat"))
    names = {f"nation_{k}\\b": f"N{k}" for k in range(25)}
    return t("orders").select("o_orderkey", F.array_join(labels.borrowed(said, "ankrat", names, F.concat(F.lit("N"), number)), ",").alias("lenders"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Åsa Öst-Berg' ELSE 'Bo Ek' END AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'minister' ELSE 'talesperson' END AS role FROM customer""")
def people_in_text(t):
    key = F.col("c_custkey")
    text = F.when(key % 7 == 0, "Redaktionen, minister Åsa Öst-Berg").when(key % 2 == 0, "Minister Åsa Öst-Berg sade").otherwise("Bo Ek, talesperson för")
    found = labels.person(text, "minister|talesperson", "Redaktionen")
    return t("customer").select("c_custkey", found["name"].alias("name"), found["role"].alias("role"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform([' ' || upper(p_name), p_type || ' '], lambda x: lower(trim(x))), lambda x: x <> ''), ',') AS codes, CASE WHEN p_size % 5 = 0 THEN 'Inget parti har svarat.' ELSE (p_size % 5) || ' av ' || p_size || ' svar är givna, av ' || (p_size // 2) || ' partier.' END AS said FROM part""")
def candidate_forms(t):
    size = F.col("p_size")
    codes = labels.normalised_codes(F.array(F.concat(F.lit(" "), F.upper("p_name")), F.concat("p_type", F.lit(" ")), F.lit("  ")))
    return t("part").select("p_partkey", F.array_join(codes, ",").alias("codes"), labels.summary_sentence(size % 5, size, F.floor(size / 2)).alias("said"))


@query("""SELECT p_type, count(*) AS n FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['ring', 'ringen', 'ringet'])) > 0 GROUP BY p_type""")
def search_examples(t):
    return t("part").where(F.arrays_overlap(F.split("p_name", " "), word_index.search_forms(F.lit("ringen")))).groupBy("p_type").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) FILTER (regexp_matches(text, '(^|[^\\p{L}\\p{N}])(EU|USA|AI)($|[^\\p{L}\\p{N}])')) AS with_abbreviation, count(*) AS n FROM documents GROUP BY lang""")
def abbreviations(t):
    return t("documents").groupBy("lang").agg(F.count(F.when(F.col("text").rlike("(^|[^\\p{L}\\p{N}])(EU|USA|AI)($|[^\\p{L}\\p{N}])"), 1)).alias("with_abbreviation"), F.count("*").alias("n"))


@query("""SELECT s_nationkey, count(*) AS links, count(DISTINCT l_orderkey) AS promises, count(*) FILTER (s_nationkey = c_nationkey) AS own, count(*) FILTER (s_nationkey <> c_nationkey) AS others
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY s_nationkey""")
def party_page_actions(t):
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    items = t("lineitem").select("l_suppkey", "l_orderkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    items, orders = links.dealt_by_key((items, "l_orderkey"), (orders, "o_orderkey"), rows=t("lineitem").count())
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # counts for each party and promise first, so that no group is gathered
    each = links.tally(rows, ["s_nationkey", "l_orderkey"], {"own": F.col("s_nationkey") == F.col("c_nationkey"), "others": F.col("s_nationkey") != F.col("c_nationkey")})
    return each.groupBy("s_nationkey").agg(F.sum("n").alias("links"), F.count("*").alias("promises"), F.sum("own").alias("own"), F.sum("others").alias("others"))


@query("""SELECT o_orderkey, o_orderstatus, count(l_partkey) AS links, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS kinds, coalesce(max(l_shipdate), max(o_orderdate)) AS latest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def promise_details(t):
    found = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("links"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("kinds"), F.max("l_shipdate").alias("last"))
    out = t("orders").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "o_orderstatus", F.coalesce("links", F.lit(0)).alias("links"), "kinds", F.coalesce("last", "o_orderdate").alias("latest"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 120""")
def run_budget(t):
    return t("orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").select("o_orderkey").limit(120)


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'motion' WHEN 'SMALL' THEN 'vote' ELSE 'question' END AS kind, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 2 END::INT AS names,
    CASE WHEN p_size % 5 = 0 THEN lower(p_type) WHEN lower(p_brand) < lower(p_type) THEN lower(p_brand) || ',' || lower(p_type) ELSE lower(p_type) || ',' || lower(p_brand) END AS parties
    FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE') AND p_size <> 3""")
def documents_as_actions(t):
    who = lambda name, party: F.struct(name.alias("name"), F.col(party).alias("party"))
    authors = F.array(who(F.lit(" Ada "), "p_type"), who(F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")), "p_brand"))
    action = labels.action_of(F.col("p_type"), {"ECONOMY": "motion", "SMALL": "vote", "LARGE": "question"}, F.col("p_partkey"), F.when(F.col("p_size") != 3, F.col("p_size")), authors)
    found = t("part").select(action.alias("a")).where("a IS NOT NULL")
    return found.select(F.col("a.number").alias("p_partkey"), "a.kind", F.size("a.names").alias("names"), F.array_join("a.parties", ",").alias("parties"))


@query("""SELECT event_type, count(*) || ' ' || event_type || ' highest ' || max(event_id) || ' last ' || max(ts)::DATE AS line FROM events GROUP BY event_type""")
def alert_lines(t):
    line = labels.alert_text(F.count("*"), F.col("event_type"), F.max("event_id"), F.to_date(F.max("ts")))
    return t("events").groupBy("event_type").agg(line.alias("line"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'gone' WHEN p_size % 5 = 0 THEN 'empty' WHEN p_size % 3 = 0 THEN 'same' WHEN length(p_name) < 10 THEN 'short' WHEN contains(p_brand || ' ' || p_name, p_name) AND p_size % 2 = 0 THEN 'set: own text' ELSE 'set: report' END AS outcome FROM part""")
def rationale_swaps(t):
    size = F.col("p_size")
    wanted = F.when(size % 5 == 0, "  ").otherwise(F.concat(F.col("p_name"), F.lit(" ")))
    own = F.when(size % 2 == 0, F.concat_ws(" ", "p_brand", "p_name"))
    outcome = reviews.rationale_outcome(size % 7 != 0, F.when(size % 3 == 0, F.col("p_name")), wanted, own)
    return t("part").select("p_partkey", outcome.alias("outcome"))
