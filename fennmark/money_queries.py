"""Queries on amounts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import money
from .registry import query

_GAP, _MINUS = money.GAP, money.MINUS


def _grouped(x: str, gap: str = " ") -> str:
    return f"replace(format('{{:,}}', ({x})::BIGINT), ',', '{gap}')"


_WROTE = f"('kostar ' || {_grouped('floor(o_totalprice)', chr(160))} || ' mkr, sedan ' || (o_orderkey % 90) || ',5 miljarder kronor och en miljon kronor; 12 barn, 3–4 mdkr')"


def _wrote():
    whole = F.floor("o_totalprice")
    return F.concat(F.lit("kostar "), money.grouped(whole, "\u00a0"), F.lit(" mkr, sedan "), (F.col("o_orderkey") % 90).cast("string"), F.lit(",5 miljarder kronor och en miljon kronor; 12 barn, 3–4 mdkr"))


def _sql_amounts(pattern: str, value: str, thousand: str) -> str:
    return f"""WITH f AS (SELECT o_orderkey, regexp_extract_all(w, '{pattern}', 1) AS n, regexp_extract_all(w, '{pattern}', 2) AS u FROM (SELECT o_orderkey, {_WROTE} AS w FROM orders)),
    x AS (SELECT o_orderkey, unnest(n) AS n, lower(unnest(u)) AS u FROM f), y AS (SELECT o_orderkey, {value} * CASE WHEN {thousand} THEN 1000 ELSE 1 END AS a FROM x)
    SELECT o_orderkey, count(*) FILTER (a IS NOT NULL) AS n, round(sum(a), 3) AS total FROM y GROUP BY o_orderkey"""


_PLAIN = "replace(translate(n, ' \u00a0\u202f\u2009\u2007', ''), ',', '.')::DOUBLE"


@query(_sql_amounts(f"(?i)({money.NUMBER})\\s*({money.UNITS})", f"CASE WHEN lower(n) IN ('en', 'ett') THEN 1 ELSE {_PLAIN} END", "regexp_matches(u, '^(miljard|mdkr)')"))
def amounts_in_text(t):
    a = t("orders").select("o_orderkey", money.amounts(_wrote()).alias("a"))
    return a.select("o_orderkey", F.size("a").cast("bigint").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query(_sql_amounts(f"(?i){money.IN_SENTENCE}", _PLAIN, "u IN ('mdkr', 'miljarder')"))
def amounts_in_sentences(t):
    a = t("orders").select("o_orderkey", money.amounts_in_sentence(_wrote()).alias("a"))
    return a.select("o_orderkey", F.size("a").cast("bigint").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


_LOOSE = f"CASE o_orderkey % 5 WHEN 0 THEN 'ca ' || {_grouped('o_orderkey', chr(0x202f))} || ',5' WHEN 1 THEN '{_MINUS}' || o_orderkey WHEN 2 THEN o_orderkey || '-' || o_custkey WHEN 3 THEN ' cirka ' || o_orderkey || '.25 ' ELSE 'minst 5' END"


@query(f"""WITH p AS (SELECT o_orderkey, trim(translate(translate({_LOOSE}, '\u00a0\u202f\u2009\u2007', '    '), '\u2212\u2013\u2014', '---')) AS p FROM orders), b AS (SELECT o_orderkey, trim(regexp_replace(p, '(?i)^(?:~|ca\\.?|cirka|omkring)\\s*', '')) AS b FROM p)
    SELECT o_orderkey, CASE WHEN regexp_matches(b, '^(-?[0-9]{{1,3}}( [0-9]{{3}})*([.,][0-9]+)?|-?[0-9]+([.,][0-9]+)?)$') THEN replace(replace(b, ' ', ''), ',', '.')::DOUBLE END AS number FROM b""")
def lenient_numbers(t):
    key = F.col("o_orderkey")
    text = F.when(key % 5 == 0, F.concat(F.lit("ca "), money.grouped(key, "\u202f"), F.lit(",5"))).when(key % 5 == 1, F.concat(F.lit(_MINUS), key.cast("string"))).when(key % 5 == 2, F.concat_ws("-", key.cast("string"), F.col("o_custkey").cast("string"))).when(key % 5 == 3, F.concat(F.lit(" cirka "), key.cast("string"), F.lit(".25 "))).otherwise("minst 5")
    return t("orders").select("o_orderkey", money.lenient_number(text).alias("number"))


_DEVIATION = "(o_orderkey % 7 - 3) * o_custkey"


@query(f"""WITH d AS (SELECT o_orderkey, ({_DEVIATION})::BIGINT AS d FROM orders), c AS (SELECT *, CASE WHEN d = 0 THEN '±0' WHEN d < 0 THEN '{_MINUS}' || {_grouped('abs(d)', chr(160))} ELSE {_grouped('d')} || ',5' END AS cell FROM d),
    s AS (SELECT *, regexp_replace(cell, '[\\s  ]', '', 'g') AS s FROM c)
    SELECT o_orderkey, CASE WHEN s = '±0' THEN 0 ELSE CASE WHEN s LIKE '{_MINUS}%' THEN -1 ELSE 1 END * replace(ltrim(s, '{_MINUS}'), ',', '.')::DOUBLE END AS number,
    CASE WHEN d = 0 THEN '±0' ELSE CASE WHEN d > 0 THEN '+' ELSE '{_MINUS}' END || {_grouped('abs(d)')} END AS amount FROM s""")
def cell_numbers(t):
    d = (F.col("o_orderkey") % 7 - 3) * F.col("o_custkey")
    cell = F.when(d == 0, "±0").when(d < 0, F.concat(F.lit(_MINUS), money.grouped(F.abs(d), "\u00a0"))).otherwise(F.concat(money.grouped(d), F.lit(",5")))
    return t("orders").select("o_orderkey", money.cell_number(cell).alias("number"), money.row_amount(d).alias("amount"))


_SIGNED = "(floor(o_totalprice)::BIGINT * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)"
_TENTH = "replace(round(abs(m) / 1000.0::DOUBLE, 1)::DECIMAL(20,1)::VARCHAR, '.', ',')"


@query(f"""WITH m AS (SELECT o_orderkey, o_orderstatus, {_SIGNED} // CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 300 END AS m FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '≈ ' ELSE '' END || CASE WHEN m < 0 THEN '{_MINUS}' ELSE '' END || CASE WHEN abs(m) >= 10000 THEN {_grouped('round(abs(m) / 1000.0::DOUBLE)', _GAP)} || ' mdkr'
        WHEN abs(m) >= 1000 THEN {_TENTH} || ' mdkr' ELSE {_grouped('abs(m)', _GAP)} || ' mkr' END AS money,
    CASE WHEN abs(m) >= 10000 THEN {_grouped('round(abs(m) / 1000.0::DOUBLE)', _GAP)} || ' miljarder kronor' WHEN abs(m) >= 1000 THEN regexp_replace({_TENTH}, ',0$', '') || ' miljarder kronor' ELSE {_grouped('abs(m)', _GAP)} || ' miljoner kronor' END AS words,
    CASE WHEN m < 0 THEN '{_MINUS}' ELSE '' END || {_grouped('abs(m)')} AS thousands FROM m""")
def money_texts(t):
    signed = F.floor("o_totalprice") * F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    m = t("orders").select("o_orderkey", "o_orderstatus", (F.signum(signed) * F.floor(F.abs(signed) / F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(300))).cast("bigint").alias("m"))
    return m.select("o_orderkey", money.money(F.col("m"), F.col("o_orderstatus") == "O").alias("money"), money.amount_in_words(F.abs("m")).alias("words"), money.thousands(F.col("m")).alias("thousands"))


_ONE = "replace(printf('%.1f', {}::DOUBLE), '.', ',')"


@query(f"""WITH c AS (SELECT p_partkey, p_name AS label, p_size % 3 AS k, p_retailprice * CASE WHEN p_size % 2 = 0 THEN 0.00001::DOUBLE ELSE 997.3::DOUBLE END AS v FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN v >= 1 THEN {_ONE.format('v')} || ' gånger till ' || label WHEN v >= 0.01 THEN {_ONE.format('(v * 100)')} || ' % av vägen till ' || label ELSE replace(printf('%.2f', (v * 100)::DOUBLE), '.', ',') || ' % av vägen till ' || label END
    WHEN 1 THEN CASE WHEN v >= 1e6 THEN {_ONE.format('(v / 1e6)')} || ' miljoner ' || lower(label) WHEN v >= 1000 THEN {_grouped('round(v)', _GAP)} || ' ' || lower(label) ELSE {_ONE.format('v')} || ' ' || lower(label) END ELSE {_ONE.format('v')} || ' kg' END AS said FROM c""")
def comparison_texts(t):
    value = F.col("p_retailprice") * F.when(F.col("p_size") % 2 == 0, 0.00001).otherwise(997.3)
    unit = F.when(F.col("p_size") % 3 == 0, "share").when(F.col("p_size") % 3 == 1, "things").otherwise("kg")
    return t("part").select("p_partkey", money.comparison(value, unit, F.col("p_name")).alias("said"))


_REP = "(SELECT arg_max((o_orderstatus, o_orderpriority), (o_totalprice, -o_orderkey)) AS x, max(o_totalprice)::DECIMAL(18,2) AS m FROM orders GROUP BY o_custkey)"


@query(f"""WITH r AS (SELECT x[1] AS s, x[2] AS p, m FROM {_REP}), f AS (SELECT coalesce(sum(m) FILTER (s = 'O'), 0) AS gross, coalesce(sum(m) FILTER (s = 'F'), 0) AS saving,
    coalesce(sum(m * CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 4 ELSE 1 END) FILTER (s = 'P'), 0) AS financing FROM r)
    SELECT gross::DOUBLE AS gross, saving::DOUBLE AS saving, financing::DOUBLE AS financing, (gross - saving - financing)::DOUBLE AS gap FROM f""")
def financing_gap(t):
    order = F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))
    one = t("orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority", "o_totalprice"), order).alias("x")).select("x.*")
    yearly = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    part = lambda s, x: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, x.cast("decimal(18,2)"))), F.lit(0))
    price = F.col("o_totalprice")
    sums = one.agg(part("O", price).alias("gross"), part("F", price).alias("saving"), part("P", money.multiplied(price, yearly, 4)).alias("financing"))
    return sums.withColumn("gap", F.col("gross") - F.col("saving") - F.col("financing")).select(*[F.col(c).cast("double").alias(c) for c in ("gross", "saving", "financing", "gap")])


def _fields(x: str) -> str:
    return ", ".join(f"{x}.{k}" for k in ("low", "base", "high", "confidence"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.75::DOUBLE) AS low, l_extendedprice AS base, round(l_extendedprice * 1.35::DOUBLE) AS high, CASE WHEN l_discount < 0.03 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
    FROM lineitem WHERE l_extendedprice >= 50 AND l_linestatus <> 'F'""")
def own_amount_spans(t):
    spans = money.own_spread(F.col("l_extendedprice"), F.col("l_linestatus") == "F", F.col("l_discount") < 0.03)
    return t("lineitem").select("l_orderkey", "l_linenumber", spans.alias("x")).where("x IS NOT NULL").select("l_orderkey", "l_linenumber", "x.*")


@query(f"""WITH e AS (SELECT o_orderkey, greatest(o_totalprice * 20 - o_custkey * 1000, 0) AS low, o_totalprice * 20 AS b, o_totalprice * 15 AS h, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 10 / 10.0::DOUBLE END AS c FROM orders), m AS (SELECT *, greatest(low, b) AS base FROM e)
    SELECT o_orderkey, round(least(low, {money.CAP})) AS low, round(least(base, {money.CAP})) AS base, round(least(greatest(base, h, low * 1.5), {money.CAP})) AS high, greatest(0, least(coalesce(c, 0.4), 0.65))::DOUBLE AS confidence FROM m""")
def bounded_estimates(t):
    price = F.col("o_totalprice")
    x = money.bounded(price * 20 - F.col("o_custkey") * 1000, price * 20, price * 15, F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 10 / 10.0))
    return t("orders").select("o_orderkey", x.alias("x")).select("o_orderkey", "x.*")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END AS a, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'R' THEN 'principle' ELSE 'other' END AS kind, CASE l_linenumber WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE '' END AS c FROM lineitem),
    s AS (SELECT *, CASE WHEN kind = 'exact' THEN 0.15 WHEN kind = 'principle' THEN 0 WHEN c = 'low' THEN 0.3 WHEN c = 'high' THEN 0.8 ELSE 0.5 END::DOUBLE AS s, CASE WHEN kind = 'exact' THEN 0.85 WHEN kind = 'principle' THEN 0.2 WHEN c = 'low' THEN 0.55 WHEN c = 'high' THEN 0.3 ELSE 0.4 END::DOUBLE AS f FROM k)
    SELECT l_orderkey, l_linenumber, CASE WHEN a > 0 THEN round(a * (1 - s)) ELSE 0 END AS low, CASE WHEN a > 0 THEN round(a) ELSE 0 END AS base,
    CASE WHEN a > 0 THEN round(CASE WHEN kind = 'other' THEN greatest(a * (1 + s), a * (1 - s) * 1.5) ELSE a * (1 + s) END) ELSE 0 END AS high, CASE WHEN a > 0 THEN f ELSE least(f, 0.3) END AS confidence FROM s""")
def imported_spans(t):
    kind = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "R", "principle").otherwise("other")
    sure = F.when(F.col("l_linenumber") == 1, "low").when(F.col("l_linenumber") == 2, "high").otherwise("")
    x = money.certainty_spread(F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice")), kind, sure)
    return t("lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("""SELECT ps.l_orderkey, ps.l_linenumber, ps.l_extendedprice AS stated, p_retailprice * 20 AS field FROM lineitem ps JOIN part ON l_partkey = p_partkey
    WHERE (p_retailprice = 0 AND l_extendedprice > 0) OR greatest(l_extendedprice, p_retailprice * 20) > 1.35 * least(l_extendedprice, p_retailprice * 20)""")
def amount_mismatches(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("stated"), (F.col("p_retailprice") * 20).alias("field"))
    return rows.where(money.mismatched(F.col("stated"), F.col("field")))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS o, l_quantity * 1500 AS b FROM lineitem)
    SELECT count(*) FILTER (b BETWEEN o * 0.9 AND o * 1.2 OR (least(o, b) > 0 AND greatest(o, b) <= 1.5 * least(o, b))) AS within, count(*) AS n FROM r""")
def triage_counts(t):
    old = F.col("l_extendedprice")
    near = money.within(old * 0.9, old, old * 1.2, F.col("l_quantity") * 1500)
    return t("lineitem").agg(F.count(F.when(near, 1)).alias("within"), F.count("*").alias("n"))


_MEANS, _RULE = "\\b(the|a)\\w*", "the|sleep"


@query(f"""SELECT p_partkey, CASE WHEN (CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END) <> 0 OR regexp_matches(p_name, '{_MEANS}') OR regexp_matches(p_name, '[0-9]') OR regexp_matches(coalesce(p_brand, ''), '{_RULE}') THEN 'reform' ELSE 'direction' END AS kind FROM part""")
def promise_kinds(t):
    base = F.when(F.col("p_size") % 2 == 0, 0).otherwise(F.col("p_size"))
    return t("part").select("p_partkey", money.measured(base, F.col("p_name"), _MEANS, _RULE, F.col("p_brand")).alias("kind"))
