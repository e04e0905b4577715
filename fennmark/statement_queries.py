"""Queries on what calculations say, each with its SQL. The texts are made of the rows' numbers in the forms that calculations take."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import statements
from .registry import query

_B, _C = "(o_custkey + 20)", "(o_orderkey % 900 + 3)"
#: By the last digit of the order: what its calculation says, and the base that it states.
_SAID = {
    0: (f"'Delarna ger 5 mkr. Sammantaget 100–9 000 miljoner kronor per år, med ' || {_B} || ' som basbelopp.'", _B),
    1: (f"'Summan blir 1–10 miljarder kronor, med bas ' || {_C} || '.'", f"{_C} * 1000"),
    2: (f"'Bas: ' || {_B} || ' platser à 50 000 kronor = ' || {_C} || ' miljoner kronor.'", _C),
    3: ("'Bidragen kostar sammanlagt 5–10 miljarder kronor per år.'", "NULL"),
    4: ("'Sammantaget 100–500 miljoner kronor. Bas 2 500 kr/förlossning.'", "NULL"),
    5: (f"'Kostnaden är sammanlagt ' || {_B} || ' miljoner per år.'", _B),
    6: ("'Löftet är svårt att prissätta. Prissätts inte.'", "NULL"),
    7: (f"'En efterhandsberäkning på ' || {_B} || ' miljoner kronor avvisades. Totalt omkring ' || {_C} || ' mkr.'", _C),
    8: (f"'Summan blir låg 500, bas ' || {_B} || ' mkr, hög 5 000 mkr. Avrundat uppåt.'", _B),
    9: ("''", "NULL"),
}
_TEXT = "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {text}" for k, (text, _) in _SAID.items()) + " END"
_STATED = "(CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {base}" for k, (_, base) in _SAID.items()) + " END)::DOUBLE"


@query(f"SELECT o_orderkey, {_STATED} AS stated FROM orders")
def stated_bases(t):
    return t("orders").select("o_orderkey", statements.stated_base(F.expr(_TEXT)).alias("stated"))


_BASE = "CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey * 2 END AS DOUBLE)"


@query(f"""WITH s AS (SELECT o_orderkey, o_orderstatus = 'P' AS withdrawn, {_BASE} AS base, {_STATED} AS stated FROM orders)
    SELECT o_orderkey, stated, CASE WHEN base / stated > 1.35 THEN 'too high' ELSE 'too low' END AS direction FROM s
    WHERE NOT withdrawn AND base <> 0 AND stated <> 0 AND (base / stated > 1.35::DOUBLE OR base / stated < 1 / 1.35::DOUBLE)""")
def text_mismatches(t):
    found = statements.mismatch(F.expr(_TEXT), F.expr(_BASE), F.col("o_orderstatus") == "P")
    return t("orders").select("o_orderkey", found.alias("x")).where("x IS NOT NULL").select("o_orderkey", "x.*")


_MOST = f"CASE o_orderkey % 10 WHEN 0 THEN 9000 WHEN 1 THEN 10000000 WHEN 2 THEN {_C} WHEN 3 THEN 10000000 WHEN 4 THEN 500 WHEN 7 THEN {_C} WHEN 8 THEN greatest({_B}, 5000) END::DOUBLE"


@query(f"SELECT o_orderkey, {_MOST} AS most FROM orders WHERE {_BASE} = 0 AND o_orderstatus <> 'P' AND {_MOST} > 0")
def sums_behind_zero(t):
    most = statements.sum_behind_zero(F.expr(_TEXT), F.expr(_BASE), F.col("o_orderstatus") == "P")
    return t("orders").select("o_orderkey", most.alias("most")).where("most IS NOT NULL")


_QUOTE = f"CASE o_custkey % 4 WHEN 0 THEN 'Vi vill höja barnbidraget rejält' WHEN 1 THEN 'En kraftig satsning på vården' WHEN 2 THEN 'Vi lägger ' || {_B} || ' miljoner kronor på skolan' ELSE 'Sänk den lokala skatten' END"
_BASIS = "CASE WHEN o_orderpriority < '3' THEN 'parti' ELSE 'llm_estimat' END"


def _rules(base: str) -> str:
    k, q, there = "o_orderkey % 10", "o_custkey % 4", "o_orderkey % 10 <> 9"
    own = f"{q} = 2 AND {_B} <> {base} AND {k} NOT IN (7, 8) AND NOT ({k} = 2 AND {_B} = {_C}) AND NOT ({k} = 0 AND {_B} = 9000) AND NOT ({k} = 4 AND {_B} = 500)"
    rules = {
        "zero without anchor": f"{base} = 0 AND {q} = 0", "no calculation": f"NOT ({there})", "amount not named": f"{there} AND {base} > 0 AND {k} = 6", "own number bypassed": f"{there} AND {own}",
        "value word as level": f"{there} AND {base} > 0 AND o_orderpriority < '3' AND {q} IN (0, 1)", "zero without reason": f"{there} AND {base} = 0 AND {k} <> 6",
        "span without base": f"{there} AND NOT ({base} BETWEEN o_custkey AND 100000)", "kind against quote": f"{there} AND {q} = 3 AND {base} > 0 AND o_orderstatus = 'O'",
    }
    return ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items())


@query(f"SELECT o_orderkey, array_to_string(list_filter([{_rules('base')}], lambda x: x IS NOT NULL), ',') AS found FROM (SELECT *, {_BASE} AS base FROM orders)")
def calculation_faults(t):
    kind = F.when(F.col("o_orderstatus") == "O", "utgift").otherwise("intakt")
    row = statements.Costing(F.expr(_QUOTE), F.expr(_TEXT), F.lit(""), F.expr(_BASE), F.col("o_custkey").cast("double"), F.lit(100000.0), F.expr(_BASIS), kind)
    return t("orders").select("o_orderkey", F.array_join(statements.objections(row), ",").alias("found"))
