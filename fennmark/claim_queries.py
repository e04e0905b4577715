"""Queries on what the wording of promises tells, on kinds of motions, and on votes that may bear on a promise, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import claims
from .functions import text as forms
from .functions.money import CAP
from .operators import vote_candidates
from .registry import query
from .text_queries import _sql_verbatim as _V

_SAID = [
    "Vi ger en gåva till alla.", "Satsa en havsmiljard årligen.", "Det blir 1 500 kr per barn.", "Vi har sänkt skatten.", "Vi har sänkt skatten och vill sänka den igen.", "Riksdagen avslår motionerna 1 och 2.",
    "Riksdagen ställer sig bakom det som anförs i motionen.", "Under nästa mandatperiod satsar vi 2 000 kr i månaden per år.", "En flerårig plan.", "Skatten är högre än någonsin.", "",
]
_SAID_SQL = "[" + ", ".join(f"'{x}'" for x in _SAID) + f"][doc_id % {len(_SAID)} + 1]"
_LIST = "list_filter([{}], lambda x: x IS NOT NULL)"


def _re2(pattern: str) -> str:
    """A fixed pattern for DuckDB, whose expressions look neither behind nor ahead."""
    return pattern.replace("(?iu)", "(?i)").replace("(?<![a-zåäöéèü])", "(^|[^a-zåäöéèü])").replace("(?![a-zåäöéèü])", "($|[^a-zåäöéèü])").replace("(?![a-zà-öø-ÿ])", "($|[^a-zà-öø-ÿ])")


def _any(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{_re2(p)}')" for p in patterns) + ")"


def _said(t):
    pick = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    return t("documents").withColumn("said", pick).withColumn("quote", F.concat("said", F.lit(" "), forms.filled(F.col("text"))))


@query(f"""WITH d AS (SELECT doc_id, {_SAID_SQL} || ' ' || coalesce(text, '') AS q FROM documents)
    SELECT doc_id, array_to_string({_LIST.format(f"CASE WHEN {_any('q', claims.ONE_OFF)} THEN 'one-off' END, CASE WHEN {_any('q', claims.RECURRING)} THEN 'recurring' END, CASE WHEN {_any('q', claims.UNIT_PRICE)} THEN 'unit price' END, CASE WHEN {_any('q', *claims.COMPLETED)} AND NOT {_any('q', *claims.COMMITMENT)} THEN 'completed' END, CASE WHEN {_any(_V('q'), claims.REJECTION)} THEN 'rejection' END, CASE WHEN {_any('q', claims.PARLIAMENT)} THEN 'parliament' END")}, ',') AS signals FROM d""")
def claim_signals(t):
    return _said(t).select("doc_id", F.array_join(claims.signals(F.col("quote")), ",").alias("signals"))


_NOTE = "trim(coalesce(string_split(text, chr(10))[1], ''), E' \\n\\r\\t')"


def _sql_note(x: str, most: int) -> str:
    cut = f"{x}[1:{most - 1}]"
    blank = f"(length({cut}) - instr(reverse({cut}), ' '))"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE regexp_replace(CASE WHEN instr({cut}, ' ') > 0 AND {blank} > {most * 0.6} THEN {cut}[1:{blank}] ELSE {cut} END, '[\\s,;:.–-]+$', '') || '…' END"


@query(f"""WITH d AS (SELECT doc_id, n_chars::DOUBLE AS n, {_SAID_SQL} AS said, {_NOTE} AS note, ['utgift', 'besparing', 'annat', NULL][doc_id % 4 + 1] AS kind, ['per_ar', 'engang', 'kvartal', NULL][doc_id // 4 % 4 + 1] AS period, doc_id % 9 / 10.0::DOUBLE AS c FROM documents),
    r AS (SELECT *, greatest(n - 400, 0) AS low, greatest(n - 400, 0, n * 3000) AS base, CASE WHEN period = 'engang' THEN 'engang' ELSE 'per_ar' END AS known FROM d WHERE n IS NOT NULL AND doc_id % 13 <> 0),
    o AS (SELECT *, known = 'per_ar' AND {_any('said', claims.ONE_OFF)} AS once_only, CASE WHEN note = '' THEN '{claims.NO_NOTE}' ELSE {_sql_note('note', claims.NOTE_CHARS)} END AS plain FROM r), m AS (SELECT *, trim(plain || '{claims.SET_ONCE}') AS longer FROM o)
    SELECT doc_id, round(least(low, {CAP})) AS low, round(least(base, {CAP})) AS base, round(least(greatest(base, n * 2, low * 1.5), {CAP})) AS high, greatest(0, least(c, 0.65))::DOUBLE AS confidence, CASE WHEN kind IN ('utgift', 'besparing') THEN kind ELSE 'utgift' END AS type,
        CASE WHEN once_only THEN 'engang' ELSE known END AS period, CASE WHEN once_only THEN {_sql_note('longer', claims.SET_NOTE_CHARS)} ELSE plain END AS note, CASE WHEN said <> '' THEN said END AS calculation FROM m""")
def estimates_in_full(t):
    n, key = F.col("n_chars").cast("double"), F.col("doc_id")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    note = F.split(forms.filled(F.col("text")), "\n")[0]
    x = claims.estimate(n - 400, F.when(key % 13 != 0, n * 3000), n * 2, key % 9 / 10.0, pick(["utgift", "besparing", "annat", None], key % 4), pick(["per_ar", "engang", "kvartal", None], F.floor(key / 4) % 4), note, F.col("said"), F.col("said"))
    return _said(t).select("doc_id", x.alias("x")).where("x IS NOT NULL").select("doc_id", "x.*")


_DEMANDS = [
    "Riksdagen anvisar anslagen för 2026 inom utgiftsområde 17.", "Riksdagen fastställer utgiftstaket för staten.", "Riksdagen godkänner beräkningen av inkomsterna.",
    "Riksdagen godkänner beräkningen av inkomsterna och regeringen ska återkomma med lagförslag i överensstämmelse med denna beräkning.", "Riksdagen ställer sig bakom det som anförs om skolan.",
]


@query(f"""WITH d AS (SELECT o_custkey AS motion, CASE WHEN o_orderkey % 41 = 0 THEN 4 ELSE (o_custkey + o_orderkey % 3) % 4 END AS k FROM orders WHERE o_custkey IS NOT NULL)
    SELECT motion, count(*) AS n, CASE WHEN bool_or(k = 4) THEN 'matter' WHEN bool_or(k = 0) THEN 'grants' ELSE 'frame' END AS kind, bool_or(k = 3) AS binding FROM d GROUP BY motion""")
def motion_kinds(t):
    k = F.when(F.col("o_orderkey") % 41 == 0, 4).otherwise((F.col("o_custkey") + F.col("o_orderkey") % 3) % 4)
    demands = t("orders").where("o_custkey IS NOT NULL").select(F.col("o_custkey").alias("motion"), F.element_at(F.array(*map(F.lit, _DEMANDS)), (k + 1).cast("int")).alias("text"))
    return vote_candidates.motion_kinds(demands, "motion", "text")


_TITLE = "CASE WHEN instr(html, '<title>') > 0 THEN trim(string_split(substr(html, instr(html, '<title>') + 7), '</title>')[1], E' \\n\\r\\t') ELSE '' END"
_WORDS = f"list_distinct(list_filter(string_split_regex(lower(nfc_normalize(coalesce({{}}, ''))), '{forms.NOT_KEPT}+'), lambda w: length(w) > 2))"


@query(f"""WITH p AS (SELECT item_id AS promise, {_WORDS.format('text')} AS words, CASE WHEN item_id % 5 = 0 THEN item_id * 3 END AS source, CASE WHEN item_id % 7 <> 0 THEN item_id % 3 END AS ours FROM benchmark),
    r AS (SELECT page_id AS report, {_WORDS.format(_TITLE)} AS words FROM pages), h AS (SELECT promise, report, source, ours, len(list_intersect(p.words, r.words)) AS hits FROM p, r WHERE len(list_intersect(p.words, r.words)) >= 2),
    v AS (SELECT o_orderkey AS vote, o_custkey AS report, CASE o_orderstatus WHEN 'F' THEN [0, 1] WHEN 'O' THEN [2] END AS theirs FROM orders)
    SELECT promise, vote, report, hits::INT AS hits, row_number() OVER (PARTITION BY promise ORDER BY hits DESC, vote)::INT AS place FROM h JOIN v USING (report) WHERE coalesce(source <> report, true) AND (ours IS NULL OR theirs IS NULL OR list_contains(theirs, ours)) QUALIFY place <= 12""")
def votes_for_promises(t):
    item = F.col("item_id")
    promises = t("benchmark").select(item.alias("promise"), forms.tokens(F.col("text")).alias("words"), F.when(item % 5 == 0, item * 3).alias("source"), F.when(item % 7 != 0, F.array(item % 3)).alias("parties"))
    title = forms.between(F.col("html"), "<title>", "</title>")
    reports = t("pages").select(F.col("page_id").alias("report"), forms.tokens(title).alias("words"))
    status = F.col("o_orderstatus")
    whole = lambda *x: F.array(*[F.lit(k).cast("bigint") for k in x])
    votes = t("orders").select(F.col("o_orderkey").alias("vote"), F.col("o_custkey").alias("report"), F.when(status == "F", whole(0, 1)).when(status == "O", whole(2)).alias("parties"))
    return vote_candidates.ranked_votes(promises, reports, votes, 12)
