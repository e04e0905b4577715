"""Queries on statements of parties and on what of a document is the action itself, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import own_text as own
from .functions.text import filled
from .operators import stances
from .registry import query
from .text_queries import _sql_verbatim as _V

_HOSTS = [f"src{k}.example" for k in range(12)]
_NAMES = "list_filter([{}], lambda x: x IS NOT NULL)"
_QUOTED = lambda names: ", ".join(f"'{x}'" for x in names)
_CODES = [*stances.PARTIES, "x"]

_STATEMENTS = f"""a AS (SELECT doc_id AS article, coalesce(text, '') AS text, source, 'https://www.' || source || '.example/a' AS url, CASE WHEN doc_id % 17 = 0 THEN source || '.other' WHEN doc_id % 2 = 0 THEN 'www.' || source || '.example' ELSE source || '.example' END AS declared,
        CASE WHEN doc_id % 23 <> 0 THEN 300 - doc_id % 1000 END AS days FROM documents WHERE doc_id IS NOT NULL),
    s AS (SELECT *, article * 4 + k AS statement, 'q-' || (article + k) % 40 AS question, CASE WHEN article % 19 = 0 THEN 's' ELSE [{_QUOTED(_CODES)}, NULL][(article * 3 + k) % 10 + 1] END AS party, ['ja', 'nej', 'villkorat', 'kanske'][(article // 3 + k) % 4 + 1] AS position,
        CASE article % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 301) WHEN 2 THEN 'om det finns pengar' END AS note, CASE k WHEN 0 THEN string_split(text, chr(10))[1] WHEN 1 THEN string_split(text, chr(10))[-1] WHEN 2 THEN 'which stands nowhere in any text' ELSE array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') END AS quote,
        CASE WHEN article % 6 = 0 THEN 'Å' WHEN article % 6 = 1 THEN 'Åsa' END AS name, CASE WHEN article % 6 < 2 THEN 'ledamot' END AS role FROM a, range(4) x(k))"""
_JUDGED = f"""WITH {_STATEMENTS}, q AS (SELECT 'q-' || n_nationkey AS question, CASE WHEN n_nationkey % 5 = 0 THEN 'vilande' ELSE 'aktiv' END AS state FROM nation),
    c AS (SELECT article, max(n) AS most FROM (SELECT article, party, count(*) AS n FROM s GROUP BY article, party) GROUP BY article), f AS (SELECT article, {_V('text')} AS form FROM a),
    j AS (SELECT s.*, q.state, most, form, {_V('s.quote')} AS t FROM s JOIN c USING (article) JOIN f USING (article) LEFT JOIN q ON q.question = s.question), w AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM j),
    x AS (SELECT statement, CASE WHEN source IS NULL OR source || '.example' NOT IN ({_QUOTED(_HOSTS)}) OR article % 17 = 0 THEN 'domain' WHEN most > 3 THEN 'crowd' END AS fault,
        {_NAMES.format(f"CASE WHEN length(question) < 4 THEN 'question' END, CASE WHEN party IS NULL OR party NOT IN ({_QUOTED(stances.PARTIES)}) THEN 'party' END, CASE WHEN position = 'kanske' THEN 'position' END, CASE WHEN length(note) > 300 THEN 'note' END, CASE WHEN length(quote) NOT BETWEEN 10 AND 600 THEN 'quote' END, CASE WHEN length(name) < 2 THEN 'person' END")} AS schema,
        {_NAMES.format("CASE WHEN state IS NULL THEN 'unknown question' END, CASE WHEN state <> 'aktiv' THEN 'question not live' END, CASE WHEN position = 'villkorat' AND coalesce(note, '') = '' THEN 'no condition' END, CASE WHEN n < 5 THEN 'short' END, CASE WHEN n > 40 THEN 'long' END, CASE WHEN n BETWEEN 5 AND 40 AND NOT contains(form, t) THEN 'not verbatim' END, CASE WHEN days IS NULL THEN 'no date' END, CASE WHEN abs(days) > 548 THEN 'date' END")} AS content FROM w),
    g AS (SELECT statement, CASE WHEN fault IS NOT NULL THEN 'article' WHEN len(schema) > 0 THEN 'schema' WHEN len(content) > 0 THEN 'content' END AS gate, array_to_string(CASE WHEN fault IS NOT NULL THEN [fault] WHEN len(schema) > 0 THEN schema ELSE content END, ',') AS faults FROM x)"""


def _statements(t):
    """Four statements on each document, with a question, a party, a position and a quote of their own."""
    key, text = F.col("doc_id"), filled(F.col("text"))
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    site = F.concat("source", F.lit(".example"))
    now = F.lit("2026-08-01").cast("timestamp")
    articles = t("documents").where("doc_id IS NOT NULL").select(
        key.alias("article"), text.alias("text"), F.concat(F.lit("https://www."), site, F.lit("/a")).alias("url"),
        F.when(key % 17 == 0, F.concat("source", F.lit(".other"))).when(key % 2 == 0, F.concat(F.lit("www."), site)).otherwise(site).alias("declared"),
        F.when(key % 23 != 0, F.timestamp_seconds(F.unix_seconds(now) - (300 - key % 1000) * 86_400)).alias("published"),
    )
    a, k = F.col("article"), F.col("k")
    lines = F.split("text", "\n")
    statements = articles.select("article", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        (a * 4 + k).alias("statement"), "article", F.concat(F.lit("q-"), (a + k) % 40).alias("question"), F.when(a % 19 == 0, "s").otherwise(pick([*_CODES, None], (a * 3 + k) % 10)).alias("party"),
        pick(["ja", "nej", "villkorat", "kanske"], (F.floor(a / 3) + k) % 4).alias("position"), F.when(a % 5 == 0, "").when(a % 5 == 1, "x" * 301).when(a % 5 == 2, "om det finns pengar").alias("note"),
        F.when(k == 0, lines[0]).when(k == 1, F.element_at(lines, -1)).when(k == 2, "which stands nowhere in any text").otherwise(F.array_join(F.slice(F.split("text", " "), 1, 12), " ")).alias("quote"),
        F.when(a % 6 == 0, "Å").when(a % 6 == 1, "Åsa").alias("name"), F.when(a % 6 < 2, "ledamot").alias("role"),
    )
    questions = t("nation").select(F.concat(F.lit("q-"), "n_nationkey").alias("question"), F.when(F.col("n_nationkey") % 5 == 0, "vilande").otherwise("aktiv").alias("state"))
    return stances.judged(statements, articles, questions, _HOSTS, now)


@query(f"{_JUDGED} SELECT statement, gate, faults FROM g")
def stance_gates(t):
    return _statements(t).select("statement", "gate", F.array_join("faults", ",").alias("faults"))


@query(f"{_JUDGED} SELECT gate, fault, count(*) AS n FROM (SELECT coalesce(gate, 'taken') AS gate, unnest(CASE WHEN gate IS NULL THEN [''] ELSE string_split(faults, ',') END) AS fault FROM g) GROUP BY gate, fault")
def stance_gate_counts(t):
    accepted, review = stances.taken(_statements(t).select("statement", "gate", "faults"))
    reasons = review.select("gate", F.explode("faults").alias("fault")).unionByName(accepted.select(F.lit("taken").alias("gate"), F.lit("").alias("fault")))
    return reasons.groupBy("gate", "fault").agg(F.count("*").alias("n"))


_GRANT, _CEILING, _INCOME = "Riksdagen anvisar anslagen för 2026 enligt tabell 1.", "Riksdagen fastställer utgiftstaket för 2026.", "Riksdagen godkänner beräkningen av inkomsterna."
_ASKING, _END = " Jag vill därför fråga statsrådet: ", " Utskottets förslag till riksdagsbeslut"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10))[1] AS head, string_split(coalesce(text, ''), chr(10))[-1] AS foot FROM documents),
    r AS (SELECT doc_id, foot, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'Riksdagen antar ' ELSE 'Riksdagen avslår motion ' END || head END AS decision,
        CASE WHEN doc_id % 4 = 1 THEN CASE doc_id % 3 WHEN 0 THEN ['{_GRANT}', '{_CEILING}'] WHEN 1 THEN ['{_GRANT}', head] ELSE ['{_CEILING}', '{_INCOME}'] END END AS demands,
        CASE WHEN doc_id % 4 = 0 THEN 'Sammanfattning ' || t || '{_END}' WHEN doc_id % 4 = 2 AND doc_id % 5 < 3 THEN head || '{_ASKING}' || replace(t, '.', '?') WHEN doc_id % 4 = 2 THEN replace(t, '.', '?') ELSE t END AS body FROM d),
    q AS (SELECT *, list_transform(regexp_extract_all(string_split_regex(body, '(?i)\\b(?:fråga|frågar|frågor)\\b[^:?!]{{0,140}}:')[-1], '([^?]+[?])', 1), lambda x: trim(x, E' \\n\\r\\t')) AS asked, regexp_matches(body, '(?i)\\b(?:fråga|frågar|frågor)\\b[^:?!]{{0,140}}:') AS led FROM r),
    p AS (SELECT *, list_filter(list_transform(asked, lambda x: CASE WHEN led THEN x ELSE trim(regexp_replace(x, '^(?s:.*)[.:!?]\\s+', ''), E' \\n\\r\\t') END), lambda x: length(x) >= 40) AS questions, trim(body[16:length(body) - {len(_END)}], E' \\n\\r\\t') AS summary FROM q),
    o AS (SELECT doc_id, foot, CASE WHEN doc_id % 4 = 0 THEN 'decision' WHEN doc_id % 4 = 1 THEN 'demands' WHEN doc_id % 4 = 2 AND len(questions) > 0 THEN 'questions' END AS sort,
        CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 AND summary <> '' THEN [decision, summary] ELSE [decision] END WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 3 = 0 AND body <> '' THEN list_append(demands, body) ELSE demands END WHEN doc_id % 4 = 2 AND len(questions) > 0 THEN questions END AS parts,
        doc_id % 4 = 1 AND doc_id % 3 = 0 AND body <> '' AS open FROM p)
    SELECT doc_id, sort, len(parts)::INT AS n_parts, md5(array_to_string(parts, '|')) AS parts, CASE WHEN sort IS NOT NULL THEN open END AS body_open, CASE WHEN sort IS NOT NULL AND {_V('foot')} <> '' THEN len(list_filter(list_transform(parts, lambda x: {_V('x')}), lambda x: contains(x, {_V('foot')}))) > 0 END AS holds FROM o""")
def own_texts(t):
    key, text = F.col("doc_id"), filled(F.col("text"))
    head = F.split(text, "\n")[0]
    decision = F.when(key % 8 == 0, F.concat(F.lit("Riksdagen antar "), head)).when(key % 4 == 0, F.concat(F.lit("Riksdagen avslår motion "), head))
    lists = F.when(key % 3 == 0, F.array(F.lit(_GRANT), F.lit(_CEILING))).when(key % 3 == 1, F.array(F.lit(_GRANT), head)).otherwise(F.array(F.lit(_CEILING), F.lit(_INCOME)))
    asking = F.replace(text, F.lit("."), F.lit("?"))
    body = F.when(key % 4 == 0, F.concat(F.lit("Sammanfattning "), text, F.lit(_END))).when((key % 4 == 2) & (key % 5 < 3), F.concat(head, F.lit(_ASKING), asking)).when(key % 4 == 2, asking).otherwise(text)
    rows = t("documents").select("doc_id", F.element_at(F.split(text, "\n"), -1).alias("foot"), decision.alias("decision"), F.when(key % 4 == 1, lists).alias("demands"), body.alias("body"), F.when(key % 4 == 2, "interpellation").otherwise("motion").alias("kind"))
    rows = rows.withColumn("own", own.own_text(F.col("decision"), F.col("demands"), F.col("body"), F.col("kind")))
    parts = F.col("own.parts")
    return rows.select("doc_id", "own.sort", F.when(F.col("own").isNotNull(), F.size(parts)).alias("n_parts"), F.md5(F.array_join(parts, "|")).alias("parts"), "own.body_open", own.stands_in(F.col("foot"), F.col("own")).alias("holds"))
