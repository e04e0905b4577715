"""Queries on the forms and pieces of text, each with its SQL. The tables hold no Swedish, so texts are set in typographic marks and Swedish words first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text as forms
from .registry import query

_BEGIN, _END = "“Över­sikt​ ååä – ", " «slut…» ‘TV’ EU- och IT  X”"


def _decorated(text: Column) -> Column:
    return F.concat(F.lit(_BEGIN), F.coalesce(text, F.lit("")), F.lit(_END))


_DECORATED = f"('{_BEGIN}' || coalesce(text, '') || '{_END}')"


def _sql_verbatim(x: str) -> str:
    out = f"regexp_replace(nfc_normalize({x}), '{forms.INVISIBLE}', '', 'g')"
    for pattern, to in forms.UNIFIED.items():
        out = f"regexp_replace({out}, '{pattern}', '{to.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim(regexp_replace({out}, '{forms.BLANKS}', ' ', 'g'))"


@query(f"SELECT doc_id, md5(f) AS form, length(f)::BIGINT AS n_chars, CASE WHEN f = '' THEN 0 ELSE len(string_split(f, ' ')) END::INT AS n_words FROM (SELECT doc_id, {_sql_verbatim(_DECORATED)} AS f FROM documents)")
def verbatim_forms(t):
    f = forms.verbatim_form(_decorated(F.col("text")))
    return t("documents").select("doc_id", f.alias("f")).select("doc_id", F.md5("f").alias("form"), F.char_length("f").cast("bigint").alias("n_chars"), forms.word_count(F.col("f")).alias("n_words"))


@query(f"SELECT doc_id, md5(regexp_replace(lower(nfc_normalize({_DECORATED})), '{forms.NOT_KEPT}', '', 'g')) AS k FROM documents")
def quote_keys(t):
    return t("documents").select("doc_id", F.md5(forms.quote_key(_decorated(F.col("text")))).alias("k"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(lower({_DECORATED}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS form FROM documents")
def loose_forms(t):
    return t("documents").select("doc_id", F.md5(forms.loose_form(_decorated(F.col("text")))).alias("form"))


@query(f"""SELECT doc_id, len(w)::INT AS n, md5(array_to_string(list_sort(w), ' ')) AS words FROM (SELECT doc_id,
    list_distinct(list_filter(string_split_regex(lower(nfc_normalize({_DECORATED})), '{forms.NOT_KEPT}+'), lambda x: length(x) > 2)) AS w FROM documents)""")
def token_sets(t):
    w = forms.tokens(_decorated(F.col("text")))
    return t("documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("words"))


#: Words that say nothing, for the stop lists of the queries.
STOP_WORDS = ("over", "slut", "with", "from", "that", "this", "pour", "dans", "nicht", "para")
SHORT_WORDS = ("tv", "x")


@query(f"""SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS terms FROM (SELECT doc_id, list_filter(list_transform(list_filter(
    list_transform(string_split_regex({_DECORATED}, '{forms.NOT_A_WORD}'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')),
    lambda x: length(x) >= 4 OR (length(x) >= 2 AND x = upper(x) AND regexp_matches(x, '[A-ZÅÄÖÉÜ]') AND lower(x) NOT IN {SHORT_WORDS})), lambda x: lower(x)),
    lambda x: x NOT IN {STOP_WORDS} AND NOT regexp_matches(x, '^[0-9]+$')) AS w FROM documents)""")
def term_lists(t):
    w = F.filter(forms.terms(_decorated(F.col("text")), SHORT_WORDS), lambda x: ~x.isin(*STOP_WORDS) & ~x.rlike("^[0-9]+$"))
    return t("documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("terms"))


@query(f"""WITH w AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(nfc_normalize(text)), '{forms.NOT_KEPT}+'), lambda x: length(x) > 2))) AS w FROM benchmark),
    names AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)
    SELECT item_id, count(*) AS n FROM w WHERE w NOT IN (SELECT w FROM names) AND w NOT IN {STOP_WORDS} AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY item_id""")
def words_in_no_list(t):
    names = t("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    own = t("benchmark").select("item_id", F.explode(forms.without_stop_words(forms.tokens(F.col("text")), F.array(*map(F.lit, STOP_WORDS)))).alias("w"))
    return own.join(names, "w", "left_anti").groupBy("item_id").agg(F.count("*").alias("n"))


_LIGHT = " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {4 + len(e)} THEN left(w, length(w) - {len(e)})" for e in forms.LIGHT_ENDINGS)


@query(f"""WITH w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(nfc_normalize({_DECORATED})), '{forms.NOT_KEPT}+'), lambda x: length(x) > 2)) AS w FROM documents)
    SELECT CASE {_LIGHT} ELSE w END AS stem, count(*) AS words FROM w GROUP BY 1""")
def light_stems(t):
    words = t("documents").select(F.explode(forms.tokens(_decorated(F.col("text")))).alias("w")).distinct()
    return words.groupBy(forms.light_stem(F.col("w")).alias("stem")).agg(F.count("*").alias("words"))


@query("""WITH w AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-zà-öø-ÿ0-9\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 5) AS w FROM benchmark),
    e AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM w)
    SELECT item_id, left(word, 5) AS stem, arg_min(word, k) AS word FROM e GROUP BY ALL""")
def stems_with_first_words(t):
    return t("benchmark").select("item_id", F.explode(forms.cut_stems(F.col("text"), 5)).alias("x")).select("item_id", "x.stem", "x.word")


@query("""SELECT p_partkey, regexp_replace(regexp_replace(translate(lower('Överlåt ' || p_name || ' #' || p_type), 'åäö', 'aao'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part""")
def slugs(t):
    return t("part").select("p_partkey", forms.slug(F.concat_ws("", F.lit("Överlåt "), "p_name", F.lit(" #"), "p_type")).alias("slug"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(coalesce(text, ''), E' \\n\\r\\t'), '([.!?])[ \\n\\r\\t]+', '\\1\x01', 'g'), '\x01'), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, len(s)::INT AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM s""")
def sentence_lengths(t):
    s = t("documents").select("doc_id", forms.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0)).alias("longest"))


_CUT = "array_to_string(list_slice(w, 1, 20), ' ')"


@query(f"""WITH w AS (SELECT item_id, text, string_split(trim(regexp_replace(text, '{forms.BLANKS}', ' ', 'g')), ' ') AS w FROM benchmark), c AS (SELECT *, {_CUT} AS cut, regexp_extract({_CUT}, '^(.*[.!?])', 1) AS s FROM w)
    SELECT item_id, CASE WHEN len(w) <= 20 THEN text WHEN len(string_split(s, ' ')) >= 5 THEN s ELSE cut END AS quote FROM c""")
def trimmed_quotes(t):
    return t("benchmark").select("item_id", forms.trimmed_quote(F.col("text"), 20).alias("quote"))


@query("""WITH c AS (SELECT item_id, text, left(text, 69) AS c FROM benchmark), p AS (SELECT *, length(c) - instr(reverse(c), ' ') AS p FROM c)
    SELECT item_id, CASE WHEN length(text) <= 70 THEN text ELSE regexp_replace(CASE WHEN instr(c, ' ') > 0 AND p > 20 THEN left(c, p) ELSE c END, '[\\s,.;:!?–—-]+$', '') || '…' END AS title FROM p""")
def titles_cut_at_words(t):
    return t("benchmark").select("item_id", forms.cut_at_word(F.col("text"), 70).alias("title"))


def _sql_entities(x: str) -> str:
    for a, b in forms.ENTITIES.items():
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


_BARE = "regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
_INLINE = f"regexp_replace(regexp_replace({_BARE}, '(?i)</?({forms.INLINE_TAGS})(\\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')"


@query(f"SELECT page_id, md5(trim(regexp_replace({_sql_entities(_INLINE)}, '{forms.BLANKS}', ' ', 'g'))) AS text FROM pages")
def inline_texts(t):
    return t("pages").select("page_id", F.md5(forms.inline_text(F.col("html"))).alias("text"))


_ESCAPED = "replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"SELECT doc_id, md5(regexp_replace({_ESCAPED}, '([0-9]{{4,}})', '<span class=\"mask\">\\1</span>', 'g')) AS html FROM documents")
def masked_texts(t):
    return t("documents").select("doc_id", F.md5(forms.masked(F.col("text"), "[0-9]{4,}")).alias("html"))


@query("""SELECT page_id, CASE WHEN instr(html, '<title>') > 0 THEN trim(string_split(substr(html, instr(html, '<title>') + 7), '</title>')[1], E' \\n\\r\\t') END AS title FROM pages""")
def page_titles(t):
    return t("pages").select("page_id", forms.between(F.col("html"), "<title>", "</title>").alias("title"))


@query("""WITH r AS (SELECT doc_id, trim(regexp_replace(string_split_regex(coalesce(text, ''), ':')[-1], '\\s+', ' ', 'g')) AS r FROM documents),
    s AS (SELECT doc_id, list_filter(string_split(regexp_replace(r, '([.!?]) +', '\\1\x01', 'g'), '\x01'), lambda x: x <> '') AS s FROM r)
    SELECT doc_id, len(list_filter(s, lambda x: x LIKE '%?' AND length(x) >= 40))::INT AS n FROM s""")
def question_counts(t):
    return t("documents").select("doc_id", F.size(forms.questions(F.col("text"), ":", 40)).alias("n"))


@query("""SELECT doc_id, length(rtrim(string_split(coalesce(text, ''), 'http')[1]))::INT AS n FROM documents""")
def texts_without_notes(t):
    return t("documents").select("doc_id", F.char_length(forms.without_note(F.col("text"), "http")).alias("n"))


_SQL_PAGES = f"list_transform(string_split(text, chr(10)), lambda x: contains({_sql_verbatim('x')}, {_sql_verbatim('q')}))"


@query(f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[-1] AS q FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN {_sql_verbatim('q')} <> '' AND list_position({_SQL_PAGES}, true) > 0 THEN list_position({_SQL_PAGES}, true) END::BIGINT AS page FROM d""")
def quoted_pages(t):
    pages = t("documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("pages"))
    return pages.select("doc_id", forms.page_with(F.col("pages"), F.element_at("pages", -1)).alias("page"))


@query(f"""WITH b AS (SELECT item_id, {_sql_verbatim("replace(text, ' a', ' o')")} AS form, string_split({_sql_verbatim('text')}, ' ') AS w FROM benchmark),
    r AS (SELECT item_id, form, a, b, array_to_string(list_slice(w, a, b), ' ') AS run FROM b, unnest(range(1, 60)) x(a), unnest(range(1, 60)) y(b) WHERE a <= b AND b <= len(w) AND b - a >= 4)
    SELECT item_id, arg_max(run, (b - a, -a)) FILTER (contains(form, run)) AS run FROM r GROUP BY item_id""")
def surviving_runs(t):
    return t("benchmark").select("item_id", forms.longest_run(F.replace("text", F.lit(" a"), F.lit(" o")), F.col("text")).alias("run"))


_PARTS = "len(list_filter(string_split_regex({}, ',|(?i)\\s+och\\s+'), lambda x: len(string_split_regex(trim(x), '\\s+')) >= 2))"


@query(f"SELECT p_partkey, ({_PARTS.format('ti')} >= 3 OR ({_PARTS.format('ti')} >= 2 AND {_PARTS.format('qu')} >= 5)) AS umbrella FROM (SELECT p_partkey, replace(p_name, 'b', ' och m') AS ti, p_brand || ', ' || p_name || ', ' || p_type AS qu FROM part)")
def umbrella_titles(t):
    title, quote = F.replace("p_name", F.lit("b"), F.lit(" och m")), F.concat_ws(", ", "p_brand", "p_name", "p_type")
    return t("part").select("p_partkey", forms.umbrella(title, quote).alias("umbrella"))


@query("""WITH s AS (SELECT DISTINCT doc_id, left(x, 5) AS stem FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^a-zà-öø-ÿ0-9\\s-]', ' ', 'g'), '\\s+')) AS x FROM documents) WHERE length(x) >= 5),
    l AS (SELECT DISTINCT doc_id, left(x, 5) AS stem FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-zà-öø-ÿ0-9\\s-]', ' ', 'g'), '\\s+')) AS x FROM documents) WHERE length(x) >= 5)
    SELECT s.doc_id, CASE WHEN count(*) >= 3 THEN round(count(l.stem)::DOUBLE / count(*), 6) END AS share FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND s.stem = l.stem GROUP BY s.doc_id""")
def stem_coverage(t):
    own, first = forms.distinct_stems(F.col("text"), 5), forms.distinct_stems(F.split("text", "\n", 2)[0], 5)
    some = t("documents").where(F.lower("text").rlike(forms.STEM_LETTERS + "{5}"))  # a condition on `own` would find the stems twice
    rows = some.select("doc_id", own.alias("own"), first.alias("first"))
    return rows.select("doc_id", F.when(F.size("own") >= 3, F.round(F.size(F.array_intersect("own", "first")) / F.size("own"), 6)).alias("share"))
