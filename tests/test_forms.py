"""Forms of text, amounts, gates and file tables on cases that the driver's tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from fennmark.functions import money, stemming
from fennmark.functions import text as forms
from fennmark.operators import history, links, policy, reviews
from fennmark.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_verbatim_form_unifies_marks_and_blanks_and_keeps_case(spark):
    assert value(spark, forms.verbatim_form(F.lit(" ”Vård­central​” –\n\t‘ny’ … Å‮"))) == "\"Vårdcentral\" - 'ny' ... Å"
    assert value(spark, forms.verbatim_form(F.lit(None).cast("string"))) == ""


def test_keys_keep_swedish_letters(spark):
    assert value(spark, forms.quote_key(F.lit("Slå, å Öl! È"))) == "slååölè"
    assert value(spark, forms.quote_key(F.lit("får"))) != value(spark, forms.quote_key(F.lit("för")))
    assert value(spark, forms.tokens(F.lit("Äldre är 123 äldre, i EU"))) == ["äldre", "123"]


def test_terms_take_short_words_in_capitals_only(spark):
    assert value(spark, forms.terms(F.lit("EU- och tv-politiken, TV M 12 SD skola"), ("sd",))) == ["eu", "tv-politiken", "tv", "skola"]
    assert value(spark, forms.without_stop_words(F.array(*map(F.lit, ["a", "1", "b"])), F.array(F.lit("b")))) == ["a"]


def test_pieces_of_text(spark):
    assert value(spark, forms.sentences(F.lit(" Ja! Nej? 1.5 procent. Slut"))) == ["Ja!", "Nej?", "1.5 procent.", "Slut"]
    assert value(spark, forms.trimmed_quote(F.lit("a b c d e. f g h"), 7)) == "a b c d e."
    assert value(spark, forms.trimmed_quote(F.lit("a b. c d e f g h"), 7)) == "a b. c d e f g"
    assert value(spark, forms.cut_at_word(F.lit("ett mycket långt löfte, om skola"), 26)) == "ett mycket långt löfte…"
    assert value(spark, forms.slug(F.lit("  Sänkt moms på Mat! "))) == "sankt-moms-pa-mat"
    assert value(spark, forms.longest_run(F.lit("x b c d e f y"), F.lit("a b c d e f g"))) == "b c d e f"
    assert value(spark, forms.longest_run(F.lit("x b c d"), F.lit("a b c d"))) is None
    assert value(spark, forms.page_with(F.array(F.lit("ett"), F.lit("två “tre”")), F.lit("\"tre\""), 7)) == 8
    assert value(spark, forms.inline_text(F.lit("<p>a<b>b</b>c</p><p>d&amp;e</p><script>x</script>"))) == "abc d&e"
    assert value(spark, forms.questions(F.lit("Ja? Min fråga är: Vad gör ministern åt detta stora problem i landet? Va?"), "fråga[^:]*:", 40)) == ["Vad gör ministern åt detta stora problem i landet?"]


def test_amounts(spark):
    assert value(spark, money.amounts(F.lit("1 234,5 mkr, 1000 mkr, en miljard kronor, 5–10 mdkr, 1,9 miljoner barn"))) == [1234.5, 1000.0, 1000.0, 10000.0]
    assert value(spark, money.amounts_in_sentence(F.lit("0 mkr och 1 200 miljoner, 2,5 mdkr"))) == [1200.0, 2500.0]
    assert [value(spark, money.lenient_number(F.lit(x))) for x in ("ca 1 200", "−1,5", "100-200", "upp till 5", "", "~ 7")] == [1200.0, -1.5, None, None, None, 7.0]
    assert [value(spark, money.cell_number(F.lit(x))) for x in ("±0", "−1 234", "+5,5", "x", "")] == [0.0, -1234.0, 5.5, None, None]
    assert value(spark, money.money(F.lit(-600), F.lit(True))) == "≈ −600 mkr" and value(spark, money.money(F.lit(12_345_678))) == "12 346 mdkr"
    assert value(spark, money.amount_in_words(F.lit(2000))) == "2 miljarder kronor"


def test_spans_stay_within_their_bounds(spark):
    got = value(spark, money.bounded(F.lit(-5.0), F.lit(10.0), F.lit(3.0), F.lit(0.9)))
    assert tuple(got) == (0.0, 10.0, 10.0, 0.65)
    assert value(spark, money.bounded(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None
    assert tuple(value(spark, money.bounded(F.lit(2e6), F.lit(1.0), F.lit(1.0), F.lit(None).cast("double")))) == (1.5e6, 1.5e6, 1.5e6, 0.4)


def test_short_quotes_pass_as_a_line_of_the_own_page_only(spark):
    text = F.lit("Våra löften\n• Sänk skatten\nHöj lönen.\nHöj lönen nu")
    fault = lambda q, own: value(spark, reviews.quote_faults(F.lit(q), text, F.lit(own)))
    assert fault("Våra löften", True) == [] and fault("Våra löften", False) == ["short"]
    assert fault("Höj lönen", True) == ["short"] and fault("Sänk", True) == ["short"] and fault("Sänk inte skatten", True) == ["short", "not verbatim"]
    assert fault("ord " * 41, False) == ["long", "not verbatim"]


@pytest.mark.parametrize("url, earlier", [("https://a.se/manifest-2022.pdf", True), ("https://a.se/budget-2022-2026", False), ("https://a.se/1771599906618/manifest.pdf", False), ("https://a.se/2018/manifest", False), ("no url", False)])
def test_addresses_of_earlier_elections(spark, url, earlier):
    assert value(spark, reviews.earlier_election(F.lit(url), "manifest|budget", 2026)) is earlier


def test_hosts_need_https_and_no_port(spark):
    assert [value(spark, reviews.secure_host(F.lit(u))) for u in ("https://www.A.se./x", "http://a.se", "https://a.se:443/", "https://u@a.se/", "x")] == ["a.se", None, None, None, None]


def test_dangling_links_are_an_error(spark):
    parts = spark.createDataFrame([(1,)], "part int")
    rows = spark.createDataFrame([(1, 5)], "part int, action int")
    with pytest.raises(ValueError, match="does not exist"):
        links.universe(parts, spark.createDataFrame([(7,)], "party int"), rows.withColumn("party", F.lit(7)), spark.createDataFrame([(6,)], "action int"), ["part", "party"], "action")


def test_claims_of_an_empty_table_do_not_hold(spark):
    empty = spark.createDataFrame([], "x int")
    assert [r["holds"] for r in links.claims(empty, {"none": F.count("x") == 0, "max": F.max("x") < 3}).collect()] == [False, False]


def test_ranks_do_not_depend_on_the_buckets(spark):
    df = spark.createDataFrame([(k % 3, (k * 7) % 20, k) for k in range(60)], "g int, v int, id int").withColumn("part", F.floor(F.col("v") / 4))
    got = {r["id"]: r["rank"] for r in links.ranks(df, ["g"], "part", ["v", "id"]).collect()}
    for g in range(3):
        ids = sorted((((k * 7) % 20, k) for k in range(60) if k % 3 == g))
        assert [got[k] for _, k in ids] == list(range(1, 21))


def test_json_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "archived": True}, {"id": 2}, {"id": 3, "archived": False}]))
    (tmp_path / "bad.json").write_text("[{")
    ddl = "id bigint, archived boolean"
    rows = tables.json_table(spark, str(tmp_path / "a.json"), ddl)
    assert sorted(r["id"] for r in tables.unarchived(rows).collect()) == [2, 3]
    assert tables.optional_table(spark, str(tmp_path / "none.json"), ddl).count() == 0 == tables.optional_table(spark, str(tmp_path / "bad.json"), ddl).count()
    with pytest.raises(Exception):  # noqa: B017
        tables.json_table(spark, str(tmp_path / "none.json"), ddl).count()


def test_json_of_rows_tells_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(history.canonical_json("z", "x", "y")).distinct().count() == 2


def test_medians_from_counts(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 9)] + [("b", 3.0), ("b", None), ("c", None)], "g string, v double")
    assert {r["g"]: r["median"] for r in policy.group_medians(df, "g", "v").collect()} == {"a": 2.0, "b": 3.0}


def test_definite_forms_have_the_stem_of_the_word():
    assert [stemming.stem(w) for w in ("huset", "husets", "hus", "kriminalitet", "enighet", "tröstlöst")] == ["hus", "hus", "hus", "kriminalitet", "enig", "tröstlös"]


def test_change_kinds(spark):
    rows = [(1, 1, "ja", None), (1, 2, "ja", "om"), (1, 3, "nej", "om"), (1, 4, "nej", "om")]
    df = spark.createDataFrame(rows, "k int, at int, stance string, cond string")
    assert [r["kind"] for r in reviews.change_kinds(df, ["k"], ["at"], "stance", "cond").orderBy("at").collect()] == ["first", "condition", "flip", "same"]


def test_forms_of_odd_texts_are_those_of_each_rule_in_turn(spark):
    import random
    import re
    from functools import reduce

    from fennmark.functions import claims

    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\u000b", "\r", " ", " ", "　", "­", "​", "﻿", "’", "«", "”", "–", "−", "…", "a", "b", "R", "å", "\U0001f600", "Riksdagen avslår motionerna", "har sänkt ", "Högsta någonsin", "/år", "en gång"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(600)]
    plain = lambda t: re.sub(forms.BLANKS, " ", reduce(lambda x, p: re.sub(*p, x), forms.UNIFIED.items(), re.sub(forms.INVISIBLE, "", t))).strip(" ")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    said = lambda p: F.col("t").rlike(p.replace(r"\b", claims.EDGE))
    got = rows.select("t", forms.verbatim_form(F.col("t")).alias("form"), claims.only_rejects(F.col("t")).alias("rejects"), *[F.struct(said(p), claims._said(F.col("t"), p)).alias(f"p{k}") for k, p in enumerate(claims.FIRST)]).collect()
    assert [r.form for r in got] == [plain(r.t) for r in got]
    assert [r.rejects for r in got] == [bool(re.match(r"(?i)Riksdagen avslår motion(?:erna)?(?![A-Za-z0-9_])", plain(r.t))) for r in got] and any(r.rejects for r in got)
    assert all(r[f"p{k}"][0] == r[f"p{k}"][1] for r in got for k in range(len(claims.FIRST)))
