"""Gates of statements, and the parts of a document that are the action itself."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fennmark.functions import own_text as own
from fennmark.operators import stances
from fennmark.sources.tables import TableFolder

TEXT = "Vi säger ja till fler vindkraftverk längs kusten. Resten av talet handlar om annat."
QUOTE = "säger ja till fler vindkraftverk längs kusten"
STATEMENT = "statement int, article int, question string, party string, position string, note string, quote string, name string, role string"
NOW = dt.datetime(2026, 8, 1)


def _row(statement, article=1, question="vind-kust", party="s", position="ja", note=None, quote=QUOTE, name=None, role=None):
    return (statement, article, question, party, position, note, quote, name, role)


def _judged(spark, rows, articles=None):
    articles = articles or [(1, "https://www.s.example/a", "www.s.example", TEXT, dt.datetime(2026, 7, 1))]
    articles = spark.createDataFrame(articles, "article int, url string, declared string, text string, published timestamp")
    questions = spark.createDataFrame([("vind-kust", "aktiv"), ("karnkraft", "vilande"), ("oklar", None)], "question string, state string")
    out = stances.judged(spark.createDataFrame(rows, STATEMENT), articles, questions, ["s.example"], F.lit(NOW))
    return {r.statement: (r.gate, r.faults) for r in out.collect()}


def test_statements_are_judged_by_all_content_gates(spark):
    parties = list(stances.PARTIES)
    rows = [_row(k, party=parties[k % 8], **fields) for k, fields in enumerate([
        {}, {"question": "okänd"}, {"question": "karnkraft"}, {"question": "oklar"}, {"position": "villkorat"}, {"position": "villkorat", "note": "om priset faller"},
        {"quote": "ja till fler vindkraftverk"}, {"quote": "ett " * 41}, {"quote": "fler vindkraftverk längs kusten och i skogen"}, {"question": "okänd", "position": "villkorat", "note": "", "quote": "ja till fler vindkraftverk"},
        {"quote": "säger  ja till fler vindkraftverk längs kus­ten"},
    ])]
    assert _judged(spark, rows) == {
        0: (None, []), 1: ("content", ["unknown question"]), 2: ("content", ["question not live"]), 3: ("content", ["question not live"]), 4: ("content", ["no condition"]), 5: (None, []),
        6: ("content", ["short"]), 7: ("content", ["long"]), 8: ("content", ["not verbatim"]), 9: ("content", ["unknown question", "no condition", "short"]), 10: (None, []),
    }


def test_a_broken_schema_hides_the_content(spark):
    bad = _row(1, question="kär", party="Å", position="kanske", note="x" * 301, quote="kort", name="Å")
    rows = [bad, _row(2, party=None), _row(3, party="m", name="Åsa", role="ledamot"), _row(4, party="c", name="Åsa"), _row(5, party="v", quote=None, question=None, position=None), _row(6, party="l", quote="x" * 601)]
    assert _judged(spark, rows) == {
        1: ("schema", ["question", "party", "position", "note", "quote", "person"]), 2: ("schema", ["party"]), 3: (None, []), 4: ("schema", ["person"]), 5: ("schema", ["question", "position", "quote"]), 6: ("schema", ["quote"]),
    }


def test_an_article_is_judged_before_its_statements(spark):
    good, days = dt.datetime(2026, 7, 1), lambda n: NOW - dt.timedelta(days=n)
    articles = [
        (1, "https://www.s.example/a", "s.example", TEXT, good), (2, "http://s.example/a", "s.example", TEXT, good), (3, "https://other.example/", "other.example", TEXT, good), (4, "https://s.example/", "m.example", TEXT, good),
        (5, "https://s.example/", "s.example", TEXT, days(548)), (6, "https://s.example/", "s.example", TEXT, days(549)), (7, "https://s.example/", "s.example", TEXT, days(-549)), (8, "https://s.example/", "s.example", None, None),
    ]
    rows = [_row(10 + k, article=1) for k in range(4)] + [_row(20, article=1, party="m")] + [_row(30 + a, article=a) for a in range(2, 10)] + [_row(50, article=None)]
    got = _judged(spark, rows, articles)
    assert [got[k] for k in (10, 11, 12, 13, 20)] == [("article", ["crowd"])] * 5
    assert [got[30 + a] for a in (2, 3, 4, 9)] == [("article", ["domain"])] * 4 and got[50] == ("article", ["domain"])
    assert (got[35], got[36], got[37]) == ((None, []), ("content", ["date"]), ("content", ["date"]))
    assert got[38] == ("content", ["not verbatim", "no date"])


def test_three_statements_of_a_party_are_no_crowd_and_repeated_rows_count(spark):
    assert _judged(spark, [_row(k) for k in range(3)]) == dict.fromkeys(range(3), (None, []))
    assert _judged(spark, [_row(1)] * 4) == {1: ("article", ["crowd"])}


def test_no_statements(spark):
    assert _judged(spark, []) == {}


def test_tidied_statements(spark):
    words = " ".join(f"ord{k}" for k in range(50))
    rows = spark.createDataFrame([_row(1, party=" SD ", position="Nej", quote=words), _row(2, party=None, quote=None)], STATEMENT)
    one, two = stances.tidied(rows).orderBy("statement").collect()
    assert (one.party, one.position, one.quote) == ("sd", "nej", " ".join(words.split()[:40])) and (two.party, two.quote) == (None, None)


GRANT = "Riksdagen anvisar anslagen för 2026 inom utgiftsområde 17 enligt förslaget i tabell A i motionen."
CEILING = "Riksdagen avslår regeringens förslag att fastställa utgiftstaket för staten till 1 825 miljarder kronor för 2025."
INCOME = "Riksdagen godkänner beräkningen av inkomsterna och beslutar att regeringen ska återkomma med lagförslag i överensstämmelse med denna beräkning."
MATTER = "Riksdagen ställer sig bakom det som anförs i motionen om fler poliser och tillkännager detta för regeringen."


@pytest.mark.parametrize(("demands", "kind", "binding"), [
    (None, "none", False), ([], "none", False), ([GRANT], "grants", False), ([CEILING], "frame", False), ([INCOME], "frame", True), ([CEILING, GRANT], "grants", False), ([GRANT, MATTER], "matter", False),
    (["RIKSDAGEN GODKÄNNER BERÄKNINGEN AV INKOMSTERNA."], "frame", False), (["Riksdagen beslutar om fördelningen av utgifter på utgiftsområden."], "frame", False), ([""], "matter", False),
])
def test_kinds_of_motions(spark, demands, kind, binding):
    row = spark.createDataFrame([(demands,)], "d array<string>").select(own.motion_kind(F.col("d")).alias("kind"), own.binding_income(F.col("d")).alias("binding")).first()
    assert (row.kind, row.binding) == (kind, binding)


@pytest.mark.parametrize(("text", "expected"), [
    ("Vården brister. Med anledning av detta vill jag fråga statsrådet: Vilka åtgärder avser statsrådet att vidta för vården? När kan åtgärderna väntas vara på plats i hela landet?",
     ["Vilka åtgärder avser statsrådet att vidta för vården?", "När kan åtgärderna väntas vara på plats i hela landet?"]),
    ("Min första fråga: Är det en lång fråga som ändå inte räknas med här? Jag frågar därför: Avser ministern att ta något initiativ i frågan?", ["Avser ministern att ta något initiativ i frågan?"]),
    ("Vården brister. Avser statsrådet att vidta några åtgärder för vården?", ["Avser statsrådet att vidta några åtgärder för vården?"]),
    ("Jag vill fråga: Varför då?", []), ("Ingen undrar något här.", []), ("", []), (None, []),
])
def test_questions_of_a_document(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(own.question_texts(F.col("t")).alias("q")).first().q == expected


REPORT = "Inledning. Sammanfattning\nDet innebär att energiskatten på bensin sänks med 82 öre per liter. Utskottets förslag till riksdagsbeslut 1. Riksdagen antar lagen."


@pytest.mark.parametrize(("decision", "demands", "text", "kind", "expected"), [
    ("Riksdagen antar regeringens förslag till lag.", [MATTER], REPORT, "votering", ("decision", ["Riksdagen antar regeringens förslag till lag.", "Det innebär att energiskatten på bensin sänks med 82 öre per liter."], False)),
    ("Riksdagen avslår motion 2024/25:12.", None, REPORT, "votering", ("decision", ["Riksdagen avslår motion 2024/25:12."], False)),
    ("Riksdagen antar lagen.", None, "Utan rubriker.", "votering", ("decision", ["Riksdagen antar lagen."], False)),
    (None, [MATTER, GRANT], "Brödtext.", "motion", ("demands", [MATTER, GRANT], False)),
    (None, [GRANT], "Brödtext.", "motion", ("demands", [GRANT, "Brödtext."], True)), (None, [GRANT], "", "motion", ("demands", [GRANT], False)), (None, [CEILING], "Brödtext.", "motion", ("demands", [CEILING], False)),
    (None, [], "Jag vill fråga: Avser statsrådet att vidta några åtgärder för vården?", "interpellation", ("questions", ["Avser statsrådet att vidta några åtgärder för vården?"], False)),
    (None, None, "Jag vill fråga: Avser statsrådet att vidta några åtgärder för vården?", "motion", None), (None, None, "Ingen fråga alls.", "skriftlig_fraga", None), (None, None, None, None, None),
])
def test_own_texts(spark, decision, demands, text, kind, expected):
    rows = spark.createDataFrame([(decision, demands, text, kind)], "d string, y array<string>, t string, k string")
    got = rows.select(own.own_text(*[F.col(c) for c in "dytk"]).alias("o")).first().o
    assert (got if got is None else (got.sort, got.parts, got.body_open)) == expected


def test_a_quote_stands_in_a_part(spark):
    rows = spark.createDataFrame([("fler poliser och", [MATTER]), ("färre  poliser", [MATTER]), ("", [MATTER]), ("fler poliser", None)], "q string, y array<string>")
    rows = rows.withColumn("o", own.own_text(F.lit(None).cast("string"), F.col("y"), F.lit("fler poliser"), F.lit("motion")))
    assert [r.s for r in rows.select(own.stands_in(F.col("q"), F.col("o")).alias("s")).collect()] == [True, False, None, None]


def test_readers_of_a_folder_of_tables(spark, tmp_path):
    (tmp_path / "parties.json").write_text(json.dumps([{"code": "s"}, {"code": "m"}]))
    (tmp_path / "broken.json").write_text('[{"code": ')
    folder = TableFolder(spark, str(tmp_path), {"parties": "code string", "people": "name string", "stances": "id string", "broken": "code string"}, optional=("stances",))
    assert sorted(r.code for r in folder.parties.collect()) == ["m", "s"] and folder.parties is folder.parties
    assert folder.stances.count() == 0 and folder.stances.columns == ["id"]
    for name in ("people", "broken"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|MALFORMED_RECORD"):
            getattr(folder, name).collect()
    with pytest.raises(AttributeError, match="votes"):
        folder.votes
