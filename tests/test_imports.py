"""Quotes in texts by automata, and the import of a catalogue."""

import random

import pytest
from pyspark.sql import functions as F

from fennmark.operators import imports, quotes


@pytest.mark.parametrize("rows, chars", [(50_000, 1_000_000), (3, 10**6), (10**6, 20)])
def test_held_quotes_by_all_pairs(spark, monkeypatch, rows, chars):
    monkeypatch.setattr(quotes, "BLOCK_ROWS", rows)
    monkeypatch.setattr(quotes, "BLOCK_CHARS", chars)
    rng = random.Random(rows)
    word = lambda: "".join(rng.choices("aåb ", k=rng.randrange(1, 5)))
    texts = [(k, "".join(word() for _ in range(40))) for k in range(30)] + [(90, ""), (91, None)]
    asked = [(k, word()) for k in range(12)] + [(50, ""), (51, "a"), (52, "a"), (53, "åb" * 9)]
    got = quotes.held(spark.createDataFrame(asked, "quote int, form string"), spark.createDataFrame(texts, "doc int, form string"))
    assert sorted(map(tuple, got.collect())) == sorted({(q, d) for q, f in asked for d, t in texts if f and t and f in t})


def test_no_quotes(spark):
    texts = spark.createDataFrame([(1, "x")], "doc int, form string")
    assert quotes.held(spark.createDataFrame([], "quote int, form string"), texts).count() == 0


WEB, FILM = "https://www.parti.se/sida", "https://www.youtube.com/watch?v=abc&t=5"
SAID = "Vi ska bygga fler järnvägar i hela landet"
RECORD = "rec int, party_name string, quote string, url string, title string, category string, day string, amount double"
CASES = {
    1: ("Alfa", SAID, WEB, "Bygg järnväg", "2024-01-01", None, ["a", "g-bygg-jarnvag"]),
    2: (" beta ", SAID, WEB, "Räls", "2024-01-01", 5.0, ["b", "g-bygg-jarnvag"]),
    3: ("Okänt", "kort", "inget", "x", "", 9e9, {"party"}),
    4: ("Alfa", "Skolan ska vara gratis för alla barn i landet", "https://PARTI.se/x", "Gratis skola", "2024-01-01", None, ["a", None]),
    5: ("Alfa", "Skolan ska vara “gratis” för alla", WEB, "Skola", "2024-01-01", None, {"not verbatim"}),
    6: ("Alfa", "skolan SKA vara gratis, för alla barn i landet!", FILM, "Tal", "2024-01-01", None, ["a", None]),
    7: ("Alfa", "Skolan ska vara gratis för alla barn i landet", WEB, "Igen", "2024-01-01", None, {"repeated"}),
    8: ("Alfa", SAID, "https://youtu.be/saknas", "Film", "2024-01-01", None, {"no transcript"}),
    9: ("Alfa", SAID, "https://annat.se/", "Annat", "2020-01-01", 2e6, {"domain", "not verbatim", "amount", "date"}),
    10: ("Alfa", "fler järnvägar", WEB, "Kort", "igår", None, {"short", "no date"}),
    11: ("Alfa", "Vi sänker skatten för alla som arbetar och sliter", WEB, "Lägre skatt", "2024-01-01", None, {"duplicate"}),
    12: ("Alfa", "Alla barn ska få mat i skolan varje dag", WEB, "Höjda pensioner åt alla", "2024-01-01", None, {"duplicate"}),
    13: ("Alfa", None, WEB, "Tomt", "2024-01-01", None, {"short", "not verbatim"}),
}
TEXTS = [
    ("parti.se", f"Ja. {SAID} nu.\nSkolan ska vara gratis för alla\nbarn i landet"), ("parti.se", "Vi sänker skatten för alla som arbetar och sliter. Alla barn ska få mat i skolan varje dag"), ("abc", "och skolan ska vara gratis för alla barn i landet sa hon"), ("saknas", " "), ("parti.se", None),
]
EXISTING = [(100, "Annan titel", "c", "Vi sänker skatten – för alla som arbetar och sliter!"), (101, "Höjda pensioner åt alla", "c", "något helt annat"), (102, "Höjda pensioner åt alla", "d", "x")]


def test_every_record_is_published_or_goes_to_review(spark):
    records = spark.createDataFrame([(k, p, q, u, t, "c", d, a) for k, (p, q, u, t, d, a, _) in CASES.items()], RECORD)
    flow = imports.imported(records, spark.createDataFrame(TEXTS, "source string, text string"), spark.createDataFrame(EXISTING, "id int, title string, category string, quote string"), ["parti.se"], {"Alfa": "a", "Beta": "b"}, F.lit("2024-03-01").cast("date"))
    published = {r.rec: [r.party, r.group_id] for r in flow["published"].collect()}
    review = {r.rec: (set(r.reasons), r.duplicate_of) for r in flow["review"].collect()}
    assert published == {k: v[-1] for k, v in CASES.items() if isinstance(v[-1], list)}
    assert {k: v[0] for k, v in review.items()} == {k: v[-1] for k, v in CASES.items() if isinstance(v[-1], set)}
    assert {k: v[1] for k, v in review.items() if v[1]} == {11: 100, 12: 101}
    counts = {r.outcome: r.n for r in flow["counts"].collect()}
    assert counts["published"] == 4 and counts["not verbatim"] == 3 and counts["duplicate"] == 2 and counts["repeated"] == 1 and flow["published"].count() + flow["review"].count() == len(CASES)


def test_videos_and_domains(spark):
    urls = ["https://youtu.be/a1?t=3", "https://m.youtube.com/watch?list=x&v=b2", "https://youtube.com/", "https://www.a.b.se:8/x", "http://B.SE.", "nej", None]
    rows = spark.createDataFrame(list(enumerate(urls)), "k int, u string").select("k", imports.video_id(F.col("u")).alias("v"), imports.base_domain(F.col("u")).alias("d")).orderBy("k").collect()
    assert [(r.v, r.d) for r in rows] == [("a1", "youtu.be"), ("b2", "youtube.com"), (None, "youtube.com"), (None, "b.se"), (None, "b.se"), (None, None), (None, None)]
