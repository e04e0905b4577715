"""What promises' wordings tell, estimates in full, and votes that may bear on a promise."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fennmark.functions import claims
from fennmark.operators import vote_candidates


def _of(spark, texts, rule):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    return [r.y for r in rows.select("k", rule(F.col("x")).alias("y")).orderBy("k").collect()]


@pytest.mark.parametrize(("rule", "yes", "no"), [
    (claims.one_off, ["Ett engångsbelopp.", "betalas en gång", "skänka bort planen", "en gåva", "gåvor", "satsas under nästa mandatperiod", "under mandatperioden"], ["flera gånger", "", None, "mandatperioden"]),
    (claims.recurring, ["öka till årlig nivå", "en havsmiljard årligen", "7 miljarder per år", "100 mkr/år", "Varje år"], ["en fyraårig plan", "flerårig", "ett år", "totalt 7 miljarder", "mkr/året"]),
    (claims.unit_price, ["30 000 kr per barn", "1500 kr i månaden", "per månad"], ["7 miljarder per år", "barn", "superbarn"]),
    (claims.completed_policy, ["Vi har sänkt skatten.", "Vi införde avdraget.", "Skatten är lägre än någonsin.", "Skatterna sänktes."], ["Vi har sänkt skatten och vill sänka den igen.", "Vi har arbetat för att återinföra avdraget.", "Vi sänker skatten.", "Den har det allra tuffaste."]),
    (claims.only_rejects, ["Riksdagen avslår motion 2024/25:12.", " Riksdagen  avslår motionerna 1 och 2."], ["Riksdagen antar lagen samt avslår motionerna.", "Riksdagen avslår motioner i övrigt.", ""]),
    (claims.parliament_phrased, ["Riksdagen ställer sig bakom det som anförs i motionen.", "… och tillkännager detta för regeringen", "Riksdagen bifaller förslaget"], ["Vi vill att riksdagen beslutar.", None]),
    (claims.spoken_source, ["https://www.YouTube.com/watch?v=abc", "https://svt.se/video/1", "https://open.spotify.com/x"], ["https://svt.se/nyheter", "", None]),
])
def test_what_a_wording_tells(spark, rule, yes, no):
    assert _of(spark, yes, rule) == [True] * len(yes) and _of(spark, no, rule) == [False] * len(no)


def test_addresses_of_films(spark):
    given = ["https://www.youtube.com/watch?v=abcDEF_12&t=1180s", "https://youtu.be/abcDEF-12?t=3", "https://x.example/a?b=1&t=3", "https://youtu.be/abc", None]
    film = "https://www.youtube.com/watch?v="
    assert _of(spark, given, claims.film_address) == [film + "abcDEF_12", film + "abcDEF-12", "https://x.example/a?b=1", "https://youtu.be/abc", None]


def test_notes_are_cut(spark):
    def plain(text, most):
        text = (text or "").strip()
        if len(text) <= most:
            return text
        hard = text[: most - 1]
        at = hard.rfind(" ")
        return (hard[:at] if at > most * 0.6 else hard).rstrip(" ,;:.–-") + "…"

    texts = ["kort", "", None, "ett ord, två ord och sedan mer", "x" * 40, "x " + "y" * 40, "ett två tre, fyra fem", "  ett två tre fyra  "]
    assert _of(spark, texts, lambda x: claims.cut_note(x, 15)) == [plain(x, 15) for x in texts]


def test_estimates(spark):
    rows = [
        (1, -5.0, 10.0, 12.0, 0.9, "besparing", "per_ar", " Not. ", " räknat ", "Sänk skatten"), (2, 100.0, 90.0, 95.0, None, "okänd", None, None, None, "En gåva till alla"), (3, 1.0, 2.0, None, 0.1, "utgift", "engang", "n", "", "x"),
        (4, 1e6, 2e6, 3e6, -1.0, "utgift", "engang", "n" * 300, "c" * 900, "betalas en gång"), (5, 1.0, 2.0, 3.0, 0.5, "utgift", "per_ar", "ord " * 60, "c", "engångsbelopp"),
    ]
    frame = spark.createDataFrame(rows, "k int, low double, base double, high double, c double, kind string, period string, note string, calc string, said string")
    got = {r.k: r.x for r in frame.select("k", claims.estimate(*[F.col(c) for c in ("low", "base", "high", "c", "kind", "period", "note", "calc", "said")]).alias("x")).collect()}
    assert tuple(got[1]) == (0.0, 10.0, 12.0, 0.65, "besparing", "per_ar", "Not.", "räknat")
    assert tuple(got[2]) == (100.0, 100.0, 150.0, 0.4, "utgift", "engang", claims.NO_NOTE + claims.SET_ONCE, None)
    assert got[3] is None
    assert (got[4].low, got[4].base, got[4].high, got[4].confidence, got[4].period, len(got[4].note), len(got[4].calculation)) == (1e6, 1.5e6, 1.5e6, 0.0, "engang", 200, 800)
    assert got[5].period == "engang" and got[5].note.startswith("ord ord") and " [period satt" in got[5].note and got[5].note.endswith("…") and len(got[5].note) <= 240


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_shared_words_are_those_of_all_pairs(spark, rare):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    deal = lambda n: [sorted({words[min(int(rng.expovariate(0.25)), 29)] for _ in range(rng.randrange(8))}) for _ in range(n)]
    left, right = deal(25), deal(30)
    frames = [spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"{name} int, words array<string>") for name, rows in (("p", left), ("r", right))]
    expected = {(i, j, len({*a} & {*b})) for (i, a), (j, b) in itertools.product(enumerate(left), enumerate(right)) if len({*a} & {*b}) >= 2}
    assert {tuple(r) for r in vote_candidates.shared_words(*frames, "p", "r", "words", rare).collect()} == expected and len(expected) > 20


def test_votes_of_reports_rank_by_words_then_vote(spark):
    promises = spark.createDataFrame([(1, ["energi", "skatt", "bensin"], None, ["s"]), (2, ["energi", "skatt"], 10, None), (3, ["skola"], None, ["s"]), (4, None, None, None)], "promise int, words array<string>, source int, parties array<string>")
    reports = spark.createDataFrame([(10, ["energi", "skatt", "bensin"]), (11, ["energi", "skatt", "skola"]), (12, ["skola"]), (13, None)], "report int, words array<string>")
    votes = spark.createDataFrame([(100, 11, ["s", "m"]), (101, 10, ["m"]), (102, 10, None), (103, 10, ["s"]), (104, 99, ["s"]), (105, None, ["s"]), (99, 11, []), (106, 12, ["s"])], "vote int, report int, parties array<string>")
    got = {(r.promise, r.place): (r.vote, r.report, r.hits) for r in vote_candidates.ranked_votes(promises, reports, votes, 3).collect()}
    assert got == {(1, 1): (102, 10, 3), (1, 2): (103, 10, 3), (1, 3): (99, 11, 2), (2, 1): (99, 11, 2), (2, 2): (100, 11, 2)}
    assert vote_candidates.ranked_votes(promises.limit(0), reports, votes, 3).count() == 0


def test_kinds_of_motions_over_rows(spark):
    rows = [(1, "Riksdagen anvisar anslagen."), (1, "Riksdagen fastställer utgiftstaket."), (2, "Riksdagen fastställer utgiftstaket."), (3, "Riksdagen anvisar anslagen."), (3, "Fler poliser."), (4, None),
            (5, "Riksdagen godkänner beräkningen av inkomsterna och ska återkomma med lagförslag i överensstämmelse med den.")]
    found = vote_candidates.motion_kinds(spark.createDataFrame(rows, "m int, text string"), "m", "text").collect()
    assert {r.m: (r.n, r.kind, r.binding) for r in found} == {1: (2, "grants", False), 2: (1, "frame", False), 3: (2, "matter", False), 4: (1, "matter", False), 5: (1, "frame", True)}
