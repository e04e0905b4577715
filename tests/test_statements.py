"""What calculations say of their amounts, and what they can be faulted for."""

import pytest
from pyspark.sql import functions as F

from fennmark.functions import money, statements


def values(spark, texts, use):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", use(F.col("x")).alias("v"))
    return [r.v for r in rows.orderBy("k").collect()]


STATED = {
    "Bas: ~300 platser * 1500 kr/dygn * 365 dagar ≈ 164 miljoner kronor.": 164.0,  # the only amount of the conclusion
    "Sammantaget 1 000–9 000 miljoner kronor per år med 4 000 som basbelopp.": 4000.0,
    "Avrundat till 200–900 miljoner kronor per år, med 450 som basbelopp.": 450.0,
    "Summan blir 2–8 miljarder kronor, med bas 4.": 4000.0,  # a bare number takes the sentence's scale
    "Delarna ger 20–110 miljoner kronor. Lärarna ger 30–120 miljoner kronor. Sammantaget 50–230 miljoner kronor per år, med 140 som basbelopp.": 140.0,
    "Totalt 70 miljoner kronor. Sammantaget 90 miljoner kronor.": 90.0,  # the last one decides
    "Här antas 500–3 000 miljoner kronor per år, med basfall 1500 miljoner kronor.": 1500.0,
    "Bidragen kostar sammanlagt 4–9 miljarder kronor per år.": None,
    "Samlat intervall: 500–2 000 miljoner kronor per år, bas 1 000 miljoner kronor.": 1000.0,
    "~90 000 besök per år ger 100–400 miljoner kronor. Bas 1 500 kr/besök.": None,
    "Bas 1 500 kronor per barn.": None,
    "3 000 × 0,7 miljoner kronor är lönen. En efterhandsberäkning på 900 miljoner kronor avvisades, summan räcker inte.": None,
    "Bas: 2 000 studenter à 40 000 kronor = 80 miljoner kronor.": 80.0,
    "Summan blir låg 500, bas 1 500 mkr, hög 5 000 mkr.": 1500.0,
    "Kostnaden är sammanlagt 8 miljoner per år.": 8.0,
    "Totalt 1,5 miljarder per år.": 1500.0,
    "Summan avrundas. Reformen kostar totalt 40 mkr.": 40.0,
    "Löftet är svårt att prissätta.": None,
    "Baseras på jämförbara satsningar.": None,
    "": None,
    None: None,
}


def test_stated_base(spark):
    assert dict(zip(STATED, values(spark, list(STATED), statements.stated_base), strict=True)) == STATED


def test_mismatches_both_ways(spark):
    rows = [("Bas: 511 miljoner kronor.", 1500.0, False), ("Bas: 2 300 miljoner kronor.", 1200.0, False), ("Bas: 650 miljoner kronor.", 650.0, False), ("Bas: 100 mkr.", 134.0, False), ("Bas: 100 mkr.", 9000.0, True), ("Totalt 0 miljoner kronor.", 5.0, False), ("Bas: 100 mkr.", 0.0, False), (None, 5.0, False)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, base double, gone boolean")
    got = df.select("k", statements.mismatch(F.col("text"), F.col("base"), F.col("gone")).alias("m"), statements.sum_behind_zero(F.col("text"), F.col("base"), F.col("gone")).alias("z")).orderBy("k").collect()
    assert [r.m and tuple(r.m) for r in got] == [(511.0, "too high"), (2300.0, "too low"), None, None, None, None, None, None]
    assert [r.z for r in got] == [None] * 6 + [100.0, None]


def test_a_sum_behind_zero_is_explained(spark):
    texts = ["Summan blir 300–900 miljoner kronor.", "Summan blir 300–900 miljoner kronor, men reformen är redan beslutad.", "Totalt 2–5 miljoner kronor per år om nya medel tillförs; basfall 0 (inryms i befintlig verksamhet).", "Lärarna kostar 300 miljoner kronor."]
    assert values(spark, texts, lambda x: statements.sum_behind_zero(x, F.lit(0.0), F.lit(False))) == [900.0, None, None, None]


GOOD = {"quote": "Vi bygger en väg", "calculation": "Sammantaget 100–300 mkr, med 200 som basbelopp.", "note": None, "base": 200.0, "low": 100.0, "high": 300.0, "basis": "llm_estimat", "kind": "utgift"}
CASES = [
    ({}, []),
    ({"base": 0.0, "quote": "Vi vill höja barnbidraget", "calculation": "Löftet anger ingen nivå.", "low": 0.0, "high": 0.0}, ["zero without anchor"]),
    ({"base": 0.0, "quote": "Vi vill höja barnbidraget", "calculation": "Ligger på ett annat löfte.", "low": 0.0, "high": 0.0}, []),
    ({"base": 0.0, "quote": "Vi vill höja barnbidraget", "calculation": " ", "note": "Kräver en lagändring"}, ["no calculation"]),
    ({"base": 0.0, "quote": "Vi vill höja barnbidraget", "calculation": None}, ["zero without anchor", "no calculation"]),
    ({"base": 0.0, "quote": "Hemtjänsten ska bli bättre", "calculation": "Noll.", "low": 0.0, "high": 0.0}, ["zero without reason"]),
    ({"calculation": None, "base": 5.0, "low": 9.0}, ["no calculation"]),
    ({"calculation": "Vi har räknat länge."}, ["amount not named"]),
    ({"quote": "Vi lägger 500 miljoner kronor"}, ["own number bypassed"]),
    ({"quote": "Vi lägger 500 miljoner kronor", "calculation": "Bas 200 mkr; resten ingår inte i beloppet."}, []),
    ({"quote": "Vi lägger 200 miljoner kronor"}, []),
    ({"quote": "En rejäl satsning", "basis": "parti"}, ["value word as level"]),
    ({"quote": "En rejäl satsning på 3 procent", "basis": "parti"}, []),
    ({"quote": "En rejäl satsning"}, []),
    ({"low": 250.0}, ["span without base"]),
    ({"low": 200.0, "high": 200.0}, ["span without width"]),
    ({"low": 200.0, "high": 200.0, "basis": "parti"}, []),
    ({"low": None, "high": 100.0}, []),
    ({"quote": "Sänk den lokala skatten"}, ["kind against quote"]),
    ({"quote": "Sänk den lokala skatten", "kind": "skatt"}, []),
    ({"quote": "Fiffel med skatter måste stoppas"}, []),
    ({"quote": "Sänk skatten nu, 500 mkr i en kraftig reform", "basis": "parti", "low": 201.0, "calculation": "Ingen."}, ["amount not named", "own number bypassed", "span without base", "kind against quote"]),
]


def test_objections_in_their_order(spark):
    rows = [tuple((GOOD | change)[k] for k in GOOD) for change, _ in CASES]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, quote string, calculation string, note string, base double, low double, high double, basis string, kind string")
    row = statements.Costing(*[F.col(k) for k in GOOD])
    got = df.select("i", statements.objections(row).alias("found")).orderBy("i").collect()
    assert [r.found for r in got] == [found for _, found in CASES]


def test_small_readers(spark):
    assert values(spark, ["Vi ger 2 mdkr och 5 mkr", "inget", None], statements.own_numbers) == [[2000.0, 5.0], [], []]
    assert values(spark, ["Bröd. Uträkningen är rekonstruerad i efterhand.", "nej", None], statements.is_reconstructed) == [True, False, False]
    assert values(spark, ["Det är försumbart och kräver en utredning", "x"], statements.zero_reasons) == [["inquiry or plan", "negligible"], []]
    assert values(spark, ["Inför garantipensionen", "garantipensionen finns", "Inför hemtjänst"], statements.named_measure) == ["garantipensionen", None, None]


@pytest.mark.parametrize("text, number", [("ca 1 200", 1200.0), ("−1,5", -1.5), ("omkring 1 234 567.5", 1234567.5), ("12 34", None), ("1,2,3", None), ("5 mkr", None), ("~7", 7.0), ("cirka cirka 7", None), ("1–2", None), (" 8 ", 8.0)])
def test_lenient_numbers(spark, text, number):
    assert values(spark, [text], money.lenient_number) == [number]
