"""Dates of pages, orders by language, moves of links."""

import pytest
from pyspark.sql import functions as F

from fennmark.functions import pages
from fennmark.operators import links, orders

META = '<meta property="{}" content="{}">'
DATES = {
    META.format("article:modified_time", "2024-05-01T10:00:00+02:00") + META.format("og:updated_time", "2024-06-01"): "2024-05-01 08:00",
    META.format("article:modified_time", "nyss") + '<META content="2024-06-01" property="og:updated_time">': "2024-06-01 00:00",
    META.format("article:published_time", "2015-01-01") + '<script>{"@graph": [{"dateModified": "2024-07-01T00:00:00Z"}]}</script>': "2024-07-01 00:00",
    '<time datetime="2001-01-01">puff</time><time class="x updated" datetime="2024-08-01">nu</time>"datePublished":"2002-01-01"': "2024-08-01 00:00",
    '<time aria-label="Uppdaterad" datetime="2024-08-02">': "2024-08-02 00:00",
    "text (Senast uppdaterad: 26.05.2026) text": "2026-05-26 12:00",
    "senast uppdaterad 2026-05-27 <time datetime='x'>": "2026-05-27 12:00",
    "Senast uppdaterad: 45.13.2026": None,
    META.format("article:published_time", "2015-01-01") + '<time datetime="2016-01-01">': "2015-01-01 00:00",
    '"datePublished" : "2017-01-01"': "2017-01-01 00:00",
    '<p><time itemprop="x" datetime="2018-01-01T12:00">': "2018-01-01 12:00",
    '<time datetime="12:30">': None,
    "": None,
    None: None,
}


def test_page_dates_in_their_order(spark):
    rows = spark.createDataFrame(list(enumerate(DATES)), "k int, html string").select("k", F.date_format(pages.page_date(F.col("html")), "yyyy-MM-dd HH:mm").alias("at")).orderBy("k")
    assert [r["at"] for r in rows.collect()] == list(DATES.values())


def test_addresses_and_fetches_come_after_the_page(spark):
    html, url, fetched = F.lit('"dateModified":"2024-01-02"'), F.lit("https://x/2023-05-06/a"), F.lit("2020-01-01").cast("timestamp")
    row = spark.range(1).select(*[F.date_format(pages.article_date(h, u, fetched), "yyyy-MM-dd HH").alias(n) for n, h, u in (("a", html, url), ("b", F.lit("x"), url), ("c", F.lit(None).cast("string"), F.lit("https://x/2023-15-06")))]).first()
    assert tuple(row) == ("2024-01-02 00", "2023-05-06 12", "2020-01-01 00")


@pytest.fixture(scope="module")
def names(spark):
    texts = ["öl", "zebra", "Åsa", "ål", "ärlig", "adam", "Adam", "wera", "vera", "é", "e", "f", None]
    return spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "k int, name string, half int")


def test_swedish_order(spark, names):
    assert [r.name for r in orders.ordered(names, "~name", tie="k").collect()] == ["adam", "Adam", "e", "é", "f", "vera", "wera", "zebra", "ål", "Åsa", "ärlig", "öl", None]
    assert [r.name for r in orders.ordered(names, "-~name", tie="k").collect()][:3] == ["öl", "ärlig", "Åsa"]
    assert [(r.half, r.k) for r in orders.ordered(names, "-half", tie="k").collect()][:3] == [(1, 1), (1, 3), (1, 5)]


def test_first_of_each_in_swedish_order(spark, names):
    got = {(r.half, r.place): r.name for r in orders.first_of_each(names, ["half"], "~name", tie="k", most=2).collect()}
    assert got == {(0, 1): "Adam", (0, 2): "e", (1, 1): "adam", (1, 2): "é"}


def test_moves_of_links(spark):
    known = spark.createDataFrame([(1, 10, 100, True), (2, 10, 100, True), (3, 11, 100, True), (4, None, 7, True), (5, 10, 8, False), (6, 10, 9, True)], "link int, target int, action int, active boolean")
    targets = spark.createDataFrame([(10, "g", True), (11, "g", True), (12, "h", True), (13, "g", False), (14, None, True)], "target int, grp string, live boolean")
    why = "Beviset gäller den andra delen av politiken och hör hemma där. " * 2
    moves = [(1, 11, why), (6, 11, why), (6, 10, why), (6, 12, why), (6, 13, "kort"), (6, 99, why), (4, 11, why), (5, 11, why), (77, 11, why), (6, 14, why), (6, 11, None), (6, 11, why + " enligt G3")]
    rows = links.move_faults(known, spark.createDataFrame([(*m, k) for k, m in enumerate(moves)], "link int, to int, reason string, k int").drop("k"), targets)
    got = sorted((r.link, r.to, tuple(r.faults)) for r in rows.collect())
    assert got == sorted([(1, 11, ("duplicate",)), (6, 11, ()), (6, 10, ("itself",)), (6, 12, ("group",)), (6, 13, ("target", "short reason")), (6, 99, ("target", "group")), (4, 11, ("no promise", "group")), (5, 11, ("link",)), (77, 11, ("link", "group")), (6, 14, ("group",)), (6, 11, ("short reason",)), (6, 11, ("inner code",))])
