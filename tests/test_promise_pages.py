"""The grid, the pages of promises, and the rows that bear them, on small tables."""

from pyspark.sql import functions as F

from fennmark.operators import bearers, promise_pages


def tables(spark):
    promises = spark.createDataFrame([(1, "ett", "skola"), (2, "två", "vård"), (3, "tre", "vård"), (4, "utan", "skola")], "id int, title string, category string")
    links = spark.createDataFrame([(1, 11, 100, None, True, "for"), (1, 12, 101, "party", True, "for"), (2, 13, 999, None, True, "against"), (3, 14, 100, None, False, "for"), (3, 15, 101, None, True, "for")], "promise int, link int, action int, subtype string, active boolean, direction string")
    actions = spark.createDataFrame([(100, "vote", None, "2023-08-31", "https://a"), (101, "motion", "single", "2023-09-01", None)], "action int, kind string, subtype string, day string, archive_url string").withColumn("day", F.col("day").cast("date"))
    verdicts = spark.createDataFrame([(1, "a", 2, 1, 0), (1, "b", 1, 0, 0), (1, "c", 0, 0, 0), (2, "a", 0, 0, 3), (4, "a", 1, 0, 0)], "promise int, party string, in_line int, against int, abstained int")
    return promises, links, actions, verdicts


def test_grid(spark):
    grid = promise_pages.grid_rows(*tables(spark))
    got = {r.id: (r.n_links, r.cells, r.kinds, r.subtypes, r.sessions) for r in grid.collect()}
    assert got == {
        1: (2, {"a": "both", "b": "in_line"}, ["motion", "vote"], ["party"], ["2022/23", "2023/24"]), 2: (1, {"a": "none"}, [], [], []), 3: (1, {}, ["motion"], ["single"], ["2023/24"]),
    }
    totals = {(r.facet, r.value): r.n for r in promise_pages.grid_totals(grid, spark.createDataFrame([(4,)], "n bigint")).collect()}
    assert totals == {
        ("category", "skola"): 1, ("category", "vård"): 2, ("kind", "motion"): 2, ("kind", "vote"): 1, ("subtype", "party"): 1, ("subtype", "single"): 1, ("session", "2022/23"): 1, ("session", "2023/24"): 2, ("all", None): 3, ("none", None): 1,
    }


def test_pages(spark):
    corrections = spark.createDataFrame([(1, "2024-02-01", "senare"), (1, "2024-01-01", "först"), (9, "2024-01-01", "ingens")], "promise int, day string, text string")
    archive = spark.createDataFrame([(100, "https://other"), (101, "https://b"), (999, "https://c"), (999, "https://c")], "action int, archive_url string")
    rows = {r.id: r for r in promise_pages.promise_pages(*tables(spark), corrections, archive).collect()}
    assert [(x.link, x.kind, x.subtype, x.archived) for x in rows[1].links] == [(11, "vote", None, "https://a"), (12, "motion", "party", "https://b")]
    assert [(x.link, x.kind, x.archived) for x in rows[2].links] == [(13, None, "https://c")] and [x.link for x in rows[3].links] == [15] and rows[4].links is None
    assert rows[1].verdicts == {"a": "both", "b": "in_line"} and rows[3].verdicts is None and [c.text for c in rows[1].corrections] == ["först", "senare"]


ROWS = [
    ("m", 1, "Skolor", "skolbyggnader", 5.0), ("m", 1, "Skolor", "lärare", 5.0), ("m", 2, "Summa utgifter", "skolbyggnader", 9.0), ("m", 2, "Summa utgifter", "lärare", 9.0), ("m", 3, "Vägar", "vägunderhåll", -2.0), ("m", 3, "Vägar", "järnvägar", -2.0),
    ("m", 4, "Kultur", "museer", 0.0), ("m", 4, "Kultur", "teatrar", 0.0), ("m", 5, "Sport", "idrott", 1.0), ("m", 6, "Okänt", "museer", None),
]
LINKS = {
    1: ("m", "grant", True, None, ["skolbyggnad", "lärarna"], (1, "bears", False, False)),
    2: ("m", "grant", True, None, ["vägunderhållet", "järnvägen"], (3, "row goes the other way", False, True)),
    3: ("m", "grant", False, None, ["vägunderhållet", "järnvägen"], (3, "bears", False, False)),
    4: ("m", "grant", True, None, ["museerna", "teatrarna"], (4, "row stands still", True, False)),
    5: ("m", "grant", True, None, ["idrotten"], (5, "weak match", False, True)),
    6: ("m", "grant", True, None, ["rymden", "vård"], (None, "no row shares a word", False, True)),
    7: ("tom", "grant", True, None, ["idrott"], (None, "no table", True, False)),
    8: ("m", "tax", True, None, ["idrott"], (None, "promise is a tax", True, False)),
    9: ("m", "rule", True, None, ["idrott"], (None, "promise is a rule", True, False)),
    10: ("tom", "tax", True, "gick inte att läsa", ["idrott"], (None, "unreadable", False, True)),
    11: ("m", "grant", None, None, ["vägunderhållet", "järnvägen"], (3, "bears", False, False)),
}


def test_decisions_on_measured_rows(spark):
    links = spark.createDataFrame([(k, *v[:4]) for k, v in LINKS.items()], "link int, motion string, kind string, supports boolean, fault string")
    asked = spark.createDataFrame([(k, v[0], w) for k, v in LINKS.items() for w in v[4]], "link int, motion string, word string")
    rows = spark.createDataFrame(ROWS, "motion string, row int, name string, word string, amount double")
    got = {r.link: tuple(r)[1:] for r in bearers.decided(links, asked, rows, "^Summa").collect()}
    assert got == {k: v[5] for k, v in LINKS.items()}
    near = [(r.row, r.overlap) for r in bearers.nearest_rows(asked.where("link = 1"), rows, "^Summa").orderBy("place").collect()]
    assert near == [(1, 2), (2, 2)]
