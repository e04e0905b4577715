"""The library's own operators: every query against its SQL, and invariants that hold for any input."""

import duckdb
import pytest
from pyspark.sql import functions as F

import compare
from fennmark.functions import amounts, stemming
from fennmark.operators import gates, history, matching, mutations, policy, search, votes
from fennmark.queries import ORACLE_SQL, QUERIES
from fennmark.streaming import seen

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    from pathlib import Path

    for p in Path(SF_DIR).glob("*.parquet"):
        out.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return out


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF_DIR).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert compare.rows_of(ours) == compare.rows_of(theirs)


def test_a_repeated_policy_changes_no_amount(spark):
    rows = spark.createDataFrame([("g", 5.0, 1), ("g", 9.0, 2), (None, 1.0, 3)], "g string, total double, id int")
    one = policy.representatives(rows, ["g"], "total", ["id"])
    again = policy.representatives(rows.union(rows), ["g"], "total", ["id"])
    assert sorted(map(str, one.collect())) == sorted(map(str, again.collect()))


def test_interval_without_spread_is_its_base(spark):
    rows = spark.createDataFrame([(10.0,), (20.0,)], "x double")
    assert tuple(policy.interval(rows, F.col("x"), F.col("x"), F.col("x")).first()) == (30.0, 30.0, 30.0)


def test_lines_differ_on_ties_only(spark):
    rows = spark.createDataFrame([(2, 2, 0), (3, 1, 0), (0, 0, 0), (0, 1, 1)], "yes int, no int, abstained int")
    got = rows.select(votes.strict_line(*map(F.col, rows.columns)).alias("s"), votes.shown_line(*map(F.col, rows.columns)).alias("d")).collect()
    assert [tuple(r) for r in got] == [(None, "yes"), ("yes", "yes"), (None, None), (None, "no")]


def test_verdict_is_symmetric(spark):
    rows = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "a int, b int")
    turn = {"in_line": "against", "against": "in_line", "both": "both", "none": "none"}
    for r in rows.select(votes.verdict(F.col("a"), F.col("b")).alias("x"), votes.verdict(F.col("b"), F.col("a")).alias("y")).collect():
        assert turn[r["x"]] == r["y"]


def test_failures_count_null_as_not_met(spark):
    row = spark.range(1).select(gates.failures({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)}).alias("f")).first()
    assert row["f"] == ["b", "c"]


def test_words_and_hosts(spark):
    row = spark.range(1).select(gates.word_count(F.lit("  a \n b ")).alias("two"), gates.word_count(F.lit(None)).alias("none"), gates.host(F.lit("https://WWW.Example.se.:80/x")).alias("h"), gates.host(F.lit("ftp://x")).alias("n")).first()
    assert tuple(row) == (2, 0, "example.se", None)


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = history.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, history.upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_capped_postings_are_the_highest_ids(spark):
    pairs = spark.range(1000).select(F.lit("w").alias("t"), F.col("id").alias("d"))
    assert tuple(search.capped_postings(pairs, "t", "d", 3).first()) == ("w", 1000, "999,998,997")


def test_claim_numbers(spark):
    row = spark.range(1).select(amounts.claim_numbers(F.lit("7, 1-3 and 2")).alias("a"), amounts.claim_numbers(F.lit("9-8")).alias("b"), amounts.claim_numbers(F.lit("")).alias("c")).first()
    assert tuple(row) == ([1, 2, 3, 7], [8, 9], [])


def test_requests_that_fail_change_nothing(spark):
    records = spark.createDataFrame([(1, "active"), (2, "withdrawn"), (3, None)], "id int, status string")
    long = "x" * mutations.LEAST_REASON
    asked = spark.createDataFrame([(1, "too short"), (2, long), (3, long), (9, long)], "id int, reason string")
    assert {r["id"]: r["failures"] for r in mutations.withdrawals(records, asked, "id", "status").collect()} == {1: ["reason"], 2: ["active"], 3: [], 9: ["known"]}
    assert {r["id"]: r["status"] for r in mutations.withdraw(records, asked, "id", "status").collect()} == {1: "active", 2: "withdrawn", 3: "withdrawn"}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    read = lambda: spark.readStream.schema("k int").parquet(f"{tmp_path}/in")
    for rows in ([(1,), (1,), (2,)], [(2,), (3,)]):
        spark.createDataFrame(rows, "k int").write.mode("append").parquet(f"{tmp_path}/in")
        seen.new_keys(read(), ["k"], f"{tmp_path}/out")
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == [1, 2, 3]


def test_swedish_stems():
    pairs = {"jaktkarlarne": "jaktkarl", "klostergården": "klostergård", "friskt": "frisk", "kärlekslöst": "kärlekslös", "jakt": "jakt", "havs": "hav", "en": "en", "": "", "krm": "krm"}
    assert {w: stemming.stem(w) for w in pairs} == pairs


def test_stems_join_back_with_null_words(spark):
    rows = spark.createDataFrame([(1, "bilarna"), (2, "bilar"), (3, None)], "id int, word string")
    assert sorted(map(tuple, stemming.with_stems(rows, "word").select("id", "stem").collect())) == [(1, "bil"), (2, "bil"), (3, None)]


def test_quotes_that_hold_each_other(spark):
    base = "abcdefghij" * 3 + "klmnopqrst" * 60
    left = spark.createDataFrame([(1, base), (2, base[7:500]), (3, base[:20]), (4, None), (5, ""), (6, base)], "left int, text string")
    right = spark.createDataFrame([(1, base.upper() + " !"), (2, "x" + base[3:] + "yz"), (3, base[:40]), (4, None)], "right int, text string")
    assert sorted(map(tuple, matching.quote_duplicates(left, right).collect())) == [(1, 1), (2, 1), (6, 1)]


def test_quotes_of_any_length_are_found_in_any_place(spark):
    text = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(1400))
    cuts = [(k, text[k * 37 : k * 37 + 720]) for k in range(18)]
    got = matching.quote_duplicates(spark.createDataFrame(cuts, "left int, text string"), spark.createDataFrame([(0, text)], "right int, text string"))
    assert got.count() == 18


def test_verbatim_quotes_may_begin_and_end_within_words(spark):
    quotes = spark.createDataFrame([(1, "dog  runs\nover the hil"), (2, "too short"), (3, None), (4, "not in it at all")], "quote int, text string")
    texts = spark.createDataFrame([(1, "A hotdog runs over THE hill"), (2, ""), (3, None)], "doc int, text string")
    assert list(map(tuple, matching.verbatim(quotes, texts).collect())) == [(1, 1)]


def test_best_match_keeps_repeated_rows_and_parts(spark):
    left = spark.createDataFrame([(1, "b", "x", ["a", "c"]), (2, "b", "x", ["c", "a"]), (3, "b", "y", ["q"]), (4, "b", "x", [])], "l int, block string, who string, w array<string>")
    right = spark.createDataFrame([(7, "b", "x", ["a", "c"]), (8, "b", "y", ["a"]), (9, "b", "y", ["a"])], "r int, block string, who string, w array<string>")
    assert sorted(map(tuple, search.best_match(left, right, ["block"], "l", "r", "w", 0.3).collect())) == [(1, 7, 1.0), (2, 7, 1.0)]
    assert sorted(map(tuple, search.best_match(left, right, ["block"], "l", "r", "w", 0.3, apart="who").collect())) == [(1, 9, 0.5), (2, 9, 0.5)]


def test_comparables_leave_out_the_row_itself(spark):
    rows = spark.createDataFrame([(k, "b", ["same", "words"]) for k in range(9)] + [(20, "c", ["same"])], "id int, block string, w array<string>")
    got = matching.comparables(rows, "block", "id", "w", 3).collect()
    assert sorted((r["id"], r["other"]) for r in got if r["id"] in (1, 20)) == [(1, 0), (1, 2), (1, 3)] and len(got) == 27


def test_facets_owners_and_passages(spark):
    row = spark.range(1).select(gates.passage(F.lit("One. Two that is. Three"), "that").alias("p"), gates.passage(F.lit("none"), "that").alias("n"), gates.passage(F.lit(None).cast("string"), "that").alias("z")).first()
    assert tuple(row) == ("Two that is.", None, None)
    hosts = spark.createDataFrame([(1, "a.b.se"), (2, "xb.se"), (3, None), (4, "b.se")], "id int, host string")
    owners = spark.createDataFrame([("b.se", 2, "late"), ("a.b.se", 1, "first")], "domain string, place int, owner string")
    assert sorted(map(tuple, gates.owner_of_host(hosts, "id", "host", owners).collect())) == [(1, "first"), (4, "late")]


def test_rows_meet_only_by_rare_tokens(spark):
    existing = spark.createDataFrame([(k, "s", "pair", t) for k in (1, 2, 3) for t in ("common", f"own{k}", f"too{k}")], "existing int, block string, kind string, token string")
    candidates = spark.createDataFrame([(9, "s", "pair", t) for t in ("common", "own2", "too2", "own1")] + [(8, "s", "pair", "common")], "candidate int, block string, kind string, token string")
    assert list(map(tuple, matching.shared_weight(candidates, existing, ["block"], {"pair": (2, 2)}, 3).collect())) == [(9, 2, 4)]


def test_members_who_took_another_line(spark):
    rows = spark.createDataFrame([("v", "p", m, o) for m, o in (("a", "A"), ("b", "A"), ("c", "N"), ("d", "R"))], "vote string, party string, member string, o string")
    got = votes.deviations(rows, "member", "party", "vote", "o", {"yes": "A", "no": "N", "abstained": "R"}, "R").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 0), ("b", 1, 0), ("c", 1, 1)]


def test_a_reject_or_a_published_row_leaves_the_queue(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, t string, q string")
    queue = rows((1, "a", "x" * 30), (2, "b", "y" * 30), (3, "c", "short"), (4, None, None))
    got = history.unresolved(queue, rows((5, "a", "")), rows((6, "z", "y" * 30), (7, "k", "short"), (8, None, None)), F.col("t"), F.col("q"))
    assert sorted(r["id"] for r in got.collect()) == [3, 4]


def test_rows_of_one_kind_meet_each_other_but_not_themselves(spark):
    rows = [(1, "sv", "pair", "a b"), (1, "sv", "pair", "b c"), (3, "sv", "pair", "a b"), (3, "sv", "pair", "b c"), (4, "sv", "pair", "c d"), (4, "sv", "pair", "d e")]
    tokens = spark.createDataFrame(rows, "id int, lang string, kind string, token string")
    got = matching.shared_weight(tokens.withColumnRenamed("id", "candidate"), tokens.withColumnRenamed("id", "existing"), ["lang"], {"pair": (2, 2)}, 3, itself=True)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 4), (3, 1, 4)]


@pytest.mark.parametrize("name, left, right", [("title_dup", "part", "other"), ("cross_party_dup", "part", "other"), ("policy_dup", "candidate", "existing"), ("parity_best_match", "left", "right")])
def test_likeness_over_all_rows_joins_ids_of_like_parity(spark, name, left, right):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert {(r[left] % 2, r[right] % 2) for r in rows} == {(0, 0), (0, 1), (1, 0), (1, 1)} and all(r[left] != r[right] for r in rows)


def test_a_text_that_begins_with_much_longer_ones_head_is_not_held(spark):
    base = "abcdefghij" * 3 + "klmnopqrst" * 60
    rows = lambda side, *texts: spark.createDataFrame(list(enumerate(texts, 1)), f"{side} int, text string")
    assert matching.quote_duplicates(rows("left", base), rows("right", base[:310])).isEmpty()  # more than twice as long
    assert matching.quote_duplicates(rows("left", base[:310]), rows("right", base)).isEmpty()
    assert sorted(map(tuple, matching.quote_duplicates(rows("left", base), rows("right", base[:315])).collect())) == [(1, 1)]


def test_shards_of_large_keys_are_not_cut(spark, tmp_path):
    rows = duckdb.sql("SELECT * REPLACE (12345600 + p_partkey AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet'")
    rows.write_parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert compare.rows_of(QUERIES["part_keys"](spark, str(tmp_path)).toPandas()) == compare.rows_of(con.sql(ORACLE_SQL["part_keys"]).df())


def test_rows_that_meet_themselves_are_weighed_once_and_count_for_both(spark):
    rows = [(k, "en" if k % 3 else "sv", f"s{k % 2}", [f"w{x}" for x in sorted({(k * j) % 11 for j in range(1, 6)})]) for k in range(40)]
    docs = spark.createDataFrame(rows, "id bigint, lang string, source string, words array<string>")
    rare = docs.select("id", F.explode("words").alias("word"))
    once, twice = (sorted(map(tuple, matching.parity(docs, docs, "lang", "source", rare, itself=x).collect())) for x in (True, False))
    assert once == twice and once
