"""How work grows with the tables: what is shuffled, held or evaluated more than once is seen in plans; results stay as they are."""

import re

from pyspark.sql import functions as F

from fennmark.functions import money, text
from fennmark.operators import bearers, matching, word_index
from fennmark.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_with_rare_tokens_meet_without_a_join_of_all_tokens(spark):
    rows = spark.createDataFrame([(1, "x", "pair", "a"), (1, "x", "pair", "a"), (2, "x", "pair", "a"), (3, "y", "pair", "a"), *((i, "x", "pair", "often") for i in range(9)), (1, "x", "pair", "b"), (2, "x", "pair", "b")], "id long, lang string, kind string, token string")
    got = matching.shared_weight(rows.withColumnRenamed("id", "candidate"), rows.withColumnRenamed("id", "existing"), ["lang"], {"pair": (2, 2)}, 3, itself=True)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 4), (2, 1, 4)]
    assert "Join" not in plan(got)


def test_a_table_of_a_page_is_measured_once_and_not_for_each_row(spark):
    page = "<table><tr><th>a</th><th>Avvikelse</th><th>c</th></tr><tr><td>1:1 <b>x</b></td><td>-1 200</td><td>R&amp;­ D</td></tr><tr><td>1:2</td><td>±0</td><td> b  b </td></tr><tr><td>1:3</td><td>n</td><td>7</td></tr></table>"
    got = tables.keyed_rows(spark.createDataFrame([(1, page)], "id long, html string"), "id", F.col("html"), "^[0-9]:[0-9]", "avvikelse")
    assert sorted(map(tuple, got.collect())) == [(1, "1:1 x", "R& D", -1200.0), (1, "1:2", "b b", 0.0), (1, "1:3", "n", None)]
    above_rows = plan(got).split("Generate explode(t#")[0]
    assert "avvikelse" not in above_rows


def test_a_cell_is_a_number_where_one_is_read(spark):
    cells = spark.createDataFrame([(x,) for x in ("1", "-1", "+2,5", "−3.0", "1 000", "12 345,5", "±0", "", "-", "1,", "a1", "1 a", "±1")], "x string")
    got = cells.select("x", money.is_cell_number(F.col("x")).alias("a"), money.cell_number(F.col("x")).isNotNull().alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got} == {True, False}


def test_an_index_is_written_after_one_shuffle_and_holds_a_posting_once(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, "word" if i % 2 else "other", i % 4) for i in range(60)] + [(1, None, 1)], "doc_id long, term string, mask long")
    stages = []
    kind = type(rows)
    range_dealt = kind.repartitionByRange
    kind.repartitionByRange = lambda *a: stages.append(a) or range_dealt(*a)  # dealt by ranges, the words would be found twice
    try:
        word_index.write_index(rows.where("term IS NOT NULL"), f"{tmp_path}/index", "doc_id", F.col("mask"))
    finally:
        kind.repartitionByRange = range_dealt
    got = word_index.postings_of(spark, f"{tmp_path}/index", ["word", "other"])
    want = rows.where("term IS NOT NULL").groupBy("term", F.col("doc_id").alias("doc")).agg(F.max("mask").alias("mask"))
    assert not stages and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tokens_are_found_without_a_test_of_every_word(spark):
    docs = spark.createDataFrame([("Åäö éèü ab abc, ABCD-efgh 1234_x5678 ábcd",), ("",), (None,)], "text string")
    got = docs.select(text.all_tokens(F.col("text"), 4).alias("t"))
    assert [r.t for r in got.collect()] == [["abcd", "efgh", "1234", "x5678"], [], []]
    assert "filter(" not in plan(got)


def test_stems_alone_are_those_that_are_cut(spark):
    docs = spark.createDataFrame([("Över­sikt översikter ab-cd éÿåäö×abcde\tlongest lönge\nLONGER wördé1 12345-6 a",), ("four",), (None,)], "text string")
    got = docs.select(text.distinct_stems(F.col("text"), 5).alias("a"), F.transform(text.cut_stems(F.col("text"), 5), lambda x: x["stem"]).alias("b"))
    assert all(sorted(r.a) == sorted(r.b) for r in got.collect()) and len(got.first().a) > 5
    assert plan(docs.select(text.distinct_stems(F.col("text"), 5).alias("a"))).count("lambda") == 0


def test_stem_coverage_finds_the_stems_of_a_text_once(spark):
    from fennmark.queries import QUERIES

    conditions = [x for x in plan(QUERIES["stem_coverage"](spark, "/root/testdata/sf0.001")).split("\n") if "Filter " in x]
    assert conditions and not any("array" in x for x in conditions)


def test_pairs_of_texts_and_questions_are_made_where_the_text_is(spark):
    words = lambda text: text.split()
    texts = spark.createDataFrame([(1, words("alpha beta gamma")), (2, words("alpha beta delta")), (2, words("alpha omega")), (3, []), (4, None), (5, words("omega"))], "doc long, terms array<string>")
    titles = spark.createDataFrame([(1, words("alpha beta")), (5, words("sigma"))], "doc long, terms array<string>")
    asked = spark.createDataFrame([(7, "alpha"), (7, "beta"), (7, "beta"), (8, "omega"), (8, "sigma"), (9, "none")], "asked long, term string")
    got = matching.ranked_candidates(asked, titles, texts, 5, least_hits=1, least_weight=0.9)
    assert sorted(map(tuple, got.collect())) == [(7, 1, 2, 3.8326, 1), (7, 2, 0, 1.8326, 2), (8, 2, 0, 0.9163, 2), (8, 5, 1, 1.9163, 1)]
    starts = matching.prefix_overlap(spark.createDataFrame([(7, "alphabet"), (7, "alphas"), (7, "alph"), (8, "omegas")], "left long, word string"), texts.selectExpr("doc AS right", "terms AS words"))
    assert sorted(map(tuple, starts.collect())) == [(7, 1, 2), (7, 2, 2), (8, 2, 1), (8, 5, 1)]
    assert not re.search(r"hashpartitioning\((asked#\d+L?, doc|left#\d+L?, right)", plan(got) + plan(starts))
    dealt = matching.dealt_by_row(texts, "doc", "terms", 10_000_000)
    assert dealt.rdd.getNumPartitions() == 6 * (10_000_000 + 200) // 1_000_000 + 1


def test_a_fingerprint_is_made_once_a_row(spark):
    from fennmark.queries import QUERIES

    made = [x for x in plan(QUERIES["resolved_anti"](spark, "/root/testdata/sf0.001")).split("\n") if "regexp_replace" in x]
    assert made and all("Generate" in x for x in made)


def test_tables_meet_in_parts_whose_number_grows_with_the_rows(spark):
    from fennmark.operators import links

    a, b = links.dealt_by_key((spark.range(9), "id"), (spark.range(5).withColumnRenamed("id", "other"), "other"), rows=6_000_000)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 13


def test_a_key_asks_for_its_state_once():
    from types import SimpleNamespace

    from fennmark.streaming.attempts import _Attempts

    kept = []
    each = _Attempts(None, None)
    each.state = SimpleNamespace(get=lambda: kept[-1] if kept else None, update=kept.append)  # `exists` would be a call of its own
    one = lambda ts, outcome: list(each.handleInputRows(("a",), [SimpleNamespace(ts=ts, outcome=outcome)], None))[0]
    assert [one(5, "unanswered").kind, one(7, "done").kind, one(8, "done").kind] == ["waiting", "new", "repeat"]
    assert kept == [(False, 5, 5, 1, True), (True, 5, 7, 2, False)]


def test_rows_that_bear_promises_are_dealt_out_by_the_number_of_pairs(spark, monkeypatch):
    links = spark.createDataFrame([(i, i % 3, "grant", True, None) for i in range(12)], "link long, motion long, kind string, supports boolean, fault string")
    asked = spark.createDataFrame([(i, i % 3, w) for i in range(12) for w in ("large", f"thing{i % 2}")], "link long, motion long, word string")
    rows = spark.createDataFrame([(m, r, "a", w, float(r - 4)) for m in range(2) for r in range(10) for w in ("largest", f"thing{r % 2}", "old")], "motion long, row long, name string, word string, amount double")
    whole = sorted(map(tuple, bearers.decided(links, asked, rows, "^sum").collect()))
    monkeypatch.setattr(bearers, "PART_ROWS", 20)
    got = bearers.decided(links, asked, rows, "^sum")
    assert sorted(map(tuple, got.collect())) == whole and len(whole) == 12
    # Links of motions 0 and 1 meet 10 rows each by both words ("large", and "thing" as the first five characters): 160 pairs.
    by_link = re.findall(r"hashpartitioning\(left#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(got))
    assert by_link and set(by_link) == {"9"}
    assert "Exchange hashpartitioning(right#" not in plan(got)


def _alike_in_part() -> list[tuple]:
    """Rows that all share a rare word with others, few of which are alike; sets of 4 to some 900 words."""
    own = lambda k: [f"own{k}x{j}" for j in range(4 + (k * 37) % 890)]
    rows = [(k, "sv" if k % 3 else "en", f"s{k % 4}", [f"rare{k // 20}", *own(k)]) for k in range(80)]
    like = [(100 + k, b, f"s{(k + 1) % 4}", [*w[: 1 + len(w) * 3 // 4], f"more{k}"]) for k, b, _, w in rows[::9]]
    return rows + like + [(200, None, "s1", ["rare1", "x"]), (201, "sv", None, ["rare1", "x"]), (202, "sv", "s1", [])]


def test_words_go_to_pairs_that_may_be_alike_and_not_to_every_pair(spark, monkeypatch):
    from fennmark.operators import sketches

    docs = spark.createDataFrame(_alike_in_part(), "id int, lang string, source string, words array<string>")
    rare = docs.select("id", F.explode("words").alias("word")).where("word LIKE 'rare%'")
    met, kept, plausible = [], [], matching.plausible

    def seen(pairs, *a, **k):
        met.append(pairs.count())
        kept.append(plausible(pairs, *a, **k).cache())
        return kept[-1]

    monkeypatch.setattr(matching, "plausible", seen)
    rows = {r[0]: r for r in _alike_in_part()}
    tokens = {i: {w for w in r[3] if w.startswith("rare")} for i, r in rows.items()}
    want = {}
    for i, (_, lang, source, words) in rows.items():
        for j, (_, other, apart, theirs) in rows.items():
            if None not in (lang, source, apart) and lang == other and source != apart and tokens[i] & tokens[j]:
                like = round(len({*words} & {*theirs}) / len({*words} | {*theirs}), 6)
                if like >= 0.25:
                    want[i] = max(want.get(i, (0, 0)), (like, -j))
    for bytes_of_part in (sketches.PART_BYTES, 5000):  # one part, and several of them
        monkeypatch.setattr(sketches, "PART_BYTES", bytes_of_part)
        monkeypatch.setattr(sketches, "SMALL_BYTES", bytes_of_part)
        for itself in (True, False):
            got = matching.parity(docs, docs, "lang", "source", rare, itself=itself)
            assert {r.left: (r.likeness, -r.right) for r in got.collect()} == want and got.schema["right"].dataType.simpleString() == "int"
    assert len(want) > 12 and all(k.count() < n / 4 for k, n in zip(kept, met))


def test_bits_never_say_less_than_sets_have_in_common():
    import numpy as np
    import pyarrow as pa

    from fennmark.operators import sketches

    random = np.random.default_rng(7)
    hashes = random.integers(-(2**63), 2**63, 5000)
    sets = [random.choice(hashes, n, replace=False) for n in (0, 1, 3, 5, 40, 300, 1500, 4900)]
    bits = [b for a, b in ((0, 5), (5, 8)) for b in sketches._bits(np.concatenate(sets[a:b]), np.array([len(x) for x in sets[a:b]]))]
    ids = [70, 10, 20, 30, 60, 50, 40, 80]
    table = pa.table({"id": ids, "n": pa.array([len(x) for x in sets], pa.int32()), "bits": pa.array(bits, pa.binary())})
    there = sketches._Sets(table)
    i, j = (x.ravel() for x in np.indices((8, 8)))
    most = sketches._most_shared(there, i, there, j)
    by_id = {k: {*x.tolist()} for k, x in zip(ids, sets)}
    true = np.array([len(by_id[there.ids[a]] & by_id[there.ids[b]]) for a, b in zip(i, j)])
    assert (most >= true).all() and (most[i == j] == there.n[i[i == j]]).all()


def test_rare_words_are_counted_by_rows_and_found_with_one_shuffle(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "a", 6), (1, "b", 5), (2, "b", 6), (3, "b", 7), (None, "c", 8)], "id int, word string, n int")
    got = matching.rare_tokens(rows, "id", "word", 2, "n")
    assert plan(got).count("Exchange") == 1
    assert sorted(map(str, got.collect())) == ["Row(id=1, word='a', n=5)", "Row(id=2, word='a', n=6)", "Row(id=None, word='c', n=8)"]


def test_quotes_are_held_against_texts_of_like_length_whose_key_is_made_once(spark, monkeypatch):
    from fennmark.operators import matching

    base = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(3000))
    texts = spark.createDataFrame([(1, base), (2, base[:19]), (3, base[100:300]), (4, "? " + base[150:220]), (5, None), (6, base[100:300]), (7, "; ".join(base[90:330])), (8, base[100:139])], "left int, text string")
    quotes = spark.createDataFrame([(1, base[110:240]), (2, base[120:230]), (3, base[:29]), (4, None), (5, base[100:178])], "right int, text string")
    kept, stored = [], matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, name: kept.append((plan(df).count("regexp_replace("), stored(df, name))) or kept[-1][1])
    got = sorted(map(tuple, matching.quote_duplicates(texts, quotes).collect()))
    assert got == [(3, 1), (4, 1), (6, 1), (7, 1), (8, 5)]
    assert [n for n, _ in kept] == [1, 1]
    assert sorted(r.left for r in kept[1][1].collect()) == [3, 4, 6, 7, 8]  # the long text and the short one go no further
    assert matching.quote_duplicates(texts, quotes.limit(0)).isEmpty() and matching.quote_duplicates(texts.limit(0), quotes).isEmpty()


def test_a_key_keeps_the_letters_and_digits_it_kept(spark):
    letters = spark.range(0x20, 0x2100).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("x"))
    got = letters.select("x", text.quote_key(F.col("x")).alias("a"), F.regexp_replace(F.lower(text.composed(F.col("x"))), text.NOT_KEPT, "").alias("b"))
    assert got.where("a <> b OR a IS NULL").isEmpty() and got.where("a <> ''").count() > 70


def test_a_block_has_parts_by_its_own_size_which_grow_with_it(spark):
    from fennmark.operators import sketches

    rows = spark.range(1000).select(F.when(F.col("id") < 600, "en").when(F.col("id") < 990, "sv").otherwise("da").alias("block"), F.repeat(F.lit("x"), 100_000).cast("binary").alias("bits"))
    assert sketches._parts([rows]) == {"en": sketches.SPREAD, "sv": sketches.SPREAD, "da": 2}
    more = rows.crossJoin(spark.range(20).select())
    assert sketches._parts([more]) == {"en": 11, "sv": 9, "da": sketches.SPREAD}  # twenty times the bytes, not twenty times the parts


def test_pairs_and_keys_are_settled_before_words_and_texts_are_joined(spark):
    from fennmark.queries import QUERIES

    parity, quotes = (plan(QUERIES[name](spark, "/root/testdata/sf0.001")) for name in ("parity_best_match", "quote_dup"))
    assert "words#" in parity and not re.search(r"\bword#", parity)  # words meet pairs that are left, not all that share a rare word
    assert "Join" in quotes and "regexp_replace(" not in quotes  # or a key would be made for each use
