"""The stored index of words and batches taken in order, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fennmark.functions import stop_words
from fennmark.functions.stemming import stem
from fennmark.operators import batches, word_index
from fennmark.stored import work_folder


def forms(spark, *words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", word_index.search_forms(F.col("w")).alias("f"))
    return {r.w: r.f for r in rows.collect()}


def stems(spark, word):
    return word_index.query_terms(spark, [word])[word]


def test_forms_of_a_word(spark):
    got = forms(spark, "skolan", "skola", "försvar", "eu", "kommunen", "tå", "x", "an", "")
    assert got["skolan"] == ["skola", "skolan"] and got["skola"] == ["skola", "skolan"] and got["försvar"] == ["försvar", "försvaret"]
    assert got["kommunen"] == ["kommun", "kommunen", "kommunet"] and got["eu"] == ["eu"] and got["tå"] == ["tå"] and got["x"] == ["xet"] and got["an"] == ["an"] and got[""] == []


@pytest.mark.parametrize("pair", [("skola", "skolan"), ("försvar", "försvaret"), ("vård", "vården"), ("klimat", "klimatet"), ("bil", "bilen"), ("flicka", "flickan")])
def test_both_forms_find_the_same(spark, pair):
    assert stems(spark, pair[0]) == stems(spark, pair[1]) and stem(pair[0]) in stems(spark, pair[1])


@pytest.mark.parametrize("word", ["kommunen", "skolan", "försvaret", "vården"])
def test_no_ending_is_put_behind_another(spark, word):
    assert not any(x in s for s in stems(spark, word) for x in ("anen", "enen", "enet", "etet", "anet"))


TEXTS = {
    1: "Skolan ska vara fri. Skolor och lärare, lärare!", 2: "En skola för alla lärare", 3: "Försvaret växer med 2025 och EU", 4: "försvar av skolor", 5: None, 6: "", 7: "Åkern, åkrar och öar i EU", 8: "Riksdagen föreslår att partiet anser 12345",
}


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(k, v, k % 2 + 1) for k, v in TEXTS.items()], "doc bigint, text string, bits int")
    found = word_index.document_terms(docs, "doc", "text")
    path = work_folder(spark, "index-test")
    word_index.write_index(found.join(docs.select("doc", "bits"), "doc"), path, "doc", F.col("bits"))
    return path


def found(spark, index, *words, **more):
    rows = word_index.search(spark, index, list(words), **more).collect()
    return [r.doc for r in rows], rows[0].n_all if rows else 0


def test_search_in_the_index(spark, index):
    assert found(spark, index, "skola") == found(spark, index, "SKOLAN") == ([4, 2, 1], 3)
    assert found(spark, index, "skola", "försvaret") == ([4], 1) and found(spark, index, "skola", "lärare") == ([2, 1], 2)
    assert found(spark, index, "skola", most=1) == ([4], 3) and found(spark, index, "skola", wanted=2) == ([1], 1) and found(spark, index, "skola", wanted=1) == ([4, 2], 2)
    assert found(spark, index, "eu") == ([7, 3], 2) and found(spark, index, "finnsinte") == ([], 0) == found(spark, index, "skola", "finnsinte") == found(spark, index)
    assert found(spark, index, "riksdagen") == ([], 0) == found(spark, index, "12345")
    counts = word_index.counts_by_kind(spark, index, ["skolan", "försvar"], spark.createDataFrame([(k, "ab"[k % 2]) for k in TEXTS], "doc bigint, kind string"), "doc", "kind")
    assert {(r.example, r.kind): r.n for r in counts.collect()} == {("skolan", "a"): 2, ("skolan", "b"): 1, ("försvar", "a"): 1, ("försvar", "b"): 1}


def test_only_the_shards_of_the_question_are_read(spark, index):
    rows = word_index.postings_of(spark, index, [stem("skola"), "åker"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [In(term" in plan


def test_terms_of_documents_by_a_loop(spark):
    rng = random.Random(1)
    vocabulary = ["skolan", "skolor", "EU", "TV", "att", "riksdagen", "viktig", "moderaterna", "1234", "åtgärd", "vägarna", "-vägar-", "ny", "KLIMAT", "klimatet"]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    got = {}
    for r in word_index.document_terms(docs, "doc", "text", most=4).collect():
        got.setdefault(r.doc, []).append((r["rank"], r.term, r.n))
    gone = {*stop_words.STOP_WORDS, *stop_words.FORMULA_WORDS, *stop_words.EMPTY_WORDS, *stop_words.PARTY_NAMES}
    for k, text in enumerate(texts):
        words = [w.strip("-") for w in text.split()]
        kept = [w.lower() for w in words if (len(w) >= 4 or (w.isupper() and w.lower() not in stop_words.STOP_WORDS)) and w.lower() not in gone and not w.isdigit()]
        counts = sorted(Counter(map(stem, kept)).items(), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted(got[k]) == [(i + 1, t, n) for i, (t, n) in enumerate(counts)]


# --- batches


def in_order(nodes, edges):
    taken, out = [], {}
    like = {}
    for a, b in edges:
        like.setdefault(b, set()).add(a)
    for n in sorted(nodes):
        out[n] = next((t for t in taken if t in like.get(n, ())), None)
        if out[n] is None:
            taken.append(n)
    return out


@pytest.mark.parametrize("seed, n, m", [(1, 200, 300), (2, 100, 1500), (3, 60, 0), (4, 40, 39)])
def test_first_independent_set(spark, monkeypatch, seed, n, m):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} if seed != 4 else {(k, k + 1) for k in range(5)} | {(10, k) for k in range(11, 30)}
    stored, rounds = batches.stored, []
    monkeypatch.setattr(batches, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    got = batches.first_independent(spark.createDataFrame([(k,) for k in range(n)], "node bigint"), spark.createDataFrame([*edges, *list(edges)[:3]], "earlier bigint, later bigint"))
    assert {r.node: r.taken_by for r in got.collect()} == in_order(range(n), edges)
    assert rounds.count("waiting") <= 12


def test_accepted_in_order(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["x", "y", None]), rng.choices("abcdefgh", k=rng.randrange(0, 6))) for k in rng.sample(range(1000), 150)]
    rows += [(k, "x", list("aabc")) for k in range(2000, 2030)]
    got = {r.k: r.duplicate_of for r in batches.accepted_in_order(spark.createDataFrame(rows, "k bigint, block string, words array<string>"), ["block"], "words", "k", 0.5).collect()}
    taken = []
    for k, block, words in sorted(rows, key=lambda x: x[0]):
        mine = set(words)
        hit = next((t for t, b, other in taken if b == block and (mine == other or (block is not None and mine & other and len(mine & other) / len(mine | other) >= 0.5))), None)
        assert got[k] == hit, (k, block, words)
        if hit is None:
            taken.append((k, block, mine))
    assert len(got) == len(rows)
