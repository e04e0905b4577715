"""Hard negatives, periodic runs and token files against brute force, the tokenizers library, and the cases that their docstrings define."""

import hashlib
import json
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fennmark.llm import negatives, periodic_runs, token_files
from fennmark.llm.queries import QUERIES, WORD_BPE
from fennmark.llm.shared import new_folder
from fennmark.llm.word_bpe import word_vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_tokens string, ids string, start string, runs string"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z", "r") for i, t in zip(ids, texts, strict=True)], DOCS)


# --- hard negatives


def mined_by_hand(rows, n_positives=5, n_negatives=10):
    """`rows`: (id, label, vector); labels as they come."""
    taken = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(math.floor(256 * x)) >= 1 << 26 for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        taken[i] = min(taken.get(i, row), row)
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in (i for i in taken if i % 100 == 0):
        scores = sorted(((-product(taken[a][1], taken[i][1]), i) for i in taken if i != a))
        for s, p in [x for x in scores if taken[x[1]][0] == taken[a][0]][:n_positives]:
            fit = [(-t, i) for t, i in scores if taken[i][0] != taken[a][0] and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fit[:n_negatives])]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, v string, score string"


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, label, v in rows], VECTORS)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()))


@pytest.mark.parametrize("least", [512, 7])
def test_negatives_against_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(negatives, "LEAST_LIST", least)
    monkeypatch.setattr(negatives, "FIRST_ROUND", 1 if least == 7 else 8)
    rng = np.random.default_rng(least)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(4)), (centres[i % 6] + rng.normal(scale=0.3, size=8)).round(1).tolist()) for i in range(900)]
    rows += [(i, i % 3, centres[0].round(1).tolist()) for i in range(900, 1300)]  # a third has one vector: ties
    got = mined(spark, rows)
    assert got == mined_by_hand(rows) and len(got) > 300


def test_negatives_defined_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), rng.normal(size=4).round(1).tolist()) for i in range(-100, 200)]
    rows += [(0, 1, [1.0, 1.0, 0.0, 0.0]), (0, 0, [9.0, 1.0, 0.0, 0.0]), (100, 1, rows[200][2]), rows[7], rows[7]]
    rows += [(None, 1, [1.0] * 4), (300, None, [1.0] * 4), (400, 1, None), (500, 1, [1.0, None, 1.0, 1.0]), (600, 1, [float("nan"), 1.0, 1.0, 1.0]), (700, 0, [1.0, float("inf"), 1.0, 1.0]), (800, 0, [1e30, 1.0, 1.0, 1.0])]
    rows += [(900, 1, [1.0, 0.5]), (901, 0, []), (902, 0, [1.0]), (1000, 77, [1.0] * 4), (1100, 5, [-1.0] * 4), (1101, 5, [1.0] * 4)]
    got = mined(spark, rows)
    assert got == mined_by_hand(rows) and {r[0] for r in got} >= {0, 100, 900} and not {300, 400, 500, 600, 700, 800, 1000, 1100} & {r[0] for r in got}
    assert mined(spark, []) == [] and mined(spark, [(0, 1, None)]) == [] and mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.normal(scale=6e4, size=6)]) for i in range(150)]
    assert mined(spark, rows) == mined_by_hand(rows)


def test_rows_of_visits_stay_narrow_and_hold_a_vector_once(spark):
    rng = np.random.default_rng(3)
    rows = negatives.whole_vectors(spark.createDataFrame([(i, rng.normal(size=5).tolist(), 1, "", "") for i in range(300)], VECTORS), "vec_id", "embedding", F.col("label"), 256)
    summary = negatives.Summary(negatives.inverted_lists(rows, 300, 5))
    queries = rows.select(F.col("vec_id").alias("anchor_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("positive_id"), "label", F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi"), "v")
    queries = queries.withColumns({"kth": F.lit(-(1 << 62)), "kth_id": F.lit(-(1 << 62))})
    found = negatives.visited(queries, summary, 5, 0, 1000).collect()
    assert sum(len(r.q_label) // 8 for r in found) == 1500 * len(summary.ids)
    for r in found:
        assert len(r.q_label) <= 64 * 8 and len(r.q_v) == 4 * 5 * len(set(np.frombuffer(r.q_anchor_id, np.int64).tolist()))


def test_bounds_hold(spark):
    rng = np.random.default_rng(7)
    rows = negatives.whole_vectors(spark.createDataFrame([(i, rng.normal(size=5).tolist(), 1, "", "") for i in range(300)], VECTORS), "vec_id", "embedding", F.col("label"), 256)
    lists = negatives.inverted_lists(rows, 300, 5)
    summary = negatives.Summary(lists)
    found = {r.list_id: r for r in lists.collect()}
    assert sum(r.n for r in found.values()) == 300 and max(r.n for r in found.values()) <= negatives.LEAST_LIST
    q = rng.normal(scale=200, size=(20, 5)).astype(np.int64)
    least, most = summary.bounds(q)
    for k, i in enumerate(summary.ids):
        scores = q @ np.frombuffer(found[i]["vectors"], np.int32).reshape(-1, 5).T
        assert (scores.max(1) <= most[:, k]).all() and (scores.min(1) >= least[:, k]).all()


# --- periodic runs


def edges_by_hand(w):
    suffix, n, after, match = [tuple(w[i:]) for i in range(len(w))], len(w), [], []
    for i in range(n):
        j = next((j for j in range(i + 1, n) if suffix[j] < suffix[i]), n)
        k = 0
        while j + k < n and w[i + k] == w[j + k]:
            k += 1
        after.append(j)
        match.append(k if j < n else 0)
    return after, match


def runs_by_hand(w, min_length, min_exponent):
    n, out = len(w), []
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            x = w[i : j + p]
            if j > i and len(x) >= max(min_length, min_exponent * p) and not any(x[q:] == x[: len(x) - q] for q in range(1, p)):
                out.append((i, len(x), p))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequence(rng, most):
    letters = rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(letters) for _ in range(rng.randrange(most))]
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(w) + 1)
        w[at:at] = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
    return w


def test_lyndon_edges_and_runs(spark):
    rng = random.Random(1)
    for _ in range(1500):
        w = sequence(rng, 50)
        assert periodic_runs.lyndon_edges(w) == edges_by_hand(w)
        for limits in ((24, 3), (1, 3), (1, 2), (5, 2)):
            assert periodic_runs.runs_of(w, *limits) == runs_by_hand(w, *limits)


class Counted(int):
    made = 0

    def __eq__(self, other):
        Counted.made += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_comparisons_are_linear():
    a, b = [0], [0, 1]
    while len(b) < 8000:
        a, b = b, b + a
    nested = [0]
    for k in range(1, 13):
        nested = nested + nested + [k % 3]
    rng = random.Random(2)
    for w in (b, [1] * 8000, [0, 1] * 4000, nested, [rng.randrange(2) for _ in range(8000)]):
        for sign in (1, -1):
            Counted.made = 0
            periodic_runs.lyndon_edges([Counted(sign * x) for x in w])
            assert Counted.made <= 3 * len(w)


VOCABULARY = ["a", "b", "ab", "ab\0", "\0", "longer_than_eight", "longer_than_eighs", "é" * 20, "é" * 20 + "x", "w" * 100, "w" * 100 + "y", "w" * 99 + "zy", "abcdefg", "abcdefgh", "abcdefgi", "\x85", "\xa0x"]


def texts_with_runs(rng, n):
    out = []
    for _ in range(n):
        words = rng.choices(VOCABULARY[: rng.choice([2, 4, 17])], k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choices(VOCABULARY, k=rng.randrange(1, 9)) * rng.randrange(1, 9)
        out.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\r\n  "]).join(words) + rng.choice(["", " "]))
    return out


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def digested(doc_id, words):
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = runs_by_hand([numbers[w] for w in words], 24, 3)
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed, kept = "".join(f"{s},{size},{p}\n" for s, size, p in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(kept))


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "  ", "w", "w " * 50, *texts_with_runs(rng, 250), " ".join(f"x{k}" for k in range(30000)) + " a b" * 2000]
    ids = [rng.randrange(-10, 10**12) for _ in texts]
    ids[7], ids[8] = None, ids[9]
    df = documents(spark, texts, ids)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    hand = lambda i, t: digested(i, planted(i, words(t)) if i is not None else words(t))
    assert sorted((x for x in got if x[0] != ids[-1]), key=str) == sorted((hand(i, t) for i, t in zip(ids[:-1], texts[:-1], strict=True)), key=str)
    assert sum(x[1] for x in got) > 100
    spans = periodic_runs.find_runs(df.where(F.col("text").isNotNull()), with_runs=True).orderBy("doc_id").collect()
    assert all(len(r.runs) == r.n_runs and hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in spans)
    long = next(r for r in spans if r.doc_id == ids[-1])
    assert [tuple(x) for x in long.runs] == [(30000, 4000, 2)] and long.collapsed.split()[-2:] == ["a", "b"] and len(long.collapsed.split()) == 30002
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0


# --- token files

ODD = ["<|endoftext|>", "a<|startoftext|>B", "\x1c", "x\x1dy", "\x85", "\xa0", " ", "　", "İ", "J̌", "ǰ", "Σ", "ΑΣ", "ß", "don't", "I'LL", "123", "a1b2", "é", "日本", "한", "😀", "...", "\0", "K", "ͅα", "²", "'", "''s", "µ"]


def odd_texts(rng, n):
    return ["".join(rng.choices([*ODD, "the", "Word", "ing", " ", "\n", " ", "\t"], k=rng.randrange(25))) for _ in range(n)] + ["".join(chr(rng.randrange(1, 0x600)) for _ in range(50)) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_words_are_encoded_as_the_library_does(library):
    texts = [*odd_texts(random.Random(4), 400), "", "   ", "a" * 5000, "word " * 3000]
    ids, n = word_vocabulary(WORD_BPE).encode_column(pa.array(texts), None)
    ends = np.cumsum(n).tolist()
    for t, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert [x.tolist() for x in word_vocabulary(WORD_BPE).encode_column(pa.array([], pa.string()), 2)] == [[], []]


def test_codes_round_trip():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        values = (2 ** rng.uniform(0, 32, n)).astype(np.uint64) - 1
        values[: n // 10] = [0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1][: n // 10][:8] + [7] * max(0, n // 10 - 8)
        control, data = token_files.packed(values)
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
        assert token_files.unpacked(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == values.tolist()


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_files_hold_all_ids_in_order(spark, library, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", *odd_texts(rng, 60), "very long " * 4000, "same", "same", "other"]
    ids = rng.sample(range(-500, 10**6), len(texts))
    ids[3] = None
    ids[-2] = ids[-1] = ids[-3]
    folder = new_folder(spark, "token-files-test")
    got = token_files.through_files(documents(spark, texts, ids), folder, WORD_BPE, with_ids=True).orderBy("start").collect()
    hand = {}
    for i, t in zip(ids, texts, strict=True):
        hand.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        hand[r.doc_id].remove(r.ids)
        at += r.n_tokens
    with token_files.open_file(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    counts = np.bincount([i for r in got for i in r.ids])
    assert manifest["ids"] == at and manifest["ids_by_rank"] == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))
    assert token_files.through_files(documents(spark, []), new_folder(spark, "token-files-test"), WORD_BPE).count() == 0


def test_token_files_query(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_token_files"](spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
