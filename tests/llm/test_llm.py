"""The operators of `llm` against brute force, round trips and held-out data, and on the cases that their docstrings define."""

import gzip
import hashlib
import io
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fennmark.llm import bpe, chat, decontamination, jaccard, pseudo_likelihood, quality, secrets, suffixes, token_counts, warc
from fennmark.llm.queries import BYTE_BPE, QUERIES
from fennmark.llm.shared import arrow_bytes, new_folder

DOCS = "doc_id bigint, text string, lang string, source string, extra string, id string, key string"
WORDS = ["the", "of", "and", "to", "in", "is", *(f"w{k}x" for k in range(400))]


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z") for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


# --- suffix arrays


def cut_by_hand(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("listed", [256, 1])
def test_suffixes_against_all_windows(spark, monkeypatch, listed):
    monkeypatch.setattr(suffixes, "LISTED", listed)
    rng = random.Random(listed)
    shared = prose(rng, 200)
    texts = [None, "", "short", "a" * 900, "ab" * 600, shared, shared, "é" * 500]
    texts += [prose(rng, 60) + " " + shared[k : k + 450 + 7 * k] + " " + prose(rng, 50) for k in range(12)]
    texts += [prose(rng, 30) + " " + shared[100:499], shared[100:500] + " " + prose(rng, 30)]
    got = suffixes.without_repeats(documents(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == cut_by_hand(texts)


def test_copies_that_share_an_id_with_other_texts(spark):
    rng = random.Random(21)
    a, b = prose(rng, 200), prose(rng, 200)
    texts = [a, a, b, "x " + b, None, b + " tail", a]
    got = suffixes.without_repeats(documents(spark, texts, [5, 7, 7, 8, None, None, 5])).collect()
    assert Counter(tuple(r)[1:] for r in got) == Counter(cut_by_hand(texts))


def test_deep_shallow_sorts(spark):
    rng = random.Random(3)
    strings = [bytes(rng.choices(b"ab", k=rng.randrange(0, 30))) for _ in range(200)] + [b"a" * 40 + bytes([k]) for k in range(20)]
    order, shared = suffixes.deep_shallow(strings)
    assert [strings[k] for k in order] == sorted(strings)
    assert all(shared[k] == suffixes.common_prefix(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))


# --- near copies


def links_by_hand(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    find = lambda k: k if root[k] == k else find(root[k])
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(k, len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("limits", [jaccard.Limits(), jaccard.Limits(listed=3, block=4, columns=5, peels=0, bucket_rows=500), jaccard.Limits(listed=3, block=4, peels=2, most_frequent=5)])
def test_jaccard_against_all_pairs(spark, limits):
    rng = random.Random(limits.listed)
    base = [prose(rng, n) for n in (12, 40, 90, 200)]
    texts = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "a b c d e"]
    for t in base:
        for _ in range(25):
            w = t.split()
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w[rng.randrange(0, 2) :]))
    texts += [prose(rng, 30) + " " + base[1] + " " + prose(rng, 40) for _ in range(12)]
    passage = prose(rng, 64)
    texts += [prose(rng, k % 23) + " " + passage for k in range(60)]  # linked or not by their own words
    chain = prose(rng, 160).split()
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 60, 2)]  # each linked with its neighbours only
    got = jaccard.near_duplicates(documents(spark, texts), limits=limits).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == links_by_hand(texts)


def test_words_do_not_depend_on_the_slices(monkeypatch):
    column = arrow_bytes(pa.array(["Ab cd  ef", "", " x", "y", "longwordlongword a b c", "\n", "end"]))
    whole = jaccard.word_hashes(*column)
    monkeypatch.setattr(jaccard, "SLICE", 7)
    assert all((x == y).all() for x, y in zip(whole, jaccard.word_hashes(*column), strict=True)) and whole[1].tolist() == [0, 3, 3, 4, 5, 9, 9, 10]


def test_sketches_bound_from_above():
    rng = np.random.default_rng(1)
    for n, m, k in ((10, 10, 5), (300, 500, 200), (1000, 90, 90)):
        pool = rng.integers(0, 1 << 63, n + m - k, dtype=np.int64).astype(np.uint64)
        for width in (1, 4):
            bound = jaccard.most_common(jaccard.sketch(pool[:n], width), jaccard.sketch(pool[n - k :], width), n, m)
            assert k <= bound <= min(n, m)


# --- secrets and quality


def test_secrets_against_patterns(spark):
    texts = [None, "", "password = 'abc123abc123' and Secret: short", "AKIA" + "B7" * 9 + " deadbeefdeadbeef01", "éé api_key=AAAAAAAAAAAAAAAA token:x", "z token=" + "q7Xk29" * 9]
    kinds = [("assign", re.compile(secrets.ASSIGN.replace("(?i:", "(?:"), re.I), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    for row, t in zip(secrets.scan(documents(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= least)
        listed = ",".join(f"{name}:{s}:{e}" for s, _, e, name in spans)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(x[3] == k for x in spans) for k in ("assign", "access", "hex"))


def random_strings(rng, alphabet, n, count):
    return ["".join(rng.choices(alphabet, k=n)) for _ in range(count)]


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(18)
    b32, b64, b36 = (secrets.ENCODINGS[k][1] for k in ("base32", "base64", "base36"))
    kinds = {"base32": random_strings(rng, b32, 32, 50), "hex": random_strings(rng, "0123456789ABCDEF", 40, 50), "base64": random_strings(rng, b64, 40, 50), "base36": random_strings(rng, b36, 40, 50)}
    planted = [(k, x) for k, xs in kinds.items() for x in xs]
    syllables = ["ta", "re", "men", "li", "on", "er", "sta", "ge", "ni", "tion", "o", "a", "es", "pro", "con"]
    word = lambda n: "".join(rng.choices(syllables, k=n))
    page = lambda: " ".join(word(rng.randrange(1, 5)) for _ in range(60)) + f". {word(2).title()} {rng.randrange(1900, 2100)}"
    odd = lambda k: [word(9) + str(k), f"{word(3)}/{word(3)}/{word(4)}-{k}.html", word(3).title() + word(4).title() + word(3).title() + str(k), f"{word(4)}_{word(4)}_2024".upper(), "=" * 30, secrets.ENCODINGS["base64"][1], "Ab1" * 12][k % 7]
    texts = [f"{page()} {x} {page()}" for _, x in planted] + [f"{page()} {odd(k)} {page()}" for k in range(700)]
    rows = secrets.scan(documents(spark, texts)).orderBy("doc_id").collect()
    found = Counter(kind for (kind, x), row, text in zip(planted, rows, texts, strict=False) if f"random:{text.index(x)}:{text.index(x) + len(x)}" in row["spans"].split(","))
    assert all(found[k] >= 45 for k in kinds), found
    false = [row["spans"] for row in rows[len(planted) :] if "random" in row["spans"]]
    assert len(false) <= 0.05 * sum(found.values()), false


def test_counts_of_ordinary_text_against_loops(spark):
    texts = ["Ab-c 12aa  XY_z", None, "é9=zz/Q"]
    got = secrets.ordinary(documents(spark, texts))
    of = {c: k for k, v in (*secrets.CLASSES.items(), ("m", "-")) for c in v}
    pairs = Counter(of[a] + of[b] for t in texts for a, b in zip(t or "", (t or "")[1:], strict=False) if a in of and b in of)
    low = Counter(c.replace("-", "_") for t in texts for c in (t or "").lower())
    for a in secrets.CLASSES:
        for b in secrets.CLASSES:
            share = (pairs[a + b] + 1) / sum(pairs[a + x] + 1 for x in secrets.CLASSES)
            assert got[a + b] == pytest.approx(-np.log(max(share, secrets.STAYS) if a == b else share))
    assert got["z"] == pytest.approx(-np.log((low["z"] + 1) / sum(low[c] + 1 for c in secrets.CLASSES["l"])))


def test_randomness_tests_against_loops(spark):
    rng = random.Random(19)
    alphabet = secrets.ENCODINGS["base32"][1]
    tokens = random_strings(rng, alphabet, 32, 300) + ["".join(rng.choices("ABCDEFGH234", k=40)) for _ in range(20)] + [alphabet, "A2B3" * 8]
    got = [r[0] for r in documents(spark, tokens).orderBy("doc_id").select(secrets.is_random(F.col("text"), "base32")).collect()]

    def by_hand(t):
        x, k, n = [alphabet.index(c) for c in t], 32, len(t)
        chi = (sum(v * v for v in Counter(x).values()) * k / n - n) / (k - 1)
        uneven = (chi ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / (2 / (9 * (k - 1))) ** 0.5
        high = [v >= k / 2 for v in x]
        expected = 1 + 2 * sum(high) * (n - sum(high)) / n
        runs = (1 + sum(a != b for a, b in zip(high, high[1:], strict=False)) - expected) / max((expected - 1) * (expected - 2) / (n - 1), 0.01) ** 0.5
        mean = sum(x) / n
        serial = (sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / sum((a - mean) ** 2 for a in x) + 1 / n) * n**0.5
        return uneven <= secrets.ONE_TAIL and abs(runs) <= secrets.TWO_TAILS and abs(serial) <= secrets.TWO_TAILS

    assert got == [by_hand(t) for t in tokens]
    assert sum(got[:300]) >= 285 and not any(got[300:])


def test_redaction_keeps_the_rest(spark):
    docs = documents(spark, [None, "plain", "x password=abc123abc123 y"])
    out = secrets.redact(docs).orderBy("doc_id")
    assert out.columns == docs.columns
    assert [r["text"] for r in out.collect()] == [None, "plain", "x [SECRET] y"]


def test_quality_statistics_against_loops(spark):
    rng = random.Random(5)
    texts = [None, "", "  ", "a b c a b c", "one\none\n\none # $", prose(rng, 80) + "\n" + "x y z " * 30, prose(rng, 300)]
    for row, t in zip(quality.judged(documents(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        w = [x for x in re.split("[ \t-\r]+", t or "") if x]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) for j in range(3) if seen[tuple(w[k : k + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if re.search("[^ \t-\r]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(row)[1:6] == want
        assert row["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rejects_what_lies_far_off(spark):
    rng = random.Random(6)
    usual = [prose(rng, rng.randrange(100, 400)) for _ in range(150)]
    odd = ["#$% " * 40 + prose(rng, 150) + " |" * 400]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(documents(spark, usual + odd)).collect()}
    assert sum(kept[k] for k in range(150)) >= 149 and not kept[150]


def test_quality_rejects_on_repeated_lines_alone(spark):
    rng = random.Random(13)
    usual = [prose(rng, rng.randrange(100, 400)) for _ in range(150)]
    lines = "\n".join(rng.choices([f"w{k}x" for k in range(100, 126)], k=400))
    row = quality.judged(documents(spark, [*usual, lines])).where("doc_id = 150").first()
    assert row["n_dup_lines"] > 370 and not row["base_failed"] and not row["kept"]


def test_quality_judges_small_groups_too(spark):
    rng = random.Random(14)
    junk = prose(rng, 200).replace(" ", "#$%| ")
    rows = [(k, prose(rng, rng.randrange(100, 400)), "en", "large") for k in range(150)]
    rows += [(200 + k, prose(rng, 200), "en", "small") for k in range(3)] + [(300, junk, "en", "small"), (301, junk, "xx", "x"), (302, junk, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert all(r["squared_distance"] is not None for r in got.values())
    assert [k for k in got if k >= 200 and not got[k]["kept"]] == [300, 301, 302]
    few = {r["doc_id"]: r["kept"] for r in quality.judged(docs.where("doc_id < 20 OR doc_id = 300")).collect()}
    assert all(few[k] for k in range(20)) and not few[300]


@pytest.mark.parametrize("share, equal", [(0.22, False), (0.5, True)])
def test_quality_clumps_of_junk_do_not_pull_the_estimate(spark, share, equal):
    rng = random.Random(15)
    body = [w + "#$%|" for w in prose(rng, 200).split()]
    texts = [prose(rng, rng.randrange(100, 400)) for _ in range(round(200 * (1 - share)))]
    n = len(texts)
    texts += [" ".join(body if equal else rng.sample(body, len(body))) for _ in range(200 - n)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(documents(spark, texts)).collect()}
    assert sum(kept[k] for k in range(n)) >= n - 1 and not any(kept[k] for k in range(n, 200))


# --- tokens


def test_bpe_against_the_library(spark, tokenizer):
    texts = [None, "", "a", "  \n\n x's 12345 éü 日本 <|endoftext|>tail", "\u0085  x", "a" * 3000, "🙂 ok" * 50]
    for row, t in zip(bpe.encode_documents(documents(spark, texts), BYTE_BPE).orderBy("doc_id").collect(), texts, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(row["ids"]) == ids
        assert row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) == (t or "")


def test_other_settings_of_a_vocabulary_are_refused(tmp_path):
    with open(BYTE_BPE, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 50256, "content": "<|endoftext|>", "lstrip": True}]}):
        path = tmp_path / "changed.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="not supported"):
            bpe.Vocabulary(str(path))


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_counts_follow_edits(tokenizer, monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    rng, words = random.Random(leaf), bpe.vocabulary(BYTE_BPE)
    parts = ["the ", "a", " ", "  ", "\n", "12", "'s", "<|endoftext|>", "<|endof", "text|>", "é", "Word", "!!", "x", " " * 90]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 300))) for _ in range(120)]
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    chars, tokens, _ = map(list, zip(*token_counts.planted(words, texts), strict=True))
    for _ in range(3):  # each round starts from the trees that the one before it kept
        edits, after = [], []
        for t in texts:
            cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * rng.randrange(0, 5))))
            made = [(a, b, rng.choice([*parts, ""])) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
            edits.append([{"start": a, "end": b, "replacement": r} for a, b, r in made])
            for a, b, r in reversed(made):
                t = t[:a] + r + t[b:]
            after.append(t)
        texts, chars, tokens, _, _ = map(list, zip(*token_counts.grown(words, texts, chars, tokens, edits), strict=True))
        assert texts == after and [sum(x) for x in chars] == [len(t) for t in texts]
        assert [sum(x) for x in tokens] == [n(t) for t in texts]


def test_few_pre_tokens_are_split_anew():
    words = bpe.vocabulary(BYTE_BPE)
    text = "one two three " * 20_000
    ((chars, tokens, pieces),) = token_counts.planted(words, [text])
    ((_, _, _, made, resplit),) = token_counts.grown(words, [text], [chars], [tokens], [[{"start": 1000, "end": 1003, "replacement": "x"}, {"start": 150_000, "end": 150_000, "replacement": "y"}]])
    assert pieces > 60_000 and made == 2 and resplit <= 4 * token_counts.LEAF


def test_sums_of_a_segment_tree():
    nodes = token_counts.summed([3, 1, 4, 1, 5])
    assert nodes.tolist()[1:8] == [14, 9, 5, 4, 5, 5, 0]
    assert [token_counts.leaf_at(nodes, p) for p in (0, 2, 3, 13, 99)] == [(0, 0), (0, 0), (1, 3), (4, 9), (4, 9)]
    assert token_counts.leaf_at(token_counts.summed([0]), 5) == (0, 0)


def test_counts_of_documents(spark, tokenizer):
    texts = [None, "", "no edits here", "in 12345 and internationalisation 99999", "12345", "in 12345 and internationalisation 99999"]
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    df = documents(spark, texts, [None, 1, 2, 3, 3, 3])
    rounds = [lambda text, p=p, m=m: token_counts.masks(text, p, m) for p, m in (("[0-9]{4,}", "<number>"), ("[a-z]{12,}", "<word>"))]
    after = [re.sub("[a-z]{12,}", "<word>", re.sub("[0-9]{4,}", "<number>", t or "")) for t in texts]
    got = token_counts.count_with_edits(df, rounds, BYTE_BPE).collect()
    assert sorted((r["n_tokens"], r["n_after"], r["n_edits"]) for r in got) == sorted((n(t or ""), n(u), e) for t, u, e in zip(texts, after, [0, 0, 0, 3, 1, 3], strict=True))
    assert token_counts.count_with_edits(documents(spark, []), rounds, BYTE_BPE).count() == 0


def test_edits_that_overlap_are_left_out():
    e = lambda a, b: {"start": a, "end": b, "replacement": None}
    assert token_counts.in_order([e(3, 5), e(4, 9), None, e(3, 5), e(-2, 1), e(90, 99)], 10) == [(0, 1, ""), (3, 5, ""), (10, 10, "")]
    assert token_counts.in_order(None, 10) == []


# --- benchmark passages


def distance_by_table(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distance_against_the_table():
    rng = random.Random(9)
    pairs = [["".join(rng.choices("abé ", k=rng.randrange(0, n))) for n in (15, 40)] for _ in range(100)] + [["".join(rng.choices("ab", k=rng.randrange(60, 140))) for _ in range(2)] for _ in range(30)]
    assert decontamination.edits([p for p, _ in pairs], [t for _, t in pairs]).tolist() == [distance_by_table(p, t) for p, t in pairs]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = rng.choice(["", *"abcdefgh "])
    return "".join(out)


@pytest.mark.parametrize("size", [(12, 26), (26, 45), (45, 80), (80, 120), (120, 400)])
@pytest.mark.parametrize("rate", [0.05, 0.15, 0.2, 0.25])
def test_recall_of_edited_passages(rate, size):
    rng = random.Random(16)
    letters = "etaoinshrdlu"
    words = ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=90))[: rng.randrange(*size)].strip() for _ in range(200)]
    items = decontamination.Items(list(range(len(texts))), texts)
    rows = [" ".join(rng.choices(words, k=30)) + "\n" + edited(rng, t, int(rate * len(t))) + " " + " ".join(rng.choices(words, k=30)) for t in texts]
    got = {(r, k): d for r, k, d, *_ in decontamination.pairs_in_rows(items, pa.array(rows), 0.25)}
    assert len(got.keys() & {(k, k) for k in range(len(texts))}) >= 0.9 * len(texts)
    assert all(d == distance_by_table(texts[k], " ".join(decontamination.normalised(rows[r]))) for (r, k), d in list(got.items())[:20])


def test_pairs_against_the_distances_of_all_pairs(spark):
    rng = random.Random(29)
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n)) for n in (12, 30, 60)]
    items = [prose(rng, n) for n in (3, 4, 6, 9, 14, 40) for _ in range(6)] + chinese + ["https://a.example/" + "/".join(rng.choices(WORDS, k=12)), "one\x00two three\x07four five six"]
    rows = [prose(rng, 20) + " " + edited(rng, t, int(rate * len(t))) + " " + prose(rng, 20) for t in items for rate in (0, 0.1, 0.2)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(documents(spark, rows), bench).collect()}
    flat = lambda t: " ".join(decontamination.normalised(t))
    pairs = [(d, k) for d in range(len(rows)) for k in range(len(items))]
    distance = dict(zip(pairs, decontamination.edits([flat(items[k]) for _, k in pairs], [flat(rows[d]) for d, _ in pairs]).tolist(), strict=True))
    want = {(d, k): n for (d, k), n in distance.items() if n <= decontamination.RATE * len(flat(items[k]))}
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want)
    assert all((3 * k, k) in got for k in range(len(items)))


def test_passages_are_found_and_nothing_else(spark, monkeypatch):
    rng = random.Random(10)
    items = [prose(rng, rng.randrange(14, 60)) for _ in range(30)] + ["", "two words", "a seven word item is short indeed"]
    texts, want = [None, ""], set()
    for k, item in enumerate(items):
        w = item.split()
        for _ in range(len(w) // 12):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        for body in (item.upper(), " ".join(w) if len(w) >= 14 else item):
            if item:
                want.add((len(texts), k))
            texts.append(prose(rng, 80) + "\n" + body + "  " + prose(rng, 80))
    texts += [prose(rng, 200) for _ in range(50)] + [prose(rng, 30_000) + " " + items[3] + " " + prose(rng, 30_000), "two words", "x two words", "two"]
    want |= {(len(texts) - 4, 3), (len(texts) - 3, 31), (len(texts) - 2, 31)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(documents(spark, texts), bench).collect()}
    assert found - want == set()
    assert len(found & want) >= 0.97 * len(want)
    clean = decontamination.clean_documents(documents(spark, texts), bench)
    assert clean.columns == documents(spark, []).columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in found}
    monkeypatch.setattr(decontamination, "MOST_ITEMS", 7)
    blocks = decontamination.contaminated(documents(spark, texts), bench)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == found


def test_rows_without_an_id_are_judged_by_their_text(spark):
    item = prose(random.Random(17), 40)
    docs = documents(spark, ["x " + item, "clean", item, "clean too"], [None, None, 7, 7])
    bench = spark.createDataFrame([(1, item), (1, item), (None, None), (2, "")], "item_id bigint, text string")
    assert sorted(r["text"] for r in decontamination.clean_documents(docs, bench).collect()) == ["clean", "clean too"]
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()} == {(None, 1), (7, 1)}


# --- language model


def test_gradient_and_probabilities_of_the_network():
    rng = np.random.default_rng(11)
    shape = pseudo_likelihood.Shape(7, 6)
    net = pseudo_likelihood.Network(shape, pseudo_likelihood.Network.fresh(shape).flat.astype(np.float64))
    around, token = rng.integers(0, 14, (4, 40)), rng.integers(0, 13, 40)
    loss = lambda flat: -pseudo_likelihood.Network(shape, flat).log_probabilities(around, token).mean()
    g = net.gradient(around, token)
    for k in [*np.argsort(-np.abs(g))[:10].tolist(), *rng.integers(0, len(g), 10).tolist()]:
        step = np.zeros(len(g))
        step[k] = 1e-5
        assert abs((loss(net.flat + step) - loss(net.flat - step)) / 2e-5 - g[k]) < 1e-6
    assert sum(np.exp(net.log_probabilities(around[:, :1], np.array([t])))[0] for t in range(13)) == pytest.approx(1)


def test_windows_against_loops():
    texts = ["a b c d", "", "x", "a  a\nb"]
    shape = pseudo_likelihood.Shape(0, 50)
    around, token, _, bounds = pseudo_likelihood.windows(pa.array(texts), np.zeros(0, np.uint64), shape)
    t = {w: int(pseudo_likelihood.windows(pa.array([w]), np.zeros(0, np.uint64), shape)[1][0]) for w in "abcdx"} | {None: 50}
    at = lambda w, k: t[w[k]] if 0 <= k < len(w) else 50
    assert bounds.tolist() == [0, 4, 4, 5, 8] and token.tolist() == [t[w] for x in texts for w in x.split()]
    assert around.T.tolist() == [[at(w, k - 1), at(w, k + 1), at(w, k - 2), at(w, k + 2)] for w in map(str.split, texts) for k in range(len(w))]


def test_pseudo_likelihood_learns_order(spark):
    rng = random.Random(12)
    chain = " ".join(["red green blue"] * 40)
    texts = [chain] * 30 + [" ".join(rng.sample(chain.split(), 120)) for _ in range(3)] + [None, ""]
    got = pseudo_likelihood.score(documents(spark, texts)).orderBy("doc_id").collect()
    assert got[0]["mean_log_likelihood"] > -0.3 and got[0]["mean_log_likelihood"] > got[30]["mean_log_likelihood"] + 0.5
    assert tuple(got[-1])[1:] == tuple(got[-2])[1:] == (0, 0.0, None)


def test_scores_against_the_network_and_the_table_of_counts(spark, monkeypatch):
    rng = random.Random(20)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(40, 0, -1), k=rng.randrange(1, 60))) for _ in range(40)]
    texts += texts[:3] + [prose(rng, 3000)]
    docs = documents(spark, texts, [None, *range(1, 43), 1])
    kept = {}
    trained = pseudo_likelihood.trained
    monkeypatch.setattr(pseudo_likelihood, "trained", lambda rows, words, shape: kept.setdefault("net", (words, trained(rows, words, shape)))[1])
    got = Counter(map(tuple, pseudo_likelihood.score(docs).select("doc_id", "n_tokens", "log_likelihood").collect()))
    words, net = kept["net"]
    each = [pseudo_likelihood.windows(pa.array([t]), words, net.shape) for t in texts]
    chosen = lambda near: int(near) % pseudo_likelihood.MEMORY == 0
    pairs = Counter((int(n), int(t)) for _, token, near, _ in each for n, t in zip(near, token, strict=True) if chosen(n))
    alone = Counter(n for n, _ in pairs.elements())
    want = []
    for i, (around, token, near, _) in zip([None, *range(1, 43), 1], each, strict=True):
        logp = net.log_probabilities(around, token).astype(float)
        total = sum(np.log((pairs[int(n), int(t)] - 1 + np.exp(p)) / (alone[int(n)] - 1 + 1)) if chosen(n) else p for p, n, t in zip(logp, near, token, strict=True))
        want.append((i, len(token), total))
    assert len(want) == sum(got.values())
    for a, b in zip(sorted(got.elements(), key=lambda r: (r[1], r[2])), sorted(want, key=lambda r: (r[1], r[2])), strict=True):
        assert a[1] == b[1] and a[2] == pytest.approx(b[2], abs=0.01)


# --- chat and archives


def test_chat_parts_and_round_trip(spark):
    rows = [(1, 0, "user", [("text", "see </s> \\ <image>", None, 0, 0), ("image", None, "a.png", 57, 28)]), (1, 1, "assistant", [("text", "[INST] fine", None, 0, 0)])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content array<struct<type:string,text:string,ref:string,width:int,height:int>>")
    got = chat.format_conversations(df, content_col="content").orderBy("turn").collect()
    whole = "".join(r["formatted"] for r in got)
    assert [(r, t) for r, t, _ in chat.parse_turns(whole)] == [("user", "see </s> \\ <image><image>"), ("assistant", "[INST] fine")]
    assert got[0]["attachments"][0]["ref"] == "a.png" and got[0]["expanded_tokens"] == 3
    assert chat.unescape(got[1]["formatted"][got[1]["loss_start"] : got[1]["loss_end"]]) == "[INST] fine"


def test_odd_parts_do_not_crash():
    parts = [{"type": "image", "width": float("nan"), "height": 30}, {"type": "image", "width": 56, "height": 29}, {"type": "audio", "seconds": float("nan")}, {"type": "audio", "seconds": 0.1}, {"type": "document", "pages": 1.5}]
    parts += [{"type": "document", "pages": None}, {"type": "audio", "seconds": float("inf")}, {"type": "hologram", "ref": "h"}, {"type": None}, {"type": "text", "text": None}, None]
    text, start, end, found = chat.format_turn("assistant", parts, frozenset(["assistant"]), chat.Expansion())
    assert [x["tokens"] for x in found] == [0, 4, 0, 3, 2048, 0, 0, 0, 0] and [x["type"] for x in found][-2:] == ["file", "file"]
    assert text[start:end] == "<image><image><audio><audio><document><document><audio><file><file>"


def test_conversations_with_nulls_ties_and_nothing(spark):
    ddl = "conv_id bigint, turn bigint, role string, text string, formatted string"
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, None, None, None, None), (None, 1, "assistant", "<s>" * 40_000, None)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, ddl))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 120_000
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], ddl))).count() == 0


def test_streams_of_several_members_are_inflated():
    raw = [b"a" * 5000, b"", b"bcd" * 1000]
    packed = b"".join(gzip.compress(x) for x in raw)
    for chunk in (1, 7, 1 << 20):
        assert b"".join(warc.inflated(io.BytesIO(packed), chunk)) == b"".join(raw)


def test_archives_of_nothing_and_of_rows_without_an_id(spark):
    ddl = "page_id bigint, url string, html string, payload string"
    assert warc.archive_pages(spark.createDataFrame([], ddl), new_folder(spark, "test-warc")).count() == 0
    pages = spark.createDataFrame([(None, "u", "same", "x"), (5, "u", "same", "y"), (5, "v", "same", "z"), (None, "w", "alone", "x"), (None, "w", "alone", "x")], ddl)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.archive_pages(pages, new_folder(spark, "test-warc")).collect())
    assert got == [(0, "response", 0), (0, "response", 0), (0, "revisit", 5), (5, "response", 0), (5, "response", 0)]


def test_archives_are_read_back(spark):
    pages = spark.createDataFrame([(3, "u\r\nv", "same"), (1, None, "same"), (2, "u", None), (4, "u", "é" * 5000)], "page_id bigint, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_pages(pages, new_folder(spark, "test-warc")).collect()}
    assert {k: (v[0], v[2], v[3]) for k, v in got.items()} == {1: (4, "response", None), 3: (4, "revisit", 1), 2: (0, "response", None), 4: (10000, "response", None)}


# --- all of them


def test_every_position_is_looked_up_in_the_counts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, 60)) for _ in range(40)] * 2
    looked = []
    remembered = pseudo_likelihood.remembered
    monkeypatch.setattr(pseudo_likelihood, "remembered", lambda scored: looked.append(scored) or remembered(scored))
    pseudo_likelihood.score(documents(spark, texts)).collect()
    assert {(r.n_tokens, len(r.around), len(r.token), len(r.logp)) for r in looked[0].collect()} == {(60, 60, 60, 60)}


@pytest.mark.parametrize("run", [suffixes.without_repeats, pseudo_likelihood.score, jaccard.near_duplicates, jaccard.one_of_each, quality.judged, quality.kept_documents, secrets.scan, secrets.redact], ids=lambda f: f.__name__)
def test_empty_tables_and_null_or_repeated_ids(spark, run):
    assert run(documents(spark, [])).count() == 0
    text = prose(random.Random(1), 90)
    odd = documents(spark, [text, text + " more", None, None, "x"], [7, 7, None, None, 8])
    if run not in (jaccard.one_of_each, quality.kept_documents):
        assert run(odd).count() == 5
    else:
        run(odd).collect()


def test_batches_of_nothing(spark):
    assert bpe.encode_documents(documents(spark, []), BYTE_BPE).count() == 0
    assert bpe.vocabulary(BYTE_BPE).merge([]) == []
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contaminated(documents(spark, ["a b"]), empty).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 11))


def test_pipeline_stages_do_what_their_operators_do(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = c.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns and ids(kept) == ids(quality.judged(docs).where("kept"))
    unique = c.near_duplicates(spark, docs, sf)
    rows = docs.orderBy("doc_id").toPandas()
    assert ids(unique) == {int(rows["doc_id"][k]) for k, _, root in links_by_hand(list(rows["text"])) if root == k}
    bench = {" ".join(decontamination.normalised(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    holds = {d for d, t in zip(rows["doc_id"], rows["text"], strict=True) if any(x in " ".join(decontamination.normalised(t)) for x in bench)}
    assert ids(c.benchmark_passages(spark, docs, sf)) == ids(docs) - holds
    assert ids(c.secret_scans(spark, docs, sf)) == ids(docs) == ids(c.tokens(spark, docs, sf))
