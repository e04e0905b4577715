"""What a Python task holds at once is bounded by settings, not by what a batch brings."""

import random

import numpy as np
import pyarrow as pa

from fennmark.llm import pseudo_likelihood, suffixes


class Taken(Exception):
    pass


class Rows:
    def mapInArrow(self, run, schema):
        raise Taken(run)


def task_of(operator, *args):
    try:
        operator(Rows(), *args)
    except Taken as e:
        return e.args[0]


def test_contexts_leave_a_task_slice_by_slice(monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 3000)
    draw = np.random.default_rng(5)
    texts = [bytes(draw.integers(97, 123, 1000, np.uint8)) for _ in range(12)]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.arange(0, 12001, 1000)
    row, place, _, _ = suffixes.anchors(raw, ends)
    hashes = suffixes._core_hashes(raw, place)
    cores = [[hashes[row == k].tobytes()] for k in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"%016d" % k for k in range(12)], pa.binary()), pa.array([x.decode() for x in texts]), pa.array(cores, pa.list_(pa.binary()))], names=["key", "text", "cores"])
    out = list(task_of(suffixes.contexts)(iter([batch])))
    assert len(out) == 4 and sum(map(len, out)) == len(place)


def test_windows_of_many_contexts_are_hashed_some_at_a_time(monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 10, raising=False)
    met = []
    monkeypatch.setattr(suffixes, "_dealt", lambda high, low, refs, buckets: met.append(len(high)) or iter(()))
    names = [b"%016d" % k for k in range(35)]
    columns = [pa.array(names, pa.binary()), pa.array([b"a" * 50] * 35, pa.binary()), pa.array([b"b" * 450] * 35, pa.binary()), pa.array([1] * 35, pa.int32()), pa.array([50] * 35, pa.int32())]
    batch = pa.RecordBatch.from_arrays(columns, names=["context_id", "behind", "ahead", "least", "most"])
    list(task_of(suffixes._single_windows, 4)(iter([batch])))
    assert met == [500, 500, 500, 250]


def test_scores_keep_nothing_for_a_position_and_are_the_same_in_any_blocks(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "b", "c", "d", "e"], k=rng.randrange(0, 90))) for _ in range(60)] + [None, "", " ".join(["a b"] * 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept, trained, stored = {}, pseudo_likelihood.trained, pseudo_likelihood.stored
    written = []
    monkeypatch.setattr(pseudo_likelihood, "trained", lambda rows, words, shape: kept.setdefault("net", trained(rows, words, shape)))
    monkeypatch.setattr(pseudo_likelihood, "stored", lambda df, name: written.append(df.columns) or stored(df, name))
    want = sorted(map(tuple, pseudo_likelihood.score(docs).collect()))
    assert written == [["word", "n"]]
    monkeypatch.setattr(pseudo_likelihood, "BLOCK", 128)
    monkeypatch.setattr(pseudo_likelihood, "BUCKET", 256)
    assert sorted(map(tuple, pseudo_likelihood.score(docs).collect())) == want
