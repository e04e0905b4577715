"""LM scoring: masked pseudo-likelihood by a window network that looks to both sides.

A token is a frequent word of the corpus or one of many classes of the other words; a mark stands before the first and after the last. The network predicts a
token from the two words on each side of it: four embeddings are added, go through tanh, and a softmax in two steps follows, over clusters of tokens
and over the tokens of the cluster. A document's score is the sum of the log-probabilities of all its tokens, each with itself masked.

What the model gathers grows with the corpus of N words: a word is a token of its own from sqrt(N) occurrences on (so there are sqrt(N) of them at most, which
bounds what is broadcast), the others fall into N^0.4 classes, all documents are trained on, and the network is the prior of a table of counts: for every pair of neighbours (one in
MEMORY, which is 1), the corpus's counts of the tokens between them, less the token in question itself, are added to PRIOR times the network's distribution.

The counts are asked for by block: documents are dealt into blocks, a block names each of its pairs of neighbours and tokens once, sorted, to the buckets of neighbours that the table is dealt
in, and gets their counts back in that order. Only then are its texts scored, so that nothing is kept for a position but while its block is worked on.

Training is numpy, data-parallel: ROUNDS rounds take disjoint parts of the documents, all of them together. In a round each task makes Adagrad steps over its
documents batch by batch from the shared parameters; the weighted mean of what the tasks end with, taken piece by piece in tasks, begins the next round.

Defined cases: a null text, or one without words, has no tokens, score 0 and a null mean; repeated rows are scored alike, and each counts in the
other's table; rows that share an id, or have none, are rows of their own; texts of any length are taken whole; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .jaccard import word_hashes
from .shared import arrow_bytes, limit_batches, mixed, stored

SIDE, WIDTH = 2, 16
ROUNDS, RATE = 3, 0.1
#: Tokens of a step, and steps that a batch of documents gets at least.
STEP_TOKENS, LEAST_STEPS = 8192, 100
#: Tokens that are scored together; parameters in a piece.
TOGETHER, PIECE = 1 << 13, 1 << 16
MEMORY, PRIOR = 1, 1.0
#: Logits are cut there, so that no exponential leaves the range of 32-bit numbers.
MOST_LOGIT = 60
#: Words in a block of documents and in a bucket of the table of counts, about.
BLOCK = BUCKET = 1 << 20


@dataclass(frozen=True)
class Shape:
    """How many words are tokens of their own, and classes of others."""

    words: int
    others: int
    #: All words of the corpus.
    total: int = 0

    @property
    def tokens(self) -> int:
        return self.words + self.others

    @property
    def per(self) -> int:
        """Tokens in a cluster."""
        return max(1, math.isqrt(self.tokens - 1) + 1)

    @property
    def clusters(self) -> int:
        return -(-self.tokens // self.per)

    def parts(self) -> list[tuple[int, ...]]:
        """Embeddings of the words on each side (and of the mark), their bias, the clusters with their bias, the tokens of each cluster with theirs."""
        return [(2 * SIDE, self.tokens + 1, WIDTH), (WIDTH,), (WIDTH, self.clusters), (self.clusters,), (self.clusters, WIDTH, self.per), (self.clusters, self.per)]


def token_ids(hashes: np.ndarray, words: np.ndarray, shape: Shape) -> np.ndarray:
    """The token of each word; `words` are the sorted hashes of the frequent words."""
    out = shape.words + (hashes >> np.uint64(11)).astype(np.int64) % shape.others
    if len(words):
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        out = np.where(words[at] == hashes, at, out)
    return out


def windows(column, words: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of the rows: the tokens on each side, nearest left, nearest right, and so on outwards; the token; a hash of the nearest two words; and where each row begins and ends among them."""
    hashes, bounds = word_hashes(*arrow_bytes(column))
    token, n = token_ids(hashes, words, shape), np.diff(bounds)
    place, left_end, right_end = np.arange(len(token)), np.repeat(bounds[:-1], n), np.repeat(bounds[1:], n)
    around = np.full((2 * SIDE, len(token)), shape.tokens, np.int64)
    near = np.zeros((2, len(token)), np.uint64)
    for step in range(1, SIDE + 1):
        for k, (at, inside) in enumerate(((place - step, place - step >= left_end), (place + step, place + step < right_end))):
            around[2 * step - 2 + k, inside] = token[at[inside]]
            if step == 1:
                near[k, inside] = hashes[at[inside]]
    return around, token, mixed(mixed(near[0]) + near[1]), bounds


def _order(x: np.ndarray, below: int) -> np.ndarray:
    """A stable order of small whole numbers; 16 bits are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if below <= 1 << 16 else x, kind="stable")


class Network:
    """The parameters, as one flat array, and views of its parts."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        cuts = np.cumsum([math.prod(s) for s in shape.parts()])
        self.sides, self.bias, self.cluster, self.cluster_bias, self.within, self.within_bias = (flat[b - math.prod(s) : b].reshape(s) for s, b in zip(shape.parts(), cuts.tolist(), strict=True))

    @classmethod
    def fresh(cls, shape: Shape, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(shape, rng.normal(0, 0.1, sum(math.prod(s) for s in shape.parts())).astype(np.float32))

    def _exponents(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exponential of each logit (in place), and the sum of each row."""
        np.exp(np.clip(logits, -MOST_LOGIT, MOST_LOGIT, out=logits), out=logits)
        return logits, logits @ np.ones(logits.shape[1], logits.dtype)

    def _softmax(self, logits: np.ndarray) -> np.ndarray:
        logits, sums = self._exponents(logits)
        logits *= (1 / sums)[:, None]
        return logits

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        return np.tanh(sum((side[x] for side, x in zip(self.sides, around, strict=True)), self.bias))

    def _groups(self, token: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The cluster, the rows and their places within the cluster."""
        of = token // self.shape.per
        order = _order(of, self.shape.clusters)
        cuts = np.r_[0, np.flatnonzero(np.diff(of[order])) + 1, len(of)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                yield int(of[order[a]]), order[a:b], token[order[a:b]] % self.shape.per

    def _absent(self, c: int) -> int:
        """How many tokens the last cluster lacks."""
        return max(0, (c + 1) * self.shape.per - self.shape.tokens)

    def log_probabilities(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """That of each token, given what is around it."""
        hidden = self._hidden(around)
        e, sums = self._exponents(hidden @ self.cluster + self.cluster_bias)
        out = np.log(e[np.arange(len(token)), token // self.shape.per] / sums)
        for c, rows, place in self._groups(token):
            n = self.shape.per - self._absent(c)
            e, sums = self._exponents(hidden[rows] @ self.within[c, :, :n] + self.within_bias[c, :n])
            out[rows] += np.log(e[np.arange(len(rows)), place] / sums)
        return out

    def gradient(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability of the tokens."""
        out = Network(self.shape, np.zeros_like(self.flat))
        hidden, every = self._hidden(around), np.arange(len(token))
        outer = self._softmax(hidden @ self.cluster + self.cluster_bias)
        outer[every, token // self.shape.per] -= 1
        outer /= len(token)
        out.cluster += hidden.T @ outer
        out.cluster_bias += outer.sum(0)
        back = outer @ self.cluster.T
        for c, rows, place in self._groups(token):
            n, h = self.shape.per - self._absent(c), hidden[rows]
            inner = self._softmax(h @ self.within[c, :, :n] + self.within_bias[c, :n])
            inner[np.arange(len(rows)), place] -= 1
            inner /= len(token)
            out.within[c, :, :n] = h.T @ inner
            out.within_bias[c, :n] = inner.sum(0)
            back[rows] += inner @ self.within[c, :, :n].T
        back *= 1 - hidden * hidden
        out.bias += back.sum(0)
        for side, x in zip(out.sides, around, strict=True):
            order = _order(x, self.shape.tokens + 1)
            first = np.r_[0, np.flatnonzero(np.diff(x[order])) + 1]
            side[x[order[first]]] = np.add.reduceat(back[order], first, axis=0)
        return out.flat

    def train(self, around: np.ndarray, token: np.ndarray, squares: np.ndarray, rate: float) -> None:
        """Adagrad steps over the tokens in mixed order, in place."""
        n = len(token)
        size = min(STEP_TOKENS, max(64, n // LEAST_STEPS))
        rng = np.random.default_rng(n)
        for _ in range(max(1, -(-LEAST_STEPS * size // (2 * n)))):
            order = rng.permutation(n)
            for a in range(0, n, size):
                some = order[a : a + size]
                g = self.gradient(around[:, some], token[some])
                g *= len(some) ** 0.5  # so that steps of few tokens and of many move about alike
                squares += g * g
                self.flat -= rate * g / (np.sqrt(squares) + 1e-6)


def vocabulary(rows: DataFrame) -> tuple[np.ndarray, Shape]:
    """The sorted hashes of the words with sqrt(N) occurrences or more, N the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, n = np.unique(word_hashes(*arrow_bytes(batch.column(1)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    seen = Observation()
    counted = rows.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).observe(seen, F.sum("n").alias("total"))
    counted = stored(counted.where("n > 1"), "lm-words")
    total = seen.get["total"] or 0
    words = np.sort(counted.where(F.col("n") >= max(2, math.isqrt(total))).select("word").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    return words, Shape(len(words), max(8, int(total**0.4)), total)


def trained(rows: DataFrame, words: np.ndarray, shape: Shape) -> Network:
    """A network trained on all rows."""
    spark = rows.sparkSession
    now, known = Network.fresh(shape), spark.sparkContext.broadcast(words)
    part = F.pmod(F.xxhash64("text", "id"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(now.flat)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=RATE / (1 + k) ** 0.5) -> Iterator[pa.RecordBatch]:
            mine, seen = Network(shape, sent.value.copy()), 0
            squares = np.full_like(mine.flat, 1e-3)
            for batch in batches:
                around, token, _, _ = windows(batch.column(1), known.value, shape)
                if len(token):
                    mine.train(around, token, squares, rate)
                    seen += len(token)
            if seen:
                pieces = [mine.flat[a : a + PIECE].tobytes() for a in range(0, len(mine.flat), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array([float(seen)] * len(pieces)), pa.array(pieces, pa.binary())], names=["piece", "seen", "flat"])

        ended = rows.where(part == k).mapInArrow(run, "piece bigint, seen double, flat binary")
        got = ended.groupBy("piece").applyInArrow(_mean, "piece bigint, seen double, flat binary").orderBy("piece").toArrow()
        if got.num_rows:
            now = Network(shape, np.frombuffer(b"".join(got.column("flat").to_pylist()), np.float32).copy())
        sent.unpersist()
    return now


def _mean(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of a piece of the parameters, over the tasks, batch by batch."""
    seen, total, piece = 0.0, 0.0, None
    for batch in group:
        for n, flat in zip(batch.column("seen").to_pylist(), batch.column("flat"), strict=True):
            total = total + n * np.frombuffer(flat.as_buffer(), np.float32).astype(np.float64)
            seen += n
        piece = batch.column("piece")[:1] if batch.num_rows else piece
    yield pa.RecordBatch.from_arrays([piece, pa.array([seen]), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], names=["piece", "seen", "flat"])


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: bytes that are alike lie together, and shuffles compress them."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _values(planes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _grouped(near: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by neighbours, then tokens, and where the distinct pairs begin in it."""
    order = np.lexsort((token, near))
    a, b = near[order], token[order]
    return order, np.flatnonzero(np.r_[np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _joined(column: pa.ChunkedArray):
    """One array of all of a group's texts."""
    return pa.chunked_array([c.cast(pa.large_string()) for c in column.chunks], pa.large_string()).combine_chunks()


def asked(dealt: DataFrame, words, shape: Shape) -> DataFrame:
    """bucket, block, near, token, n: what each block asks of each bucket, its distinct pairs of neighbours and tokens in order, and how often it has them. `dealt`: block, id, text."""
    buckets = 1 + shape.total // BUCKET

    def run(group: pa.Table) -> pa.Table:
        _, token, near, _ = windows(_joined(group.column("text")), words.value, shape)
        order, first = _grouped(near, token)
        near, token, n = near[order[first]], token[order[first]].astype(np.int32), np.diff(np.r_[first, len(order)])
        cuts = np.searchsorted(_bucket(near, buckets), np.arange(buckets + 1)).tolist()
        some = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        gaps = lambda x: np.diff(x, prepend=np.uint64(0))
        binary = [pa.array([_planes(np.ascontiguousarray(f(x[a:b]))) for _, a, b in some], pa.binary()) for x, f in ((near, gaps), (token, np.asarray), (n.astype(np.int64), np.asarray))]
        block = group.column("block")[0].as_py()
        return pa.table([pa.array([k for k, _, _ in some], pa.int64()), pa.array([block] * len(some), pa.int64()), *binary], names=["bucket", "block", "near", "token", "n"])

    return dealt.groupBy("block").applyInArrow(run, "bucket bigint, block bigint, near binary, token binary, n binary")


def _bucket(near: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of neighbours; it grows with their hash."""
    return ((near >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _answered(group: pa.Table) -> pa.Table:
    """bucket, block, n, c: for each pair that a block asks for, in its order, the counts of the pair and of the neighbours in the corpus."""
    near = [np.cumsum(_values(x.as_buffer(), np.uint64), dtype=np.uint64) for x in group.column("near")]
    token = np.concatenate([_values(x.as_buffer(), np.int32) for x in group.column("token")])
    n = np.concatenate([_values(x.as_buffer(), np.int64) for x in group.column("n")])
    ends, near = np.cumsum([len(x) for x in near])[:-1], np.concatenate(near)
    order, first = _grouped(near, token)
    pairs = np.add.reduceat(n[order], first)
    begins = np.flatnonzero(np.diff(near[order[first]], prepend=~near[order[:1]]))
    alike = np.repeat(np.add.reduceat(pairs, begins), np.diff(np.r_[begins, len(pairs)]))
    out = []
    for x in (pairs, alike):
        n[order] = np.repeat(x, np.diff(np.r_[first, len(order)]))
        out.append(pa.array([_planes(part) for part in np.split(n, ends)], pa.binary()))
    return pa.table([group.column("bucket"), group.column("block"), *out], names=["bucket", "block", "n", "c"])


def remembered(scored: DataFrame) -> DataFrame:
    """`scored` with what the table of counts adds to the score of each row. Neighbours that occur once add nothing."""
    p = lambda x: F.exp(x["logp"])
    gain = lambda x: F.log((x["n"] - 1 + PRIOR * p(x)) / (x["c"] - 1 + PRIOR)) - x["logp"]
    millionths = F.transform(F.arrays_zip("logp", "n", "c"), lambda x: F.when(x["c"] > 1, F.round(gain(x) * 1e6).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return scored.withColumn("gain", F.aggregate(millionths, F.lit(0).cast("bigint"), lambda a, x: a + x) / 1e6)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_likelihood (the sum of each token's log-probability between its neighbours) and mean_log_likelihood of each row."""
    spark = df.sparkSession
    limit_batches(spark, 8)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words, shape = vocabulary(rows)
    network = trained(rows, words, shape)
    sent, known = spark.sparkContext.broadcast(network.flat), spark.sparkContext.broadcast(words)

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        net, answers = Network(shape, sent.value), answers.sort_by("bucket")
        around, token, near, bounds = windows(_joined(group.column("text")), known.value, shape)
        logp = np.concatenate([net.log_probabilities(around[:, a : a + TOGETHER], token[a : a + TOGETHER]) for a in range(0, len(token), TOGETHER)] or [np.zeros(0, np.float32)])
        sums = np.r_[0.0, np.cumsum(logp, dtype=np.float64)]
        order, first = _grouped(near, token)
        counts = []
        for name in ("n", "c"):
            got = np.concatenate([np.zeros(0, np.int64), *(_values(x.as_buffer(), np.int64) for x in answers.column(name))])
            if len(got) != len(first):
                raise ValueError("a block's texts are not those that it asked for")
            counts.append(np.empty(len(order), np.int64))
            counts[-1][order] = np.repeat(got, np.diff(np.r_[first, len(order)]))
        chosen = np.flatnonzero(near % np.uint64(MEMORY) == 0)
        ends = pa.array(np.searchsorted(chosen, bounds), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[chosen])) for x in (near.view(np.int64), token, logp.astype(np.float64), *counts)]
        own = [group.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(sums[bounds[1:]] - sums[bounds[:-1]])]
        return pa.table([*own, *lists], names=["id", "n_tokens", "score", "around", "token", "logp", "n", "c"])

    id_type = df.schema[id_col].dataType.simpleString()
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("text", "id"), F.lit(1 + shape.total // BLOCK)))
    answers = asked(dealt, known, shape).groupBy("bucket").applyInArrow(_answered, "bucket bigint, block bigint, n binary, c binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"id {id_type}, n_tokens bigint, score double, around array<bigint>, token array<bigint>, logp array<double>, n array<bigint>, c array<bigint>")
    total = F.round(F.col("score") + F.col("gain"), 3)
    mean = F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 5))
    return remembered(scored).select(F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))
