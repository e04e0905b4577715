"""Hard negatives by exact search in inverted lists.

K-means centroids, fitted on a bounded sample, deal all rows into clusters. A cluster's rows, by their distance from its
centroid, are cut into lists of bounded size; each list is stored as one row with the mean of its vectors, the radius around
that mean and its smallest id. No score of a list can exceed q.c + |q|r (Cauchy-Schwarz) or fall below q.c - |q|r. A query visits
lists in the order of the upper bound; lists outside the window of scores it asks for are skipped, and it stops where the bound
falls strictly below the score of its kth row so far (or equals it with no smaller id in the list). Visits are made in rounds, a
join of queries with lists and a merge of the best rows each, until no query has a list left to visit: the result is exact.

What is broadcast: the centroids, MOST_CENTROIDS at most, and a mean, radius and id for each list. Lists grow with the input
so that there are MOST_LISTS of them at most, apart from one more for each centroid and each partition.

Defined cases: rows take no part if their id, label or vector is null, if a component is null or not finite, or if one scaled
to an integer reaches 2**26, beyond which sums leave 64 bits; a shorter vector counts as filled up with zeros; of rows that share
an id one takes part, that with the smallest label, then vector; equal scores are ordered by id; an anchor with no other row of its
label, and a positive with a score under zero, have no negatives; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import limit_batches, stored

#: Rows that the centroids are fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 16_384
MOST_CENTROIDS, MOST_LISTS, LEAST_LIST = 1024, 8192, 512
#: Queries that are compared with a list in one step, and sent to it in one row. Rows are read back by thousands, so they stay narrow.
STEP, SENT = 512, 64
#: Bounds (of queries with lists) that are computed in one step, and rows sent in one batch.
CELLS, ROWS = 1 << 20, 1024
#: Lists that a query visits in the first round; each round goes so many times as far as the one before.
FIRST_ROUND, GROWTH = 8, 8
_NONE = -(1 << 62)
_LIMIT = 1 << 26


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label and v, the scaled and floored components, of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce((F.abs(F.floor(x * scale)) < _LIMIT) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & fine)
    rows = stored(rows.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("v")), "vectors")
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return stored(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*"), "vectors")


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow column of integer lists as rows of `dims` components, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), flat.dtype)
    out[np.arange(dims)[None] < sizes[:, None]] = flat
    return out


def centroids_of(x: np.ndarray, k: int, steps: int = 8, seed: int = 0) -> np.ndarray:
    """K-means by Lloyd's steps, from k rows drawn among the distinct ones."""
    x = x.astype(np.float64)
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(steps):
        at = nearest(x, c)[0]
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths, step = (c * c).sum(1)[None], max(1, CELLS // len(c))
    at = np.concatenate([(lengths - 2 * (x[k : k + step] @ c.T)).argmin(1) for k in range(0, len(x), step)] or [np.zeros(0, np.int64)])
    return at, np.sqrt(((x - c[at]) ** 2).sum(1))


_LIST = "list_id bigint, n bigint, min_id bigint, radius double, mean binary, ids binary, labels binary, vectors binary"


def _list(list_id: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict:
    order = np.argsort(ids, kind="stable")
    mean = x.mean(0)
    radius = float(np.sqrt(((x - mean) ** 2).sum(1)).max())
    return {"list_id": list_id, "n": len(ids), "min_id": int(ids.min()), "radius": radius, "mean": mean.tobytes(), "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": x[order].astype(np.int32).tobytes()}


def inverted_lists(rows: DataFrame, n_rows: int, dims: int) -> DataFrame:
    """A row for each list, of bounded size; stored."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    c = centroids_of(matrix(sample.column("v"), dims), max(1, min(MOST_CENTROIDS, int(n_rows**0.5) // 2)))
    most = max(LEAST_LIST, -(-n_rows // MOST_LISTS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = nearest(matrix(batch.column("v"), dims).astype(np.float64), c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(distance, pa.float64())], names=[*batch.schema.names, "cluster", "distance"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, None
        schema = pa.schema([("list_id", pa.int64()), ("n", pa.int64()), ("min_id", pa.int64()), ("radius", pa.float64()), *((k, pa.binary()) for k in ("mean", "ids", "labels", "vectors"))])
        for batch in batches:
            new = [np.asarray(batch.column(k)) for k in ("cluster", "vec_id", "label")] + [matrix(batch.column("v"), dims).astype(np.float64)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            edges = [0, *(np.flatnonzero(np.diff(held[0])) + 1).tolist(), len(held[0])]
            done, start = [], 0
            for a, b in zip(edges, edges[1:], strict=False):
                for start in range(a, b, most):
                    if min(start + most, b) < len(held[0]):  # the last list may go on in the next batch
                        done.append(_list(base + made, *(x[start : min(start + most, b)] for x in held[1:])))
                        made += 1
            held = [x[start:] for x in held]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_pylist([_list(base + made, *held[1:])], schema)

    clustered = rows.mapInArrow(dealt, "vec_id bigint, label bigint, v array<int>, cluster int, distance double")
    return stored(clustered.repartitionByRange("cluster", "distance", "vec_id").sortWithinPartitions("cluster", "distance", "vec_id").mapInArrow(cut, _LIST), "lists")


class Summary:
    """Means, radii and smallest ids of all lists, by smallest id."""

    def __init__(self, lists: DataFrame):
        found = lists.select("list_id", "min_id", "radius", "mean").toArrow().sort_by([("min_id", "ascending"), ("list_id", "ascending")])
        self.ids, self.min_ids, self.radii = (found.column(k).to_numpy() for k in ("list_id", "min_id", "radius"))
        self.means = np.frombuffer(b"".join(found.column("mean").to_pylist()), np.float64).reshape(len(self.ids), -1)
        self.lengths = np.sqrt((self.means**2).sum(1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest whole score that each list can hold for each query."""
        q = q.astype(np.float64)
        length = np.sqrt((q * q).sum(1))[:, None]
        middle, reach = q @ self.means.T, length * self.radii[None]
        slack = 1e-3 + 1e-9 * length * (self.lengths + self.radii)[None]
        return np.ceil(middle - reach - slack), np.floor(middle + reach + slack)

    def visits(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) for the lists from place `start` to `end` in the order of the bound that a query still has to visit."""
        least, most = self.bounds(q)
        bound = np.where((most >= lo[:, None]) & (least <= hi[:, None]), np.minimum(most, hi[:, None]), -np.inf)
        at = np.argsort(-bound, axis=1, kind="stable")[:, start:end]
        bound = np.take_along_axis(bound, at, 1)
        open_ = (bound > kth[:, None]) | (bound == kth[:, None]) & (self.min_ids[at] < kth_id[:, None])
        query, place = np.nonzero(open_ & (bound > -np.inf))
        return query, at[query, place]


_SENT = ("anchor_id", "positive_id", "label", "lo", "hi", "kth")
_VISIT = "list_id bigint, " + ", ".join(f"q_{k} binary" for k in (*_SENT, "v"))


def visited(queries: DataFrame, summary: Summary, dims: int, start: int, end: int) -> DataFrame:
    """A row for each list and each SENT queries, at most, that visit it, by anchor; q_v has the vector of each anchor once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("list_id", pa.int64()), *((f"q_{k}", pa.binary()) for k in (*_SENT, "v"))])
        step = max(16, min(STEP, CELLS // len(summary.ids)))
        for batch in batches:
            batch = batch.sort_by("anchor_id")
            for piece in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                col = {k: np.asarray(piece.column(k)) for k in (*_SENT, "kth_id")}
                v = matrix(piece.column("v"), dims).astype(np.int32)
                query, lists = summary.visits(v, *(col[k] for k in ("lo", "hi", "kth", "kth_id")), start, end)
                order = np.argsort(lists, kind="stable")
                query, lists = query[order], lists[order]
                edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
                out = []
                for a, b in ((k, min(k + SENT, b)) for a, b in zip(edges, edges[1:], strict=False) for k in range(a, b, SENT)):
                    of = query[a:b]
                    anchors = col["anchor_id"][of]
                    first = of[np.r_[True, anchors[1:] != anchors[:-1]]]
                    out.append({"list_id": int(summary.ids[lists[a]]), "q_v": v[first].tobytes()} | {f"q_{k}": col[k][of].tobytes() for k in _SENT})
                    if len(out) == ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return queries.select(*_SENT, "kth_id", "v").mapInArrow(run, _VISIT)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products. Sums under 2**53 are exact in floating point."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best_of_list(row: dict, visits: list[dict], dims: int, k: int, same_label: bool) -> tuple[np.ndarray, ...]:
    """anchor, positive, id and score of the best k rows of a list for each query of the rows that visit it."""
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    x = np.frombuffer(row["vectors"], np.int32).reshape(len(ids), dims)
    anchor, positive, label, lo, hi, kth = (np.frombuffer(b"".join(v[f"q_{c}"] for v in visits), np.int64) for c in _SENT)
    q = np.frombuffer(b"".join(v["q_v"] for v in visits), np.int32).reshape(-1, dims)
    begins = np.r_[True, anchor[1:] != anchor[:-1]]  # a vector for each anchor of a row of visits
    begins[np.cumsum([len(v["q_label"]) // 8 for v in visits[:-1]], dtype=np.int64)] = True
    score = products(q, x)[np.cumsum(begins) - 1]
    fine = ((labels[None] == label[:, None]) == same_label) & (ids[None] != anchor[:, None]) & (score >= np.maximum(lo, kth)[:, None]) & (score <= hi[:, None])
    if len(ids) > k:
        masked = np.where(fine, score, _NONE)
        fine &= score >= np.partition(masked, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
    query, at = np.nonzero(fine)
    order = np.lexsort((at, -score[query, at], query))  # the rows of a list are in the order of their ids
    query, at = query[order], at[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, "left")
    query, at = query[place < k], at[place < k]
    return anchor[query], positive[query], ids[at], score[query, at]


def best_rows(queries: DataFrame, lists: DataFrame, summary: Summary, dims: int, k: int, same_label: bool) -> DataFrame:
    """anchor_id, positive_id, id, score and place of the best k rows for each query: rows with its label, or with another one, whose score
    lies from lo to hi. `queries`: anchor_id, positive_id, label, lo, hi, v."""
    spark = queries.sparkSession
    keys = ["anchor_id", "positive_id"]
    by_score = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each list, then what visits it, as they come: one list is held, and STEP queries."""
        now, visits, n = None, [], 0
        for row in (batch.slice(at, 1).to_pylist()[0] for batch in batches for at in range(batch.num_rows)):
            if visits and (row["ids"] is not None or n >= STEP):
                yield from best_of(now, visits)
                visits, n = [], 0
            if row["ids"] is not None:
                now = row
            else:
                visits.append(row)
                n += len(row["q_label"]) // 8
        if visits:
            yield from best_of(now, visits)

    def best_of(now: dict, visits: list[dict]) -> Iterator[pa.RecordBatch]:
        found = best_of_list(now, visits, dims, k, same_label)
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=[*keys, "id", "score"])

    best = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, id bigint, score bigint, place int")
    start, end = 0, FIRST_ROUND
    while start < len(summary.ids):
        last = best.where(F.col("place") == k).select(*keys, F.col("score").alias("kth"), F.col("id").alias("kth_id"))
        open_ = (queries.join(last, keys, "left") if start else queries.withColumns({"kth": F.lit(None).cast("bigint"), "kth_id": F.lit(None).cast("bigint")})).fillna({"kth": _NONE, "kth_id": _NONE})
        visits = stored(visited(open_, summary, dims, start, end), "visits")
        if visits.isEmpty():
            break
        both = lists.select("list_id", "ids", "labels", "vectors").unionByName(visits, allowMissingColumns=True)
        met = both.repartition("list_id").sortWithinPartitions("list_id", F.col("ids").isNull())  # a list comes before its visits
        found = met.mapInArrow(run, "anchor_id bigint, positive_id bigint, id bigint, score bigint")
        best = stored(best.drop("place").unionByName(found).withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k), "best")
        start, end = end, end * GROWTH
    return best


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label",
    scale: int = 256, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """For each anchor (a condition on vec_id, label and v) and each of its best rows of the same label, the best rows of other labels whose score
    lies from `low` to `high` per cent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    limit_batches(spark)
    rows = whole_vectors(df, id_col, vector_col, F.col(label) if isinstance(label, str) else label, scale)
    n_rows, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n_rows or not dims:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    lists = inverted_lists(rows, n_rows, dims)
    summary = Summary(lists)
    asked = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    first = asked.select("anchor_id", F.col("anchor_id").alias("positive_id"), "label", F.lit(_NONE).alias("lo"), F.lit(-_NONE).alias("hi"), "v")
    positives = best_rows(first, lists, summary, dims, n_positives, True).where("score >= 0").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = positives.withColumns({"lo": F.expr(f"({low} * positive_score + 99) div 100"), "hi": F.expr(f"({high} * positive_score) div 100")})
    windows = stored(windows.join(asked, "anchor_id"), "windows")
    found = best_rows(windows.drop("positive_score"), lists, summary, dims, n_negatives, False)
    scores = windows.select("anchor_id", "positive_id", "positive_score")
    return found.join(scores, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
