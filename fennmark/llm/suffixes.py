"""Suffix-array dedup: every byte that lies in a string of WINDOW bytes which starts in more than one place.

A suffix array of the whole corpus would hold every byte's suffix. Here it is sparse and dealt out:

* each window belongs to an anchor, the place of the smallest hash of GRAM bytes among its first SPAN places. Equal windows
  have their anchors at the same place within them, and CORE bytes from the anchor on are in all windows of an anchor. So an anchor
  whose core occurs once is done with. Cores are met as 64-bit hashes in packed arrays, a bucket of them to a task;
* of the other anchors the bytes that their windows span (the context) are kept, equal ones once. An anchor whose context occurs twice is
  repeated in full. Contexts of one core that differ are sorted as suffixes, from the anchor forwards and from it backwards, by
  deep-shallow sorting: multikey quicksort to SHALLOW bytes (behind the core, which all share), then a blind trie for each group of longer common prefix. The least
  common prefix between two contexts, in both orders, tells which windows of them are equal;
* a core with more than LISTED different contexts (the edges of a passage that very many documents share) is no group for one task. Its
  windows are dealt out one by one as hashes of 128 bits, packed like the cores.

Texts that occur twice are removed whole and stand in all that once. Texts go through a shuffle only if they have a repeated core.

Defined cases: a null text is empty; texts under WINDOW bytes keep all their bytes; runs of one byte repeat themselves at the next
place; a null id keeps its row; rows that share an id are documents of their own, and exact copies of one another if their texts
are equal; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, arrow_bytes, limit_batches, mixed, stored

WINDOW = 400
SPAN = 200
GRAM = 8
CORE = WINDOW - SPAN + 1
#: Bytes of a string that multikey quicksort looks at.
SHALLOW = 6
#: Different contexts of one core that a task compares at most.
LISTED = 256
#: Hashes in a bucket, about; a bucket takes 24 bytes for each.
BUCKET_ROWS = 1_000_000
#: Bytes of text that are looked at together; some 80 bytes of memory for each.
SLICE = 512 << 10
#: Contexts whose windows are hashed together, of up to SPAN windows each; some 200 bytes of memory for a window.
TOGETHER = 500
#: Different contexts in a bucket of cores, about.
BUCKET_CONTEXTS = 20_000

_PLACE = np.uint64((1 << 31) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor, first and last start of the windows that have the anchor, for each anchor of the rows."""
    sizes = np.diff(offsets)
    long_rows = np.flatnonzero(sizes >= WINDOW)
    if not len(long_rows):
        return (np.zeros(0, np.int64),) * 4
    value = data.astype(np.uint64)
    for step in (1, 2, 4):
        value = (value[:-step] << np.uint64(8 * step)) | value[step:]
    value = (mixed(value) & ~_PLACE) | np.arange(len(value), dtype=np.uint64)
    span = 1
    while span * 2 <= SPAN:
        value, span = np.minimum(value[:-span], value[span:]), span * 2
    value = np.minimum(value[: len(value) - (SPAN - span)], value[SPAN - span :])
    counts = sizes[long_rows] - WINDOW + 1
    row = np.repeat(long_rows, counts)
    start = np.arange(len(row)) + np.repeat(offsets[long_rows] - np.r_[0, np.cumsum(counts)[:-1]], counts)
    place = (value[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[first[1:], len(row)] - 1
    return row[first], place[first], start[first], start[last]


def _sliced(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of a column in slices of SLICE bytes or one row: the first row's number, the bytes, the offsets."""
    at = 0
    _, ends = arrow_bytes(column)
    while at < len(column):
        n = max(1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1 - at)
        yield at, *arrow_bytes(column.slice(at, n))
        at += n


def _core_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[p : p + CORE]) for p in places.tolist()), np.uint64, len(places))


_PACKED = "owner binary, bucket bigint, high binary, low binary, refs binary"


def _dealt(high: np.ndarray, low: np.ndarray, refs: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Hashes and what they belong to (fixed-width bytes), as packed arrays. What is repeated here already is known (rows with an owner, the one
    that is repeated) and goes on once, without an owner (zeros)."""
    order = np.lexsort((low, high))
    high, low, refs = high[order], low[order], refs[order]
    new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
    first = np.flatnonzero(new)
    several = np.diff(np.r_[first, len(high)]) > 1
    known = np.repeat(several, np.diff(np.r_[first, len(high)]))
    if known.any():
        yield _by_owner(high[known], refs[known])
    high, low, refs = high[first], low[first], refs[first].copy()
    refs[several] = np.zeros(1, refs.dtype)[0]
    bucket = (high % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]).tolist()
    parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = [[x[p].tobytes() for p in parts] for x in (high, low, refs)]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.binary()), pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), *[pa.array(x, pa.binary()) for x in columns]], names=["owner", "bucket", "high", "low", "refs"])


def _by_owner(high: np.ndarray, refs: np.ndarray) -> pa.RecordBatch:
    """A row for each owner (the first 16 bytes of a ref), with its hashes and refs."""
    raw = np.ascontiguousarray(refs).view(np.uint8).reshape(len(refs), -1)
    owner = np.ascontiguousarray(raw[:, :16]).view(np.uint64)
    order = np.lexsort((owner[:, 1], owner[:, 0]))
    owner = owner[order]
    cuts = np.flatnonzero(np.r_[True, (np.diff(owner.astype(np.int64), axis=0) != 0).any(1), True]).tolist()
    parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = [[raw[p[0], :16].tobytes() for p in parts], [high[p].tobytes() for p in parts], [b""] * len(parts), [refs[p].tobytes() for p in parts]]
    owners, highs, lows, all_refs = (pa.array(x, pa.binary()) for x in columns)
    return pa.RecordBatch.from_arrays([owners, pa.nulls(len(parts), pa.int64()), highs, lows, all_refs], names=["owner", "bucket", "high", "low", "refs"])


def repeated(dealt: DataFrame, width: int) -> DataFrame:
    """owner, high (hashes) and refs of what is repeated, of the rows that `_dealt` made; `width` is the size of a ref in bytes."""

    def run(table: pa.Table) -> pa.Table:
        high, low, refs = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in (("high", np.uint64), ("low", np.uint64), ("refs", f"V{width}")))
        order = np.lexsort((low, high))
        high, low, refs = high[order], low[order], refs[order]
        same = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        again = np.r_[False, same] | np.r_[same, False]
        owned = refs != np.zeros(1, refs.dtype)[0]
        out = [_by_owner(high[again & owned], refs[again & owned])] if (again & owned).any() else []
        return pa.Table.from_batches(out, table.schema)

    found = dealt.where("owner IS NULL").groupBy("bucket").applyInArrow(run, _PACKED)
    return found.union(dealt.where("owner IS NOT NULL")).select("owner", "high", "refs")


def repeated_cores(rows: DataFrame, buckets: int) -> DataFrame:
    """owner (a text's key) and high (hashes) of the cores that occur in more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([x.as_py() for x in batch.column(0)], "V16")
            high, refs = [], []
            for at, data, offsets in _sliced(batch.column(1)):
                row, place, _, _ = anchors(data, offsets)
                high.append(_core_hashes(data, place))
                refs.append(keys[row + at])
            if sum(map(len, high)):
                hashes = np.concatenate(high)
                yield from _dealt(hashes, np.zeros(len(hashes), np.uint64), np.concatenate(refs), buckets)

    return repeated(stored(rows.mapInArrow(run, _PACKED), "suffix-cores"), 16).select("owner", "high")


_CONTEXT = "core bigint, context_id binary, least int, most int, behind binary, ahead binary, key binary, place int"


def contexts(rows: DataFrame) -> DataFrame:
    """A row for each anchor whose core is repeated. The bytes (from the anchor backwards, and forwards) are only in the first row of a context in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("core", pa.int64()), ("context_id", pa.binary()), ("least", pa.int32()), ("most", pa.int32()), ("behind", pa.binary()), ("ahead", pa.binary()), ("key", pa.binary()), ("place", pa.int32())])
        for batch in batches:
            keys, cores = batch.column(0).to_pylist(), batch.column(2)
            met: set[bytes] = set()
            for at, data, offsets in _sliced(batch.column(1)):
                out: list[tuple] = []
                wanted = [np.frombuffer(b"".join(cores[at + k].as_py()), np.uint64) for k in range(len(offsets) - 1)]
                row, place, first, last = anchors(data, offsets)
                hashes = _core_hashes(data, place)
                pairs = np.concatenate([np.stack([np.full(len(w), k, np.uint64), w]) for k, w in enumerate(wanted)], axis=1)
                known = np.unique(mixed(pairs[0] + np.uint64(1)) ^ pairs[1])
                chosen = np.isin(mixed(row.astype(np.uint64) + np.uint64(1)) ^ hashes, known)
                raw = data.tobytes()
                for r, p, a, b, h in zip(row[chosen].tolist(), place[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist(), hashes[chosen].view(np.int64).tolist(), strict=True):
                    behind, ahead = raw[a:p][::-1], raw[p : b + WINDOW]
                    name = xxhash.xxh3_128_digest(b"%d:%d:" % (p - a, p - b) + behind + ahead)
                    body = (behind, ahead) if name not in met else (None, None)
                    met.add(name)
                    out.append((h, name, p - b, p - a, *body, keys[at + r], p - int(offsets[r])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, _CONTEXT)


def common_prefix(s: bytes, t: bytes) -> int:
    low, high = 0, min(len(s), len(t))
    while low < high:
        middle = (low + high + 1) // 2
        if s[low:middle] == t[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    """An inner node of a blind trie: how long the prefix is that its strings share, and its branches by the next byte (-1: none)."""

    __slots__ = ("depth", "branches")

    def __init__(self, depth: int):
        self.depth, self.branches = depth, {}


def blind_trie(strings: list[bytes], which: list[int]) -> tuple[list[int], list[int]]:
    """The numbers `which` in the order of their strings, and each one's common prefix with the one before (0 for the first).

    A string is led down by single bytes, without comparing, to any leaf; its common prefix with that leaf tells where it branches off."""
    at = lambda s, d: s[d] if d < len(s) else -1
    top: _Node | list = [which[0]]  # a leaf is the list of equal strings
    for k in which[1:]:
        s, node = strings[k], top
        while isinstance(node, _Node):
            node = node.branches.get(at(s, node.depth)) or next(iter(node.branches.values()))
        t = strings[node[0]]
        shared = common_prefix(s, t)
        if shared == len(s) == len(t):
            node.append(k)
            continue
        above, node = None, top
        while isinstance(node, _Node) and node.depth < shared:
            above, node = node, node.branches[at(s, node.depth)]
        if not (isinstance(node, _Node) and node.depth == shared):
            fork = _Node(shared)
            fork.branches[at(t, shared)] = node
            if above is None:
                top = fork
            else:
                above.branches[at(s, above.depth)] = fork
            node = fork
        node.branches[at(s, shared)] = [k]
    order, shared_before, waiting = [], [], [(top, 0)]
    while waiting:
        node, before = waiting.pop()
        if isinstance(node, _Node):
            names = sorted(node.branches, reverse=True)
            waiting += [(node.branches[c], before if c == names[-1] else node.depth) for c in names]
        else:
            order += node
            shared_before += [before] + [len(strings[node[0]])] * (len(node) - 1)
    return order, shared_before


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of the strings, and each one's common prefix with the one before it (0 for the first)."""
    order: list[int] = []
    shared: list[int] = []
    waiting = [(list(range(len(strings))), 0, 0)]  # numbers, bytes they share and have been sorted by, bytes shared with what is before
    while waiting:
        group, depth, before = waiting.pop()
        if not group:
            continue
        if len(group) == 1:
            order, shared = order + group, shared + [before]
        elif depth >= SHALLOW:
            some, prefixes = blind_trie(strings, group)
            order, shared = order + some, shared + [before, *prefixes[1:]]
        else:
            letters = [strings[k][depth] if depth < len(strings[k]) else -1 for k in group]
            pivot = sorted(letters)[len(letters) // 2]
            parts = [[k for k, c in zip(group, letters, strict=True) if test(c)] for test in (pivot.__gt__, pivot.__eq__, pivot.__lt__)]
            deeper = depth + 1 if pivot >= 0 else SHALLOW
            firsts = [before if not any(parts[:n]) else depth for n in range(3)]
            waiting += [(parts[2], depth, firsts[2]), (parts[1], deeper, firsts[1]), (parts[0], depth, firsts[0])]
    return order, shared


def _prefix_matrix(strings: list[bytes]) -> np.ndarray:
    """The common prefix of any two of the strings: the least of the sorted order between them."""
    order, shared = deep_shallow(strings)
    n = len(order)
    out = np.zeros((n, n), np.int32)
    steps = np.array(shared, np.int32)
    for i in range(n - 1):
        out[i, i + 1 :] = np.minimum.accumulate(steps[i + 1 :])
    out += out.T
    rank = np.argsort(order)
    return out[np.ix_(rank, rank)]


def repeated_offsets(behind: list[bytes], ahead: list[bytes], least: list[int], most: list[int]) -> list[list[int]]:
    """For each context of one core, the offsets from a window's start to its anchor at which another context has the same window: first, last, first, last, ..."""
    n = len(behind)
    known = CORE if len({x[:CORE] for x in ahead}) == 1 else 0  # all begin with the core, unless two cores have one hash
    low, high = WINDOW - known - _prefix_matrix([x[known:] for x in ahead]), _prefix_matrix(behind)
    low, high = np.maximum(low, np.array(least)[:, None]), np.minimum(high, np.array(most)[:, None])
    i, j = np.nonzero((low <= high) & ~np.eye(n, dtype=bool))
    marks = np.zeros((n, SPAN + 2), np.int32)
    np.add.at(marks, (i, low[i, j]), 1)
    np.add.at(marks, (i, high[i, j] + 1), -1)
    edges = np.diff((np.cumsum(marks, axis=1) > 0).astype(np.int8), axis=1, prepend=0)
    out: list[list[int]] = [[] for _ in range(n)]
    for k in set(i.tolist()):
        begins, ends = np.flatnonzero(edges[k] > 0), np.flatnonzero(edges[k] < 0) - 1
        out[k] = np.stack([begins, ends], axis=1).ravel().tolist()
    return out


_FOUND = "context_id binary, offsets array<int>"


def _compared(table: pa.Table) -> pa.Table:
    """The repeated offsets of the contexts of a bucket of cores."""
    table = table.sort_by([("core", "ascending"), ("context_id", "ascending")])
    core = table.column("core").to_numpy()
    cuts = np.flatnonzero(np.r_[True, core[1:] != core[:-1], True]).tolist()
    names, behind, ahead, least, most = (table.column(c).to_pylist() for c in ("context_id", "behind", "ahead", "least", "most"))
    out: list[list[int]] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out += repeated_offsets(behind[a:b], ahead[a:b], least[a:b], most[a:b])
    return pa.table([pa.array(names, pa.binary()), pa.array(out, pa.list_(pa.int32()))], names=["context_id", "offsets"])


def _single_windows(open_contexts: DataFrame, buckets: int) -> DataFrame:
    """The repeated offsets of contexts whose core has too many, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, TOGETHER) for x in batches for at in range(0, len(x), TOGETHER)):
            high, low, refs = [], [], []
            for name, behind, ahead, least, most in zip(*(batch.column(c).to_pylist() for c in ("context_id", "behind", "ahead", "least", "most")), strict=True):
                whole, p = behind[::-1] + ahead, len(behind)
                for k in range(least, most + 1):
                    h = xxhash.xxh3_128_intdigest(whole[p - k : p - k + WINDOW], seed=k)
                    high.append(h >> 64)
                    low.append(h & 0xFFFFFFFFFFFFFFFF)
                    refs.append(name + k.to_bytes(4, "little"))
            if high:
                yield from _dealt(np.array(high, np.uint64), np.array(low, np.uint64), np.array(refs, "V20"), buckets)

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                k = np.unique(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 20)[:, 16:].copy().view(np.uint32).ravel())
                first = np.flatnonzero(np.r_[True, np.diff(k) != 1])
                out.append(np.stack([k[first], k[np.r_[first[1:], len(k)] - 1]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["context_id", "offsets"])

    found = repeated(stored(open_contexts.mapInArrow(run, _PACKED), "suffix-windows"), 20)
    return found.groupBy(F.col("owner").alias("context_id")).agg(F.collect_list("refs").alias("refs")).mapInArrow(offsets, _FOUND)


def resolved(found: DataFrame) -> DataFrame:
    """context_id and repeated offsets of the contexts."""
    each = stored(found.groupBy("core", "context_id").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")), "suffix-contexts")
    whole = each.where("n > 1").select("context_id", F.array("least", "most").alias("offsets"))
    sizes = stored(each.groupBy("core").agg(F.count("*").alias("different")).where("different > 1"), "suffix-sizes")
    bodies = found.where("behind IS NOT NULL").join(sizes, "core").groupBy("core", "context_id", "different", "least", "most").agg(F.first("behind").alias("behind"), F.first("ahead").alias("ahead"))
    bodies = stored(bodies, "suffix-bodies")
    small = bodies.where(f"different <= {LISTED}")
    small = small.withColumn("bucket", F.pmod("core", F.lit(max(16, small.count() // BUCKET_CONTEXTS + 1))))
    compared = small.groupBy("bucket").applyInArrow(_compared, _FOUND)
    large = bodies.where(f"different > {LISTED}")
    windows = max(1, large.count() * SPAN // 2 // BUCKET_ROWS + 1)
    partly = compared.union(_single_windows(large, windows)).where(F.size("offsets") > 0)
    return whole.union(partly.join(whole.select("context_id"), "context_id", "left_anti"))


_OUTCOME = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of the texts without the bytes from each begin to each end."""
    for batch in batches:
        out = []
        for key, text, begins, ends in zip(*(batch.column(c) for c in ("key", "text", "begins", "ends")), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            marks = np.zeros(len(raw) + 1, np.int64)
            np.add.at(marks, begins.values.to_numpy(), 1)
            np.add.at(marks, ends.values.to_numpy(), -1)
            gone = np.cumsum(marks)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((key.as_py(), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        if out:
            columns = zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["key", "n_removed", "n_spans", "kept_sha256"])


def _those(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with one of the stored, distinct keys; a set that is counted and found small is broadcast, so that other texts stay where they are."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge"), "key", "left_semi")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of each row."""
    spark = df.sparkSession
    limit_batches(spark, 16)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    profile = stored(rows.select("id", "key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-profile")
    counts = stored(profile.where(f"n_bytes >= {WINDOW}").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.max("n_bytes").alias("n")), "suffix-texts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4, int(total * 2 // SPAN // BUCKET_ROWS) + 1)
    spare = stored(profile.join(counts.where("copies > 1"), "key").where("id != first").select("id", "key").distinct(), "suffix-copies")
    few = spare.count() <= BROADCAST_ROWS
    distinct = rows.where(F.octet_length("text") >= WINDOW).join(F.broadcast(spare) if few else spare.hint("merge"), ["id", "key"], "left_anti").select("key", "text")

    cores = repeated_cores(distinct, buckets)
    flags = stored(cores.groupBy(F.col("owner").alias("key")).agg(F.collect_list("high").alias("cores")), "suffix-flags")
    flagged = _those(distinct, flags.select("key")).join(flags, "key").select("key", "text", "cores")
    found = stored(contexts(flagged), "suffix-found")
    known = stored(resolved(found), "suffix-resolved")
    spans = found.select("context_id", "key", "place").join(known, "context_id").select("key", "place", F.posexplode("offsets").alias("k", "offset"))
    ranges = spans.groupBy("key").agg(
        F.collect_list(F.when(F.col("k") % 2 == 1, F.col("place") - F.col("offset"))).alias("begins"),
        F.collect_list(F.when(F.col("k") % 2 == 0, F.col("place") - F.col("offset") + WINDOW)).alias("ends"),
    )
    single = counts.where("copies = 1").select("key")
    ranges = stored(ranges.join(single, "key", "left_semi"), "suffix-ranges")
    cut = _those(distinct, ranges.select("key")).join(ranges, "key").select("key", "text", "begins", "ends").mapInArrow(_cut, _OUTCOME)

    out = profile.join(counts.where("copies > 1").select("key", "copies"), "key", "left").join(stored(cut, "suffix-outcome"), "key", "left")
    copied = F.col("copies").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
