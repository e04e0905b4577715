"""N-gram Jaccard join: all pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more, as connected groups.

Signatures are prefixes of token combinations. Shingles are ordered by class (rare before frequent), then by a hash. Two linked
sets share at least two shingles within their prefixes of `n - ceil(0.75 n) + 2` (one more than one shared shingle
needs). If one of those is rare, the index of single rare shingles brings the two together; else both are frequent, and the
index of pairs of frequent shingles does. Candidates are then verified on their texts.

What is done for scale:

* equal sets are folded into one first, by a digest, so copies cost one row each;
* the prefixes leave a task as packed arrays, one for each of a number of buckets that grows with the input; a bucket is sorted in
  numpy and gives the distinct lists of documents that share a rare shingle (`listed` at most each);
* a shingle in more prefixes than `listed` is frequent. It is handled
  as plain rows with map-side combined aggregations, never as a gathered group;
* candidates are verified in steps. First every document against one centre of each of its lists and frequent shingles, which
  links groups of near copies in a number of pairs linear in their size. Components are then found, and only
  candidates in different components are left. Of those that share frequent shingles only, a document stays open if one of another component with the same shingle can have
  enough in common with it, told by counts for each size. While a shingle has more than `block` open documents outside its largest component, further centres are tried, again linear. The last step
  is complete: lists give their pairs, combinations of two frequent shingles theirs. The combinations with the same later shingle are handled
  together, in blocks of bounded size, and a pair only at its first combination;
* a bit map of each set rules most candidates out (it bounds the intersection from above, so no link is lost);
* texts are only fetched for documents in a candidate pair that is left, compressed.

Defined cases: a null or blank text has the empty set and links with nothing; fewer than five words are one shingle; a
null id keeps its row, with no links and a null component; rows that share an id are one node; an empty table gives an empty result; columns besides the
two named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import BROADCAST_ROWS, arrow_bytes, filtered_by_ids, limit_batches, mixed, stored

WORDS = 5
#: Similarity as a fraction of whole numbers: linked if DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Bytes of text that are hashed together.
SLICE = 1 << 20


@dataclass(frozen=True)
class Limits:
    """What bounds a task. None of these changes a result."""

    #: A rare shingle is in so many sets at most.
    listed: int = 64
    #: Frequent shingles that tasks get as a sorted array of 8 bytes each; the rarer ones beyond are found from their lists.
    most_frequent: int = 1_000_000
    #: Prefix shingles in a bucket, about; a bucket takes 20 bytes for each.
    bucket_rows: int = 1_000_000
    #: Members of lists in a bucket, about.
    bucket_members: int = 20_000
    #: Documents of one frequent shingle that a task compares with as many others, and the shingles that it looks at together.
    block: int = 1024
    columns: int = 4096
    #: Rounds that join large groups around further centres before pairs are compared.
    peels: int = 6


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.array([pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places about SLICE bytes apart that split no word."""
    cuts = [0]
    while cuts[-1] + SLICE < len(data):
        at = cuts[-1] + SLICE
        row = int(offsets[np.searchsorted(offsets, at)])
        while at < row:
            space = np.flatnonzero(_SPACE[data[at : min(at + 4096, row)]])
            if len(space):
                row = at + int(space[0])
            at += 4096
        cuts.append(row)
    return [*cuts, len(data)] if cuts[-1] < len(data) else cuts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the rows, and where each row's words begin and end among them. A slice of the bytes is looked at at a time."""
    cuts, hashes, starts = _cuts(data, offsets), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        found, places = _slice_hashes(data[a:b], rows)
        hashes.append(found)
        starts.append(places + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _slice_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place of each word; a word also begins where a row does."""
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[rows] |= word[rows]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    data, word = data[starts[0] :], word[starts[0] :]
    place = np.arange(len(data)) - np.repeat(starts - starts[0], np.diff(np.r_[starts - starts[0], len(data)]))
    place[~word] = 0
    terms = (_LOWER[data] + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    terms[~word] = 0
    sums = np.add.reduceat(terms, starts - starts[0])
    sizes = np.add.reduceat(word.astype(np.uint64), starts - starts[0])
    return mixed(sums ^ (sizes << np.uint64(56))), starts


def shingle_sets(column) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    at = 0
    while at < len(column):
        _, sizes = arrow_bytes(column.slice(at))
        n = max(1, int(np.searchsorted(sizes, SLICE, "right")) - 1)
        data, offsets = arrow_bytes(column.slice(at, n))
        words, bounds = word_hashes(data, offsets)
        grams = np.zeros(0, np.uint64)
        if len(words) >= WORDS:
            grams = words[: len(words) - WORDS + 1] * _PLACES[0]
            for k in range(1, WORDS):
                grams = grams + words[k : len(words) - WORDS + 1 + k] * _PLACES[k]
            grams = mixed(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(grams[a : b - WORDS + 1])
            elif b > a:
                yield mixed(np.array([(words[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield grams[:0]
        at += n


def prefix_length(n: int) -> int:
    """Two sets of which one has n elements, if linked, share two at least within prefixes of this length (or all of one)."""
    return min(n, n - -(-NUM * n // DEN) + 2)


def sketch(s: np.ndarray, width: int) -> bytes:
    """A bit map of a set with `width` to twice as many bits for each element."""
    m = width << max(4, (len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(m, bool)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """An upper bound of the intersection of two sets of nx and ny elements, of their sketches: a bit that one lacks is an element that it lacks."""
    if len(x) > len(y):
        x, y, nx, ny = y, x, ny, nx
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        b = (b >> bits) | (b & ((1 << bits) - 1))
    both = (a & b).bit_count()
    return min(nx - a.bit_count() + both, ny - b.bit_count() + both)


_PROFILE = "id bigint, n bigint, key binary, small binary, sketch binary, prefix binary"


def profiles(rows: DataFrame) -> DataFrame:
    """id, number of shingles, digest and sketches of the set of each row, and its prefix if all shingles were ordered by their hashes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), sketch(s, 1), sketch(s, 4), s[: prefix_length(len(s))].tobytes()) for s in shingle_sets(batch.column(1))]
            columns = zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True) if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in columns]], names=["id", "n", "key", "small", "sketch", "prefix"])

    return rows.mapInArrow(run, _PROFILE)


_COUNTS = "token bigint, n bigint"


def _counted(tokens: np.ndarray) -> pa.RecordBatch:
    tokens, n = np.unique(tokens, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])


def _most_frequent(counts: DataFrame, listed: int, most: int) -> np.ndarray:
    """The sorted shingles with more than `listed` documents; if those are more than `most`, the most frequent of them."""
    some = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > listed).orderBy(F.desc("n"), "token").limit(most)
    return np.sort(some.select("token").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def frequent_shingles(rows: DataFrame, sets: DataFrame, listed: int, most: int) -> np.ndarray:
    """The frequent shingles of documents that matter: those with a shingle that is frequent among prefixes by hashes alone. Of these documents all shingles are
    counted, as what lies behind a prefix now is in it once the frequent shingles come last."""
    spark = rows.sparkSession

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _counted(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64))

    first = _most_frequent(sets.select("prefix").mapInArrow(prefixes, _COUNTS), listed, most)
    if not len(first):
        return first
    sent = spark.sparkContext.broadcast(first)

    def concerned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(1).to_pylist()
            has = np.r_[0, np.cumsum(np.isin(np.frombuffer(b"".join(prefix), np.uint64), sent.value))]
            ends = np.cumsum([0, *(len(x) // 8 for x in prefix)])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(has[ends[1:]] > has[ends[:-1]]))], names=["id"])

    ids = stored(sets.select("id", "prefix").mapInArrow(concerned, "id bigint").distinct(), "jaccard-concerned")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _counted(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column(1))]))

    every = _most_frequent(filtered_by_ids(rows, ids, "id", "left_semi").mapInArrow(whole, _COUNTS), listed, most)
    return np.union1d(first, every)


_PACKED = "bucket bigint, tokens binary, docs binary, sizes binary"
_INDEX = "token bigint, known boolean, docs array<bigint>, sizes array<int>"


def packed_prefixes(rows: DataFrame, frequent, buckets: int) -> DataFrame:
    """The prefixes of the rows as packed arrays: rare shingles by bucket, frequent ones in a bucket of the batch's own (negative)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(frequent.value, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tokens, lengths, sizes = [], [], []
            for s in shingle_sets(batch.column(1)):
                p = prefix_length(len(s))
                if len(known) and len(s):
                    is_known = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
                    if is_known[:p].any():
                        s = np.concatenate([s[~is_known], s[is_known]])
                tokens.append(s[:p])
                lengths.append(p)
                sizes.append(len(s))
            if not sum(lengths):
                continue
            token = np.concatenate(tokens)
            doc, size = np.repeat(ids, lengths), np.repeat(np.array(sizes, np.int32), lengths)
            bucket = ((token >> np.uint64(3)) % np.uint64(buckets)).astype(np.int64)
            if len(known):
                bucket[known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token] = -1 - int(xxhash.xxh3_64_intdigest(doc.tobytes()) >> 2)
            order = np.argsort(bucket, kind="stable")
            token, doc, size, bucket = token[order], doc[order], size[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist()
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            columns = [pa.array(bucket[cuts[:-1]], pa.int64())] + [pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (token, doc, size)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "tokens", "docs", "sizes"])

    return rows.mapInArrow(run, _PACKED)


def _lists(table: pa.Table, listed: int) -> pa.Table:
    """A bucket's distinct lists of documents with a rare shingle in common (token null), and the rows of frequent ones (a document each)."""
    token, doc, size = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in (("tokens", np.uint64), ("docs", np.int64), ("sizes", np.int32)))
    order = np.lexsort((doc, token))
    token, doc, size = token[order], doc[order], size[order]
    again = np.r_[False, (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])]
    token, doc, size = token[~again], doc[~again], size[~again]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    counts = np.diff(np.r_[starts, len(token)])
    known = table.column("bucket")[0].as_py() < 0
    flat = np.repeat((counts > listed) | known, counts)
    lists: dict[bytes, tuple[list, list]] = {}
    short = (counts > 1) & (counts <= listed) & ~flat[starts]
    for a, n in zip(starts[short].tolist(), counts[short].tolist(), strict=True):
        lists.setdefault(doc[a : a + n].tobytes(), (doc[a : a + n].tolist(), size[a : a + n].tolist()))
    tokens = [None] * len(lists) + token[flat].view(np.int64).tolist()
    docs = [x for x, _ in lists.values()] + [[x] for x in doc[flat].tolist()]
    sizes = [x for _, x in lists.values()] + [[x] for x in size[flat].tolist()]
    return pa.table([pa.array(tokens, pa.int64()), pa.array([known] * len(tokens), pa.bool_()), pa.array(docs, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["token", "known", "docs", "sizes"])


def _close(a: str, b: str):
    """Whether two sizes allow a link."""
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM)


def _enough(most, a: str, b: str):
    """Whether sizes a, b allow a link, and `most` elements in common do."""
    return _close(a, b) & (most * (DEN + NUM) >= (F.col(a) + F.col(b)) * NUM)


def _prefix_length(n: str):
    return F.least(F.col(n), F.col(n) - F.ceil(F.col(n) * NUM / DEN) + 2)


def _joined(rows: DataFrame, side: DataFrame, on, how: str = "inner") -> DataFrame:
    """`rows` joined with a stored table that is sent to all tasks if it is counted and found small, so that rows of a hot key stay where they are."""
    return rows.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side.hint("merge"), on, how)


def list_stars(lists: DataFrame) -> DataFrame:
    """Each document with the smallest of each of its lists."""
    of_lists = lists.select(F.explode(F.arrays_zip("docs", "sizes")).alias("x"), F.col("docs")[0].alias("b"), F.col("sizes")[0].alias("nb")).select(F.col("x.docs").alias("a"), F.col("x.sizes").alias("na"), "b", "nb")
    return of_lists.where((F.col("a") != F.col("b")) & _close("na", "nb")).select("a", "b").distinct()


def frequent_rows(flat: DataFrame) -> DataFrame:
    """token, doc, size, `rare`: the rare shingles in the document's prefix, and `most`: what it can have in common at most with a document that shares none of those.
    If a shingle that all tasks know as frequent is in the prefix, all rare ones are, as they come first. One frequent shingle alone brings no two documents together."""
    tokens = flat.groupBy("doc", "size").agg(F.collect_set("token").alias("tokens"), F.max("known").alias("known")).where(F.size("tokens") > 1)
    rare = (_prefix_length("size") - F.size("tokens")).cast("int")
    most = F.when(F.col("known"), F.col("size") - rare).otherwise(F.col("size"))
    return stored(tokens.select("doc", "size", rare.alias("rare"), most.alias("most"), F.explode("tokens").alias("token")), "jaccard-frequent")


def frequent_stars(rows: DataFrame, by: tuple[str, ...] = ("token",)) -> DataFrame:
    """Each document with one of those that share a frequent shingle with it: that which has the fewest rare shingles in its prefix, so the likeliest to be what the others are copies of.
    With a root in `rows`, the centres are those of the two likeliest roots, and no pair is of one root."""
    c = F.struct("rare", F.col("doc").alias("b"), F.col("size").alias("nb"), F.col("most").alias("most_b"))
    centres = rows.groupBy(*by).agg(F.min(c).alias("c"))
    apart = F.lit(True)
    if "root" in by:
        order = Window.partitionBy("token").orderBy("c")
        centres = centres.withColumn("k", F.row_number().over(order)).where("k <= 2").withColumnRenamed("root", "root_b")
        apart = F.col("root") != F.col("root_b")
    centres = stored(centres.select("token", "c.b", "c.nb", "c.most_b", *["root_b"] * ("root" in by)), "jaccard-centres")
    pairs = _joined(rows, centres, "token").where((F.col("doc") != F.col("b")) & apart & _enough(F.least("most", "most_b"), "size", "nb"))
    return pairs.select(F.col("doc").alias("a"), "b").distinct()


_PAIRS = "a bigint, b bigint"


def _table_of(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["a", "b"])


def _may_link(table: pa.Table, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of rows i, j (columns doc, size, sketch) that their sketches don't rule out."""
    doc, size, sketches = table.column("doc").to_pylist(), table.column("size").to_pylist(), table.column("sketch").to_pylist()
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        c = most_common(sketches[x], sketches[y], size[x], size[y])
        if DEN * c >= NUM * (size[x] + size[y] - c):
            out.append((doc[x], doc[y]))
    return out


def _list_pairs(table: pa.Table) -> pa.Table:
    """The plausible pairs in different components, of a bucket of lists (k1, k2)."""
    table = table.sort_by([("k1", "ascending"), ("k2", "ascending"), ("doc", "ascending")])
    k1, k2, root, size = (table.column(c).to_numpy() for c in ("k1", "k2", "root", "size"))
    size = size.astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]), True])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if (root[a:b] != root[a]).any():
            r, n = root[a:b], size[a:b]
            small, large = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
            i, j = np.nonzero(np.triu((r[:, None] != r) & (small * DEN >= large * NUM), 1))
            left.append(i + a)
            right.append(j + a)
    i, j = np.concatenate(left), np.concatenate(right)
    doc = table.column("doc").to_numpy()
    _, once = np.unique(np.stack([doc[i], doc[j]]), axis=1, return_index=True)
    return _table_of(_may_link(table, i[once], j[once]))


def _in_common(lists: pa.ListArray, x: np.ndarray, y: np.ndarray, names: np.ndarray, below: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """How many names each row of x has in common with each of y, and how many of those lie before `below`. `columns` names are taken at a time."""
    at = np.searchsorted(names, lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()])
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    common, before = (np.zeros((len(x), len(y)), np.float32) for _ in range(2))
    for first in range(0, len(names), columns):
        inside = (at >= first) & (at < first + columns)
        has = np.zeros((len(lists), min(columns, len(names) - first)), np.float32)
        has[row[inside], at[inside] - first] = 1
        common += has[x] @ has[y].T
        if below > first:
            before += has[x, : below - first] @ has[y, : below - first].T
    return common, before


def _frequent_pairs(table: pa.Table, columns: int) -> pa.Table:
    """The plausible pairs in different components of a block of one frequent shingle's documents, or of two blocks.

    A pair is taken up at its first combination of two common frequent shingles only, of which this is the later one. If they share no rare one, what
    they have in common is the frequent ones in both prefixes and at most what lies behind a prefix."""
    token, low, high = (table.column(c)[0].as_py() for c in ("token", "lo", "hi"))
    own, root, size, limit = (table.column(c).to_numpy() for c in ("own", "root", "size", "most"))
    lists = table.column("tokens").combine_chunks()
    names = np.unique(lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()])
    x, y = np.flatnonzero(own == low), np.flatnonzero(own == high)
    common, before = _in_common(lists, x, y, names, int(np.searchsorted(names, token)), columns)
    size = size.astype(np.int32)
    rest = size - np.array([prefix_length(n) for n in size.tolist()], np.int32)
    sums = size[x][:, None] + size[y][None, :]
    most = np.minimum(common.astype(np.int32) + np.maximum(rest[x][:, None], rest[y][None, :]), np.minimum(limit[x][:, None], limit[y][None, :]))
    open_pairs = (before == 1) & (root[x][:, None] != root[y][None, :]) & (most.astype(np.int64) * (DEN + NUM) >= NUM * sums.astype(np.int64))
    if low == high:
        open_pairs = np.triu(open_pairs, 1)
    i, j = np.nonzero(open_pairs)
    return _table_of(_may_link(table, x[i], y[j]))


def open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The frequent rows, with their roots, that may have a partner under another root at the same shingle: for each size of a shingle's
    documents, the two roots whose documents can have most in common with others say whether there can be one."""
    rooted = stored(rows.join(roots, F.col("doc") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "doc").alias("root")), "jaccard-rooted")
    of_root = rooted.groupBy("token", "size", "root").agg(F.max("most").alias("most"))
    order = Window.partitionBy("token", "size").orderBy(F.desc("most"), "root")
    tops = of_root.withColumn("k", F.row_number().over(order)).where("k <= 2")
    tops = stored(tops.select(F.col("token").alias("t"), F.col("size").alias("nb"), F.col("most").alias("most_b"), F.col("root").alias("root_b")), "jaccard-tops")
    on = (F.col("token") == F.col("t")) & (F.col("root") != F.col("root_b")) & _enough(F.least("most", "most_b"), "size", "nb")
    return stored(_joined(rooted, tops, on, "left_semi"), "jaccard-open")


def list_pairs(lists: DataFrame, roots: DataFrame, sets: DataFrame, bucket_members: int) -> DataFrame:
    """The plausible candidates of the lists whose documents are in different components so far."""
    about = _about(roots, sets)
    # a passage gives the same list for each of its shingles, in any bucket
    listed = lists.dropDuplicates(["docs"]).select(F.xxhash64("docs", F.lit(1)).alias("k1"), F.xxhash64("docs", F.lit(2)).alias("k2"), F.explode(F.arrays_zip("docs", "sizes")).alias("x")).select("k1", "k2", F.col("x.docs").alias("doc"), F.col("x.sizes").alias("size"))
    buckets = lists.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0] // bucket_members + 1
    listed = listed.join(about.drop("sketch").withColumnRenamed("small", "sketch"), ["doc", "size"]).withColumn("bucket", F.pmod("k1", F.lit(buckets)))
    return plausible(listed.groupBy("bucket").applyInArrow(_list_pairs, _PAIRS).distinct(), sets)


def _about(roots: DataFrame, sets: DataFrame) -> DataFrame:
    return sets.join(roots, F.col("id") == F.col("node"), "left").select(F.col("id").alias("doc"), F.col("n").cast("int").alias("size"), "small", "sketch", F.coalesce("root", "id").alias("root"))


def frequent_pairs(still: DataFrame, sets: DataFrame, limits: Limits) -> DataFrame:
    """The plausible candidates among the rows of `open_rows`: pairs at combinations of two frequent shingles."""
    tokens = still.groupBy("doc", "size", "most", "root").agg(F.array_sort(F.collect_set("token")).alias("tokens")).where(F.size("tokens") > 1)
    about = sets.select(F.col("id").alias("doc"), "sketch")
    placed = stored(tokens.join(about, "doc").select("*", F.explode("tokens").alias("token")), "jaccard-placed")
    dealt = _joined(placed, stored(_sides(placed, limits.block), "jaccard-sides"), "token")
    large = F.col("root") == F.col("main")
    block = F.pmod(F.xxhash64("doc"), F.when(large, F.col("mains")).otherwise(F.col("others"))).cast("int")
    dealt = dealt.withColumn("own", F.when(large, -1 - block).otherwise(block))
    others, mains = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("others", "mains"))
    meets = F.when(large, others).otherwise(F.concat(others, F.transform(mains, lambda j: -1 - j)))
    dealt = dealt.withColumn("other", F.explode(meets)).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return dealt.groupBy("token", "lo", "hi").applyInArrow(lambda t: _frequent_pairs(t, limits.columns), _PAIRS).distinct()


def _sides(rows: DataFrame, block: int) -> DataFrame:
    """For each shingle whose documents have several roots, its main root (that of most documents) and in how many blocks its documents and the others are dealt. Documents of the main
    root meet the others only, so that the rows are as many as the documents, and the others once more for each block of them."""
    of_root = rows.groupBy("token", "root").agg(F.count("*").alias("n"))
    sides = of_root.groupBy("token").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all")).where("all > m.n")
    blocks = lambda n: F.ceil(n / block).cast("int")
    return sides.select("token", F.col("m.root").alias("main"), blocks(F.col("m.n")).alias("mains"), blocks(F.col("all") - F.col("m.n")).alias("others"), (F.col("all") - F.col("m.n")).alias("n_others"))


def compressed_texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents, compressed; one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([zlib.compress(x.as_buffer().to_pybytes(), 1) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["id", "packed"])

    return stored(filtered_by_ids(rows, ids, "id", "left_semi").mapInArrow(run, "id bigint, packed binary"), "jaccard-texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose shingle sets are linked."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("packed").alias(f"text_{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(doc: int, packed) -> np.ndarray:
            if doc not in kept:
                (kept[doc],) = shingle_sets(pa.array([zlib.decompress(packed.as_buffer()).decode("utf-8", "replace")], pa.string()))
                if len(kept) > 256:
                    kept.popitem(last=False)
            kept.move_to_end(doc)
            return kept[doc]

        for batch in batches:
            linked = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                u, v = shingles(a, x), shingles(b, y)
                common = len(np.intersect1d(u, v, assume_unique=True))
                linked.append(DEN * common >= NUM * (len(u) + len(v) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return stored(joined.mapInArrow(run, "a bigint, b bigint"), "jaccard-links")


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that their sketches don't rule out."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")), strict=True)
            may = [DEN * (c := most_common(x, y, nx, ny)) >= NUM * (nx + ny - c) for x, y, nx, ny in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(may, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def _links(pairs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    pairs = stored(pairs, name)
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    return verified(pairs, compressed_texts(rows, ids))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links lead to) of each row."""
    spark = df.sparkSession
    limit_batches(spark, 8)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sets = stored(profiles(rows), "jaccard-profiles")
    filled = sets.where("n > 0 AND id IS NOT NULL")
    firsts = stored(filled.groupBy("key").agg(F.min("id").alias("first")), "jaccard-sets")
    same = filled.join(firsts, "key").where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    copies = stored(same.select("a").distinct().join(firsts.select(F.col("first").alias("a")), "a", "left_anti"), "jaccard-copies")
    distinct = filtered_by_ids(rows.where("id IS NOT NULL"), copies, "id", "left_anti")

    known = frequent_shingles(distinct, filtered_by_ids(filled, copies, "id", "left_anti"), limits.listed, limits.most_frequent)
    total = filled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4, int(total * (DEN - NUM) // DEN // limits.bucket_rows) + 1)
    packed = packed_prefixes(distinct, spark.sparkContext.broadcast(known.tobytes()), buckets)
    index = stored(packed.groupBy("bucket").applyInArrow(lambda t: _lists(t, limits.listed), _INDEX), "jaccard-index")
    lists = index.where("token IS NULL").select("docs", "sizes")
    flat = index.where("token IS NOT NULL").select("token", "known", F.col("docs")[0].alias("doc"), F.col("sizes")[0].alias("size"))

    rows_of = frequent_rows(flat)
    links = [_links(plausible(list_stars(lists).union(frequent_stars(rows_of)).distinct(), filled), rows, "jaccard-star")]
    roots = components(links[0])
    still = open_rows(rows_of, roots)
    for _ in range(limits.peels):
        if (_sides(still, limits.block).agg(F.max("n_others")).first()[0] or 0) <= limits.block:
            break
        links.append(_links(plausible(frequent_stars(still, ("token", "root")), filled), rows, "jaccard-peel"))
        if not links[-1].limit(1).count():
            break
        roots = components(reduce(DataFrame.union, links))
        still = open_rows(rows_of, roots)
    links.append(_links(list_pairs(lists, roots, filled, limits.bucket_members).union(frequent_pairs(still, filled, limits)).distinct(), rows, "jaccard-rest"))
    roots = components(reduce(DataFrame.union, [*links, same]))
    out = sets.join(roots, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` but for near copies of a document with a smaller id."""
    dropped = near_duplicates(df, id_col, text_col).where(f"`{id_col}` != component_id").select(F.col(id_col).alias("id")).distinct()
    return filtered_by_ids(df, stored(dropped, "jaccard-dropped"), id_col, "left_anti")
