"""Token ids in files: ids ranked by frequency, in byte-aligned codes of variable length with their control bytes apart.

Texts are encoded and stored, ids are counted over all texts, and the most frequent id gets rank 0. Documents are dealt to files by
ranges of their ids, so files in the order of their names, and documents within a file, ascend. A file is a sequence of blocks of
some BLOCK ids, each with whole documents:

    uint32 documents, uint64 ids, uint64 data bytes
    int64 for each document's id, uint8 for each: whether it has one, uint64 for each: how many ids
    a control byte for each four ids: two bits each, from the low ones up, one less than the bytes of its rank
    the ranks' bytes, low bytes first, one to four each

Beside each file lies an index, a JSON line for each block; `manifest.json` has the ids by rank and how many ids lie before each file.
A block is decoded by table lookup: a table of 256 rows gives the sizes that a control byte stands for, their running sums are the
offsets, and a mask for each size cuts its four bytes.

Defined cases: a null text is empty; each document ends with `end_id`, so an empty one has that alone; the strings of added tokens in
a text are those tokens; ids of documents are taken as 64-bit integers, null ids come first; rows that share an id are ordered by a
hash of their tokens, then their number, then the tokens; texts are taken whole, one of more ids than a block has a larger block for
itself; an empty table gives an empty result; other columns are ignored. A task that runs again writes the same files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import limit_batches, open_file, put_file, stored
from .word_bpe import word_vocabulary

#: Ids of a block, about.
BLOCK = 1 << 20
_HEAD = "<IQQ"
#: The four sizes that a control byte stands for; the bits that belong to a value of each size.
SIZES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.int64) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def packed(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-len(values) % 4 + len(values), np.uint8)
    codes[: len(values)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4)[None] < sizes[:, None]].tobytes()


def unpacked(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values of `packed`."""
    sizes = SIZES[control].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    four = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(4, np.uint8)]), 4)[at]
    return np.ascontiguousarray(four).view("<u4").ravel() & _MASKS[sizes]


def encode(df: DataFrame, vocabulary_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids, little-endian in two bytes each where the vocabulary allows it, else in four. No shuffle."""
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = word_vocabulary(vocabulary_path)
        width = id_width(v.size, end_id)
        for batch in batches:
            ids, n = v.encode_column(batch.column(1), end_id)
            offsets = np.r_[0, np.cumsum(n) * width].astype(np.int64)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), data.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def id_width(vocabulary_size: int, end_id: int) -> int:
    return 2 if max(vocabulary_size - 1, end_id) < 1 << 16 else 4


def ids_of(column: pa.Array, width: int) -> np.ndarray:
    """All ids of an Arrow column, one document's after another's."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return np.frombuffer(data, f"<u{width}", (offsets[-1] - offsets[0]) // width, int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, f"<u{width}")


def ids_by_rank(encoded: DataFrame, width: int) -> list[int]:
    """All ids that occur, the most frequent one first (ties: the smaller one). As many as the vocabulary has, at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(ids_of(batch.column(0), width), minlength=len(total))
            n[: len(total)] += total
            total = n
        found = np.flatnonzero(total)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return [r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))]


def blocks(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray, width: int) -> Iterator[tuple[bytes, int]]:
    """Blocks of documents, each with the number of its ids."""
    held: list[tuple] = []
    n_held = 0

    def block() -> tuple[bytes, int]:
        names, sizes, ranks = (np.concatenate([x[k] for x in held]) for k in range(3))
        known = np.concatenate([x[3] for x in held])
        control, data = packed(ranks)
        head = struct.pack(_HEAD, len(sizes), len(ranks), len(data))
        return head + names.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + sizes.astype("<u8").tobytes() + control + data, len(ranks)

    for batch in batches:
        names, sizes = batch.column("doc_id"), np.asarray(batch.column("n_tokens"))
        known, ranks, ends = np.asarray(names.is_valid()), rank_of[ids_of(batch.column("ids"), width)], np.cumsum(sizes)
        names = np.asarray(names.fill_null(0))
        start = 0
        while start < len(sizes):
            before = ends[start] - sizes[start]
            end = max(start + 1, int(np.searchsorted(ends, before + BLOCK - n_held, "right")))
            if held and ends[end - 1] - before + n_held > BLOCK:  # the next document is too large for this block
                yield block()
                held, n_held = [], 0
                continue
            held.append((names[start:end], sizes[start:end], ranks[before : ends[end - 1]], known[start:end]))
            n_held += ends[end - 1] - before
            start = end
            if n_held >= BLOCK:
                yield block()
                held, n_held = [], 0
    if held:
        yield block()


def write(encoded: DataFrame, folder: str, width: int) -> None:
    """Write the rows of `encode`, which must be stored, to files below `folder`."""
    ranked = ids_by_rank(encoded, width)
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}"
        found = blocks(batches, rank_of, width)
        first = next(found, None)
        if first is None:
            return
        index: list[dict] = []

        def written() -> Iterator[bytes]:
            at = start = 0
            for raw, n in chain([first], found):
                index.append({"file": name, "offset": at, "length": len(raw), "start": start})
                at, start = at + len(raw), start + n
                yield raw
            index.append({"n": start})

        put_file(f"{folder}/data/{name}.ids", written())
        total = index.pop()["n"]
        put_file(f"{folder}/index/{name}.json", [(json.dumps(x) + "\n").encode() for x in index])
        yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([total], pa.int64())})

    order = ["doc_id", "hash", "n_tokens"]
    dealt = encoded.withColumn("hash", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    files = sorted(dealt.select("doc_id", "n_tokens", "ids").mapInArrow(run, "file string, n bigint").collect())  # a row for each file
    before, starts = 0, {}
    for name, n in files:
        starts[name], before = before, before + n
    put_file(f"{folder}/manifest.json", [json.dumps({"ids_by_rank": ranked, "files": starts, "ids": before}).encode()])


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document below `folder` and, if asked for, its ids."""
    with open_file(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    id_of, starts = np.array(manifest["ids_by_rank"], "<u4"), manifest["files"]
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    if not starts:
        return spark.createDataFrame([], ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(0).to_pylist():
                entry = json.loads(line)
                with open_file(f"{folder}/data/{entry['file']}.ids") as f:
                    f.seek(entry["offset"])
                    raw = f.read(entry["length"])
                docs, n, n_data = struct.unpack_from(_HEAD, raw)
                at = np.cumsum([struct.calcsize(_HEAD), 8 * docs, docs, 8 * docs, -(-n // 4), n_data]).tolist()
                if at[-1] != len(raw):
                    raise ValueError(f"{entry}: the block is not as long as its head says")
                names, known, sizes = (np.frombuffer(raw, t, docs, a) for t, a in zip(("<i8", "u1", "<u8"), at, strict=False))
                ids = id_of[unpacked(np.frombuffer(raw, np.uint8, at[4] - at[3], at[3]), np.frombuffer(raw, np.uint8, n_data, at[4]), n)]
                ends = np.cumsum(sizes.astype(np.int64))
                begins = ends - sizes.astype(np.int64)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(names, pa.int64(), mask=known == 0), pa.array(begins + entry["start"] + starts[entry["file"]]), pa.array(ends - begins), pa.array(crc, pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int64()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return spark.read.text(f"{folder}/index").mapInArrow(run, ddl)


def through_files(df: DataFrame, folder: str, vocabulary_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode all texts, write them to files below `folder` and read those back."""
    width = id_width(word_vocabulary(vocabulary_path).size, end_id)
    write(stored(encode(df, vocabulary_path, end_id, id_col, text_col), "token-ids", "zstd"), folder, width)
    return read(df.sparkSession, folder, with_ids)
