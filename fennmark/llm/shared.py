"""Paths and tables that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset, a temporary folder in local mode, in which all run on one machine; an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file://" + os.path.join(tempfile.gettempdir(), "fennmark-shared")).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is made there yet."""
    return f"{shared_dir(spark)}/fennmark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession, mebibytes: int = 16) -> None:
    """Bound the Arrow batches that Python tasks get by bytes too: rows of documents differ a thousandfold in size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mebibytes << 20))


def local_path(uri: str) -> str | None:
    """The path of a `file:` address or a bare path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def put_file(uri: str, chunks) -> None:
    """Write chunks of bytes to `uri`, whole or not at all: a task that runs twice leaves the same file."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out:
            for x in chunks:
                out.write(x)
        store.move(part, at)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        for x in chunks:
            out.write(x)
    os.replace(part, path)


def open_file(uri: str):
    """A seekable reader of `uri`."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    return store.open_input_file(at)


#: A set of ids of so many rows at most is broadcast: 8 bytes each, and Spark's hash relation takes about four times that.
BROADCAST_ROWS = 500_000


def filtered_by_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """`df` left semi or anti joined with the distinct, stored `ids` (one column). A set that is counted and found small is
    broadcast, so that wide rows stay where they are; a larger one is joined through a shuffle."""
    named = ids.select(ids.columns[0]).withColumnRenamed(ids.columns[0], "__id")
    side = F.broadcast(named) if ids.count() <= BROADCAST_ROWS else named.hint("merge")
    return df.join(side, F.col(column) == F.col("__id"), how)


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column without nulls as one array of bytes and the offsets of its rows; no copy."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
