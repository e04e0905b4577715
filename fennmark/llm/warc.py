"""WARC archives: writing with revisit records, a normaliser for whole-file gzip streams, and reading by index.

`write_archives` lets Spark's own text writer lay records one after another in files that are one gzip stream each,
as many crawlers left them. `normalise` inflates each such stream once, writes every record again as a gzip member of
its own and puts an index of offsets beside the archive. `read_archives` goes by that index: it seeks to each record
and inflates that member alone.

Defined cases: a null payload is empty; a null or many-lined address is written without its line ends; rows with the
same id are records of their own, all of them responses where the id is the smallest of its payload; a null id never
becomes the target of a revisit unless no other has that payload, and then all such records are responses; payloads
under `min_bytes` are always responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, open_file, put_file, stored

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to: the smallest id with the same payload, null for responses.

    Digests and ids are aggregated; what comes of it, a row for each revisit, is sent to all tasks if it is counted and found small, so that payloads stay where they are."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\\r\\n]+", "").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": base32_sha1(F.col("payload"))})
    names = stored(rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest"), "warc-digests")
    firsts = names.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(firsts, "warc-firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    other = (F.col("first_id") < F.col("page_id")) | (F.col("page_id").isNull() & F.col("first_id").isNotNull())
    revisits = names.join(firsts, "payload_digest").where(other).select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("first_id").alias("refers_to"))
    revisits = stored(revisits.distinct(), "warc-revisits")
    small = revisits.count() <= BROADCAST_ROWS
    same = (F.col("payload_digest") == F.col("__digest")) & F.col("page_id").eqNullSafe(F.col("__id"))
    return rows.join(F.broadcast(revisits) if small else revisits.hint("merge"), same, "left").drop("__id", "__digest")


def record(date: str) -> Column:
    """The WARC record of a row of `with_roles`, without the two line ends after it."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), name("page_id"),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), name("refers_to"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), block_bytes.cast("string"),
        F.lit(CRLF * 2), http, F.when(revisit, "").otherwise(F.col("payload")),
    )


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 5000) -> None:
    """Write the rows of `with_roles` as archives of one gzip stream each."""
    rows.select(record(date).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def inflated(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an open file's stream, whether it is one gzip member or several. So much is read, and given out, at a time."""
    d = zlib.decompressobj(wbits=31)
    while data := source.read(chunk):
        while data:
            if d.eof:
                d = zlib.decompressobj(wbits=31)
            yield d.decompress(data, chunk)
            data = d.unused_data if d.eof else d.unconsumed_tail
    if not d.eof:
        yield d.flush()


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Each record's bytes, the two line ends after its block among them."""
    held = bytearray()
    want = 0
    for chunk in chunks:
        held += chunk
        while len(held) >= max(want, 1):
            if not want:
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                want = head + 8 + int(header(bytes(held[:head]))["content-length"])
                continue
            yield bytes(held[:want])
            del held[:want]
            want = 0
    if held:
        raise ValueError(f"the stream ends within a record: {len(held)} bytes left")


def header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split(CRLF)[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def normalise(spark: SparkSession, source: str, target: str, level: int = 4) -> int:
    """Archives below `source`, of any member layout, to archives below `target` with a member for each record, each
    with an index `.cdxj` beside it: a JSON line with id, type, offset and length for each record. Returns the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = path.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".txt")
                index: list[str] = []

                def members(path=path, index=index):
                    at = 0
                    with open_file(path) as source:
                        for raw in records(inflated(source)):
                            fields = header(raw[: raw.index(b"\r\n\r\n")])
                            member = gzip.compress(raw, level, mtime=0)
                            index.append(json.dumps({"id": fields["warc-record-id"], "type": fields["warc-type"], "offset": at, "length": len(member)}))
                            at += len(member)
                            yield member

                put_file(f"{target}/{name}.warc.gz", members())
                put_file(f"{target}/{name}.cdxj", [f'{{"archive": "{name}.warc.gz", "line": {x}}}\n'.encode() for x in index])
                yield pa.RecordBatch.from_pydict({"records": pa.array([len(index)], pa.int64())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return files.mapInArrow(run, "records bigint").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _page(name: str | None) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">") if name else "null"
    return None if found == "null" else int(found)


def _read_record(raw: bytes) -> tuple:
    head = raw.index(b"\r\n\r\n")
    fields = header(raw[:head])
    block = raw[head + 4 : head + 4 + int(fields["content-length"])]
    http = block.index(b"\r\n\r\n")
    size = int(header(block[:http])["content-length"])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response":
        payload = block[http + 4 :]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload is not what its header says")
    return _page(fields["warc-record-id"]), size, digest, kind, _page(fields.get("warc-refers-to"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record that the indexes below `folder` name, read by seeking; a response's payload is held
    against its digest and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, archive = None, None
        for batch in batches:
            out = []
            for line in batch.column("value").to_pylist():
                entry = json.loads(line)
                if entry["archive"] != name:
                    if archive:
                        archive.close()
                    name, archive = entry["archive"], open_file(f"{folder}/{entry['archive']}")
                archive.seek(entry["line"]["offset"])
                out.append(_read_record(gzip.decompress(archive.read(entry["line"]["length"]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)
        if archive:
            archive.close()

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return spark.read.option("pathGlobFilter", "*.cdxj").text(folder).mapInArrow(run, ddl)


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write `pages` to `folder`/raw, normalise to `folder`/archives and read those back."""
    spark = pages.sparkSession
    write_archives(with_roles(pages, id_col, url_col, payload_col, min_bytes), f"{folder}/raw")
    if not normalise(spark, f"{folder}/raw", f"{folder}/archives"):
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_archives(spark, f"{folder}/archives")
