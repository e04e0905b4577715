"""Attempts at keys as a stream with a state for each key: what is done is seen, what failed is not, and what waits too long blocks.

A key's state is when it was first and last tried, how often, and whether it is done. An attempt that succeeds ends the wait and marks the key as seen; one that the
other side did not answer keeps it waiting; one that was answered in the negative is no wait, but no success either. Later rows of a seen key are repeats. Rows
older than what earlier runs let pass are late: they change no state and go to review. A state that is not touched for `keep` is dropped, so states are bounded by the keys of that time.

Each run reads what has come since the last one and stops; started again with the same folder it goes on where it stopped, and a run that failed is made again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The outcomes of an attempt, and the days that a key may wait.
DONE, UNANSWERED = "done", "unanswered"
MOST_DAYS = 14
_STATE = "done boolean, first bigint, latest bigint, attempts bigint, waits boolean"  # times in microseconds
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Attempts(StatefulProcessor):
    def __init__(self, late_before: int | None, keep: timedelta | None):
        self.late_before, self.keep = late_before, keep

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", _STATE, ttlDurationMs=int(self.keep.total_seconds() * 1000)) if self.keep else handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        done, first, latest, attempts, waits = self.state.get() or (False, None, None, 0, False)  # each call asks the JVM; none gives None
        touched = False
        for row in sorted(rows, key=lambda r: (r.ts, r.outcome or "")):
            if self.late_before is not None and row.ts < self.late_before:
                kind = "late"
            elif done:
                kind = "repeat"
            else:
                touched, attempts, latest = True, attempts + 1, row.ts if latest is None else max(latest, row.ts)
                first = row.ts if first is None else min(first, row.ts)
                done, waits = row.outcome == DONE, row.outcome == UNANSWERED
                kind = "new" if done else "waiting" if waits else "answered"
            yield Row(key=key[0], ts=row.ts, kind=kind, first=first, latest=latest, attempts=attempts)
        if touched:
            self.state.update((done, first, latest, attempts, waits))

    def close(self) -> None:
        pass


OUT = "key string, ts bigint, kind string, first bigint, latest bigint, attempts bigint"


def run(source: DataFrame, folder: str, delay: timedelta | None = None, keep: timedelta | None = None) -> None:
    """One run over a stream of key (string), ts, outcome; what it makes of each row is appended to `folder`/rows. With a `delay`, rows older by it than the newest row of earlier runs are late."""
    spark = source.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    newest = latest_row(spark, folder) if delay else None
    made = source.where("key IS NOT NULL AND ts IS NOT NULL").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "outcome").groupBy("key").transformWithState(_Attempts(newest - int(delay.total_seconds() * 1e6) if newest is not None else None, keep), OUT, "append", "ProcessingTime" if keep else "None")
    how = {"once": True} if keep else {"availableNow": True}  # with a time to live, batches without rows would follow for ever
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    try:
        made.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(**how).start().awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows_of(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that runs have made so far, their times in microseconds; none before the first."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    there = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    return spark.read.schema(OUT).parquet(f"{folder}/rows") if there else spark.createDataFrame([], OUT)


def latest_row(spark: SparkSession, folder: str) -> int | None:
    return rows_of(spark, folder).where("kind <> 'late'").agg(F.max("ts")).first()[0]


def waiting(rows: DataFrame, now) -> DataFrame:
    """key, first, latest, attempts and blocked of the keys that wait, by their last row: blocked if the whole days since the first attempt are more than MOST_DAYS."""
    last = rows.where("kind IN ('new', 'waiting', 'answered')").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("attempts")))).where("place = 1")
    days = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.col("first")) / 86_400_000_000)
    return last.where("kind = 'waiting'").select("key", "first", "latest", "attempts", (days > MOST_DAYS).alias("blocked"))


def may_exceed(waits: DataFrame) -> DataFrame:
    """accepted, waiting, overdue, since: a gap above the ceiling is accepted only if some key waits and none waits too long."""
    counts = waits.agg(F.count("*").alias("waiting"), F.count(F.when(F.col("blocked"), 1)).alias("overdue"), F.min("first").alias("since"))
    return counts.select(((F.col("waiting") > 0) & (F.col("overdue") == 0)).alias("accepted"), "waiting", "overdue", "since")
