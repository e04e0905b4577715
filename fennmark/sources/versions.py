"""Tables in versions: what one run writes becomes visible at once, as a whole, or not at all.

A run writes its tables to a folder of its own and then puts a small file that names them behind the last commit, by a rename that fails if that commit is there. Readers go by the
commits alone, so a run that failed leaves nothing to see, and of two runs that go on from the same version one fails. A commit holds a digest of what the run was made from:
a run from the same input as the last one leaves no further version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(*tables: DataFrame) -> str:
    """A digest of the rows of tables, whatever their order. One pass over each."""
    parts = []
    for df in tables:
        row = F.xxhash64(*[F.col(f"`{c}`").cast("string") if kind == "map" else F.col(f"`{c}`") for c, kind in df.dtypes])
        n, total, mixed = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)"))).first()
        parts.append(f"{','.join(df.columns)}:{n}:{total}:{mixed}")
    return "|".join(parts)


class Versions:
    """The versions below a folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._rename = getattr(hadoop.fs, "Options$Rename").NONE
        self._context = hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        at = self._path(f"{self.folder}/commits")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def commit(self, version: int | None = None) -> dict | None:
        """What a version consists of; the last one's if none is given; null if there is none."""
        known = self.commits()
        if not known or (version is not None and version not in known):
            return None
        at = f"{self.folder}/commits/{known[-1] if version is None else version:08d}.json"
        return json.loads("\n".join(r.value for r in self.spark.read.text(at).collect()))  # a line

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """A table of a version; no rows where there is none yet."""
        found = self.commit(version)
        if not found or table not in found["tables"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(found["tables"][table])

    def publish(self, tables: dict[str, DataFrame], made_from: str, appended: dict[str, DataFrame] | None = None) -> int:
        """Write these tables as the next version, and add rows to those that only grow, unless the last version was made from the same. Tables that are not named stay as they are; rows
        that are there are not written again, as a version lists the folders of all its rows. Returns the version."""
        last = self.commit()
        if last and last["made_from"] == made_from:
            return last["version"]
        version, run = (last["version"] if last else 0) + 1, uuid.uuid4().hex
        paths = dict(last["tables"]) if last else {}
        for name, df in {**tables, **{f"{name}/{version}": df for name, df in (appended or {}).items()}}.items():
            paths[name] = f"{self.folder}/data/{name}-{version}-{run}"
            df.write.parquet(paths[name])
        self._put({"version": version, "made_from": made_from, "tables": paths}, version, run)
        return version

    def read_appended(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """All rows that have been appended to a table up to a version."""
        found = self.commit(version)
        paths = [p for name, p in (found["tables"] if found else {}).items() if name.startswith(f"{table}/")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _put(self, commit: dict, version: int, run: str) -> None:
        part, at = self._path(f"{self.folder}/parts/{run}.json"), self._path(f"{self.folder}/commits/{version:08d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        self._fs.mkdirs(at.getParent())
        kinds = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        kinds[0] = self._rename
        self._context.rename(part, at, kinds)
