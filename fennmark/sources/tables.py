"""Tables from JSON files, from shards of which a later one wins, and from the tables of HTML pages."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cell_number, is_cell_number
from ..functions.text import ENTITIES, single_blanks


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of files that are one JSON array each; a missing or broken file is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As `json_table`; no rows if the file is missing or broken, which is found by reading it. Any other failure is an error."""
    try:
        rows = json_table(spark, path, schema)
        rows.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" in str(e) or "MALFORMED_RECORD_IN_PARSING" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return rows


class TableFolder:
    """Readers of a folder's tables by name: `folder.parties` is the file `parties.json` with its schema. A table is read when it is first asked for, and once; a missing or broken
    one is an error unless its name is in `optional`. Names without a schema are no tables."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], optional: tuple[str, ...] = ()):
        self._spark, self._folder, self._schemas, self._optional = spark, folder, schemas, optional

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._schemas:
            raise AttributeError(f"no table {name}")
        read = optional_table if name in self._optional else json_table
        rows = read(self._spark, f"{self._folder}/{name}.json", self._schemas[name])
        setattr(self, name, rows)
        return rows


def unarchived(df: DataFrame, column: str = "archived") -> DataFrame:
    """Rows that are not marked as archived; a null is not marked."""
    return df.where(~F.coalesce(F.col(column), F.lit(False)))


def merged_shards(df: DataFrame, key: str, value: str, file: str) -> DataFrame:
    """One value for each key: that of the last file by name."""
    return df.groupBy(key).agg(F.max_by(value, file).alias(value))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def html_tables(html: Column) -> Column:
    """The tables of a page as arrays of rows of cells: entities read, soft hyphens and tags gone, single blanks. What a cell does not have is not looked for one by one."""

    def cell(x: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "­|&shy;", "")
        for name, character in ENTITIES.items():
            text = F.replace(text, F.lit(name), F.lit(character))
        return F.when(x.rlike("[<&\u00ad]"), single_blanks(text)).otherwise(single_blanks(x))

    rows = lambda t: F.transform(_found(t, "(?is)<tr[^>]*>(.*?)</tr>"), lambda r: F.transform(_found(r, "(?is)<t[dh][^>]*>(.*?)</t[dh]>"), cell))
    return F.transform(_found(F.coalesce(html, F.lit("")), "(?is)<table[^>]*>(.*?)</table>"), rows)


def keyed_rows(df: DataFrame, page: str, html: Column, key: str, deviation: str, header: tuple[str, ...] = ()) -> DataFrame:
    """page, key, name, amount of the rows whose first cell matches `key`: the first later cell that is neither empty nor a number, and the number in the column
    that the header calls `deviation`, counted from the right. Only tables with such a header (and all of `header` in it) count."""
    tables = df.select(page, F.explode(html_tables(html)).alias("t"))
    maybe = lambda r: F.lower(F.array_join(r, "\n")).rlike(f"(?m){deviation}")  # noqa: E731  (a row at once; cells hold no line ends)
    heads = F.filter("t", lambda r: maybe(r) & F.exists(r, lambda c: F.lower(c).rlike(deviation)))
    placed = tables.select(page, "t", F.explode(F.slice(heads, 1, 1)).alias("head"))
    for word in header:
        placed = placed.where(F.contains(F.lower(F.array_join("head", "\n")), F.lit(word)))
    last = F.element_at(F.filter(F.transform("head", lambda c, k: F.when(F.lower(c).rlike(deviation), k)), lambda k: k.isNotNull()), -1)
    from_right = F.size("head") - last
    placed = placed.select(page, "t", from_right.alias("from_right"))  # once a table, not for each of its rows
    rows = placed.select(page, "from_right", F.explode("t").alias("r")).where(F.get("r", 0).rlike(key))
    name = F.get(F.filter(F.slice("r", 2, F.size("r")), lambda c: (c != "") & ~is_cell_number(c)), 0)
    amount = cell_number(F.try_element_at("r", -F.col("from_right")))
    return rows.select(page, F.get("r", 0).alias("key"), name.alias("name"), amount.alias("amount"))
