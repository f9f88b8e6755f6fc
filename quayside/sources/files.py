"""Raw scans: no type is guessed, and every row keeps its place in the source."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.plans.shared import barrier
from quayside.sources import paged, ranges


class SourceUnavailable(ValueError):
    pass


def resolve(location: str, root: str) -> str:
    """A path inside the root; absolute paths and steps upwards are refused."""
    path = PurePosixPath(location)
    if path.is_absolute() or ".." in path.parts:
        raise SourceUnavailable(f"{location} is outside the sources")
    return f"{root.rstrip('/')}/{location}"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All cells as text, empty ones as '', and row_idx, a row's place in the source. Rows that are short end in empty cells.

    A file is read in ranges by as many tasks, quoted line ends included; Spark's own reader reads each record.
    """
    options = {"sep": delimiter, "escape": '"', "multiLine": True}
    names = spark.read.options(header=True, inferSchema=False, **options).csv(path).columns
    if not names:
        raise SourceUnavailable(f"{path} has no header")
    cells = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*cells, "more"])
    records = ranges.delimited_records(spark, path, delimiter)
    rows = records.select(F.col("record").alias("row_idx"), F.from_csv("value", schema, options).alias("r"))
    # More cells than names are an error of the file, as fewer are not.
    rows = rows.where(F.when(F.col("r.more").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("more cells than columns in row "), F.col("row_idx"))).cast("boolean")))
    return rows.select(*[F.coalesce(f"r.{c}", F.lit("")).alias(n.removeprefix("\ufeff")) for c, n in zip(cells, names, strict=True)], "row_idx")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, bare or under "data". Columns are the keys in the order in which they are first seen."""
    return _columns(ranges.json_records(spark, path))


def read_feed(spark: SparkSession, url: str, **options) -> DataFrame:
    """All records of a paged feed, read once into the shared folder. options: token, page_size, pages, pages_per_task."""
    spark.dataSource.register(paged.PagedSource)
    pages = spark.read.format("paged").options(url=url, **options).schema("row_idx long, record string").load()
    return _columns(barrier(pages.toDF("record", "value"), "feed"))


def _columns(records: DataFrame) -> DataFrame:
    """records (record, value) with a column for each key."""
    keys = records.select("record", "value", F.json_object_keys("value").alias("keys"))
    broken = F.when(F.col("keys").isNull(), F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 60))).cast("array<string>"))
    keys = keys.select("record", F.posexplode(F.coalesce("keys", broken)).alias("at", "key")).groupBy("key").agg(F.min(F.struct("record", "at")).alias("first"))
    names = [r["key"] for r in keys.orderBy("first").collect()]  # as many as there are columns
    return records.select(F.col("record").alias("row_idx"), *[_cell(k).alias(k) for k in names])


def _cell(name: str) -> Column:
    """A value as text; lists and objects in one form, whatever the order of their names."""
    path = f"$['{name}']"
    text = F.get_json_object("value", path)
    nested = F.try_variant_get(F.try_parse_json(F.col("value")), F.lit(path), "variant")
    # A text may look like a list or an object; the type tells.
    is_nested = F.schema_of_variant(nested).rlike("^(ARRAY|OBJECT)")
    return F.when(text.rlike(r"^\s*[\[{]"), F.when(is_nested, F.to_json(nested)).otherwise(text)).otherwise(text)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


READERS = {"csv": read_csv, "json": read_json}


def read(spark: SparkSession, kind: str, location: str, root: str | list[str], **options) -> DataFrame:
    """A source by kind: csv or json under one of the roots, or api, whose location is a URL. options as the reader takes them."""
    if kind == "api":
        return read_feed(spark, location, **options)
    if kind not in READERS:
        raise SourceUnavailable(f"unknown kind {kind!r}")
    paths = [resolve(location, r) for r in ([root] if isinstance(root, str) else root)]
    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise SourceUnavailable(f"{location} is not there")
    return READERS[kind](spark, there[0], **options)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(location, kind, n_bytes) of the files right under the root that a reader knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(x.getPath().getName(), x.getPath().getName().rpartition(".")[2].lower(), x.getLen()) for x in store.listStatus(at) if x.isFile()]
    return spark.createDataFrame([x for x in found if x[1] in READERS], "location string, kind string, n_bytes long")
