"""Tables with versions in a shared folder: what runs store of issues, failures, profiles, evaluations and records.

    root/data/<folder>/part=<n>/...     rows in order, each with its place `pos` in its part
    root/counts/<folder>/...            how many rows of each kind are in each part
    root/versions/<n>.json              what version n is made of; there is no version without it

A version is one small file, named last, so readers see all of a version or nothing of it. A writer says which version
it has read; if there is a newer one by the time it commits, it is refused. The check is as atomic as the store's rename.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a part, about.
PART_ROWS = 100_000
_PLACE_BITS = 33  # of monotonically_increasing_id that number the rows of a partition


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: tuple[str, ...] = ()
    schema: str = ""
    rows: int = 0
    truncated: bool = False
    facets: tuple[str, ...] = ()
    cut: tuple[int, int] | None = None  # part and place from which rows are left out
    note: dict = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        names = [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The newest, or that of a number; number 0 and without rows where nothing has been written."""
        known = self.versions()
        number = (known[-1] if known else 0) if number is None else number
        if not number:
            return Version()
        (row,) = self.spark.read.text(f"{self.root}/versions/{number}.json", wholetext=True).collect()
        raw = json.loads(row["value"])
        return Version(**{**raw, "folders": tuple(raw["folders"]), "facets": tuple(raw["facets"]), "cut": raw["cut"] and tuple(raw["cut"])})

    def _commit(self, version: Version) -> Version:
        final = self._path(f"{self.root}/versions/{version.number}.json")
        draft = self._path(f"{self.root}/drafts/{version.number}-{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        self._files.mkdirs(final.getParent())
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise Conflict(f"{self.root} has a version {version.number} already")
        return version

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the newest few, and what only they are made of. For when nobody reads or writes them."""
        known = self.versions()
        for number in known[:-keep]:
            self._files.delete(self._path(f"{self.root}/versions/{number}.json"), False)
        named = {f for n in known[-keep:] for f in self.version(n).folders}
        for kind in ("data", "counts"):
            at = self._path(f"{self.root}/{kind}")
            for x in self._files.listStatus(at) if self._files.exists(at) else ():
                if x.getPath().getName() not in named:
                    self._files.delete(x.getPath(), True)

    # --- writing

    def replace(self, rows: DataFrame, base: int, order: list[str | Column], facets: tuple[str, ...] = (), limit: int | None = None, **note) -> Version:
        """A version of these rows alone, by rising values of `order`; at most the first `limit` of them, and whether there were more."""
        folder = uuid.uuid4().hex
        by = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
        parts = max(1, -(-rows.count() // PART_ROWS))
        placed = rows.withColumns(by).repartitionByRange(parts, *by) if by else rows.repartition(parts)
        placed = placed.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *by).drop(*by)
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
        placed.withColumn("pos", at).write.partitionBy("part").parquet(f"{self.root}/data/{folder}")
        version = Version(base + 1, (folder,), f"{_ddl(rows)}, pos long, part int", facets=tuple(facets), note=note)
        held = self._rows(version)
        sizes = [(r["part"], r["n"]) for r in held.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]  # a row for each part
        total, cut, before = sum(n for _, n in sizes), None, 0
        for part, n in sizes:
            if limit is not None and before + n > limit and cut is None:
                cut = (part, limit - before)
            elif cut is not None:
                self._files.delete(self._path(f"{self.root}/data/{folder}/part={part}"), True)
            before += n
        version = replace(version, rows=total if limit is None else min(total, limit), truncated=cut is not None, cut=cut)
        self._rows(version).groupBy("part", *facets).agg(F.count("*").alias("n")).write.parquet(f"{self.root}/counts/{folder}")
        return self._commit(version)

    def append(self, rows: DataFrame, base: int) -> Version:
        """A version with these rows beside those of the one before; they are in no order."""
        old, folder = self.version(base), uuid.uuid4().hex
        rows.withColumns({"pos": F.lit(0).cast("long"), "part": F.lit(0)}).write.partitionBy("part").parquet(f"{self.root}/data/{folder}")
        schema = f"{_ddl(rows)}, pos long, part int"
        version = Version(base + 1, (*old.folders, folder), schema)
        return self._commit(replace(version, rows=old.rows + self._rows(replace(version, folders=(folder,))).count()))

    def clear(self, base: int) -> Version:
        return self._commit(Version(base + 1))

    # --- reading

    def _rows(self, version: Version) -> DataFrame:
        rows = self.spark.read.schema(version.schema).option("basePath", f"{self.root}/data")
        found = None
        for folder in version.folders:
            own = rows.option("basePath", f"{self.root}/data/{folder}").parquet(f"{self.root}/data/{folder}")
            found = own if found is None else found.unionByName(own)
        if version.cut is not None:
            part, place = version.cut
            found = found.where((F.col("part") < part) | ((F.col("part") == part) & (F.col("pos") < place)))
        return found

    def read(self, number: int | None = None, schema: str | None = None) -> DataFrame:
        """All rows of a version. schema: of the empty table where there is none."""
        version = self.version(number)
        if not version.folders:
            if schema is None:
                raise LookupError(f"{self.root} holds nothing")
            return self.spark.createDataFrame([], schema)
        return self._rows(version).drop("part", "pos")

    def page(self, limit: int, offset: int = 0, number: int | None = None, **asked) -> tuple[DataFrame, int]:
        """(rows, total): a page of the rows asked for, in order, and how many there are. Only the parts that hold it are read.

        asked: values of the version's facets; None asks for any.
        """
        version = self.version(number)
        asked = {k: v for k, v in asked.items() if v is not None}
        if unknown := set(asked) - set(version.facets):
            raise ValueError(f"not counted by {sorted(unknown)}")
        rows, (folder,) = self._rows(version), version.folders
        counts = self.spark.read.parquet(f"{self.root}/counts/{folder}")
        for k, v in asked.items():
            rows, counts = rows.where(F.col(k) == v), counts.where(F.col(k) == v)
        sizes = [(r["part"], r["n"]) for r in counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()]
        total, before, parts, skipped = sum(n for _, n in sizes), 0, [], None
        for part, n in sizes:
            if before + n > offset and before < offset + limit:
                skipped = before if skipped is None else skipped
                parts.append(part)
            before += n
        page = rows.where(F.col("part").isin(parts)).orderBy("part", "pos").offset(offset - (skipped or 0)).limit(limit)
        return page.drop("part", "pos"), total


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
