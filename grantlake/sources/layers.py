"""A versioned table kept as a base and overlays.

A version that changes few keys writes only those: the keys themselves, with the version's number, and the rows
that they now have (none, if they are gone). Reading a version takes each key from its newest overlay, and from the base if
it has none. What an update writes is as large as the change, whatever the table.

``Shares`` does so for a table in which many keys hold the same rows: such rows are written once, as a class, and the keys
with the class's name. A class is never changed; keys that hold other rows get another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.operators.shared import spread


class Layers:
    """``path`` holds a folder for each version; ``keys`` and ``schema`` are of this table."""

    def __init__(self, spark: SparkSession, path: str, name: str, keys: tuple[str, ...], schema: str):
        self.spark, self.path, self.name, self.keys, self.schema = spark, path, name, list(keys), schema
        self._key_schema = ", ".join(f"{k} string" for k in self.keys) + ", version long"

    def _at(self, version: int, part: str = "") -> str:
        return f"{self.path}/{version}/{self.name}{part}"

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write_base(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._at(version))

    def write_overlay(self, version: int, keys: DataFrame, rows: DataFrame) -> None:
        """``rows``: all that the ``keys`` have in this version."""
        tag = F.lit(version).cast("long").alias("version")
        keys.select(*self.keys, tag).distinct().write.mode("overwrite").parquet(self._at(version, "-keys"))
        rows.select("*", tag).write.mode("overwrite").parquet(self._at(version, "-rows"))

    def read(self, base: int, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        full, later = self._read(self.schema, [self._at(base)]), range(base + 1, version + 1)
        if not later:
            return full
        newest = self.changed(base, version).groupBy(*self.keys).agg(F.max("version").alias("version"))
        rows = self.overlay(base, version).join(newest, [*self.keys, "version"], "left_semi")
        return full.join(newest, self.keys, "left_anti").select(*full.columns).unionByName(rows.select(*full.columns))

    @staticmethod
    def _later(after: int, version: int) -> range:
        return range(max(after, 0) + 1, version + 1)  # version 0 is a base

    def changed(self, after: int, version: int) -> DataFrame:
        """(keys, version) of the overlays past a version."""
        return self._read(self._key_schema, [self._at(v, "-keys") for v in self._later(after, version)])

    def overlay(self, after: int, version: int) -> DataFrame:
        """(rows, version) of the overlays past a version."""
        return self._read(f"{self.schema}, version long", [self._at(v, "-rows") for v in self._later(after, version)])


class Shares:
    """``keys`` and ``schema`` are those of the whole table; ``by``: keys that a class has in common, beside its name."""

    def __init__(self, spark: SparkSession, path: str, name: str, keys: tuple[str, ...], schema: str, by: tuple[str, ...] = ()):
        self.spark, self.path, self.name, self.schema = spark, path, name, schema
        self._own = Layers(spark, path, name, keys, schema)
        self._places = Layers(spark, path, f"{name}-places", keys, ", ".join(f"{k} string" for k in (*keys, "rep")))
        self._columns = [c.split()[0] for c in schema.split(", ")]
        self._held = [*by, "rep", *(c for c in self._columns if c not in keys)]

    def _at(self, version: int, part: str) -> str:
        return f"{self.path}/{version}/{self.name}-classes{part}"

    def _rows(self, paths: list[str]) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in self._held)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _tagged(self, version: int, rows: DataFrame) -> DataFrame:
        """With names of classes that no other version gives."""
        return rows.withColumn("rep", F.concat(F.lit(f"{version}~"), "rep"))

    def write_base(self, version: int, placed: DataFrame, rows: DataFrame, own: DataFrame) -> None:
        self._places.write_base(version, self._tagged(version, placed))
        self._tagged(version, rows).select(*self._held).write.mode("overwrite").parquet(self._at(version, ""))
        self._own.write_base(version, own)

    def write_overlay(self, version: int, keys: DataFrame, own: DataFrame, placed: DataFrame | None = None, rows: DataFrame | None = None) -> None:
        """``own``, and with classes ``placed`` and ``rows``: all that the ``keys`` have in this version."""
        if placed is None or rows is None:
            placed, rows, _ = self.parts(-1, -1)
        self._places.write_overlay(version, keys, self._tagged(version, placed))
        self._tagged(version, rows).select(*self._held).write.mode("overwrite").parquet(self._at(version, "-rows"))
        self._own.write_overlay(version, keys, own)

    def rebase(self, base: int, version: int) -> None:
        """Write a version that is read through overlays as a base."""
        placed, rows, own = self.parts(base, version)
        self._places.write_base(version, placed)
        rows.join(placed.select("rep").distinct(), "rep", "left_semi").select(*self._held).write.mode("overwrite").parquet(self._at(version, ""))
        self._own.write_base(version, own)

    def parts(self, base: int, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(keys, rep), (by, rep, what a class holds) and the rows of keys that have no class, or more than it."""
        paths = [] if version < 0 else [self._at(base, ""), *(self._at(v, "-rows") for v in range(base + 1, version + 1))]
        return self._places.read(base, version), self._rows(paths), self._own.read(base, version)

    def read(self, base: int, version: int) -> DataFrame:
        """The whole table."""
        placed, rows, own = self.parts(base, version)
        return spread(placed, rows).select(*self._columns).unionByName(own.select(*self._columns))

    def changed(self, version: int) -> DataFrame:
        """(keys, version) of one version's overlay."""
        return self._own.changed(version - 1, version)

    def overlay(self, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The parts of one version's overlay."""
        return self._places.overlay(version - 1, version).drop("version"), self._rows([self._at(version, "-rows")]), self._own.overlay(version - 1, version).drop("version")
