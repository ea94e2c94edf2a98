"""The tables of the four layers in the session's catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from basketlens.schemas import LAYERS, PARTITION, TABLES, TableSpec
from basketlens.sinks.partitions import overwrite_day, overwrite_days, replace_days, stored_days
from basketlens.sinks.publish import publish_days
from basketlens.sinks.text import write_delimited_text
from basketlens.sources.tables import read_dimension, read_partition
from basketlens.sources.text import field_expressions, read_delimited_text

DECLARED_BUCKETS = {name: spec.buckets for name, spec in TABLES.items() if spec.buckets}


class Warehouse:
    """Names and folders of the layer tables under ``root``, a folder all executors see.

    ``prefix`` is put before the database names, for several warehouses in one catalog.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str = "") -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.prefix = prefix

    def database(self, layer: str) -> str:
        return f"{self.prefix}{layer}"

    def table(self, name: str) -> str:
        return f"{self.database(TABLES[name].layer)}.{name}"

    def path(self, name: str) -> str:
        return f"{self.root}/{TABLES[name].layer}/{name}"

    def create(
        self, tables: Iterable[str] = tuple(TABLES), buckets: Mapping[str, int] | None = None
    ) -> Warehouse:
        """Create databases and ``tables`` that do not exist yet; nothing is dropped.

        ``buckets`` gives the number of buckets of those tables that are to be bucketed and
        sorted (``DECLARED_BUCKETS`` for the modelled ones). By default none is: a bucket is
        read by one task, so the number must fit the data, and a hot key would fill one.
        """
        for layer in LAYERS:
            self.spark.sql(
                f"CREATE DATABASE IF NOT EXISTS {self.database(layer)}"
                f" LOCATION '{self.root}/{layer}'"
            )
        for spec in (TABLES[name] for name in tables):
            if spec.text:
                self._create_text(spec)
            else:
                self._create_orc(spec, (buckets or {}).get(spec.name, 0))
        return self

    def _create_orc(self, spec: TableSpec, buckets: int) -> None:
        parts = [
            f"CREATE TABLE IF NOT EXISTS {self.table(spec.name)} ({spec.full_ddl}) USING orc",
            "OPTIONS (compression 'snappy', partitionOverwriteMode 'dynamic')",
        ]
        if spec.daily:
            parts.append(f"PARTITIONED BY ({PARTITION})")
        if buckets:
            keys = ", ".join(spec.bucket_by)
            parts.append(f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS")
        parts.append(f"LOCATION '{self.path(spec.name)}'")
        self.spark.sql(" ".join(parts))

    def _create_text(self, spec: TableSpec) -> None:
        """A text folder is read through a view with the rules of delimited text."""
        if self.spark.catalog.tableExists(self.table(spec.name)):
            return
        empty = self.spark.createDataFrame([], "value string")
        empty.write.mode("append").text(self.path(spec.name))
        fields = ", ".join(field_expressions(spec.columns))
        self.spark.sql(
            f"CREATE VIEW {self.table(spec.name)} AS"
            f" SELECT {fields} FROM text.`{self.path(spec.name)}`"
        )

    def read(self, name: str, dt: str | None = None) -> DataFrame:
        """A table, or one day of it."""
        if TABLES[name].text:
            return read_delimited_text(self.spark, self.path(name), TABLES[name].columns)
        if dt is None:
            return read_dimension(self.spark, self.table(name))
        return read_partition(self.spark, self.table(name), dt)

    def write_text(self, name: str, df: DataFrame) -> None:
        write_delimited_text(df.select(*TABLES[name].data_columns), self.path(name))

    def write_day(self, name: str, df: DataFrame, dt: str) -> None:
        overwrite_day(df, self.table(name), dt)

    def write_days(self, name: str, df: DataFrame, rebalance: bool = False) -> None:
        overwrite_days(df, self.table(name), rebalance)

    def replace_days(self, name: str, df: DataFrame, days: Sequence[str]) -> None:
        """Replace the partitions of all ``days`` by those of ``df``, which has no other days."""
        replace_days(df, self.table(name), days)

    def publish_days(self, name: str, df: DataFrame, days: Sequence[str]) -> None:
        """The same at one stroke for readers; ``df`` may read these days of the table."""
        publish_days(df, self.table(name), days)

    def days(self, name: str) -> list[str]:
        """The stored days of a table, from the catalog."""
        return stored_days(self.spark, self.table(name))

    def load_dimension(self, name: str, staging: str) -> None:
        """Replace a dimension by the rows of its text table."""
        rows = self.read(staging).select(*TABLES[name].data_columns)
        rows.write.mode("overwrite").insertInto(self.table(name))

    def load_staged_day(self, name: str, staging: str, dt: str) -> None:
        """Load the staged text rows of one day into their partition."""
        self.write_day(name, self.read(staging), dt)
