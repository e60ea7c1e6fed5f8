"""A date-partitioned parquet table whose partitions are replaced as a whole, and whose readers never see half of a change.

Every write goes to a new generation: ``generation=…/<partition>=…``. A marker lists the (partition, generation) pairs that
are live; a change becomes visible by a new marker, and a reader follows the newest one from beginning to end. Partitions
are few (days within the retention), and compaction keeps their generations few, so the marker stays small. One writer
at a time; superseded files stay until ``vacuum``, for readers that still hold the marker before.
"""

from __future__ import annotations

import json
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracewell.sources import tables

_MARKS, _GENERATION = "_live", "generation"


class Generations:
    """The table under ``path``, partitioned by ``partition``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition: str):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition

    # --- the marker -----------------------------------------------------------------------------------------

    def _marks(self) -> list[int]:
        return sorted(int(n) for n in tables.names(self.spark, f"{self.path}/{_MARKS}") if n.isdigit())

    def live(self) -> set[tuple[str, str]]:
        """The live pairs of partition value and generation."""
        marks = self._marks()
        if not marks:
            return set()
        return {tuple(pair) for pair in json.loads(tables.read_text(self.spark, self._mark(marks[-1])))}

    def _mark(self, number: int) -> str:
        return f"{self.path}/{_MARKS}/{number:012d}"

    def _set_live(self, pairs: set[tuple[str, str]]) -> None:
        number = max(self._marks(), default=0) + 1
        tables.write_text(self.spark, self._mark(number), json.dumps(sorted(pairs)))

    # --- reading --------------------------------------------------------------------------------------------

    def read(self, values: Collection[str] | None = None) -> DataFrame:
        """All live rows, or those of some partition values."""
        pairs = sorted(p for p in self.live() if values is None or p[0] in values)
        if not pairs:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", self.path)
        return reader.parquet(*(self._folder(*p) for p in pairs)).select(*self.schema.names)

    def values(self) -> list[str]:
        return sorted({value for value, _ in self.live()})

    def generations(self, value: str) -> int:
        return sum(value == v for v, _ in self.live())

    def _folder(self, value: str, generation: str) -> str:
        return f"{self.path}/{_GENERATION}={generation}/{self.partition}={value}"

    # --- writing --------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, label: str, options: dict[str, str]) -> set[tuple[str, str]]:
        # The number makes a repeated write another generation: no file of a live one is ever written over.
        generation = f"{label}.{max(self._marks(), default=0) + 1}"
        folder = f"{self.path}/{_GENERATION}={generation}"
        df.select(*self.schema.names).write.mode("overwrite").options(**options).partitionBy(self.partition).parquet(folder)
        return {(value, generation) for value in tables.partition_values(self.spark, folder, self.partition)}

    def append(self, df: DataFrame, label: str) -> None:
        """Add rows. What an earlier attempt under the same label added is taken back by the same marker."""
        pairs = self._write(df, label, {})
        self._set_live(self.without(label) | pairs)

    def without(self, label: str) -> set[tuple[str, str]]:
        return {p for p in self.live() if p[1].rsplit(".", 1)[0] != label}

    def take_back(self, label: str) -> None:
        """Hide what was appended under a label, if anything."""
        kept = self.without(label)
        if kept != self.live():
            self._set_live(kept)

    def replace(self, df: DataFrame, label: str, values: Collection[str] = (), options: dict[str, str] | None = None) -> None:
        """Put rows in the place of all rows of the partitions they are in, and of the partitions ``values``."""
        pairs = self._write(df, label, options or {})
        gone = {value for value, _ in pairs} | set(values)
        self._set_live({p for p in self.live() if p[0] not in gone} | pairs)

    def drop(self, values: Collection[str]) -> None:
        if values:
            self._set_live({p for p in self.live() if p[0] not in set(values)})

    def vacuum(self) -> int:
        """Remove files that are not live and all markers but the newest. Returns the number of partition folders removed."""
        live, removed = self.live(), 0
        for generation in tables.partition_values(self.spark, self.path, _GENERATION):
            folder = f"{self.path}/{_GENERATION}={generation}"
            values = tables.partition_values(self.spark, folder, self.partition)
            for value in values:
                if (value, generation) not in live:
                    tables.remove(self.spark, self._folder(value, generation))
                    removed += 1
            if not any(generation == g for _, g in live):
                tables.remove(self.spark, folder)
        for number in self._marks()[:-1]:
            tables.remove(self.spark, self._mark(number))
        return removed
