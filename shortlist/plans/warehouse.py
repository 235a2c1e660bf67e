"""Derived inputs of the registered queries, loaded once per session.

The profiles are built from the star-schema tables and stored in the shared folder, nested and,
table by table as they are asked for, as the six flat tables, the way a user loads a data set once and then
queries it. Without a shared folder every query works on the lazy derivation instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shortlist.operators.normalise import NORMALISERS
from shortlist.plans import derived
from shortlist.session import scratch
from shortlist.sources import tables

_LOADED: dict[tuple[str, str], Warehouse] = {}


class Warehouse:
    """Lazy access to the given tables and to the stored derived ones."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._store = scratch(spark, "warehouse")
        self._nested: DataFrame | None = None
        self._flat: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.folder, name)

    @property
    def candidates(self) -> DataFrame:
        if self._nested is None:
            self._nested = derived.candidates(self.spark, self.folder)
            if self._store:
                schema = self._nested.schema
                self._nested.write.option("compression", "zstd").parquet(f"{self._store}/candidates")
                self._nested = self.spark.read.schema(schema).parquet(f"{self._store}/candidates")
        return self._nested

    def flat_table(self, name: str) -> DataFrame:
        if name not in self._flat:
            if self._store:
                tables.write_tables(self.candidates, self._store, names=[name])
                self._flat |= tables.read_tables(self.spark, self._store, [name])
            else:
                self._flat[name] = NORMALISERS[name](self.candidates)
        return self._flat[name]

    @property
    def flat(self) -> dict[str, DataFrame]:
        return {name: self.flat_table(name) for name in NORMALISERS}

    def __getattr__(self, name: str) -> DataFrame:
        if name in NORMALISERS:
            return self.flat_table(name)
        raise AttributeError(name)


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LOADED:
        _LOADED[key] = Warehouse(spark, folder)
    return _LOADED[key]
