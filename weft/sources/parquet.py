"""Tables that are opened when a query first reads them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


class ParquetTables(Mapping):
    """Parquet tables of a folder by name, ``NAME.parquet`` each."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str]):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), list(names)
        self.opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.opened[name]

    def __contains__(self, name: object) -> bool:
        return name in self.names

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)
