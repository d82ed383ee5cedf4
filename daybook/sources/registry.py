"""Logical names to tables: a source is declared once and read lazily by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[[SparkSession], DataFrame]


class Sources:
    def __init__(self, loaders: dict[str, Loader] | None = None):
        self.loaders: dict[str, Loader] = dict(loaders or {})

    @classmethod
    def parquet_folder(cls, folder: str, names: list[str]) -> "Sources":
        return cls({n: (lambda spark, n=n: spark.read.parquet(f"{folder}/{n}.parquet")) for n in names})

    def add(self, name: str, loader: Loader) -> None:
        self.loaders[name] = loader

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.loaders:
            raise KeyError(f"no source named {name!r}; declared: {sorted(self.loaders)}")
        return self.loaders[name](spark)

    def register_views(self, spark: SparkSession) -> None:
        for name in self.loaders:
            self.read(spark, name).createOrReplaceTempView(name)
