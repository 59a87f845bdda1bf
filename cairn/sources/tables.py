"""Static Parquet tables as a source of queries: no change log, so no step between scan and query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.functions.expr import Expr, bind_caller
from cairn.plans.errors import IndexNotFound, PermissionDenied, TableNotFound


class ParquetTables:
    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...]] | None = None, policies: dict[str, Expr] | None = None):
        self.spark, self.folder, self.keys, self.policies = spark, folder.rstrip("/"), keys or {}, policies or {}
        self.views: dict[str, DataFrame] = {}
        self.projections: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> ParquetTables:
        self.views[name] = df
        return self

    def table(self, name: str, index: str | None = None) -> DataFrame:
        if index is not None:
            if index not in self.projections:
                raise IndexNotFound(f"async index {index} not found")
            return self.projections[index]
        name = name.removeprefix("_global.")
        if name in self.views:
            return self.views[name]
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise TableNotFound(name) from None
            raise

    def primary_key(self, name: str) -> tuple[str, ...]:
        return self.keys.get(name, ())

    def policy(self, name: str, caller: str | None) -> Expr | None:
        p = self.policies.get(name)
        if p is not None and caller is None:
            raise PermissionDenied(f"{name} has a read policy and needs a caller")
        return None if p is None else bind_caller(p, caller)
