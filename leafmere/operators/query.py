"""Collections and lazy queries over one: filters, key prefix, one order, offset, limit and projection.

A query is a chain of copies; nothing runs before a terminal. Orders end with the key, so results are repeatable, and a
page without an order is a page in key order. Missing and null values sort last, and first when descending.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.functions.paths import FieldPath
from leafmere.operators.filters import Filter
from leafmere.operators.projection import project


@dataclass(frozen=True)
class Collection:
    """Documents in ``df``, one row each, with their key in column ``key``."""

    df: DataFrame
    key: str = "_id"

    def all(self) -> Query:
        return Query(self)

    def where(self, condition: Filter) -> Query:
        return Query(self).where(condition)

    def get(self, key) -> DataFrame:
        return self.df.where(F.col(self.key) == F.lit(key))

    def get_many(self, keys: DataFrame) -> DataFrame:
        """One row a row of ``keys`` (its first column), with null fields where there is no such document."""
        wanted = keys.select(F.col(keys.columns[0]).alias("__wanted"))
        return wanted.join(self.df, F.col("__wanted") == F.col(self.key), "left").drop(self.key).withColumnRenamed("__wanted", self.key)

    def exists(self, key) -> bool:
        return not self.get(key).isEmpty()

    def range(self, start=None, end=None) -> DataFrame:
        """Documents with start <= key < end."""
        out = self.df
        if start is not None:
            out = out.where(F.col(self.key) >= F.lit(start))
        return out.where(F.col(self.key) < F.lit(end)) if end is not None else out


@dataclass(frozen=True)
class Query:
    collection: Collection
    filters: tuple[Filter, ...] = ()
    order: tuple[str, bool] | None = None
    skip: int = 0
    most: int | None = None
    prefix: str | None = None
    paths: tuple[str, ...] = ()
    nested: bool = False

    def where(self, condition: Filter) -> Query:
        return replace(self, filters=(*self.filters, condition))

    def order_by(self, path: str, descending: bool = False) -> Query:
        return replace(self, order=(path, descending))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=max(n, 0))

    def key_prefix(self, prefix: str) -> Query:
        return replace(self, prefix=prefix)

    def select(self, *paths: str, nested: bool = False) -> Query:
        return replace(self, paths=paths, nested=nested)

    def _matching(self) -> DataFrame:
        df = self.collection.df
        if self.prefix is not None:
            df = df.where(F.col(self.collection.key).startswith(self.prefix))
        for f in self.filters:
            df = df.where(f.on(df.schema))
        return df

    def _orders(self, df: DataFrame) -> list[Column]:
        key = F.col(self.collection.key).asc()
        if self.order is None:
            return [key]
        path, descending = self.order
        found = FieldPath.parse(path).typed(df.schema)
        if found is not None and not isinstance(found[1], (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return [found[0].desc_nulls_first() if descending else found[0].asc_nulls_last(), key]
        if "doc" in df.columns and isinstance(df.schema["doc"].dataType, T.VariantType):
            return [*variant_orders(FieldPath.parse(path).variant(F.col("doc")), descending), key]
        return [key]

    def df(self) -> DataFrame:
        """The result as a lazy DataFrame."""
        df = self._matching()
        if self.order is not None or self.skip or self.most is not None:
            df = df.orderBy(*self._orders(df))
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return project(df, self.paths, self.nested) if self.paths else df

    def get(self) -> list[Row]:
        return self.df().collect()

    def stream(self) -> Iterator[Row]:
        return self.df().toLocalIterator()

    def first(self) -> Row | None:
        rows = self.limit(1).get()
        return rows[0] if rows else None

    def any(self) -> bool:
        return not self.df().isEmpty()

    def count(self) -> int:
        """Rows after offset and limit; the order plays no part in their number."""
        n = self._matching().count()
        n = max(n - self.skip, 0)
        return n if self.most is None else min(n, self.most)

    def count_df(self) -> DataFrame:
        out = replace(self, order=None)
        return (out._matching() if not self.skip and self.most is None else out.df()).agg(F.count("*").alias("n"))

    def counters(self) -> DataFrame:
        """One row (scanned, matched): documents in the collection and those that the filters let through."""
        df = self.collection.df
        met = F.lit(True)
        if self.prefix is not None:
            met = met & F.coalesce(F.col(self.collection.key).startswith(self.prefix), F.lit(False))
        for f in self.filters:
            met = met & F.coalesce(f.on(df.schema), F.lit(False))
        return df.agg(F.count("*").alias("scanned"), F.count_if(met).alias("matched"))

    def plan(self) -> dict:
        """What an explanation shows: the equalities an index could answer and Spark's plan."""
        equalities = [e for f in self.filters if (e := getattr(f, "equality", None))]
        return {"equalities": equalities, "plan": self.df()._jdf.queryExecution().explainString(self.df().sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))}


def variant_orders(v: Column, descending: bool) -> list[Column]:
    """Sort columns of a VARIANT: booleans, numbers, strings by kind and value; others are alike, missing and null apart."""
    name = F.schema_of_variant(v)
    number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    rank = F.when(name == "BOOLEAN", 0).when(number, 1).when(name == "STRING", 2).when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("int")).otherwise(3)
    values = [F.when(name == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), F.when(number, F.try_variant_get(v, "$", "double")), F.when(name == "STRING", F.try_variant_get(v, "$", "string"))]
    return [c.desc_nulls_first() if descending else c.asc_nulls_last() for c in (rank, *values)]
