"""Collections as tables of the session's catalogue, statistics over them and a check of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collections(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def create(spark: SparkSession, name: str, schema: str = "_id string, doc string", path: str | None = None) -> None:
    where = f" location '{path}'" if path else ""
    spark.sql(f"create table `{name}` ({schema}) using parquet{where}")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists `{name}`")


def statistics(df: DataFrame) -> DataFrame:
    """(file, rows) of the files that a table is read from."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))


def verified(df: DataFrame, key: str, body: str) -> DataFrame:
    """One row (checked, errors): documents, and those whose body is no JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(body))
    broken = F.coalesce(~kind.startswith("OBJECT"), F.lit(True))
    return df.agg(F.count("*").alias("checked"), F.count_if(broken).alias("errors"))


def faults(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, error) of the documents that ``verified`` counts as errors."""
    kind = F.schema_of_variant(F.try_parse_json(body))
    return df.where(F.coalesce(~kind.startswith("OBJECT"), F.lit(True))).select(key, F.when(F.col(body).isNull(), "no document").when(kind.isNull(), "no JSON").otherwise("no object").alias("error"))
