"""Projection onto field paths: flat columns named by their path, or nested again by the dots of the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.functions.paths import FieldPath


def path_column(df: DataFrame, path: str) -> Column | None:
    found = FieldPath.parse(path).typed(df.schema)
    if found is not None:
        return found[0]
    if "doc" in df.columns and isinstance(df.schema["doc"].dataType, T.VariantType):
        return FieldPath.parse(path).variant(F.col("doc"))
    return None


def project(df: DataFrame, paths: tuple[str, ...], nested: bool = False) -> DataFrame:
    """Columns of the paths that exist. nested: a.b comes as field b of struct a; paths with brackets stay flat."""
    columns = [(p, c) for p in dict.fromkeys(paths) if (c := path_column(df, p)) is not None]
    if not nested:
        return df.select(*[c.alias(p) for p, c in columns])
    tree: dict = {}
    for path, column in columns:
        steps = [path] if "[" in path else path.removeprefix("$.").split(".")
        at = tree
        for step in steps[:-1]:
            at = at.setdefault(step, {}) if isinstance(at.get(step, {}), dict) else at
        at[steps[-1]] = column

    def build(name: str, node) -> Column:
        return F.struct(*[build(k, v) for k, v in node.items()]).alias(name) if isinstance(node, dict) else node.alias(name)

    return df.select(*[build(k, v) for k, v in tree.items()])
