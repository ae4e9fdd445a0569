"""Field paths (a, a.b, $.a, a[], a[0], a[-1]) resolved against a typed schema or a VARIANT document.

Whatever follows ``[]`` in a path is not looked at: ``a[].b`` is the list ``a``. A path that does not fit the schema is
missing; a typed column cannot tell missing from null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldPath:
    """Steps of a path: names (str), places in a list (int, negative from the end); fan_out for a trailing []."""

    text: str
    steps: tuple[str | int, ...]
    fan_out: bool = False

    @staticmethod
    def parse(text: str) -> FieldPath:
        if text == "$" or not text:
            raise ValueError("a path must name a field")
        body = text[2:] if text.startswith("$.") else text
        steps: list[str | int] = []
        for segment in body.split("."):
            m = re.fullmatch(r"([^\[\]]+)((?:\[(?:\*|-?\d+)?\])*)", segment)
            if not m:
                raise ValueError(f"malformed path {text!r}")
            steps.append(m[1])
            for inner in re.findall(r"\[(\*|-?\d+)?\]", m[2]):
                if inner in ("", "*"):
                    return FieldPath(text, tuple(steps), True)
                steps.append(int(inner))
        return FieldPath(text, tuple(steps))

    def typed(self, schema: T.StructType, root: Column | None = None) -> tuple[Column, T.DataType] | None:
        """(column, type) in a schema, None where the path is missing."""
        column, kind = root, schema
        for step in self.steps:
            if isinstance(step, str):
                if isinstance(kind, T.StructType) and step in kind.names:
                    column, kind = (F.col(f"`{step}`") if column is None else column.getField(step)), kind[step].dataType
                elif isinstance(kind, T.MapType) and column is not None and isinstance(kind.keyType, T.StringType):
                    column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
                else:
                    return None
            elif isinstance(kind, T.ArrayType):
                column, kind = F.try_element_at(column, F.lit(step + 1 if step >= 0 else step)), kind.elementType
            else:
                return None
        if self.fan_out and not isinstance(kind, T.ArrayType):
            return None
        return column, kind

    def variant(self, doc: Column) -> Column:
        """The VARIANT at the path, null where it is missing; places from the end go through the list's length."""
        column, plain = doc, "$"
        for step in self.steps:
            if isinstance(step, str):
                plain += f'["{step}"]' if not re.fullmatch(r"\w+", step) else f".{step}"
            elif step >= 0:
                plain += f"[{step}]"
            else:
                if plain != "$":
                    column, plain = F.try_variant_get(column, plain, "variant"), "$"
                column = F.try_element_at(F.try_variant_get(column, "$", "array<variant>"), F.lit(step))
        return F.try_variant_get(column, plain, "variant") if plain != "$" else column
