"""Filters: two-valued predicates over nested fields with defined behaviour for missing, null and unlike types.

``Field(path)`` makes leaves, ``Filter.all/any/negate`` combine them, ``parse_filter`` reads their JSON form. A filter
compiles to one boolean column for a typed schema or a VARIANT document. Where a predicate only has to be true (not under
a negation) it is left bare, so that it reaches the Parquet scan; under a negation null counts as false.

Numbers equal across number types; strings, numbers and booleans never equal each other; NaN equals nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.functions.paths import FieldPath

OPS = {"eq", "ne", "gt", "lt", "gte", "lte", "between", "in", "notIn", "isNull", "isNotNull", "isTrue", "isFalse", "startsWith", "endsWith", "contains", "containsAll", "containsAny"}


def never() -> Column:
    return F.lit(False)


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "num"
    if isinstance(value, str):
        return "str"
    raise TypeError(f"{value!r} cannot be compared with a field")


@dataclass
class Operand:
    """A field as the predicates see it: a column a kind of value, null where the field is of another kind."""

    is_null: Column
    of_kind: dict[str, Column] = field(default_factory=dict)
    floating: Column | None = None
    elements: Column | None = None
    element_kinds: Any = None

    def equals(self, value: Any, fold: bool = False) -> Column:
        kind = kind_of(value)
        if kind == "null":
            return self.is_null
        if kind not in self.of_kind or (isinstance(value, float) and math.isnan(value)):
            return never()
        column = self.of_kind[kind]
        return F.lower(column) == value.lower() if fold and kind == "str" else column == F.lit(value)

    def compares(self, how: str, value: Any) -> Column:
        kind = kind_of(value)
        if kind not in ("num", "str") or kind not in self.of_kind:
            return never()
        c, v = self.of_kind[kind], F.lit(value)
        met = {"gt": c > v, "lt": c < v, "gte": c >= v, "lte": c <= v}[how]
        # NaN sorts above all numbers in Spark but compares with none here.
        return met & ~F.isnan(self.floating) if how in ("gt", "gte") and kind == "num" and self.floating is not None else met

    def text(self, how: str, value: Any, fold: bool) -> Column:
        if not isinstance(value, str):
            raise TypeError(f"{how} needs a string")
        if "str" not in self.of_kind:
            return never()
        c, v = (F.lower(self.of_kind["str"]), value.lower()) if fold else (self.of_kind["str"], value)
        return getattr(c, {"startsWith": "startswith", "endsWith": "endswith", "contains": "contains"}[how])(v)

    def has_element(self, value: Any) -> Column:
        return F.exists(self.elements, lambda x: F.coalesce(self.element_kinds(x).equals(value), never()))


def typed_operand(column: Column, kind: T.DataType) -> Operand:
    out = Operand(column.isNull())
    if isinstance(kind, T.NumericType):
        out.of_kind["num"] = column
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out.floating = column
    elif isinstance(kind, T.StringType):
        out.of_kind["str"] = column
    elif isinstance(kind, T.BooleanType):
        out.of_kind["bool"] = column
    elif isinstance(kind, T.ArrayType):
        out.elements, out.element_kinds = column, lambda x: typed_operand(x, kind.elementType)
    elif isinstance(kind, T.VariantType):
        return variant_operand(column)
    return out


def variant_operand(v: Column) -> Operand:
    """A VARIANT: its type is looked at first, since casts would turn strings and booleans into numbers."""
    name = F.schema_of_variant(v)
    number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    out = Operand(v.isNull() | F.is_variant_null(v))
    out.of_kind = {"num": F.when(number, F.try_variant_get(v, "$", "double")), "str": F.when(name == "STRING", F.try_variant_get(v, "$", "string")), "bool": F.when(name == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))}
    out.floating = out.of_kind["num"]
    out.elements, out.element_kinds = F.when(name.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), variant_operand
    return out


class Filter:
    """A predicate over documents."""

    def compile(self, resolve, exact: bool = False) -> Column:
        raise NotImplementedError

    def on(self, schema: T.StructType) -> Column:
        """The filter for rows of ``schema``; with a single VARIANT column ``doc`` paths lead into it."""
        return self.compile(lambda path: resolve_field(path, schema))

    @staticmethod
    def all(filters: Iterable[Filter]) -> Filter:
        return Combined(tuple(filters), and_, True)

    @staticmethod
    def any(filters: Iterable[Filter]) -> Filter:
        return Combined(tuple(filters), or_, False)

    @staticmethod
    def negate(one: Filter) -> Filter:
        return Negated(one)

    def __and__(self, other: Filter) -> Filter:
        return Filter.all((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter.any((self, other))

    def __invert__(self) -> Filter:
        return Negated(self)


def resolve_field(path: FieldPath, schema: T.StructType) -> Operand | None:
    found = path.typed(schema)
    if found is not None:
        return typed_operand(*found)
    if "doc" in schema.names and isinstance(schema["doc"].dataType, T.VariantType):
        return variant_operand(path.variant(F.col("doc")))
    return None


@dataclass(frozen=True)
class Combined(Filter):
    """AND or OR; of no filters AND is true and OR is false."""

    filters: tuple[Filter, ...]
    how: Any
    empty: bool

    def compile(self, resolve, exact: bool = False) -> Column:
        return reduce(self.how, [f.compile(resolve, exact) for f in self.filters]) if self.filters else F.lit(self.empty)


@dataclass(frozen=True)
class Negated(Filter):
    one: Filter

    def compile(self, resolve, exact: bool = False) -> Column:
        return ~self.one.compile(resolve, True)


@dataclass(frozen=True)
class Leaf(Filter):
    path: FieldPath
    op: str
    value: Any = None
    fold: bool = False
    any_match: bool = False

    @property
    def equality(self) -> tuple[str, Any] | None:
        """(path, value) of a plain equality, which an index could answer."""
        return (self.path.text, self.value) if self.op == "eq" and not self.fold else None

    def compile(self, resolve, exact: bool = False) -> Column:
        o = resolve(self.path)
        if o is None:
            return F.lit(self.op in ("ne", "notIn", "isNull"))
        if self.any_match and o.elements is not None:
            inner = Leaf(self.path, self.op, self.value, self.fold)
            return F.coalesce(F.exists(o.elements, lambda x: F.coalesce(inner._of(o.element_kinds(x)), never())), never())
        out = self._of(o)
        negated = self.op in ("ne", "notIn")
        if negated:
            return ~F.coalesce(out, never())
        return F.coalesce(out, never()) if exact else out

    def _of(self, o: Operand) -> Column:
        op, v = self.op, self.value
        if op in ("eq", "ne"):
            return o.equals(v, self.fold)
        if op in ("gt", "lt", "gte", "lte"):
            return o.compares(op, v)
        if op == "between":
            return o.compares("gte", v[0]) & o.compares("lte", v[1])
        if op in ("in", "notIn"):
            return self._member(o, list(v))
        if op == "isNull":
            return o.is_null
        if op == "isNotNull":
            return ~o.is_null
        if op in ("isTrue", "isFalse"):
            return o.equals(op == "isTrue")
        if op in ("startsWith", "endsWith"):
            return o.text(op, v, self.fold)
        if op == "contains":
            if o.elements is not None and not o.of_kind:
                return o.has_element(v)
            found = o.text(op, v, self.fold) if isinstance(v, str) else never()
            return F.coalesce(found, never()) | F.coalesce(o.has_element(v), never()) if o.elements is not None else found
        if o.elements is None:
            return never()
        each = [o.has_element(x) for x in v]
        present = o.elements.isNotNull()
        if op == "containsAll":
            return reduce(and_, each, present)
        return present & reduce(or_, each, never())

    @staticmethod
    def _member(o: Operand, values: list) -> Column:
        parts = []
        for kind in ("num", "str", "bool"):
            some = [x for x in values if kind_of(x) == kind and not (isinstance(x, float) and math.isnan(x))]
            if some and kind in o.of_kind:
                parts.append(F.coalesce(o.of_kind[kind].isin(some), never()) if None in values else o.of_kind[kind].isin(some))
        if None in values:
            parts.append(o.is_null)
        return reduce(or_, parts) if parts else never()


class Field:
    """Leaves over one field path. ``any_match`` applies a predicate to each element of a list."""

    def __init__(self, path: str, any_match: bool = False):
        self.path, self.any_match = FieldPath.parse(path), any_match

    def _leaf(self, op: str, value: Any = None, fold: bool = False) -> Leaf:
        return Leaf(self.path, op, value, fold, self.any_match)

    def equals(self, value: Any, case_sensitive: bool = True) -> Leaf:
        return self._leaf("eq", value, not case_sensitive)

    def not_equals(self, value: Any, case_sensitive: bool = True) -> Leaf:
        return self._leaf("ne", value, not case_sensitive)

    def is_greater_than(self, value: Any) -> Leaf:
        return self._leaf("gt", value)

    def is_less_than(self, value: Any) -> Leaf:
        return self._leaf("lt", value)

    def is_greater_than_or_equal_to(self, value: Any) -> Leaf:
        return self._leaf("gte", value)

    def is_less_than_or_equal_to(self, value: Any) -> Leaf:
        return self._leaf("lte", value)

    def is_between(self, low: Any, high: Any) -> Leaf:
        return self._leaf("between", (low, high))

    def is_in(self, values: Iterable) -> Leaf:
        return self._leaf("in", tuple(values))

    def is_not_in(self, values: Iterable) -> Leaf:
        return self._leaf("notIn", tuple(values))

    def is_null(self) -> Leaf:
        return self._leaf("isNull")

    def is_not_null(self) -> Leaf:
        return self._leaf("isNotNull")

    def is_true(self) -> Leaf:
        return self._leaf("isTrue")

    def is_false(self) -> Leaf:
        return self._leaf("isFalse")

    def starts_with(self, value: str, case_sensitive: bool = True) -> Leaf:
        return self._leaf("startsWith", value, not case_sensitive)

    def ends_with(self, value: str, case_sensitive: bool = True) -> Leaf:
        return self._leaf("endsWith", value, not case_sensitive)

    def contains(self, value: Any, case_sensitive: bool = True) -> Leaf:
        return self._leaf("contains", value, not case_sensitive)

    def contains_all(self, values: Iterable) -> Leaf:
        return self._leaf("containsAll", tuple(values))

    def contains_any(self, values: Iterable) -> Leaf:
        return self._leaf("containsAny", tuple(values))


def parse_filter(text: str | dict) -> Filter:
    """A filter from its JSON form: {"and": [...]}, {"or": [...]}, {"not": {...}} or {"field", "op", "value", "insensitive"}."""
    node = json.loads(text) if isinstance(text, str) else text
    if not isinstance(node, dict):
        raise ValueError("a filter must be a JSON object")
    for name, make in (("and", Filter.all), ("or", Filter.any)):
        if name in node:
            if len(node) > 1 or not isinstance(node[name], list):
                raise ValueError(f"{name} takes a list and nothing beside it")
            return make([parse_filter(x) for x in node[name]])
    if "not" in node:
        if len(node) > 1:
            raise ValueError("not takes one filter and nothing beside it")
        return Filter.negate(parse_filter(node["not"]))
    op = node.get("op")
    if not isinstance(node.get("field"), str) or op not in OPS:
        raise ValueError(f"unknown filter {node!r}")
    value = node.get("value")
    if op in ("in", "notIn", "containsAll", "containsAny", "between"):
        if not isinstance(value, list) or op == "between" and len(value) != 2:
            raise ValueError(f"{op} takes a list")
        value = tuple(value)
    return Leaf(FieldPath.parse(node["field"]), op, value, bool(node.get("insensitive", False)))
