"""JSON Schema checks compiled to one column of violations: array<struct<path, message>>, empty for a valid document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATION = "array<struct<path:string,message:string>>"
# Patterns of the formats.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$", "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$", "time": r"^\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$", "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
}
KEYWORDS = {"type", "required", "properties", "additionalProperties", "enum", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "format", "minItems", "maxItems", "items", "title", "description", "$schema"}


def type_name(kind: T.DataType) -> str:
    for types, name in (((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"), ((T.NumericType,), "number"), ((T.StringType,), "string"), ((T.BooleanType,), "boolean"), ((T.ArrayType,), "array"), ((T.StructType, T.MapType), "object")):
        if isinstance(kind, types):
            return name
    return "string"


def violations(schema: dict, data: T.StructType, root: Column | None = None, at: str = "$") -> Column:
    """Violations of the rows of ``data``; a null field is missing. Reserved names (first sign _) are not allowed on top."""
    checks: list[Column] = []
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"unknown keywords {sorted(unknown)}")

    def add(broken: Column, path: str, message: str) -> None:
        checks.append(F.when(broken, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))))

    field = lambda n: F.col(f"`{n}`") if root is None else root.getField(n)
    for name in schema.get("required", []):
        if name not in data.names:
            add(F.lit(True), f"{at}.{name}", "is required")
        else:
            add(field(name).isNull(), f"{at}.{name}", "is required")
    properties = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        for name in data.names:
            if name not in properties and name != "_id":
                add(field(name).isNotNull(), f"{at}.{name}", "is not allowed")
    nested: list[Column] = []
    for name, rule in properties.items():
        if name in data.names:
            nested += value_checks(rule, field(name), data[name].dataType, f"{at}.{name}", add)
    own = F.filter(F.array(*checks), lambda v: v.isNotNull()) if checks else F.array().cast(VIOLATION)
    return reduce(lambda a, b: F.concat(a, b), nested, own.cast(VIOLATION))


def value_checks(rule: dict, c: Column, kind: T.DataType, path: str, add) -> list[Column]:
    present = c.isNotNull()
    wanted = rule.get("type")
    name = type_name(kind)
    allowed = [wanted] if isinstance(wanted, str) else wanted or []
    if allowed and name not in allowed and not (name == "integer" and "number" in allowed):
        if name == "number" and "integer" in allowed:
            add(present & (c != F.floor(c)), path, f"must be of type {'/'.join(allowed)}")
        else:
            add(present, path, f"must be of type {'/'.join(allowed)}")
            return []
    if "enum" in rule:
        same = [v for v in rule["enum"] if v is not None and not (isinstance(v, str) ^ (name == "string"))]
        add(present & ~(c.isin(same) if same else F.lit(False)), path, "must be one of the allowed values")
    if name in ("integer", "number"):
        for key, broken, words in (("minimum", lambda v: c < v, "must be at least"), ("maximum", lambda v: c > v, "must be at most"), ("exclusiveMinimum", lambda v: c <= v, "must be above"), ("exclusiveMaximum", lambda v: c >= v, "must be below")):
            if key in rule:
                add(present & broken(F.lit(rule[key])), path, f"{words} {rule[key]}")
    if name == "string":
        if "minLength" in rule:
            add(F.length(c) < rule["minLength"], path, f"must have at least {rule['minLength']} characters")
        if "maxLength" in rule:
            add(F.length(c) > rule["maxLength"], path, f"must have at most {rule['maxLength']} characters")
        if "pattern" in rule:
            add(~c.rlike(rule["pattern"]), path, f"must match {rule['pattern']}")
        if rule.get("format") in FORMATS:
            add(~c.rlike(FORMATS[rule["format"]]), path, f"must be a valid {rule['format']}")
    if name == "array":
        if "minItems" in rule:
            add(F.size(c) < rule["minItems"], path, f"must have at least {rule['minItems']} items")
        if "maxItems" in rule:
            add(F.size(c) > rule["maxItems"], path, f"must have at most {rule['maxItems']} items")
        if "items" in rule:
            def of_item(x: Column, i: Column) -> Column:
                found: list[Column] = []
                value_checks(rule["items"], x, kind.elementType, "", lambda b, p, m: found.append(F.when(b, F.struct(F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")).alias("path"), F.lit(m).alias("message")))))
                return F.filter(F.array(*found), lambda v: v.isNotNull()).cast(VIOLATION) if found else F.array().cast(VIOLATION)

            return [F.when(present, F.flatten(F.transform(c, of_item))).otherwise(F.array().cast(VIOLATION))]
    if name == "object" and isinstance(kind, T.StructType) and ("properties" in rule or "required" in rule or "additionalProperties" in rule):
        inner = {k: rule[k] for k in ("properties", "required", "additionalProperties") if k in rule}
        return [F.when(present, violations(inner, kind, c, path)).otherwise(F.array().cast(VIOLATION))]
    return []


def validated(df: DataFrame, schema: dict, out: str = "violations") -> DataFrame:
    return df.withColumn(out, violations(schema, df.schema))


def valid(df: DataFrame, schema: dict) -> DataFrame:
    """df, or an error that names the violations of some documents."""
    broken = validated(df, schema, "__violations").where(F.size("__violations") > 0)
    some = broken.select("__violations").limit(20).collect()
    if some:
        raise ValueError("; ".join(f"{v.path} {v.message}" for r in some for v in r[0]))
    return df


def reserved_fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_") and c != "_id"]


def variant_violations(schema: dict, v: Column, at: str = "$") -> Column:
    """Violations of a VARIANT document. A JSON null is of type null, which a missing field is not."""
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"unknown keywords {sorted(unknown)}")
    shape = F.schema_of_variant(v)
    number = shape.isin("DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    value = F.try_variant_get(v, "$", "double")
    is_type = {"integer": (shape == "BIGINT") | (number & (value == F.floor(value))), "number": (shape == "BIGINT") | number, "string": shape == "STRING", "boolean": shape == "BOOLEAN", "array": shape.startswith("ARRAY"), "object": shape.startswith("OBJECT"), "null": shape == "VOID"}
    checks: list[Column] = []

    def add(broken: Column, message: str, path: str = at) -> None:
        checks.append(F.when(broken, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))))

    wanted = schema.get("type")
    allowed = [wanted] if isinstance(wanted, str) else wanted or []
    if allowed:
        add(v.isNotNull() & ~reduce(lambda a, b: a | b, [is_type[t] for t in allowed]), f"must be of type {'/'.join(allowed)}")
    text = F.when(is_type["string"], F.try_variant_get(v, "$", "string"))
    amount = F.when(is_type["number"], value)
    truth = F.when(is_type["boolean"], F.try_variant_get(v, "$", "boolean"))
    items = F.when(is_type["array"], F.try_variant_get(v, "$", "array<variant>"))
    if "enum" in schema:
        same = [text == x if isinstance(x, str) else truth == x if isinstance(x, bool) else is_type["null"] if x is None else amount == x for x in schema["enum"]]
        add(v.isNotNull() & ~reduce(lambda a, b: a | b, [F.coalesce(s, F.lit(False)) for s in same], F.lit(False)), "must be one of the allowed values")
    for key, broken, words in (("minimum", lambda x: amount < x, "must be at least"), ("maximum", lambda x: amount > x, "must be at most"), ("exclusiveMinimum", lambda x: amount <= x, "must be above"), ("exclusiveMaximum", lambda x: amount >= x, "must be below")):
        if key in schema:
            add(broken(F.lit(schema[key])), f"{words} {schema[key]}")
    for key, broken, words in (("minLength", lambda x: F.length(text) < x, "must have at least {} characters"), ("maxLength", lambda x: F.length(text) > x, "must have at most {} characters"), ("pattern", lambda x: ~text.rlike(x), "must match {}"),
                               ("minItems", lambda x: F.size(items) < x, "must have at least {} items"), ("maxItems", lambda x: F.size(items) > x, "must have at most {} items")):
        if key in schema:
            add(broken(schema[key]), words.format(schema[key]))
    if schema.get("format") in FORMATS:
        add(~text.rlike(FORMATS[schema["format"]]), f"must be a valid {schema['format']}")
    field = lambda n: F.try_variant_get(v, f'$["{n}"]', "variant")
    for name in schema.get("required", []):
        add(is_type["object"] & field(name).isNull(), "is required", f"{at}.{name}")
    out = F.filter(F.array(*checks), lambda x: x.isNotNull()).cast(VIOLATION) if checks else F.array().cast(VIOLATION)
    properties = schema.get("properties", {})
    for name, rule in properties.items():
        out = F.concat(out, variant_violations(rule, field(name), f"{at}.{name}"))
    if schema.get("additionalProperties") is False:
        names = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))
        more = F.filter(names, lambda n: ~n.isin([*properties, "_id"]))
        out = F.concat(out, F.when(is_type["object"], F.transform(more, lambda n: F.struct(F.concat(F.lit(f"{at}."), n).alias("path"), F.lit("is not allowed").alias("message")))).otherwise(F.array().cast(VIOLATION)))
    if "items" in schema:
        def of_item(x: Column, i: Column) -> Column:
            return F.transform(variant_violations(schema["items"], x, ""), lambda p: F.struct(F.concat(F.lit(f"{at}["), i.cast("string"), F.lit("]"), p["path"]).alias("path"), p["message"].alias("message")))

        out = F.concat(out, F.coalesce(F.flatten(F.transform(items, of_item)), F.array().cast(VIOLATION)))
    return out
