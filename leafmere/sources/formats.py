"""Rows as text: json, compact, ndjson, table, csv, line and ids (the first column). For results that are shown, not for stored ones.

Columns of table, csv and line are the union of the keys of the first ``sampled`` documents, in order of appearance;
nested values are JSON and null is empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, Row

MODES = ("json", "compact", "ndjson", "table", "csv", "line", "ids")


def plain(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value if value is None or isinstance(value, (str, int, float, bool)) else value.toPython() if hasattr(value, "toPython") else str(value)


def cell(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)


def csv_cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def formatted(documents: Iterable[dict], mode: str = "json", sampled: int = 100, null: str = "") -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    docs = [plain(d) for d in documents]
    dumps = lambda d, **k: json.dumps(d, ensure_ascii=False, **k)
    if mode == "json":
        return dumps(docs, indent=2)
    if mode == "compact":
        return dumps(docs, separators=(",", ":"))
    if mode == "ndjson":
        return "\n".join(dumps(d, separators=(",", ":")) for d in docs)
    if mode == "ids":
        return "\n".join(cell(next(iter(d.values()), None)) for d in docs)
    columns = list(dict.fromkeys(k for d in docs[:sampled] for k in d))
    rows = [[null if d.get(c) is None else cell(d[c]) for c in columns] for d in docs]
    if mode == "csv":
        return "\n".join(",".join(map(csv_cell, r)) for r in [columns, *rows])
    if mode == "line":
        width = max(map(len, columns), default=0)
        return "\n\n".join("\n".join(f"{c:>{width}} = {v}" for c, v in zip(columns, r)) for r in rows)
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(columns)]
    line = lambda r: " | ".join(f"{v:<{w}}" for v, w in zip(r, widths)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in widths), *map(line, rows)])


def shown(df: DataFrame, mode: str = "table", most: int = 1000) -> str:
    """The first ``most`` rows of a result as text."""
    return formatted((r.asDict() for r in df.limit(most).collect()), mode)


def write(df: DataFrame, path: str, mode: str = "ndjson") -> None:
    """The whole result as files: ndjson or csv."""
    if mode == "ndjson":
        df.write.mode("overwrite").json(path)
    elif mode == "csv":
        df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    else:
        raise ValueError("files are ndjson or csv")
