"""The write pipeline: validators see all documents first, then augmentors derive further rows, then the commit of the log ends it.

Derived rows are computed before anything is appended, and appended before the log. A failing augmentor leaves all as it was, and
derived rows whose log rows were never committed are passed over by readers that join them with the log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from leafmere.operators.cutting import cut
from leafmere.operators.log import puts
from leafmere.operators.schema import reserved_fields, valid

Validator = Callable[[DataFrame], None]
Augmentor = Callable[[DataFrame], DataFrame]


@dataclass
class Writer:
    """Appends batches to the mutation log under ``path``. Deletions pass the validators by."""

    path: str
    validators: list[Validator] = field(default_factory=list)
    augmentors: list[tuple[str, Augmentor]] = field(default_factory=list)
    schema: dict | None = None

    def put(self, docs: DataFrame, ns: str, hlc: int, device_id: str) -> DataFrame:
        if reserved := reserved_fields(docs):
            raise ValueError(f"reserved fields {reserved}")
        if self.schema is not None:
            valid(docs, self.schema)
        for check in self.validators:
            check(docs)
        rows = puts(docs, ns, hlc, device_id)
        derived = [(name, cut(derive(docs))) for name, derive in self.augmentors]
        for name, more in derived:
            more.write.mode("append").parquet(f"{self.path.rstrip('/')}-{name}")
        self.append(rows)
        return rows

    def append(self, rows: DataFrame) -> None:
        """One commit; readers see all of its rows or none."""
        rows.write.mode("append").parquet(self.path)
