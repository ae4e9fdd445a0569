"""python -m leafmere ROOT COMMAND ...: the store's data commands."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafmere.operators.filters import parse_filter
from leafmere.sources.formats import MODES, formatted
from leafmere.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmere", description=__doc__)
    p.add_argument("root")
    p.add_argument("--mode", choices=MODES, default="json")
    p.add_argument("--device", default="local")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str):
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        return c

    for name in ("scan", "count"):
        c = command(name, "collection")
        c.add_argument("--filter")
        c.add_argument("--order-by")
        c.add_argument("--desc", action="store_true")
        c.add_argument("--limit", type=int)
        c.add_argument("--offset", type=int, default=0)
        c.add_argument("--key-prefix")
        c.add_argument("--select")
        c.add_argument("--explain", action="store_true")
    command("get", "collection", "key")
    for name in ("insert", "put", "replace"):
        command(name, "collection", "documents")
    for name in ("update", "delete"):
        c = command(name, "collection")
        chosen = c.add_mutually_exclusive_group(required=True)
        chosen.add_argument("--id", action="append")
        chosen.add_argument("--filter")
        chosen.add_argument("--all", action="store_true")
        if name == "update":
            c.add_argument("--set", required=True, help="a JSON object of fields")
    command("import", "collection", "path").add_argument("--on-conflict", choices=("replace", "ignore", "error"), default="replace")
    command("export", "collection", "path")
    command("dump", "path")
    command("restore", "path")
    command("collections")
    s = command("search", "collection", "query")
    s.add_argument("--fields", required=True)
    s.add_argument("--filter")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--offset", type=int, default=0)
    command("versions", "collection", "key")
    command("promote", "collection", "key", "hlc")
    command("pull", "other")
    command("schema", "collection").add_argument("--set")
    for name in ("verify", "stats", "compact"):
        command(name)
    return p


def documents(rows) -> list[dict]:
    """Rows of a store as plain dicts: VARIANT columns as what they hold."""
    out = []
    for r in rows:
        d = r.asDict()
        doc = d.pop("doc", None)
        inner = doc.toPython() if hasattr(doc, "toPython") else json.loads(doc) if isinstance(doc, str) else {}
        out.append({**d, **inner})
    return out


def run(store: Store, a: argparse.Namespace) -> list[dict]:
    where = parse_filter(a.filter) if getattr(a, "filter", None) else None
    if a.command in ("scan", "count"):
        q = store.collection(a.collection).all()
        q = q.where(where) if where is not None else q
        q = q.key_prefix(a.key_prefix) if a.key_prefix else q
        q = q.order_by(a.order_by, a.desc) if a.order_by else q
        q = q.offset(a.offset) if a.offset else q
        q = q.limit(a.limit) if a.limit is not None else q
        if a.command == "count":
            return [{"count": q.count()}]
        if a.explain:
            return [{**q.counters().first().asDict(), **q.plan()}]
        rows = documents(q.df().collect())
        return [{k: d[k] for k in a.select.split(",") if k in d} for d in rows] if a.select else rows
    if a.command == "get":
        return documents(store.collection(a.collection).get(a.key).collect())
    if a.command in ("insert", "put", "replace"):
        given = json.loads(a.documents)
        return [{"hlc": getattr(store, a.command)(a.collection, given if isinstance(given, list) else [given])}]
    if a.command == "update":
        return [{"hlc": store.update(a.collection, json.loads(a.set), a.id, where)}]
    if a.command == "delete":
        return [{"hlc": store.delete(a.collection, a.id, where)}]
    if a.command == "import":
        return [{"hlc": store.import_file(a.collection, a.path, a.on_conflict)}]
    if a.command in ("export", "dump", "restore"):
        out = store.export(a.collection, a.path) if a.command == "export" else getattr(store, a.command)(a.path)
        return [{"hlc": out}] if out else []
    if a.command == "collections":
        return [{"name": n} for n in store.collections()]
    if a.command == "search":
        return documents(store.search(a.collection, a.query, a.fields.split(","), where, a.limit, a.offset).orderBy("rank").collect())
    if a.command == "versions":
        return documents(store.versions(a.collection, a.key).collect())
    if a.command == "promote":
        return [{"hlc": store.promote(a.collection, a.key, int(a.hlc))}]
    if a.command == "pull":
        return [{"mutations": store.pull(Store(store.spark, a.other))}]
    if a.command == "schema":
        if a.set:
            store.set_schema(a.collection, json.loads(a.set))
        return [store.schema(a.collection) or {}]
    if a.command == "compact":
        store.compact()
        return []
    return documents((store.verify() if a.command == "verify" else store.statistics()).orderBy(F.col("ns")).collect())


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("leafmere").getOrCreate()
    print(formatted(run(Store(spark, a.root, a.device), a), a.mode))


if __name__ == "__main__":
    main()
