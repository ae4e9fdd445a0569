"""The store and its commands, and convergence of several devices from a seeded sequence of actions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmere.__main__ import parser, run
from leafmere.functions.keys import Clock
from leafmere.operators.filters import Field
from leafmere.operators.schema import variant_violations
from leafmere.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def docs(store, ns="a"):
    return {r._id: r.doc.toPython() for r in store.collection(ns).df.collect()}


def test_writes_and_versions(store):
    first = store.put("a", [{"_id": "k", "v": 1, "t": "red fox"}, {"_id": "q", "v": 2}])
    store.update("a", {"v": 9, "n": None}, where=Field("t").contains("fox"))
    assert docs(store) == {"k": {"v": 9, "n": None, "t": "red fox"}, "q": {"v": 2}}
    store.delete("a", ["q", "zz"])
    store.promote("a", "k", first)
    assert docs(store) == {"k": {"v": 1, "t": "red fox"}} and store.versions("a", "k").count() == 3 and store.collections() == ["a"]
    with pytest.raises(ValueError):
        store.insert("a", [{"_id": "k"}])
    with pytest.raises(ValueError):
        store.replace("a", [{"_id": "none"}])
    with pytest.raises(ValueError):
        store.put("a", [{"_x": 1}])
    with pytest.raises(KeyError):
        store.promote("a", "k", 5)
    store.batch({"a": [{"_id": "m"}], "b": [{"v": 1}]}, {"a": ["k"]})
    assert set(docs(store)) == {"m"} and store.collections() == ["a", "b"]
    before = docs(store)
    store.compact(versions=1, days=None)
    assert docs(store) == before and store.log("a").where("_id = 'k'").count() == 1
    assert store.verify().where("errors > 0").count() == 0 and {r.ns for r in store.statistics().collect()} == {"a", "b"}


def test_schemas_on_documents(store, spark):
    store.set_schema("a", {"type": "object", "required": ["v"], "additionalProperties": False, "properties": {"v": {"type": "integer", "minimum": 0}, "l": {"type": "array", "items": {"enum": ["x", 1, None]}}}})
    store.put("a", [{"_id": "k", "v": 1.0, "l": ["x", 1, None]}])
    for bad, path in (({"v": -1}, "$.v must be at least 0"), ({}, "$.v is required"), ({"v": 1, "z": 2}, "$.z is not allowed"), ({"v": 1, "l": ["y"]}, r"\$.l\[0\] must be one"), ({"v": "1"}, "$.v must be of type integer"), ({"v": None}, "must be of type integer")):
        with pytest.raises(ValueError, match=path.replace("$", r"\$").replace("\\\\$", r"\$")):
            store.put("a", [bad])
    assert store.invalid("a").count() == 0
    store.set_schema("a", {"required": ["w"]})
    assert [tuple(r) for r in store.invalid("a").collect()] == [("k", "$.w", "is required")]
    with pytest.raises(ValueError):
        store.set_schema("a", {"anyOf": []})
    assert spark.range(1).select(variant_violations({"format": "email"}, F.parse_json(F.lit('"x"')))).first()[0][0].message == "must be a valid email"


def test_files_and_search(store, tmp_path):
    store.put("a", [{"_id": "k", "t": "red fox", "l": "en"}, {"_id": "q", "t": "fox", "l": "de"}, {"_id": "n", "t": 5}])
    assert [r._id for r in store.search("a", "fox", ["t"]).orderBy("rank").collect()] == ["q", "k"]
    assert [r._id for r in store.search("a", "fox", ["t"], Field("l").equals("en")).collect()] == ["k"]
    store.export("a", str(tmp_path / "e"))
    store.dump(str(tmp_path / "d"))
    other = Store(store.spark, str(tmp_path / "o"))
    other.import_file("a", str(tmp_path / "e"))
    third = Store(store.spark, str(tmp_path / "r"))
    third.restore(str(tmp_path / "d" / "*"))
    strip = lambda d: {k: {x: y for x, y in v.items() if x != "_id"} for k, v in d.items()}
    assert strip(docs(other)) == strip(docs(third)) == docs(store)
    other.import_file("a", str(tmp_path / "e"), "ignore")
    with pytest.raises(ValueError):
        other.import_file("a", str(tmp_path / "e"), "error")


def test_commands(store):
    do = lambda *a: run(store, parser().parse_args(["root", *a]))
    do("put", "a", '[{"_id": "k", "v": 2}, {"_id": "q", "v": 1}]')
    assert do("scan", "a", "--order-by", "v") == [{"_id": "q", "v": 1}, {"_id": "k", "v": 2}] and do("count", "a", "--filter", '{"field": "v", "op": "gt", "value": 1}') == [{"count": 1}]
    do("update", "a", "--id", "k", "--set", '{"v": 7}')
    assert do("get", "a", "k") == [{"_id": "k", "v": 7}] and do("scan", "a", "--select", "v", "--limit", "1") == [{"v": 7}] and len(do("versions", "a", "k")) == 2
    assert do("scan", "a", "--filter", '{"field": "v", "op": "eq", "value": 7}', "--explain")[0]["matched"] == 1
    do("delete", "a", "--all")
    assert do("collections") == [] and do("verify") == []
    with pytest.raises(SystemExit):
        do("delete", "a")


def test_devices_converge(spark, tmp_path):
    r, now = random.Random(11), [1_000_000]
    devices = [Store(spark, str(tmp_path / d), d, Clock(wall=lambda: now[0])) for d in "xyz"]
    writes = []
    for step in range(14):
        now[0] += r.randint(0, 2)
        d, key = r.choice(devices), f"k{r.randint(0, 3)}"
        if r.random() < 0.25:
            a = r.choice([s for s in devices if s is not d])
            d.pull(a)
        elif r.random() < 0.25:
            if key in docs(d):
                writes.append((d.delete("a", [key]), d.device_id, key, None))
        else:
            writes.append((d.put("a", [{"_id": key, "n": step}]), d.device_id, key, step))
    for _ in range(2):
        for d in devices:
            for o in devices:
                if o is not d:
                    d.pull(o)
    expected = {}
    for _, _, key, n in sorted(writes, key=lambda w: w[:2]):
        expected[key] = n
    expected = {k: {"n": n} for k, n in expected.items() if n is not None}
    assert [docs(d) for d in devices] == [expected] * 3


def test_search_reads_an_index_that_follows_the_log(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "me")
    store.put("n", [{"_id": "a", "t": "red fox"}, {"_id": "b", "t": "blue hen"}, {"_id": "c", "t": 7}, {"_id": "a", "t": "red red fox"}])
    hits = lambda q, **k: [r._id for r in store.search("n", q, ["t"], **k).orderBy("rank").collect()]
    assert store.collection("n").df.count() == 3 and hits("red hen") == ["a", "b"] or hits("red hen") == ["b", "a"]
    assert store.search("n", "red", ["t"], documents=True).first().doc.toPython()["t"] == "red red fox"
    store.put("n", [{"_id": "b", "t": "red hen"}, {"_id": "d", "t": "green"}])
    store.delete("n", ["a"])
    assert hits("red") == ["b"] and hits("green") == ["d"] and store.text_index("n", "t").state().segments <= 2
    other = Store(spark, str(tmp_path / "o"), "other")
    other.put("n", [{"_id": "e", "t": "red"}])
    assert store.pull(other) == 1 and sorted(hits("red")) == ["b", "e"]
    # Below the floor, deletions may be gone.
    end = other.end()
    store.compact(horizon=end + (1 << 30))
    late = Store(spark, str(tmp_path / "l"), "late")
    late.put("n", [{"_id": "a", "t": "back"}])
    assert store.pull(late) == 0 and "a" not in hits("back")


def test_import_stops_at_bad_lines(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "me")
    path = tmp_path / "in.ndjson"
    path.write_text('{"_id": "a", "v": 1}\n{"_id": "a", "v": 3}\n')
    store.import_file("n", str(path))
    assert store.collection("n").df.first().doc.toPython()["v"] == 3
    path.write_text('{"_id": "b"}\nbad\n')
    with pytest.raises(ValueError):
        store.import_file("n", str(path))
    store.set_schema("n", {"properties": {"v": {"type": "string"}}})
    path.write_text('{"_id": "b", "v": 1}\n')
    with pytest.raises(ValueError):
        store.import_file("n", str(path), checked=True)
    assert store.collection("n").df.count() == 1
