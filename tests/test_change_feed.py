"""The change feed against a plain fold, its cases, and that only touched buckets are rewritten."""

import random

import pytest

from leafmere.operators.change_feed import BucketTable, base_rows, change_rows, current_records

BASE = "ns string, kv_key string, hlc long, device_id string, body string"
FEED = "ns string, doc_key string, change_type string, hlc long, device_id string, body string, body2 int"


def test_against_a_fold(spark):
    r = random.Random(3)
    base = [("n", f"k{i}", r.randint(0, 50), r.choice("ab"), "{}") for i in range(30)]
    base += base[:5]
    hot = lambda: "k1" if r.random() < 0.4 else f"k{r.randint(0, 60)}"
    feed = [(r.choice(["n", "m", None]), r.choice([str.upper, str.lower, lambda k: k[0] + "-" + k[1:]])(hot()), r.choice(["added", " Updated", "DELETED ", None, "odd"]), r.choice([None, r.randint(0, 99), r.randint(0, 99)]), r.choice(["a", "b", None]), "x", 1) for _ in range(900)]
    feed += [("n", None, "added", 5, "a", "x", 1), ("n", " ", "added", 5, "a", "x", 1)]
    best = {}
    for ns, key, kind, hlc, dev, _, _ in [(b[0], b[1], "added", b[2], b[3], b[4], 0) for b in base] + feed:
        kind, key = (kind or "").strip().lower(), (key or "").strip().lower().replace("-", "")
        if kind in ("added", "updated", "deleted") and key and hlc is not None:
            best[ns, key] = max(best.get((ns, key), (-1, "", False)), (hlc, dev or "", kind == "deleted"))
    expected = {(ns, k, v[0]) for (ns, k), v in best.items() if not v[2]}
    got = current_records(spark.createDataFrame(base, BASE), spark.createDataFrame(feed, FEED))
    assert {(x.ns, x.kv_key, x.hlc) for x in got.collect()} == expected and got.count() == len(expected)


def test_only_touched_buckets_are_rewritten_and_any_order_gives_the_same(spark, tmp_path):
    base = spark.createDataFrame([("n", f"k{i}", 1, "a", str(i)) for i in range(200)], BASE)
    table = BucketTable.create(base_rows(base), str(tmp_path / "t"), buckets=16)
    one = change_rows(spark.createDataFrame([("n", "k3", "deleted", 9, "a", None, 1)], FEED))
    late = change_rows(spark.createDataFrame([("n", "k3", "updated", 5, "a", "late", 1)], FEED))
    after = table.apply(one)
    changed = [b for b, f in after.manifest["files"].items() if f != table.manifest["files"].get(b)]
    assert len(changed) == 1 and after.live().count() == 199 and table.live().count() == 200
    again = after.apply(late).apply(one)
    assert again.live().count() == 199 and BucketTable.load(spark, str(tmp_path / "t")).manifest["version"] == 3
    assert BucketTable.load(spark, str(tmp_path / "t"), 0).live().count() == 200
    with pytest.raises(RuntimeError):
        table.apply(late)


def test_empty_tables(spark):
    base, feed = spark.createDataFrame([], BASE), spark.createDataFrame([], FEED)
    assert current_records(base, feed).count() == 0
    assert current_records(base, spark.createDataFrame([("n", "k", "updated", 1, None, None, 1)], FEED)).count() == 1
    assert current_records(spark.createDataFrame([("n", "k", None, None, None)], BASE), feed).count() == 1


def test_buckets_are_merged_without_moving_the_base(spark, tmp_path):
    base = spark.createDataFrame([("n" if i % 3 else None, f"k{i}", 1, "a", str(i)) for i in range(300)], BASE)
    table = BucketTable.create(base_rows(base), str(tmp_path / "t"), buckets=8)
    assert all(len(f) == 1 for f in table.manifest["files"].values()) and len(table.manifest["files"]) == 8
    held = dict(list(table.manifest["files"].items())[:3])
    with table._bucketed(held) as old, table._bucketed(table.manifest["files"]) as new:
        joined = old.hint("merge").join(new.select("space", "key", "hlc"), ["space", "key"], "full_outer")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan.replace("SortMergeJoin", "")
        assert old.count() < 300 and old.count() == sum(spark.read.parquet(*f).count() for f in held.values())
    after = table.apply(change_rows(spark.createDataFrame([(None, "k0", "updated", 5, "b", "x", 1), ("n", "new", "added", 5, "b", "x", 1)], FEED)))
    assert {(r.ns, r.key, r.hlc) for r in after.live().where("hlc = 5").collect()} == {(None, "k0", 5), ("n", "new", 5)} and after.live().count() == 301
    assert after.vacuum() >= 1 and after.live().count() == 301
    with pytest.raises(Exception):
        BucketTable.load(spark, str(tmp_path / "t"), 0)
    keys = spark.read.parquet(after.manifest["files"]["0"][0]).select("space", "key").collect()
    assert keys == sorted(keys) and not [t for t in spark.catalog.listTables() if t.name.startswith("leafmere_")]
