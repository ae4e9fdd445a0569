"""Truth tables of the predicates, typed and VARIANT, and the JSON form."""

import json

import pytest
from pyspark.sql import functions as F

from leafmere.functions.paths import FieldPath
from leafmere.operators.filters import Field, Filter, parse_filter
from leafmere.operators.query import Collection

VALUES = {"missing": None, "null": {"v": None}, "true": {"v": True}, "one": {"v": 1}, "one_d": {"v": 1.0}, "half": {"v": 1.5}, "s1": {"v": "1"}, "a": {"v": "a"}, "A": {"v": "A"}, "empty": {"v": []}, "ab": {"v": ["a", "b"]}, "nums": {"v": [1, 2.0]}, "map": {"v": {}}}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, json.dumps(v if v is not None else {})) for k, v in VALUES.items()]
    return Collection(spark.createDataFrame(rows, "_id string, j string").select("_id", F.parse_json("j").alias("doc")))


ALL = set(VALUES)
CASES = [
    (Field("v").equals(1), {"one", "one_d"}), (Field("v").equals(True), {"true"}), (Field("v").equals("1"), {"s1"}), (Field("v").equals(None), {"missing", "null"}),
    (Field("v").equals("a", case_sensitive=False), {"a", "A"}), (Field("v").not_equals(1), ALL - {"one", "one_d"}), (Field("v").is_greater_than(1), {"half"}), (Field("v").is_less_than("b"), {"s1", "a", "A"}),
    (Field("v").is_between(1, 1.5), {"one", "one_d", "half"}), (Field("v").is_in([1, None, "a"]), {"one", "one_d", "a", "null", "missing"}), (Field("v").is_not_in([1, "a"]), ALL - {"one", "one_d", "a"}),
    (Field("v").is_null(), {"missing", "null"}), (Field("v").is_not_null(), ALL - {"missing", "null"}), (Field("v").is_true(), {"true"}), (Field("v").is_false(), set()),
    (Field("v").starts_with("A", case_sensitive=False), {"a", "A"}), (Field("v").ends_with("1"), {"s1"}), (Field("v").contains("a"), {"a", "ab"}), (Field("v").contains(2), {"nums"}),
    (Field("v").contains_all(["a", "b"]), {"ab"}), (Field("v").contains_all([]), {"empty", "ab", "nums"}), (Field("v").contains_any(["b", 1]), {"ab", "nums"}), (Field("v").contains_any([]), set()),
    (Filter.negate(Field("v").is_greater_than(0)), ALL - {"one", "one_d", "half"}), (Filter.all([]), ALL), (Filter.any([]), set()), (Field("v[0]").equals("a"), {"ab"}), (Field("v[-1]").equals(2), {"nums"}),
    (Field("v[]", any_match=True).equals("b"), {"ab"}), (Field("v[]").equals("b"), set()), (~(Field("v").equals(1) | Field("v").is_null()), ALL - {"one", "one_d", "missing", "null"}),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_variant_truth_table(docs, i):
    condition, expected = CASES[i]
    assert {r[0] for r in docs.where(condition).df().select("_id").collect()} == expected


def test_typed_columns_follow_the_variant_rules(spark):
    rows = [(1, 1, 1.5, "a", True, ["x", "y"]), (2, None, float("nan"), None, None, None), (3, 3, 0.5, "B", False, [])]
    c = Collection(spark.createDataFrame(rows, "_id int, i int, d double, s string, b boolean, l array<string>"))
    ids = lambda f: {r[0] for r in c.where(f).df().select("_id").collect()}
    assert ids(Field("i").not_equals(1)) == {2, 3} and ids(Field("i").equals("1")) == set() and ids(Field("d").is_greater_than(1)) == {1}
    assert ids(Filter.negate(Field("i").is_greater_than(2))) == {1, 2} and ids(Field("s").is_not_in(["a"])) == {2, 3} and ids(Field("absent").is_null()) == {1, 2, 3}
    assert ids(Field("l").contains_all([])) == {1, 3} and ids(Field("l[-1]").equals("y")) == {1} and ids(Field("b").is_false()) == {3} and ids(Field("d").equals(float("nan"))) == set()


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s", "id * 2.0 as d").write.parquet(str(tmp_path / "t"))
    c = Collection(spark.read.parquet(str(tmp_path / "t")), "id")
    plan = c.where(Field("id").is_greater_than(5) & Field("s").starts_with("1")).select("s").df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "StringStartsWith(s,1)" in plan and "d:double" not in plan


def test_json_form():
    assert parse_filter('{"and": []}').empty and not parse_filter('{"or": []}').empty
    for bad in ('{"field": "a", "op": "near"}', "[]", '{"and": {}}', '{"op": "eq"}', '{"field": "a", "op": "between", "value": [1]}'):
        with pytest.raises(ValueError):
            parse_filter(bad)
    with pytest.raises(json.JSONDecodeError):
        parse_filter("{")


def test_paths():
    assert FieldPath.parse("$.a.b[-1]").steps == ("a", "b", -1) and FieldPath.parse("a[].b").fan_out and FieldPath.parse("$$x").steps == ("$$x",)
    for bad in ("$", "", "a[", "a[x]"):
        with pytest.raises(ValueError):
            FieldPath.parse(bad)
