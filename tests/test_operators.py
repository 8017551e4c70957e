"""Operators on small rows: empty sides, repeated keys, order, extremes, kinds of types, plans."""

import pytest

from quillbase.functions import hashing
from quillbase.operators import aggregates, relational
from quillbase.plans.sql import SqlError
from quillbase.session import Session


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_product_of_nothing(spark):
    t, u = df(spark, [], "a int"), df(spark, [(1,), (2,)], "b int")
    assert rows(relational.product(t, u)) == rows(relational.chunked_product(t, u)) == []
    assert rows(relational.chunked_product(u, df(spark, [(1,), (2,)], "c int"), limit=0)).__len__() == 4


def test_join_of_repeated_keys(spark):
    a, b = df(spark, [(1,), (1,), (2,), (None,)], "a int"), df(spark, [(1,), (1,), (3,), (None,)], "b int")
    for join in (relational.merge_join, relational.equi_join):
        assert rows(join(a, b, "a", "b")) == [(1, 1)] * 4
    assert "SortMergeJoin" in plan(relational.merge_join(a, b, "a", "b"))
    assert rows(relational.merge_join(df(spark, [], "a int"), b, "a", "b")) == []


def test_sort(spark):
    assert rows(relational.sort(df(spark, [(1,), (2,), (3,)], "a int"), ["a"])) == [(1,), (2,), (3,)]
    assert rows(relational.sort(df(spark, [(2, "b"), (2, "a"), (1, "z")], "a int, b string"), ["a", "b"])) == [(1, "z"), (2, "a"), (2, "b")]
    assert rows(relational.sort(df(spark, [("b",), ("A",), ("a",), ("B",)], "a string"), ["a"])) == [("A",), ("B",), ("a",), ("b",)]
    assert rows(relational.sort(df(spark, [], "a int"), ["a"])) == []


def test_group_by(spark):
    t = df(spark, [(1, 5, "a"), (1, 9, "c"), (1, 3, "b")], "g int, v int, s string")
    got = relational.group_by(t, ["g"], [aggregates.max_of("v"), aggregates.max_of("s")])
    assert got.columns == ["g", "maxofv", "maxofs"] and rows(got) == [(1, 9, "c")]
    assert rows(relational.group_by(t, ["g"])) == [(1,)]
    assert rows(relational.group_by(t.where("false"), [], [aggregates.max_of("v")])) == []
    assert rows(relational.group_by(t, [], [aggregates.max_of("v")])) == [(9,)]


def test_select(spark):
    s = Session(spark)
    s.attached = {"t": df(spark, [(3, "3"), (4, "x")], "a int, b string"), "u": df(spark, [(3, "3")], "A int, c string"), "v": df(spark, [(3,)], "d bigint")}
    assert rows(s.query("select a from t where a = '3'")) == rows(s.query("select a from t where a = b")) == []
    assert rows(s.query("select b from t where A = 3")) == [("3",)]
    assert rows(s.query("select a from t, v where a = d")) == [(3,)]
    for bad in ("select a from t, u", "select z from t", "select a, a from t", "select a from t where z = 1", "select a from nowhere", "select a from t, t"):
        with pytest.raises(SqlError):
            s.query(bad)


def test_pushdown(spark, tmp_path):
    df(spark, [(1, 2, "x")], "a int, b int, c string").write.parquet(str(tmp_path / "t"))
    s = Session(spark).attach(t=str(tmp_path / "t"))
    text = plan(s.query("select a from t where c = 'x'"))
    assert "EqualTo(c,x)" in text and "ReadSchema: struct<a:int,c:string>" in text
    assert "LocalTableScan <empty>" in plan(s.query("select a from t where 1 = 2"))


@pytest.mark.parametrize("value, bucket", [(0, 41), (1, 30), (7, 64), (100000, 72), (2147483647, 73)])
def test_int_buckets(spark, value, bucket):
    t = df(spark, [(value,)], "a int")
    assert rows(t.select(hashing.value_bucket(t["a"], False))) == [(bucket,)]


def test_text_hashes(spark):
    known = {"": 14695981039346656037, "a": 12638187200555641996, "ASIA": 2794017977029030871, "BUILDING": 10970977359440647285, "joe": 4999693884618137257}
    t = df(spark, [(k,) for k in known] + [(None,)], "a string")
    got = dict(rows(t.select("a", hashing.fnv1a64_text(t["a"]))))
    assert {k: v % 2**64 for k, v in got.items() if k is not None} == known and got[None] is None


def test_temp_table(spark, tmp_path):
    assert rows(relational.temp_table(df(spark, [(1,)], "a int"), str(tmp_path))) == [(1,)]


def test_broadcast_by_bytes(spark, tmp_path):
    spark.range(2000).selectExpr("id as a", "repeat(cast(id as string), 50) as s").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert relational.broadcastable(t) and not relational.broadcastable(t, 1000)
    assert relational.estimated_bytes(t.select("a")) < relational.estimated_bytes(t)


def test_buckets_of_known_values(spark):
    values = [0, 7, -1, 2147483647, -2147483648]
    t = df(spark, [(v,) for v in values], "a int")
    assert [b for (b,) in rows(t.select(hashing.value_bucket(t["a"], False)))] == [hashing.bucket_of_value(v) for v in values]
    texts = ["", "a", "ASIA", "日本", "it's"]
    t = df(spark, [(v,) for v in texts], "a string")
    assert [b for (b,) in rows(t.select(hashing.value_bucket(t["a"], True)))] == [hashing.bucket_of_value(v) for v in texts]
