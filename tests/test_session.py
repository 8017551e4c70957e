"""Tables, transactions, views, indexes and the catalog."""

import pytest

from quillbase.plans.sql import SqlError
from quillbase.session import Session
from quillbase.sources.store import Conflict


@pytest.fixture
def s(spark, tmp_path):
    own = Session(spark, str(tmp_path))
    own.execute("create table t (a int, b varchar(5))")
    return own


def rows(s, text="select a, b from t"):
    return sorted(tuple(r) for r in s.query(text).collect())


def test_integers_round_trip(s):
    values = [0, 1, 100, 1234, 100000, 2147483647, -2147483648]
    for v in values:
        assert s.execute(f"insert into t (a) values ({v})") == 1
    assert [a for a, _ in rows(s)] == sorted(values)
    with pytest.raises(SqlError):
        s.execute("insert into t (a) values (2147483648)")


def test_statements(s):
    for a, b in ((1, "x"), (2, "y"), (3, "y")):
        s.execute(f"insert into t (a, b) values ({a}, '{b}')")
    assert s.execute("update t set a = 9 where b = 'y'") == 2
    assert rows(s) == [(1, "x"), (9, "y"), (9, "y")]
    assert s.execute("update t set b = b where a = 1") == 1
    assert s.execute("delete from t where a = 9") == 2 and s.execute("delete from t where a = 9") == 0
    s.execute("insert into t (b) values ('z')")
    s.execute("insert into t (a) values (5)")
    assert rows(s) == [(0, "z"), (1, "x"), (5, "")]
    assert s.execute("delete from t") == 3 and rows(s) == []


def test_refused(s):
    for bad in (
        "insert into t (a) values ('x')", "insert into t (b) values (1)", "insert into t (b) values ('toolong')", "insert into t (c) values (1)", "insert into t (a, A) values (1, 2)",
        "update t set a = b", "update t set b = 'toolong'", "create table t (x int)", "create table tblcat (x int)", "create table u (x int, X int)", "insert into nowhere (a) values (1)",
        "create index i on t (z)", "create view v as select z from t", "create table aname_of_17_chars (x int)",
    ):
        with pytest.raises(SqlError):
            s.execute(bad)
    assert rows(s) == []


def test_only_touched_parts_are_written_again(s):
    for a in (1, 2):
        s.execute(f"insert into t (a) values ({a})")
    before = list(s.store.current().tables["t"].parts)
    s.execute("update t set b = 'n' where a = 2")
    after = s.store.current().tables["t"].parts
    assert before[0] in after and before[1] not in after


def test_transactions(spark, s, tmp_path):
    other = Session(spark, str(tmp_path))
    s.begin()
    s.execute("insert into t (a) values (1)")
    s.execute("create table u (x int)")
    assert rows(s) == [(1, "")] and rows(other) == []
    s.commit()
    assert rows(other) == [(1, "")] and other.query("select x from u").count() == 0
    s.begin()
    s.execute("delete from t")
    s.rollback()
    assert rows(s) == [(1, "")]


def test_conflict(spark, s, tmp_path):
    other = Session(spark, str(tmp_path))
    s.execute("create table u (x int)")
    s.begin(), other.begin()
    s.execute("insert into t (a) values (1)")
    other.execute("insert into t (a) values (2)")
    s.commit()
    with pytest.raises(Conflict):
        other.commit()
    assert rows(s) == [(1, "")]
    s.begin(), other.begin()
    s.execute("insert into t (a) values (3)")
    other.execute("insert into u (x) values (4)")
    s.commit(), other.commit()
    assert rows(s) == [(1, ""), (3, "")] and other.query("select x from u").collect()[0].x == 4


def test_snapshot(spark, s, tmp_path):
    s.execute("insert into t (a) values (1)")
    reader = Session(spark, str(tmp_path))
    reader.begin()
    s.execute("delete from t")
    assert rows(reader) == [(1, "")]
    reader.rollback()
    assert rows(reader) == []


def test_recovery(spark, s, tmp_path):
    s.execute("create index i on t (a)")
    s.execute("insert into t (a) values (1)")
    s.begin()
    s.execute("insert into t (a) values (2)")
    parts = lambda: len(list((tmp_path / "parts").iterdir()))
    assert parts() == 2
    fresh = Session(spark, str(tmp_path), recover=True)
    assert parts() == 1 and rows(fresh) == [(1, "")]


def test_torn_manifests(spark, s, tmp_path):
    """A commit beside a torn manifest goes through, and recovery removes it."""
    (tmp_path / "manifest" / "2.json").write_text('{"number": 2')
    (tmp_path / "manifest" / "99.json").write_text('{"number": 99')
    assert rows(s) == [] and s.store.current().number == 1
    assert s.execute("insert into t (a) values (1)") == 1 and s.store.current().number == 100
    (tmp_path / "manifest" / "101.json").write_text('{"number": 101')
    again = Session(spark, str(tmp_path), recover=True)
    assert rows(again) == [(1, "")] and [n for n in again.store.files.names(str(tmp_path / "manifest"))] == ["100.json"]
    assert again.execute("insert into t (a) values (2)") == 1 and rows(s) == [(1, ""), (2, "")]


def test_only_one_writer_creates_a_file(s, tmp_path):
    files, place = s.store.files, f"{s.store.root}/manifest/7.json"
    assert files.create(place, "one\n") and not files.create(place, "two\n")
    assert files.read(place) == "one\n" and not [n for n in files.names(f"{s.store.root}/manifest") if n.startswith(".7")]


def test_old_manifests_go(s):
    for k in range(25):
        s.execute(f"create table t{k} (a int)")
    assert len([n for n in s.store.files.names(f"{s.store.root}/manifest") if n.endswith(".json")]) == 20
    assert s.query("select a from t24").count() == 0


def test_many_inserts_leave_few_parts(s, monkeypatch):
    from quillbase.sources import store

    monkeypatch.setattr(store, "MERGE", 4)
    s.execute("create index i on t (a)")
    s.begin()
    for k in range(30):
        s.execute(f"insert into t (a, b) values ({k % 7}, 'x{k % 10}')")
        assert len(s.mine.tables["t"].parts) <= 12
    s.commit()
    assert sum(s.store.current().tables["t"].parts.values()) == 30 == len(rows(s))
    plan = s.index_select("t", "a", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and sorted(r.a for r in s.index_select("t", "a", 3).collect()) == [3] * 4


def test_queries_take_indexes(spark, s):
    for a, b in ((1, "x"), (2, "y"), (2, "z")):
        s.execute(f"insert into t (a, b) values ({a}, '{b}')")
    s.execute("create table u (k int, name varchar(5))")
    s.execute("insert into u (k, name) values (2, 'two')")
    plan = lambda text: s.query(text)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" not in plan("select b from t where a = 2")
    s.execute("create index i on t (a)")
    assert "PartitionFilters: [isnotnull(_bucket" in plan("select b from t where a = 2") and rows(s, "select b from t where A = 2") == [("y",), ("z",)]
    assert "_bucket" not in plan("select b from t where a = '2'") and rows(s, "select b from t where a = '2'") == []
    joined = "select name, b from t, u where k = a"
    assert "_bucket" in plan(joined) and rows(s, joined) == [("two", "y"), ("two", "z")]
    s.execute("create view v as select a from t where a = 2")
    assert rows(s, "select a from v") == [(2,), (2,)] and rows(s, "select a, b from t, u where k = 2 and b = 'x'") == [(1, "x")]
    assert s.execute("update t set b = 'w' where a = 2") == 2 and rows(s, "select b from t where a = 2") == [("w",), ("w",)]
    assert s.execute("delete from t where a = 1 and b = 'q'") == 0 and s.execute("delete from t where a = 1") == 1 and rows(s) == [(2, "w"), (2, "w")]


def test_a_value_that_most_rows_have(spark, s):
    """Equal values are dealt over several files of an index."""
    frame = spark.range(40_000).selectExpr("cast(if(id % 10 < 9, 5, id) as int) as a", "cast(id as string) as b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s.append("t", frame)
        s.execute("create index i on t (a)")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = s.index_select("t", "a", 5)
    assert found.count() == 36_000 and found.selectExpr("input_file_name()").distinct().count() >= 3


def test_statistics_are_kept(spark, s, monkeypatch):
    s.attached["w"] = spark.range(30).selectExpr("cast(id as int) as x")
    assert s.statistics("w").records == 30
    s.attached["w"] = spark.range(7).selectExpr("cast(id as int) as x")
    assert s.statistics("w").records == 30
    monkeypatch.setattr("quillbase.session.REFRESH", 2)
    assert s.statistics("w").records == 7
    s.execute("insert into t (a) values (1)")
    assert s.statistics("t").records == 1


def test_strings_too_long_are_refused_in_the_same_pass(spark, s):
    with pytest.raises(SqlError):
        s.append("t", spark.createDataFrame([(1, "long enough")], "a int, b string"))
    assert rows(s) == [] and s.store.files.names(f"{s.store.root}/parts") == []
    assert s.append("t", spark.createDataFrame([(1, None), (2, "x")], "a int, b string")) == 2


def test_views(s):
    s.execute("insert into t (a, b) values (1, 'joe')")
    s.execute("insert into t (a, b) values (2, 'jim')")
    s.execute("create view v as select a, b from t where b = 'joe'")
    s.execute("create view w as select a from v")
    assert rows(s, "select a from w") == [(1,)] and rows(s, "select viewdef from viewcat where viewname = 'w'") == [("select a from v",)]
    with pytest.raises(SqlError):
        s.execute("create view x as select a from t where b = '" + "y" * 100 + "'")


def test_indexes(s):
    for a, b in ((1, "x"), (2, "y"), (2, "z")):
        s.execute(f"insert into t (a, b) values ({a}, '{b}')")
    s.execute("create index i on t (a)")
    s.execute("create index j on t (b)")
    found = lambda *k: sorted(tuple(r) for r in s.index_select("t", *k).collect())
    assert found("a", 2) == [(2, "y"), (2, "z")] and found("b", "x") == [(1, "x")] and found("a", "2") == []
    s.execute("update t set b = 'q' where a = 2")
    s.execute("insert into t (a, b) values (2, 'n')")
    s.execute("delete from t where a = 1")
    assert found("a", 2) == [(2, "n"), (2, "q"), (2, "q")] and found("a", 1) == [] and found("b", "q") == [(2, "q")] * 2
    plan = s.index_select("t", "a", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan
    left = s.spark.createDataFrame([(2, "l"), (7, "m")], "k int, name string")
    assert sorted(map(tuple, s.index_join(left, "t", "k", "a").collect())) == [(2, "l", 2, "n"), (2, "l", 2, "q"), (2, "l", 2, "q")]
    assert s.index_join(left.where("false"), "t", "k", "a").count() == 0
    with pytest.raises(SqlError):
        s.index_select("u", "a", 1)


def test_catalog(s):
    assert rows(s, "select tblname, slotsize from tblcat") == [("fldcat", 56), ("idxcat", 64), ("t", 17), ("tblcat", 28), ("viewcat", 128)]
    assert rows(s, "select fldname, type, length, offset from fldcat where tblname = 't'") == [("a", 0, 0, 4), ("b", 1, 5, 8)]


def test_explain(s):
    s.execute("create table u (x int)")
    s.execute("insert into u (x) values (1)")
    assert s.explain("select a, x from t, u where a = x").startswith("t -> u: blocks=")
    assert s.query("select a, x from t, u where a = x", order="greedy").count() == 0
