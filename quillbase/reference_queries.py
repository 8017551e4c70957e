"""One registered query for each operator of the engine, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, layout
from .operators import aggregates, relational
from .plans import cost, sql
from .plans.build import Scope
from .session import Session
from .sources.files import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

JOIN4 = (
    "select c_name, n_name, r_name, o_orderkey from customer, nation, region, orders where c_nationkey = n_nationkey "
    "and n_regionkey = r_regionkey and o_custkey = c_custkey and r_name = 'ASIA' and c_mktsegment = 'BUILDING'"
)

#: Queries whose text is the same for the engine's own front end and for the oracle.
SAME = {
    "scan": "select n_nationkey, n_name, n_regionkey from nation",
    "project": "select c_custkey, c_name from customer",
    "filter_int": "select n_name from nation where n_regionkey = 2",
    "filter_str": "select c_custkey from customer where c_mktsegment = 'BUILDING'",
    "filter_conj": "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 1",
    "filter_field_field": "select l_orderkey, l_linenumber from lineitem where l_partkey = l_suppkey",
    "filter_const_const": "select r_name from region where 1 = 1",
    "product": "select r_name, n_name from region, nation",
    "join2": "select n_name, r_name from nation, region where n_regionkey = r_regionkey",
    "join4": JOIN4,
    "event_filter": "select event_id, user_id from events where event_type = 'click'",
}


def session(spark: SparkSession, sf_dir: str, *tables: str, root: str | None = None) -> Session:
    return Session(spark, root).attach(**{t: f"{sf_dir}/{t}.parquet" for t in tables or TABLES})


def _text(text: str, order: str = "given") -> Callable[[SparkSession, str], DataFrame]:
    names = sql.parse_query(text).tables
    return lambda spark, sf_dir: session(spark, sf_dir, *names).query(text, order)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _merge_join(spark, sf_dir):
    rows = relational.merge_join(_table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey")
    return relational.project(rows, ["s_name", "n_name"])


def _group(table: str, fields: list[str], *aggs: aggregates.Aggregate):
    return lambda spark, sf_dir: relational.group_by(_table(spark, sf_dir, table), fields, list(aggs))


def _sort(spark, sf_dir):
    return relational.sort(relational.project(_table(spark, sf_dir, "nation"), ["n_regionkey", "n_name"]), ["n_regionkey", "n_name"])


def _global_max_empty(spark, sf_dir):
    rows = session(spark, sf_dir, "nation").query("select n_nationkey from nation where n_regionkey = 99")
    return relational.group_by(rows, [], [aggregates.max_of("n_nationkey")]).withColumnRenamed("maxofn_nationkey", "m")


def _materialize(spark, sf_dir):
    rows = relational.materialize(session(spark, sf_dir, "customer").query("select c_custkey, c_name, c_nationkey from customer where c_nationkey = 3"))
    return relational.project(rows, ["c_custkey", "c_name"])


def _temp_table(spark, sf_dir):
    rows = session(spark, sf_dir, "customer").query("select c_custkey, c_name from customer where c_nationkey = 3")
    return relational.temp_table(rows, scratch(spark))


def _chunked(spark, sf_dir):
    rows = relational.chunked_product(_table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation"))
    return relational.project(rows, ["r_name", "n_name"])


def _copied(spark, sf_dir, name: str, columns: str) -> Session:
    """A session with a store that holds a copy of one table."""
    own = Session(spark, scratch(spark))
    own.execute(f"create table {name} ({columns})")
    own.append(name, _table(spark, sf_dir, name))
    return own


NATION = "n_nationkey int, n_name varchar(25), n_regionkey int"


def _update(spark, sf_dir):
    own = _copied(spark, sf_dir, "nation", NATION)
    own.execute("update nation set n_regionkey = 9 where n_regionkey = 2")
    return own.query("select n_nationkey, n_name, n_regionkey from nation")


def _delete(spark, sf_dir):
    own = _copied(spark, sf_dir, "nation", NATION)
    own.execute("delete from nation where n_regionkey = 2")
    return own.query("select n_nationkey, n_name, n_regionkey from nation")


def _insert(spark, sf_dir):
    own = _copied(spark, sf_dir, "region", "r_regionkey int, r_name varchar(25)")
    own.execute("insert into region (r_name, r_regionkey) values ('X', 99)")
    return own.query("select r_regionkey, r_name from region")


def _insert_defaults(spark, sf_dir):
    own = _copied(spark, sf_dir, "region", "r_regionkey int, r_name varchar(25)")
    own.execute("insert into region (r_name) values ('only a name')")
    own.execute("insert into region (r_regionkey) values (-5)")
    return own.query("select r_regionkey, r_name from region")


def _rollback(spark, sf_dir):
    own = _copied(spark, sf_dir, "nation", NATION)
    own.begin()
    own.execute("delete from nation")
    own.rollback()
    return own.query("select n_nationkey, n_name, n_regionkey from nation")


def _view(spark, sf_dir):
    own = session(spark, sf_dir, "nation", root=scratch(spark))
    own.execute("create view asian as select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 2")
    return own.query("select n_name from asian")


def _view_over_view(spark, sf_dir):
    own = session(spark, sf_dir, "nation", "supplier", root=scratch(spark))
    own.execute("create view asian as select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 2")
    own.execute("create view named as select n_nationkey, n_name from asian")
    return own.query("select s_name, n_name from supplier, named where s_nationkey = n_nationkey")


def _indexed_orders(spark, sf_dir) -> Session:
    own = _copied(spark, sf_dir, "orders", "o_orderkey int, o_custkey int, o_orderstatus varchar(1)")
    own.attached["customer"] = _table(spark, sf_dir, "customer")
    own.execute("create index bycust on orders (o_custkey)")
    return own


def _index_select(spark, sf_dir):
    return relational.project(_indexed_orders(spark, sf_dir).index_select("orders", "o_custkey", 7), ["o_orderkey", "o_custkey"])


def _index_join(spark, sf_dir):
    own = _indexed_orders(spark, sf_dir)
    outer = own.query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
    return relational.project(own.index_join(outer, "orders", "c_custkey", "o_custkey"), ["c_name", "o_orderkey"])


def _sql_index_select(spark, sf_dir):
    """The same rows by SQL: the front end finds the index itself."""
    return _indexed_orders(spark, sf_dir).query("select o_orderkey, o_custkey from orders where o_custkey = 7")


def _sql_index_join(spark, sf_dir):
    own = _indexed_orders(spark, sf_dir)
    return own.query("select c_name, o_orderkey from customer, orders where o_custkey = c_custkey and c_mktsegment = 'BUILDING'")


def _index_delete(spark, sf_dir):
    """The rows to delete are found by the index."""
    own = _indexed_orders(spark, sf_dir)
    own.execute("delete from orders where o_custkey = 7")
    return own.query("select o_orderkey, o_custkey from orders")


def _merged_parts(spark, sf_dir):
    """More inserts than a table keeps parts of."""
    from .sources.store import MERGE

    own = _copied(spark, sf_dir, "region", "r_regionkey int, r_name varchar(25)")
    own.begin()
    for k in range(MERGE + 1):
        own.execute(f"insert into region (r_regionkey, r_name) values ({100 + k}, 'R{k}')")
    own.commit()
    return own.query("select r_regionkey, r_name from region")


def _recovery(spark, sf_dir):
    """What is committed is there after a transaction that never ended and a torn manifest; the next commit works."""
    own = _copied(spark, sf_dir, "region", "r_regionkey int, r_name varchar(25)")
    own.begin()
    own.execute("insert into region (r_regionkey, r_name) values (98, 'lost')")
    files = own.store.files
    stream = files.fs.create(files.path(f"{own.store.root}/manifest/9.json"), False)
    stream.write(bytearray(b'{"number": 9'))
    stream.close()
    again = Session(spark, own.store.root, recover=True)
    again.execute("insert into region (r_regionkey, r_name) values (99, 'X')")
    return again.query("select r_regionkey, r_name from region")


def _index_maintained(spark, sf_dir):
    own = _indexed_orders(spark, sf_dir)
    own.execute("insert into orders (o_orderkey, o_custkey, o_orderstatus) values (-1, 7, 'F')")
    own.execute("delete from orders where o_custkey = 7 and o_orderstatus = 'O'")
    return relational.project(own.index_select("orders", "o_custkey", 7), ["o_orderkey", "o_orderstatus"])


def _catalog(name: str):
    def run(spark, sf_dir):
        own = _copied(spark, sf_dir, "region", "r_regionkey int, r_name varchar(25)")
        own.execute("create view names as select r_name from region")
        own.execute("create index byname on region (r_name)")
        fields = {"tblcat": "tblname, slotsize", "fldcat": "tblname, fldname, type, length, offset", "viewcat": "viewname, viewdef", "idxcat": "indexname, tablename, fieldname"}
        return own.query(f"select {fields[name]} from {name}")

    return run


def _rows(sql_values: list[tuple], columns: list[str]) -> str:
    say = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(say, r)) + ')' for r in sql_values)}) as t({', '.join(columns)})"


def _hash_text(spark, sf_dir):
    df = _table(spark, sf_dir, "nation")
    return df.select("n_name", hashing.fnv1a64_text(F.col("n_name")).alias("hash"), hashing.value_bucket(F.col("n_name"), True).alias("bucket"))


def _hash_int(spark, sf_dir):
    df = _table(spark, sf_dir, "nation")
    return df.select("n_nationkey", hashing.fnv1a64_int(F.col("n_nationkey")).alias("hash"), hashing.value_bucket(F.col("n_nationkey"), False).alias("bucket"))


def _unrolled(column: str, is_text: bool) -> str:
    """FNV-1a in the oracle's 128-bit integers, a byte at a time."""
    byte = f"ascii(substr({column}, i, 1))" if is_text else f"(({column}::BIGINT & 4294967295) >> (8 * (4 - i))) & 255"
    count = f"length({column})" if is_text else "4"
    step = "((xor(h, b) * 435::UHUGEINT + ((xor(h, b) & 16777215::UHUGEINT) << 40)) & 18446744073709551615::UHUGEINT)"
    return f"""
    with recursive t(v, i, h) as (
      select {column}, 0, 14695981039346656037::UHUGEINT from nation
      union all
      select v, i + 1, {step} from (select v, i, h, ({byte.replace(column, "v").replace("i,", "i + 1,").replace("4 - i", "3 - i")})::UHUGEINT as b from t where i < {count.replace(column, "v")}))
    select v as {column}, (case when h >= 9223372036854775808::UHUGEINT then h::HUGEINT - 18446744073709551616::HUGEINT else h::HUGEINT end)::BIGINT as hash,
           (h % 100)::INTEGER as bucket
    from t where i = {count.replace(column, "v")}"""


BUFFERS = [(256, 1000), (10, 1000), (10, 20), (3, 50), (256, 256), (256, 100), (102, 100)]


def _buffers(spark, sf_dir):
    rows = [(a, s, layout.best_root(a, s), layout.best_factor(a, s)) for a, s in BUFFERS]
    return spark.createDataFrame(rows, "available int, size int, best_root int, best_factor int")


def _slot_size(spark, sf_dir):
    from .sources.catalog import TABLES as own

    rows = [(n, layout.layout(f).slot_size, layout.layout(f).slots_per_block) for n, f in own.items()]
    return spark.createDataFrame(rows, "tblname string, slotsize int, slots_per_block int")


def _plan_cost(spark, sf_dir):
    """Estimates of each operator over nation and supplier as tables of the engine."""
    n = cost.table(_table(spark, sf_dir, "nation").count(), [("n_nationkey", None), ("n_name", 25), ("n_regionkey", None)])
    s = cost.table(_table(spark, sf_dir, "supplier").count(), [("s_suppkey", None), ("s_name", 25), ("s_nationkey", None)])
    two = sql.Predicate((sql.Term(sql.Field("n_regionkey"), sql.Constant(2)),))
    plans = {
        "table": n, "select": cost.select(n, two), "project": cost.project(n, ["n_name"]), "product": cost.product(n, s),
        "chunked_product": cost.chunked_product(n, s, 8), "merge_join": cost.merge_join(n, s, "n_nationkey", "s_nationkey"),
        "index_select": cost.index_select(n, "n_regionkey"), "index_join": cost.index_join(s, n, "n_nationkey"),
        "sort": cost.sort(n), "materialize": cost.materialize(n), "group_by": cost.group_by(n, ["n_regionkey"]),
    }
    return spark.createDataFrame([(k, p.blocks, p.records) for k, p in plans.items()], "plan string, blocks bigint, records bigint")


PLAN_COST_SQL = """
with n as (select count(*) as r, 1 + count(*) // 3 as v, ceil(count(*) / 99)::BIGINT as b from nation),
     s as (select count(*) as r, 1 + count(*) // 3 as v, ceil(count(*) / 99)::BIGINT as b from supplier),
     x as (select n.r as nr, n.v as nv, n.b as nb, s.r as sr, s.v as sv, s.b as sb, ceil(n.r / 256)::BIGINT // 100 as search from n, s)
select 'table' as plan, nb as blocks, nr as records from x
union all select 'select', nb, nr // nv from x
union all select 'project', nb, nr from x
union all select 'product', nb + nr * sb, nr * sr from x
union all select 'chunked_product', sb + nb * greatest(1, ceil(sb / 8))::BIGINT, nr * sr from x
union all select 'merge_join', nb + sb, nr * sr // greatest(nv, sv) from x
union all select 'index_select', search + nr // nv, nr // nv from x
union all select 'index_join', sb + sr * search + sr * (nr // nv), sr * (nr // nv) from x
union all select 'sort', nb, nr from x
union all select 'materialize', nb, nr from x
union all select 'group_by', nb, nv from x
"""


def _sub_predicates(spark, sf_dir):
    """A pushed and a joining part of one predicate, applied by hand."""
    query = sql.parse_query("select c_name, n_name from customer, nation where c_nationkey = n_nationkey and c_mktsegment = 'BUILDING'")
    c, n = (_table(spark, sf_dir, t) for t in query.tables)
    own, other = set(c.columns), set(n.columns)
    left = relational.select(c, query.predicate.within(own))
    rows = relational.product(left, relational.select(n, query.predicate.within(other)))
    return relational.project(rows.where(Scope(rows).condition(query.predicate.between(own, other))), list(query.fields))


PREDICATE = "select c_name from customer, nation where c_nationkey = n_nationkey and n_name = 'CHINA' and 3 = c_custkey"


def _equated(spark, sf_dir):
    """What a predicate equates each field with."""
    predicate = sql.parse_query(PREDICATE).predicate
    rows = [(f, str(c) if (c := predicate.constant_for(f)) is not None else None, predicate.field_for(f)) for f in ("c_nationkey", "n_nationkey", "n_name", "c_custkey", "c_name")]
    return spark.createDataFrame(rows, "field string, constant string, other string")


def _applicable(spark, sf_dir):
    """How many terms of a predicate each table decides alone, and both together."""
    query = sql.parse_query(PREDICATE)
    c, n = (set(_table(spark, sf_dir, t).columns) for t in query.tables)
    rows = [("customer", len(query.predicate.within(c).terms)), ("nation", len(query.predicate.within(n).terms)), ("both", len(query.predicate.between(c, n).terms))]
    return spark.createDataFrame(rows, "tables string, terms int")


def _search_cost(spark, sf_dir):
    """Blocks that a look-up by hash and by tree reads, for tables of several sizes."""
    rows = []
    for name, field in (("nation", "n_nationkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        p = cost.table(_table(spark, sf_dir, name).count(), [(field, None)])
        rows.append((name, cost.hash_search(p, field), cost.tree_search(p, field)))
    return spark.createDataFrame(rows, "tblname string, hash_search int, tree_search int")


SEARCH_COST_SQL = " union all ".join(
    f"select '{t}' as tblname, (ceil(count(*) / 256)::BIGINT // 100)::INTEGER as hash_search, (case when count(*) <= 341 then 1 when count(*) <= 341 * 341 then 2 else 3 end)::INTEGER as tree_search from {t}"
    for t in ("nation", "orders", "lineitem")
)


def _mixed_types(spark, sf_dir):
    return session(spark, sf_dir, "nation").query("select n_name from nation where n_regionkey = '2'")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _text(text) for name, text in SAME.items()},
    "join4_greedy_order": _text(JOIN4, "greedy"),
    "merge_join": _merge_join,
    "multibuffer_product": _chunked,
    "sub_predicates": _sub_predicates,
    "group_max": _group("customer", ["c_mktsegment"], aggregates.max_of("c_custkey")),
    "group_max_str": _group("orders", ["o_orderstatus"], aggregates.max_of("o_orderpriority")),
    "group_keys": _group("orders", ["o_orderstatus", "o_orderpriority"]),
    "group_other_aggregates": _group("orders", ["o_orderstatus"], aggregates.min_of("o_orderkey"), aggregates.count_of("o_orderkey"), aggregates.sum_of("o_custkey")),
    "group_avg": _group("orders", ["o_orderstatus"], aggregates.avg_of("o_custkey")),
    "global_max": _group("orders", [], aggregates.max_of("o_orderkey")),
    "global_max_empty": _global_max_empty,
    "sort": _sort,
    "materialize": _materialize,
    "temp_table": _temp_table,
    "mixed_type_equality": _mixed_types,
    "update_effect": _update,
    "delete_effect": _delete,
    "insert_effect": _insert,
    "insert_defaults": _insert_defaults,
    "rollback": _rollback,
    "view": _view,
    "view_over_view": _view_over_view,
    "index_select": _index_select,
    "index_join": _index_join,
    "index_maintained": _index_maintained,
    "sql_index_select": _sql_index_select,
    "sql_index_join": _sql_index_join,
    "index_delete": _index_delete,
    "merged_parts": _merged_parts,
    "recovery": _recovery,
    "catalog_tables": _catalog("tblcat"),
    "catalog_fields": _catalog("fldcat"),
    "catalog_views": _catalog("viewcat"),
    "catalog_indexes": _catalog("idxcat"),
    "fnv_text": _hash_text,
    "fnv_int": _hash_int,
    "buffer_arithmetic": _buffers,
    "slot_size": _slot_size,
    "plan_cost": _plan_cost,
    "search_cost": _search_cost,
    "equated_with": _equated,
    "applicable_terms": _applicable,
}

_ALL_NATIONS = "select n_nationkey, n_name, n_regionkey from nation"
_FIELDS = [
    ("tblcat", "tblname", 1, 16, 4), ("tblcat", "slotsize", 0, 0, 24), ("fldcat", "tblname", 1, 16, 4), ("fldcat", "fldname", 1, 16, 24), ("fldcat", "type", 0, 0, 44),
    ("fldcat", "length", 0, 0, 48), ("fldcat", "offset", 0, 0, 52), ("viewcat", "viewname", 1, 16, 4), ("viewcat", "viewdef", 1, 100, 24), ("idxcat", "indexname", 1, 16, 4),
    ("idxcat", "tablename", 1, 16, 24), ("idxcat", "fieldname", 1, 16, 44), ("region", "r_regionkey", 0, 0, 4), ("region", "r_name", 1, 25, 8),
]

ORACLES: dict[str, str] = {
    **SAME,
    "join4_greedy_order": JOIN4,
    "merge_join": "select s_name, n_name from supplier join nation on s_nationkey = n_nationkey",
    "multibuffer_product": SAME["product"],
    "sub_predicates": "select c_name, n_name from customer, nation where c_nationkey = n_nationkey and c_mktsegment = 'BUILDING'",
    "group_max": "select c_mktsegment, max(c_custkey) as maxofc_custkey from customer group by c_mktsegment",
    "group_max_str": "select o_orderstatus, max(o_orderpriority) as maxofo_orderpriority from orders group by o_orderstatus",
    "group_keys": "select o_orderstatus, o_orderpriority from orders group by o_orderstatus, o_orderpriority",
    "group_other_aggregates": "select o_orderstatus, min(o_orderkey) as minofo_orderkey, count(o_orderkey) as countofo_orderkey, sum(o_custkey)::BIGINT as sumofo_custkey from orders group by o_orderstatus",
    "group_avg": "select o_orderstatus, avg(o_custkey) as avgofo_custkey from orders group by o_orderstatus",
    "global_max": "select max(o_orderkey) as maxofo_orderkey from orders",
    "global_max_empty": "select max(n_nationkey) as m from nation where n_regionkey = 99 having count(*) > 0",
    "sort": "select n_regionkey, n_name from nation order by n_regionkey, n_name",
    "materialize": "select c_custkey, c_name from customer where c_nationkey = 3",
    "temp_table": "select c_custkey, c_name from customer where c_nationkey = 3",
    "mixed_type_equality": "select n_name from nation where 1 = 2",
    "update_effect": "select n_nationkey, n_name, case when n_regionkey = 2 then 9 else n_regionkey end as n_regionkey from nation",
    "delete_effect": f"{_ALL_NATIONS} where not (n_regionkey = 2)",
    "insert_effect": "select r_regionkey, r_name from region union all select 99, 'X'",
    "insert_defaults": "select r_regionkey, r_name from region union all select 0, 'only a name' union all select -5, ''",
    "rollback": _ALL_NATIONS,
    "view": "select n_name from nation where n_regionkey = 2",
    "view_over_view": "select s_name, n_name from supplier, nation where s_nationkey = n_nationkey and n_regionkey = 2",
    "index_select": "select o_orderkey::INTEGER as o_orderkey, o_custkey::INTEGER as o_custkey from orders where o_custkey = 7",
    "index_join": "select c_name, o_orderkey::INTEGER as o_orderkey from customer, orders where o_custkey = c_custkey and c_mktsegment = 'BUILDING'",
    "index_maintained": "select o_orderkey::INTEGER as o_orderkey, o_orderstatus from orders where o_custkey = 7 and o_orderstatus <> 'O' union all select -1, 'F'",
    "sql_index_select": "select o_orderkey::INTEGER as o_orderkey, o_custkey::INTEGER as o_custkey from orders where o_custkey = 7",
    "sql_index_join": "select c_name, o_orderkey::INTEGER as o_orderkey from customer, orders where o_custkey = c_custkey and c_mktsegment = 'BUILDING'",
    "index_delete": "select o_orderkey::INTEGER as o_orderkey, o_custkey::INTEGER as o_custkey from orders where o_custkey <> 7",
    "merged_parts": "select r_regionkey, r_name from region union all select 100 + i, 'R' || i from (select unnest(range(17)) as i)",
    "recovery": "select r_regionkey, r_name from region union all select 99, 'X'",
    "catalog_tables": _rows([("tblcat", 28), ("fldcat", 56), ("viewcat", 128), ("idxcat", 64), ("region", 37)], ["tblname", "slotsize"]),
    "catalog_fields": _rows(_FIELDS, ["tblname", "fldname", "type", "length", '"offset"']),
    "catalog_views": _rows([("names", "select r_name from region")], ["viewname", "viewdef"]),
    "catalog_indexes": _rows([("byname", "region", "r_name")], ["indexname", "tablename", "fieldname"]),
    "fnv_text": _unrolled("n_name", True),
    "fnv_int": _unrolled("n_nationkey", False),
    "buffer_arithmetic": _rows([(256, 1000, 32, 250), (10, 1000, 6, 8), (10, 20, 5, 7), (3, 50, 1, 1), (256, 256, 16, 128), (256, 100, 10, 50), (102, 100, 10, 50)], ["available", "size", "best_root", "best_factor"]),
    "slot_size": _rows([("tblcat", 28, 146), ("fldcat", 56, 73), ("viewcat", 128, 32), ("idxcat", 64, 64)], ["tblname", "slotsize", "slots_per_block"]),
    "plan_cost": PLAN_COST_SQL,
    "search_cost": SEARCH_COST_SQL,
    "equated_with": "select * from (values ('c_nationkey', NULL, 'n_nationkey'), ('n_nationkey', NULL, 'c_nationkey'), ('n_name', 'CHINA', NULL), ('c_custkey', '3', NULL), ('c_name', NULL, NULL)) as t(field, constant, other)",
    "applicable_terms": "select * from (values ('customer', 1), ('nation', 1), ('both', 1)) as t(tables, terms)",
}
