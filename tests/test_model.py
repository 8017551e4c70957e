"""Layout, buffers and the cost model, against values worked out by hand."""

import pytest

from quillbase.functions.layout import best_factor, best_root, layout
from quillbase.plans import cost
from quillbase.plans.sql import parse_query


@pytest.mark.parametrize("available, size, root, factor", [(256, 1000, 32, 250), (10, 1000, 6, 8), (10, 20, 5, 7), (3, 50, 1, 1), (256, 256, 16, 128), (256, 100, 10, 50), (102, 100, 10, 50)])
def test_buffers(available, size, root, factor):
    assert (best_root(available, size), best_factor(available, size)) == (root, factor)


def test_layout():
    own = layout([("tblname", 16), ("fldname", 16), ("type", None), ("length", None), ("offset", None)])
    assert own.offsets == {"tblname": 4, "fldname": 24, "type": 44, "length": 48, "offset": 52}
    assert (own.slot_size, own.slots_per_block) == (56, 73)


def test_select_and_product():
    p = cost.table(900, [("a", None), ("b", None)])
    assert p.distinct == {"a": 301, "b": 301}
    q = cost.select(p, parse_query("select a from t where a = 1").predicate)
    assert (q.blocks, q.records, q.distinct["a"]) == (p.blocks, 2, 1)
    assert cost.select(p, parse_query("select a from t where 1 = 1").predicate).records == 900
    assert cost.select(p, parse_query("select a from t where 1 = 2").predicate).records == 0
    assert cost.product(p, q).blocks == p.blocks + 900 * q.blocks
    assert cost.chunked_product(q, p, 0).blocks == p.blocks + q.blocks * max(1, p.materialized_blocks())
    assert cost.materialize(cost.table(1, [("a", None)])).blocks == 1


def test_greedy_order():
    n = {"customer": 1500, "nation": 25, "region": 5, "orders": 15000}
    fields = {
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
        "region": ["r_regionkey", "r_name"], "orders": ["o_orderkey", "o_custkey"],
    }
    tables = {t: cost.table(n[t], [(f, None) for f in fields[t]]) for t in n}
    query = parse_query(
        "select c_name from customer, nation, region, orders where c_nationkey = n_nationkey and n_regionkey = r_regionkey and o_custkey = c_custkey and r_name = 'ASIA' and c_mktsegment = 'BUILDING'"
    )
    order, total = cost.greedy_order(tables, query.predicate)
    assert order == ["customer", "nation", "region", "orders"] and total.records == 0
