"""Relations and queries on whole tables hold what all lines say, by brute force over the smallest tables."""

from collections import defaultdict
from itertools import chain, combinations

import pytest

from sparkwright.plans import catalog
from sparkwright.sources.scratch import read_table
from sparkwright.sources.tables import relation

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return read_table(spark, FOLDER, "lineitem").collect()


HANDLERS = 10**12


@pytest.fixture(scope="module")
def functions(spark):
    return {r.pid: r for r in relation(spark, FOLDER, "functions").collect()}


@pytest.fixture(scope="module")
def customers(spark):
    return sorted(read_table(spark, FOLDER, "customer").collect(), key=lambda c: c.c_custkey)


def handler_uses(customers):
    """Each handler uses the one before it in its group."""
    last, out = {}, set()
    for c in customers:
        k = c.c_custkey
        group = c.c_mktsegment, c.c_nationkey if k % 2 == 0 else k % 8, c.c_acctbal // 500
        if group in last:
            out.add((k + HANDLERS, last[group] + HANDLERS, ("semantic", "syntactic", "heuristic")[k % 3]))
        last[group] = k
    return out


def all_uses(lines, functions):
    orders = defaultdict(list)
    for x in lines:
        orders[x.l_orderkey].append(x)
    out = set()
    for of in orders.values():
        of.sort(key=lambda x: (x.l_linenumber, x.l_partkey, x.l_suppkey))
        for a, b in zip(of, of[1:], strict=False):
            if a.l_partkey != b.l_partkey and a.l_partkey in functions and b.l_partkey in functions:
                out.add((a.l_partkey, b.l_partkey, {"A": "semantic", "N": "syntactic"}.get(b.l_returnflag, "heuristic")))
    return out


def test_uses_and_module_edges_hold_all_lines(spark, lines, functions, customers):
    want = all_uses(lines, functions) | handler_uses(customers)
    got = relation(spark, FOLDER, "uses").collect()
    assert sorted((r.src, r.dst, r.resolution) for r in got) == sorted((functions[a].id, functions[b].id, r) for a, b, r in want)
    edges = {(functions[a].module, functions[b].module) for a, b, r in want if r == "semantic"}
    got = relation(spark, FOLDER, "module_edges").collect()
    assert sorted((r.src, r.dst) for r in got) == sorted(e for e in edges if e[0] != e[1])


def test_flow_holds_all_lines(spark, lines, functions, customers):
    got = relation(spark, FOLDER, "flow").collect()
    want = [(functions[x.l_partkey].id, x.l_orderkey * 8 + x.l_linenumber) for x in lines if x.l_partkey in functions]
    want += [(functions[c.c_custkey + HANDLERS].id, c.c_custkey) for c in customers]
    assert sorted((r.symbol, r.at) for r in got) == sorted(want)


def items(spark, name):
    return sorted(r["items"] for r in catalog.queries()[name](spark, FOLDER).collect())


def test_conflicts_of_all_orders(spark, lines):
    of = defaultdict(set)
    for x in lines:
        of[x.l_orderkey].add(x.l_partkey % 9)
    sets = {frozenset(s) for s in of.values()}
    text = lambda found: sorted(",".join(map(str, sorted(s))) for s in found)
    least = lambda found: [s for s in found if not any(x < s for x in found)]
    assert items(spark, "minimal_conflicts") == text(least(sets))
    tried = [frozenset(s) for s in chain.from_iterable(combinations(range(9), k) for k in range(1, 10))]
    assert items(spark, "hitting_sets") == text(least([h for h in tried if all(h & s for s in sets)]))


def test_interfaces_of_all_orders(spark, lines):
    orders = {r.o_orderkey for r in read_table(spark, FOLDER, "orders").select("o_orderkey").collect()}
    need, have = defaultdict(set), defaultdict(set)
    for x in lines:
        have[x.l_suppkey].add(x.l_partkey)
        if x.l_orderkey in orders:
            need[x.l_orderkey].add(x.l_partkey)
    want = sorted((o, s) for o, n in need.items() for s, h in have.items() if n <= h)
    got = catalog.queries()["interface_satisfaction"](spark, FOLDER).collect()
    assert sorted((r.o_orderkey, r.l_suppkey) for r in got) == want and 0 < len(want) < len(need) * len(have) * 0.9


def test_holders_of_all_lines(spark, lines, functions):
    types = {r.fid: r.type_id for r in relation(spark, FOLDER, "files").collect()}
    holds = {(types[x.l_suppkey], functions[x.l_partkey].owner) for x in lines if x.l_suppkey in types and x.l_partkey in functions}
    holds = {(a, b) for a, b in holds if b is not None}
    reach, grown = set(holds), None
    while grown != len(reach):
        grown = len(reach)
        reach |= {(a, d) for a, b in reach for c, d in holds if b == c}
    want = sorted((b, sum(x == b and a != b for a, x in holds), (b, b) in reach) for b in {b for _, b in holds})
    got = catalog.queries()["holding_types"](spark, FOLDER).collect()
    assert sorted((r.held, r.holders, r.cyclic) for r in got) == want
