"""Tree selection against a walker of parsed documents."""

import json
import random

import pytest

from sparkwright.operators import trees
from sparkwright.operators.trees import parse


def walk(value):
    yield value
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from walk(child)


def follow(current, steps):
    for step in steps:
        out = []
        for v in current:
            if step.axis == "descend":
                out += walk(v)
            elif step.axis == "keys" and isinstance(v, dict):
                out += v.values()
            elif step.axis == "indices" and isinstance(v, list):
                out += v
            elif step.axis == "member":
                for m in step.of:
                    if isinstance(m, str) and isinstance(v, dict) and m in v:
                        out.append(v[m])
                    elif isinstance(m, int) and isinstance(v, list) and m < len(v):
                        out.append(v[m])
            elif step.axis == "filter" and any(all(compare(v, c) for c in clause) for clause in step.of):
                out.append(v)
        current = out
    return current


def compare(value, c):
    wanted = None if c.kind == "null" else c.value if c.kind == "string" else json.loads(c.value)
    met = [v for v in follow([value], c.path) if not isinstance(v, (dict, list))]
    return any(type(v) is type(wanted) and v == wanted for v in met) == c.equal


SELECTORS = [
    "$", "$.a", "$.*", "$[*]", "$..a", "$..*", "$..[0]", "$..[*]", "$.a.b", "$['a','b',0]", "$..['b',1,'a']", "$.a[1]", "$..a..b", "$.*?(@.a == 1)", "$..*[?(@.a == 'x' && @.b != 2 || @[0] == true)]",
    "$..[*]?(@..b == null)", "$..?(@.a != 1 && @.b != 'x')", "$..*?(@ == 2)", "$..*?(@ == 'it\\'s (so)')", "$..*?(@['k y'] == -1.5)", "$..?(@.a?(@.b == 1).b == 1)",
]


def test_every_axis_equals_a_walker(spark):
    rnd = random.Random(6)

    def value(depth):
        kind = rnd.random()
        if depth and kind < 0.35:
            return {k: value(depth - 1) for k in rnd.sample(["a", "b", "k y", "c\"[{"], rnd.randint(0, 3))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rnd.randint(0, 3))]
        return rnd.choice([1, 2, -1.5, True, False, None, "x", "it's (so)", 'q"\\{[,:', "", "é"])

    documents = [value(4) for _ in range(150)] + [{"a": {"b": 1}, "b": [1, {"a": 2}]}, {"z": {"a": 1}, "y": {"k y": -1.5, "t": "it's (so)"}}, {"y": {"a": "x", "b": 3}, "a": {"a": [{"b": 4}]}}, [[{"a": {"b": None}}]], {"a": [5, 6]}, [], {}, "x", 7]
    rows = [(i, json.dumps(d, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5)) for i, d in enumerate(documents)] + [(900, ""), (901, None)]
    table = trees.nodes(spark.createDataFrame(rows, "id long, body string"), "id", "body").cache()
    assert table.count() == sum(len([*walk(d)]) for d in documents)
    plain = lambda v: "[]" if isinstance(v, list) else "{}" if isinstance(v, dict) else v if isinstance(v, str) else json.dumps(v)
    show = {"object": "{}", "array": "[]", "null": "null"}
    for selector in SELECTORS:
        got = {}
        for r in trees.select(table, selector).orderBy("tree", "position").collect():
            got.setdefault(r.tree, []).append(show.get(r.kind, r.value))
        want = {i: [plain(v) for v in found] for i, d in enumerate(documents) if (found := follow([d], parse(selector)))}
        assert got == want, selector
        assert want, selector


def test_nodes_stay_where_their_text_is_and_selectors_join_nothing(spark):
    table = trees.nodes(spark.createDataFrame([(1, '{"a": [{"b": 1}, {"b": 2}]}')], "id long, body string"), "id", "body")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(table)
    assert "Join" not in plan(trees.select(table, "$.a[*]?(@.b == 1 && @..b != 2).b"))
    assert [r.value for r in trees.select(table, "$.a[*]?(@.b == 1 && @..b != 2).b").collect()] == ["1"]


@pytest.mark.parametrize("text", ["a", "$a", "$.", "$..", "$[", "$[x]", "$['a", "$?(@.a)", "$?(@.a == )", "$?(@.a == 1", "$[?(@.a == 1)", "$.a b", "$.a*"])
def test_what_is_no_selector(text):
    with pytest.raises(ValueError):
        parse(text)


def test_found_in_whole_texts_equals_a_walker(spark, monkeypatch):
    """Many texts at once, in small pieces, among texts that are no JSON."""
    rnd = random.Random(8)

    def value(depth):
        kind = rnd.random()
        if depth and kind < 0.4:
            return {k: value(depth - 1) for k in rnd.sample(["a", "b", "k y", "c\"[{"], rnd.randint(0, 3))}
        if depth and kind < 0.65:
            return [value(depth - 1) for _ in range(rnd.randint(0, 3))]
        return rnd.choice([1, 2, -1.5, True, False, None, "x", "it's (so)", 'q"\\{[,:', "", "é"])

    documents = [value(4) for _ in range(200)] + [{"a": {"a": {"b": 1, "a": 2}}, "b": [1, [2], {"a": 2}]}, [[{"a": {"b": None}}]], [], {}, "x", 7]
    rows = [(i, json.dumps(d, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5)) for i, d in enumerate(documents)]
    rows = [x for i, row in enumerate(rows) for x in (row, (1000 + i, rnd.choice(["", None, "{[", "]}}", ": 1", '{"a": [1}', "1 2"])))]
    monkeypatch.setattr(trees, "TEXT", 300)
    found = trees.found(spark.createDataFrame(rows, "id long, body string").repartition(2), "id", "body", {s: s for s in SELECTORS})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = {(r.selector, r.tree): (r.n, r.found) for r in found.collect() if r.tree < 1000}
    plain = lambda v: None if v is None or isinstance(v, (list, dict)) else v if isinstance(v, str) else json.dumps(v)
    want = {}
    for s in SELECTORS:
        for i, d in enumerate(documents):
            if met := follow([d], parse(s)):
                want[s, i] = len(met), ",".join(x for v in met if (x := plain(v)) is not None)
    assert got == want


def test_tree_select_writes_no_nodes(spark, tmp_path):
    """Orders are shuffled to become texts, and nothing after it."""
    from sparkwright.plans.trees import tree_select

    plan = tree_select(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")
    assert len(above) == 2 and "Exchange" not in above[0] and "lineitem" in above[1]
