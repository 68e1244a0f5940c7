"""Conditions as data against plain evaluation of every value of a small domain."""

import itertools
import random

from pyspark.sql import functions as F

from sparkwright.operators import conditions
from sparkwright.operators.conditions import ATOMS, Atom, condition

VALUES = {"x": range(0, 5), "y": range(0, 4), "s": ["".join(w) for n in range(5) for w in itertools.product("abcz", repeat=n)]}
FACTS = "subject long, relation string, element long, fields map<string, struct<number: long, text: string>>"
OPS = {"=": lambda v, c: v in c, "in": lambda v, c: v in c, "<": lambda v, c: v < c[0], "<=": lambda v, c: v <= c[0], ">": lambda v, c: v > c[0], ">=": lambda v, c: v >= c[0], "starts": lambda v, c: v.startswith(c[0]), "ends": lambda v, c: v.endswith(c[0]), "contains": lambda v, c: c[0] in v}


def meets(value, atom):
    op = conditions.NEGATED[atom.op] if atom.op not in OPS else atom.op
    return value is not None and OPS[op](value, atom.constants()) == (atom.op in OPS)


def random_atom(rnd, texts=True, **of):
    field = rnd.choice(["x", "y", "s"] if texts else ["x", "y"])
    if field == "s":
        op = rnd.choice(["=", "!=", "in", "not in", "starts", "not starts", "ends", "not ends", "contains", "not contains"])
        words = ["a", "ab", "b", "c", "za"] if op in ("=", "!=", "in", "not in") else ["a", "b", "c"]
        value = tuple(rnd.sample(words, 2)) if op in ("in", "not in") else rnd.choice(words)
    else:
        op = rnd.choice(["=", "!=", "<", "<=", ">", ">=", "in", "not in"])
        value = tuple(rnd.sample(range(5), 2)) if op.endswith("in") else rnd.randrange(5)
    return Atom(field, op, value, **of)


def bounded(branch):
    """Numbers within the domain, so that what holds there holds everywhere."""
    limits = [(f, op, v, k, r) for k, r in {(a.binder, a.relation) for a in branch} for f, op, v in (("x", ">=", 0), ("x", "<", 5), ("y", ">=", 0), ("y", "<", 4))]
    return (*branch, *(Atom(*x) for x in limits))


def holds(given, subject, elements):
    for branch in given:
        ok = all(meets(subject.get(a.field), a) for a in branch if not a.binder)
        for binder, relation in {(a.binder, a.relation) for a in branch if a.binder}:
            ok = ok and any(all(meets(e.get(a.field), a) for a in branch if a.binder == binder) for e in elements.get(relation, ()))
        if ok:
            return True
    return False


def test_evaluation_equals_plain_loops(spark):
    rnd = random.Random(2)
    rules = {}
    for i in range(60):
        branches = []
        for _ in range(rnd.randint(1, 3)):
            atoms = [random_atom(rnd) for _ in range(rnd.randint(1, 2))]
            for binder in range(1, rnd.randint(1, 3)):
                relation = rnd.choice(["calls", "tests"])
                atoms += [random_atom(rnd, binder=binder, relation=relation) for _ in range(rnd.randint(1, 2))]
            branches.append(tuple(atoms))
        rules[i] = tuple(branches)
    fields = lambda: {f: rnd.choice(list(VALUES[f])[:30]) for f in "xys" if rnd.random() < 0.9}
    subjects = {i: (fields(), {r: [fields() for _ in range(rnd.randint(0, 3))] for r in ("calls", "tests")}) for i in range(80)}
    pack = lambda d: {f: (None, v) if isinstance(v, str) else (v, None) for f, v in d.items()}
    facts = []
    for i, (own, elements) in subjects.items():
        facts.append((i, "", i, pack(own)))
        facts += [(i, r, k, pack(e)) for r, es in elements.items() for k, e in enumerate(es)]
    atoms = spark.createDataFrame([row for i, c in rules.items() for row in conditions.rows(i, c)], ATOMS)
    got = {tuple(r) for r in conditions.holding(atoms, spark.createDataFrame(facts, FACTS)).collect()}
    assert got == {(i, s) for i, c in rules.items() for s, (own, elements) in subjects.items() if holds(c, own, elements)} and len(got) > 200


def test_comparison_equals_enumeration(spark):
    """Overlap and containment of one-branch conditions on a subject, over all its values; unions are covered branch by branch."""
    rnd = random.Random(9)
    rules = {i: tuple(bounded(tuple(random_atom(rnd) for _ in range(rnd.randint(1, 3)))) for _ in range(rnd.choice([1, 1, 2]))) for i in range(45)}
    rules[45], rules[46] = condition(bounded((Atom("x", "=", 1), Atom("x", "=", 2)))), condition(bounded((Atom("s", "starts", "a"), Atom("s", "not starts", ""))))
    domain = [dict(zip("xys", v, strict=True)) for v in itertools.product(*VALUES.values())]
    where = {i: [{k for k, v in enumerate(domain) if holds((b,), v, {})} for b in c] for i, c in rules.items()}
    atoms = spark.createDataFrame([row for i, c in rules.items() for row in conditions.rows(i, c)], ATOMS)
    pairs = spark.createDataFrame([(a, b) for a in rules for b in rules if a < b], "a long, b long")
    got = conditions.compare(pairs, conditions.boxes(atoms)).collect()
    assert len(got) == len(rules) * (len(rules) - 1) // 2
    inside = lambda a, b: all(any(x <= y for y in where[b]) for x in where[a] if x)
    seen = [0, 0, 0]
    for r in got:
        want = (bool(set().union(*where[r.a]) & set().union(*where[r.b])), inside(r.a, r.b), inside(r.b, r.a))
        assert (r.overlap, r.a_in_b, r.b_in_a) == want, (rules[r.a], rules[r.b], want)
        seen = [n + v for n, v in zip(seen, want, strict=True)]
    assert min(seen) > 30


def test_containment_maps_binders(spark):
    calls = lambda k, *atoms: [Atom(*a, binder=k, relation="calls") for a in atoms]
    rules = {
        0: condition((("x", "=", 1), *calls(1, ("y", ">", 3), ("s", "=", "a")))),
        1: condition((("x", "<", 3), *calls(1, ("y", ">", 2)), *calls(2, ("s", "starts", "a")))),
        2: condition((("x", "<", 3), *calls(1, ("y", ">", 4)))),
        3: condition((("x", "<", 3), Atom("y", ">", 3, 1, "tests"))),
    }
    atoms = spark.createDataFrame([row for i, c in rules.items() for row in conditions.rows(i, c)], ATOMS)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)], "a long, b long")
    got = {(r.a, r.b): (r.overlap, r.a_in_b, r.b_in_a) for r in conditions.compare(pairs, conditions.boxes(atoms)).collect()}
    assert got == {(0, 1): (True, True, False), (0, 2): (True, False, False), (0, 3): (True, False, False), (1, 2): (True, False, False), (2, 3): (True, False, False)}


def test_negation_and_sql(spark):
    rnd = random.Random(5)
    for _ in range(60):
        atom = random_atom(rnd)
        assert all(meets(v, atom) != meets(v, atom.negated()) for v in VALUES[atom.field])
    given = condition((("x", ">", 2), ("s", "not starts", "a")), (("y", "in", (1, 2)), Atom("x", "=", 1, 1, "calls"), Atom("s", "contains", "b'", 1, "calls")))
    table = spark.sql("SELECT 1 AS x, 2 AS y, 'zz' AS s, array(named_struct('x', 1, 's', 'ab''c')) AS calls UNION ALL SELECT 3, 0, 'ab', array() UNION ALL SELECT 3, 0, 'zz', array()")
    assert [r.x * 10 + r.y for r in table.where(conditions.sql(given)).orderBy("x").collect()] == [12, 30]


def test_facts_are_not_broadcast(spark):
    """Facts that Spark takes for small files would go through the driver."""
    atoms = spark.createDataFrame(conditions.rows(1, ((Atom("kind", "=", "a"), Atom("size", ">", 2, 1, "calls")),)), ATOMS)
    value = "map<string,struct<number:bigint,text:string>>"
    facts = spark.createDataFrame([(1, "", 1, {"kind": (None, "a")}), (1, "calls", 2, {"size": (3, None)}), (2, "", 2, {"kind": (None, "a")})], f"subject long, relation string, element long, fields {value}")
    found = conditions.holding(atoms, facts)
    assert [tuple(r) for r in found.collect()] == [(1, 1)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_equal_boxes_are_compared_once(spark, monkeypatch):
    """Many rules of few boxes: each two boxes are judged once, however many pairs of rules have them."""
    atoms = [row for rule in range(40) for row in conditions.rows(rule, condition((("home", "in", ("a", "b")), ("size", ">=", rule % 2)), (("home", "=", "c"), ("size", "<", 0))))]
    found = conditions.boxes(spark.createDataFrame(atoms, ATOMS))
    pairs = spark.range(40).selectExpr("id a").crossJoin(spark.range(40).selectExpr("id b")).where("a < b")
    asked, judged = [], conditions._judged

    def counted(met, kinds, holds):
        asked.append((met.count(), met.select("code_a", "code_b").distinct().count()))
        return judged(met, kinds, holds)

    monkeypatch.setattr(conditions, "_judged", counted)
    got = conditions.compare(pairs, found).collect()
    assert len(got) == 780 and all(r.overlap for r in got)
    assert all(r.a_in_b == (r.a % 2 >= r.b % 2) and r.b_in_a == (r.b % 2 >= r.a % 2) for r in got)
    assert all(of <= 36 < many for many, of in asked) and len(asked) == 2


def test_elements_by_codes_hold_the_same(spark):
    """Called functions come as sets of codes, of which there are few; what holds is what holds of the elements themselves."""
    atoms = spark.createDataFrame([
        (1, 0, 0, "", "kind", "=", None, ["a"]), (1, 0, 1, "calls", "size", "<=", [2], None), (1, 0, 2, "calls", "size", ">", [2], None),
        (2, 0, 1, "calls", "size", "=", [5], None), (3, 0, 0, "", "kind", "=", None, ["a"]), (3, 0, 1, "reads", "size", ">", [0], None),
    ], conditions.ATOMS)
    fields = lambda kind, size, more: {"kind": (None, kind), "size": (size, None), "more": (more, None)}
    calls = [(1, 1), (1, 3), (1, 3), (2, 1), (2, 2), (3, 5), (4, 1), (4, 5)]
    rows = [(i, "", i, fields("ab"[i == 4], 0, 0)) for i in range(1, 6)] + [(s, "calls", 10 + k, fields("c", n, k)) for k, (s, n) in enumerate(calls)]
    facts = spark.createDataFrame(rows, FACTS)
    assert conditions.asked_fields(atoms, "calls") == ["size"]
    elements, values = conditions.coded(facts.where("relation = 'calls'"), ["size"])
    assert values.count() == 4
    sets = elements.groupBy("subject", "relation").agg(F.collect_set("code").alias("codes"))
    got = sorted(tuple(r) for r in conditions.holding(atoms, facts.where("relation = ''"), conditions.Elements(sets, values)).collect())
    assert got == sorted(tuple(r) for r in conditions.holding(atoms, facts).collect()) == [(1, 1), (2, 3), (2, 4)]


def test_condition_holds_keeps_ids_and_fields_out_of_uses(spark):
    """Uses meet functions by number, and carry a code in place of what the called one has."""
    from sparkwright.plans.conditions import function_values

    subjects, elements = function_values(spark, "/root/testdata/sf0.001", ["kind", "params"])
    assert dict(elements.sets.dtypes) == {"subject": "bigint", "relation": "string", "codes": "array<bigint>"}
    assert 1 < elements.values.count() <= 2 * 9 < subjects.count()
