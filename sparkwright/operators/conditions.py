"""Conditions as data: unions of conjunctive queries whose atoms are rows, evaluated, compared and classified by joins.

A condition is a union of branches. A branch says that its subject, and for each further binder some element of one of the
subject's child relations, meet all of their atoms: a field, an operator, a constant. Rows of atoms are
(rule, branch, binder, relation, field, op, numbers, texts); binder 0 is the subject, whose relation is ''. Numbers are whole;
either list holds an atom's constants, the other is null. Facts are rows (subject, relation, element, fields), with a map from
field to (number, text); a field that a fact lacks meets no atom, negated ones included.

Two branches are compared by their boxes, the atoms of one binder on one field: both can hold of one subject if every box
that both have on the subject is satisfiable together; one holds wherever another does if there is a map from its binders to
the other's, relation by relation, under which the other's boxes imply its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.sources.scratch import materialize

NEGATED = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", "<=": ">", ">": "<=", "in": "not in", "not in": "in", "starts": "not starts", "not starts": "starts", "ends": "not ends", "not ends": "ends", "contains": "not contains", "not contains": "contains"}
ATOMS = "rule long, branch int, binder int, relation string, field string, op string, numbers array<long>, texts array<string>"
BRANCH = ("rule", "branch")
BINDER = (*BRANCH, "binder", "relation")


@dataclass(frozen=True)
class Atom:
    field: str
    op: str
    value: object
    binder: int = 0
    relation: str = ""

    def negated(self) -> Atom:
        return Atom(self.field, NEGATED[self.op], self.value, self.binder, self.relation)

    def constants(self) -> list:
        return list(self.value) if isinstance(self.value, (tuple, list)) else [self.value]

    def sql(self, of: str = "") -> str:
        """SQL that both engines of the tests understand; a null field meets nothing."""
        field = of + self.field
        quoted = ["'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in self.constants()]
        first = quoted[0]
        shapes = {"in": f"{field} in ({', '.join(quoted)})", "starts": f"left({field}, length({first})) = {first}", "ends": f"right({field}, length({first})) = {first}", "contains": f"{field} like '%' || {first} || '%'"}
        if self.op.startswith("not "):
            return f"not ({shapes[self.op[4:]]})"
        return shapes.get(self.op, f"{field} {'<>' if self.op == '!=' else self.op} {first}")


#: A union of branches, each a tuple of atoms.
Condition = tuple[tuple[Atom, ...], ...]


def condition(*branches: tuple) -> Condition:
    """Branches of atoms given as (field, op, value) or Atom."""
    return tuple(tuple(a if isinstance(a, Atom) else Atom(*a) for a in b) for b in branches)


def sql(given: Condition) -> str:
    """The condition as SQL over a subject's columns; an element's atoms are tested in the array column of its relation."""
    branches = []
    for branch in given:
        parts = [a.sql() for a in branch if not a.binder]
        for binder, relation in sorted({(a.binder, a.relation) for a in branch if a.binder}):
            parts.append(f"exists({relation}, x -> {' and '.join(a.sql('x.') for a in branch if a.binder == binder)})")
        branches.append(" and ".join(parts))
    return branches[0] if len(branches) == 1 else " or ".join(f"({b})" for b in branches)


def rows(rule: int, given: Condition) -> list[tuple]:
    """A condition as rows of ATOMS."""
    out = []
    for i, branch in enumerate(given):
        for a in branch:
            text = isinstance(a.constants()[0], str)
            constants = [int(v) if isinstance(v, bool) else v for v in a.constants()]
            out.append((rule, i, a.binder, a.relation, a.field, a.op, None if text else constants, constants if text else None))
    return out


def _meets(number: Column, text: Column, x: Column) -> Column:
    """Whether a value, one of its two forms null, meets an atom; false where the atom is of the other form."""
    n, t = x["numbers"], x["texts"]
    listed = F.coalesce(F.array_contains(n, number), F.array_contains(t, text), F.lit(False))
    known = (n.isNotNull() & number.isNotNull()) | (t.isNotNull() & text.isNotNull())
    one, word = F.get(n, F.lit(0)), F.get(t, F.lit(0))
    op = x["op"]
    met = (
        F.when(op.isin("=", "in"), listed).when(op.isin("!=", "not in"), ~listed)
        .when(op == "<", number < one).when(op == "<=", number <= one).when(op == ">", number > one).when(op == ">=", number >= one)
        .when(op == "starts", F.startswith(text, word)).when(op == "not starts", ~F.startswith(text, word))
        .when(op == "ends", F.endswith(text, word)).when(op == "not ends", ~F.endswith(text, word))
        .when(op == "contains", F.contains(text, word)).when(op == "not contains", ~F.contains(text, word))
    )
    return known & F.coalesce(met, F.lit(False))


def binders(atoms: DataFrame) -> DataFrame:
    """One row a binder with all its atoms."""
    return atoms.groupBy(*BINDER).agg(F.collect_list(F.struct("field", "op", "numbers", "texts")).alias("atoms"))


def _all_met() -> Column:
    fields = F.col("fields")
    return F.coalesce(F.forall("atoms", lambda a: _meets(fields[a["field"]]["number"], fields[a["field"]]["text"], a)), F.lit(False))


def _seeded(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """(rule, branch, binder, relation, subject) of binders that facts meet.

    Facts come to a binder by one of its atoms of equality, so rules and facts that share no value never meet; a binder
    without such an atom meets all facts that have one of its fields.
    """
    equal = F.filter("atoms", lambda a: a["op"].isin("=", "in"))
    seeded = wanted.withColumn("seed", F.coalesce(F.get(equal, F.lit(0)), F.get("atoms", F.lit(0)))).withColumn("field", F.col("seed.field"))
    keys = F.coalesce(F.col("seed.texts"), F.transform("seed.numbers", lambda n: n.cast("string")))
    seeded = seeded.withColumn("key", F.explode(F.when(F.col("seed.op").isin("=", "in"), F.array_distinct(keys)).otherwise(F.array(F.lit(None).cast("string")))))
    seeded = materialize(seeded.drop("seed"))
    columns = [*BINDER, "subject", "atoms", "fields"]
    found = []
    for joined, by in ((seeded.where("key is not null"), ["relation", "field", "key"]), (seeded.where("key is null"), ["relation", "field"])):
        if joined.isEmpty():
            continue
        # names of fields are as few as a schema's; facts are listed under those that seeds ask for
        asked = F.broadcast(joined.select("relation", "field").distinct())
        entries = facts.select("subject", "relation", "fields", F.explode("fields").alias("field", "value")).join(asked, ["relation", "field"], "left_semi")
        entries = entries.withColumn("key", F.coalesce("value.text", F.col("value.number").cast("string"))).drop("value")
        side = joined if "key" in by else joined.drop("key")
        found.append(side.join(entries.hint("merge") if "key" in by else entries, by).select(columns))
    if not found:
        return facts.select(*(F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in BINDER), "subject").limit(0)
    return functools.reduce(DataFrame.union, found).where(_all_met()).select(*BINDER, "subject").distinct()


@dataclass(frozen=True)
class Elements:
    """Elements of child relations by codes: ``sets`` (subject, relation, codes), the codes of a subject's elements, and
    ``values`` (code, fields), what elements of a code have. Elements that share all fields that are asked for share a code."""

    sets: DataFrame
    values: DataFrame


def asked_fields(atoms: DataFrame, relation: str) -> list[str]:
    """The names of fields, as few as a schema's, that atoms compare in a relation."""
    return sorted(r.field for r in atoms.where(F.col("relation") == relation).select("field").distinct().collect())


def coded(facts: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """``facts`` with a code in place of their fields, one for all facts that have ``fields`` alike, and what codes have."""
    entries = F.array_sort(F.filter(F.map_entries("fields"), lambda e: e["key"].isin(fields)))
    facts = facts.withColumn("entries", entries).drop("fields")
    kinds = materialize(facts.select("entries").distinct().withColumn("code", F.monotonically_increasing_id()))
    return facts.join(kinds, "entries").drop("entries"), kinds.select("code", F.map_from_entries("entries").alias("fields"))


def _looked_up(own: DataFrame, inner: DataFrame, elements: Elements) -> DataFrame:
    """(rule, branch, binder, relation, subject) of inner binders that some element of the subject meets.

    Only codes of elements and of binders' atoms are brought together; what they stand for is joined where it is tested.
    """
    alike = inner.withColumn("atoms", F.array_sort("atoms"))
    kinds = materialize(alike.select("atoms").distinct().withColumn("asked", F.monotonically_increasing_id()))
    asked = own.select(*BRANCH, "subject").join(alike.join(kinds, "atoms").select(*BINDER, "asked"), list(BRANCH))
    met = asked.join(elements.sets.hint("merge"), ["subject", "relation"]).withColumn("code", F.explode("codes")).drop("codes")
    return met.join(kinds, "asked").join(elements.values, "code").where(_all_met()).select(*BINDER, "subject").distinct()


def holding(atoms: DataFrame, facts: DataFrame, coded_elements: Elements | None = None) -> DataFrame:
    """(rule, subject) for every condition that holds of a subject; elements are among the facts or ``coded_elements``.

    What a branch says of its subject is tested first; elements are looked up for the subjects that are left only, by a semi
    join for each binder. Files of maps and of exploded rows are far smaller than their rows, so Spark would take them for
    small enough to go through the driver: these joins are merged. Duplicate atoms, and subjects without elements, are fine.
    """
    every = materialize(binders(atoms))
    own = materialize(_seeded(every.where("binder = 0"), facts.where("relation = ''")))
    on_subject = every.where("binder = 0").select(*BRANCH).distinct()
    inner = every.where("binder > 0")
    if coded_elements is None:
        elements = facts.where("relation <> ''")
        asked = own.select(*BRANCH, "subject").join(inner.hint("merge"), list(BRANCH))
        looked_up = asked.join(elements.hint("merge"), ["subject", "relation"]).where(_all_met()).select(*BINDER, "subject").distinct()
    else:
        elements = coded_elements.sets.withColumn("code", F.explode("codes")).drop("codes").join(coded_elements.values, "code")
        looked_up = _looked_up(own, inner, coded_elements)
    free = _seeded(inner.join(on_subject, list(BRANCH), "left_anti"), elements)
    wanted = every.groupBy(*BRANCH).agg(F.count("*").alias("wanted"))
    whole = own.union(looked_up).union(free).groupBy(*BRANCH, "subject").agg(F.count("*").alias("n")).join(wanted.hint("merge"), list(BRANCH)).where("n = wanted")
    return whole.select("rule", "subject").distinct()


def _texts(atoms: Column, op: str) -> Column:
    return F.transform(F.filter(atoms, lambda a: a["op"] == op), lambda a: F.get(a["texts"], F.lit(0)))


def _excluded(atoms: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(atoms, lambda a: a["op"].isin("!=", "not in") & a["numbers"].isNotNull()), lambda a: a["numbers"])))


def _ends_of(atoms: Column) -> tuple[Column, Column]:
    """The least and the greatest number within bounds that isn't excluded, null where there is no bound."""
    of = lambda *ops: F.filter(atoms, lambda a: a["op"].isin(*ops))
    low = F.array_max(F.transform(of(">", ">="), lambda a: F.get(a["numbers"], F.lit(0)) + (a["op"] == ">").cast("long")))
    high = F.array_min(F.transform(of("<", "<="), lambda a: F.get(a["numbers"], F.lit(0)) - (a["op"] == "<").cast("long")))
    out = _excluded(atoms)
    left = lambda a, b: F.filter(F.sequence(a, b), lambda v: ~F.array_contains(out, v))
    return F.array_min(left(low, low + F.size(out))), F.array_max(left(high - F.size(out), high))


def _listed(atoms: Column) -> tuple[Column, Column, Column]:
    """Whether some atom lists the values, and the numbers and texts of that list which meet all atoms."""
    lists = F.filter(atoms, lambda a: a["op"].isin("=", "in"))
    first = F.get(lists, F.lit(0))
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("long")
    numbers = F.filter(F.coalesce(first["numbers"], F.array().cast("array<long>")), lambda v: F.forall(atoms, lambda a: _meets(v, no_text, a)))
    texts = F.filter(F.coalesce(first["texts"], F.array().cast("array<string>")), lambda v: F.forall(atoms, lambda a: _meets(no_number, v, a)))
    return F.size(lists) > 0, numbers, texts


def _lists(box: Column) -> Column:
    """Whether a box is one list of values, as most are; such boxes are compared as sets."""
    return (F.size(box) == 1) & F.get(box, F.lit(0))["op"].isin("=", "in")


def _overlapping(a: Column, b: Column) -> Column:
    """Whether some value meets all atoms of two boxes on one field."""
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    common = F.coalesce(F.arrays_overlap(x["texts"], y["texts"]), F.arrays_overlap(x["numbers"], y["numbers"]), F.lit(False))
    return F.when(_lists(a) & _lists(b), common).otherwise(satisfiable(F.concat(a, b)))


def _inside(a: Column, b: Column) -> Column:
    """Whether every value that meets the satisfiable box ``a`` meets ``b``."""
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    within = lambda of: F.size(F.array_except(F.array_compact(x[of]), y[of])) == 0
    both = lambda of: x[of].isNotNull() & y[of].isNotNull()
    listed = F.when(both("texts"), within("texts")).when(both("numbers"), within("numbers")).otherwise(False)
    return F.when(_lists(a) & _lists(b), listed).otherwise(F.forall(b, lambda atom: implied(a, atom)))


def satisfiable(atoms: Column) -> Column:
    """Whether some value meets all atoms on one field. Texts may be of any length over any letters."""
    first = F.get(atoms, F.lit(0))
    some = F.coalesce(F.size(F.array_compact(first["numbers"])) > 0, F.lit(False)) | F.coalesce(F.size(F.array_compact(first["texts"])) > 0, F.lit(False))
    return F.when(_lists(atoms), some).otherwise(_satisfiable(atoms))


def _satisfiable(atoms: Column) -> Column:
    has_list, numbers, texts = _listed(atoms)
    low, high = _ends_of(atoms)
    is_number = F.exists(atoms, lambda a: a["numbers"].isNotNull())
    is_text = F.exists(atoms, lambda a: a["texts"].isNotNull())
    number = low.isNull() | high.isNull() | (low <= high)
    starts, ends, holds = (_texts(atoms, op) for op in ("starts", "ends", "contains"))
    agree = lambda xs, begins: F.forall(xs, lambda a: F.forall(xs, lambda b: begins(a, b) | begins(b, a)))
    text = (
        agree(starts, F.startswith) & agree(ends, F.endswith)
        & F.forall(_texts(atoms, "not starts"), lambda n: (n != "") & ~F.exists(starts, lambda s: F.startswith(s, n)))
        & F.forall(_texts(atoms, "not ends"), lambda n: (n != "") & ~F.exists(ends, lambda s: F.endswith(s, n)))
        & F.forall(_texts(atoms, "not contains"), lambda n: (n != "") & ~F.exists(F.concat(starts, ends, holds), lambda s: F.contains(s, n)))
    )
    free = F.when(is_number & is_text, False).when(is_number, number).otherwise(text)
    return F.when(has_list, (F.size(numbers) > 0) | (F.size(texts) > 0)).otherwise(free)


def implied(atoms: Column, b: Column) -> Column:
    """Whether every value that meets all of some satisfiable atoms on a field meets atom ``b`` on it."""
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("long")
    has_list, numbers, texts = _listed(atoms)
    listed = F.forall(numbers, lambda v: _meets(v, no_text, b)) & F.forall(texts, lambda v: _meets(no_number, v, b))
    low, high = _ends_of(atoms)
    out = _excluded(atoms)
    op, one, word = b["op"], F.get(b["numbers"], F.lit(0)), F.get(b["texts"], F.lit(0))
    small = high - low + 1 <= F.size(b["numbers"]) + F.size(out)
    within = F.when(small & (low <= high), F.forall(F.sequence(low, high), lambda v: F.array_contains(out, v) | F.array_contains(b["numbers"], v))).otherwise(False)
    never = F.forall(b["numbers"], lambda v: F.coalesce(v < low, F.lit(False)) | F.coalesce(v > high, F.lit(False)) | F.array_contains(out, v))
    number = (
        F.when(op == "<", high < one).when(op == "<=", high <= one).when(op == ">", low > one).when(op == ">=", low >= one)
        .when(op.isin("!=", "not in"), never).when(op.isin("=", "in"), within)
    )
    starts, ends, holds = (_texts(atoms, o) for o in ("starts", "ends", "contains"))
    without = F.exists(_texts(atoms, "not contains"), lambda n: F.contains(word, n))
    apart = lambda xs, begins, nots: without | F.exists(xs, lambda s: ~begins(s, word) & ~begins(word, s)) | F.exists(nots, lambda n: begins(word, n))
    text = (
        F.when(op == "starts", (word == "") | F.exists(starts, lambda s: F.startswith(s, word)))
        .when(op == "ends", (word == "") | F.exists(ends, lambda s: F.endswith(s, word)))
        .when(op == "contains", (word == "") | F.exists(F.concat(starts, ends, holds), lambda s: F.contains(s, word)))
        .when(op == "not starts", apart(starts, F.startswith, _texts(atoms, "not starts")))
        .when(op == "not ends", apart(ends, F.endswith, _texts(atoms, "not ends")))
        .when(op == "not contains", without)
        .when(op.isin("!=", "not in"), F.forall(b["texts"], lambda v: ~F.forall(atoms, lambda a: _meets(no_number, v, a))))
        .otherwise(False)
    )
    free = F.when(b["numbers"].isNotNull(), F.exists(atoms, lambda a: a["numbers"].isNotNull()) & number).otherwise(F.exists(atoms, lambda a: a["texts"].isNotNull()) & text)
    return F.coalesce(F.when(has_list, listed).otherwise(free), F.lit(False))


def boxes(atoms: DataFrame) -> DataFrame:
    """The atoms of each binder by field, of branches that something can meet."""
    found = atoms.repartition(*BRANCH).groupBy(*BINDER, "field").agg(F.sort_array(F.collect_list(F.struct("op", "numbers", "texts"))).alias("box"))
    possible = F.min(F.coalesce(satisfiable(F.col("box")), F.lit(True))).over(Window.partitionBy(*BRANCH))
    return found.withColumn("possible", possible).where("possible").drop("possible")


def _judged(met: DataFrame, kinds: DataFrame, holds: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of ``met`` whose boxes code_a and code_b are such that ``holds``, which is asked once for each two boxes."""
    met = materialize(met)
    side = lambda x: kinds.select(F.col("code").alias(f"code_{x}"), F.col("box").alias(f"box_{x}"))
    asked = met.select("code_a", "code_b").distinct().join(side("a"), "code_a").join(side("b"), "code_b")
    return met.join(asked.where(holds(F.col("box_a"), F.col("box_b"))).select("code_a", "code_b"), ["code_a", "code_b"])


def compare(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of rules with: ``overlap``, both can hold of one subject; ``a_in_b``, b holds wherever a does; ``b_in_a``.

    ``found`` are boxes; equal ones have one code, pairs carry codes only, and each two boxes are compared once. A rule that nothing can meet overlaps none and is in any. Containment asks for one branch that holds
    wherever a branch does; a branch that only several of another's together cover isn't seen.
    """
    found = found.withColumn("box", F.sort_array("box"))
    kinds = materialize(found.select("box").distinct().withColumn("code", F.monotonically_increasing_id()))
    found = materialize(found.join(kinds, "box").drop("box"))
    subject = found.where("binder = 0").select(*BRANCH, "field", "code")
    branches = found.select(*BRANCH).distinct()
    side = lambda df, of: df.select(*(F.col(c).alias(of if c == "rule" else f"{c}_{of}") for c in df.columns))
    both = pairs.select("a", "b").distinct().join(side(branches, "a"), "a").join(side(branches, "b"), "b")
    met = pairs.select("a", "b").distinct().join(side(subject, "a"), "a").join(side(subject, "b").withColumnRenamed("field_b", "field_a"), ["b", "field_a"])
    met = met.select("a", "b", "branch_a", "branch_b", "code_a", "code_b")
    apart = _judged(met, kinds, lambda a, b: ~_overlapping(a, b)).select("a", "b", "branch_a", "branch_b").distinct()
    overlap = both.join(apart, ["a", "b", "branch_a", "branch_b"], "left_anti").select("a", "b").distinct().withColumn("overlap", F.lit(True))
    one_way = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    inner, outer = side(found, "a"), side(found, "b").withColumnRenamed("field_b", "field_a").withColumnRenamed("relation_b", "relation_a")
    same = one_way.join(inner, "a").join(outer, ["b", "relation_a", "field_a"])
    same = _judged(same.select("a", "b", "branch_a", "branch_b", "binder_a", "binder_b", "code_a", "code_b"), kinds, _inside)
    fields = found.groupBy(*BINDER).agg(F.count("*").alias("fields"))
    fields = fields.select(F.col("rule").alias("b"), F.col("branch").alias("branch_b"), F.col("binder").alias("binder_b"), "fields")
    mapped = same.groupBy("a", "b", "branch_a", "branch_b", "binder_a", "binder_b").agg(F.count("*").alias("n")).join(fields, ["b", "branch_b", "binder_b"]).where("n = fields")
    sizes = fields.groupBy("b", "branch_b").agg(F.count("*").alias("of"))
    covered = mapped.select("a", "b", "branch_a", "branch_b", "binder_b").distinct().groupBy("a", "b", "branch_a", "branch_b").agg(F.count("*").alias("n")).join(sizes, ["b", "branch_b"]).where("n = of")
    number = branches.groupBy(F.col("rule").alias("a")).agg(F.count("*").alias("of"))
    n = covered.select("a", "b", "branch_a").distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
    inside = one_way.join(number, "a", "left").join(n, ["a", "b"], "left").where(F.coalesce("n", F.lit(0)) == F.coalesce("of", F.lit(0))).select("a", "b", F.lit(True).alias("inside"))
    out = pairs.select("a", "b").distinct().join(overlap, ["a", "b"], "left")
    out = out.join(inside.withColumnRenamed("inside", "a_in_b"), ["a", "b"], "left")
    out = out.join(inside.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("inside").alias("b_in_a")), ["a", "b"], "left")
    return out.fillna(False, ["overlap", "a_in_b", "b_in_a"])


def sharing(found: DataFrame, field: str) -> DataFrame:
    """Pairs a < b of rules with branches that list a common value of a field, which is how two conditions come to be compared."""
    listed = F.filter("box", lambda x: x["op"].isin("=", "in"))
    values = found.where((F.col("binder") == 0) & (F.col("field") == field) & (F.size(listed) > 0)).select("rule", F.explode(F.get(listed, F.lit(0))["texts"]).alias("value")).distinct()
    a, b = values.select(F.col("rule").alias("a"), "value"), values.select(F.col("rule").alias("b"), "value")
    return a.join(b, "value").where("a < b").select("a", "b").distinct()
