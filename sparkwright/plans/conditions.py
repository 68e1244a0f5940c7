"""Queries on conditions as data: every part is a rule of a pack, whose condition is on functions, their homes and what they call.

A rule's first branch takes functions of one kind and of some length in one of two homes; every second rule has a branch for
private functions of its first home that call a method of few parameters. Rules of a pack that want different things, and
whose branches list a common home, are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import conditions as C
from sparkwright.sources.scratch import materialize, read_table, sweep
from sparkwright.sources.tables import Numbered, relation, with_sql

#: Statements that a first branch spans.
SPAN = 15
RULES_SQL = """, r AS (SELECT p_partkey AS rule, p_type AS pack, (p_partkey + p_size) % 2 AS wants, 'f' || CAST(p_partkey % n AS VARCHAR) AS f1, 'f' || CAST((p_partkey * 3 + 1) % n AS VARCHAR) AS f2,
 p_size % 20 AS lo, CASE WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'function' END AS kind, p_size % 2 = 0 AS calls, p_size % 5 AS most FROM part, (SELECT count(*) AS n FROM supplier))
"""
PAIRS_SQL = RULES_SQL + f""", h AS (SELECT DISTINCT rule, pack, wants, unnest([f1, f2]) AS home FROM r),
pairs AS (SELECT a, b, (list_has_any(p.fa, p.fb) AND abs(x.lo - y.lo) <= {SPAN} AND x.kind = y.kind) OR (y.calls AND list_contains(p.fa, y.f1)) OR (x.calls AND list_contains(p.fb, x.f1)) OR (x.calls AND y.calls AND x.f1 = y.f1) AS overlap,
 list_has_all(p.fb, p.fa) AND x.lo = y.lo AND x.kind = y.kind AND (NOT x.calls OR (y.calls AND x.f1 = y.f1 AND x.most <= y.most)) AS a_in_b,
 list_has_all(p.fa, p.fb) AND x.lo = y.lo AND x.kind = y.kind AND (NOT y.calls OR (x.calls AND x.f1 = y.f1 AND y.most <= x.most)) AS b_in_a
 FROM (SELECT DISTINCT i.rule AS a, j.rule AS b FROM h i JOIN h j ON i.pack = j.pack AND i.home = j.home AND i.wants <> j.wants AND i.rule < j.rule)
 JOIN r x ON x.rule = a JOIN r y ON y.rule = b, LATERAL (SELECT [x.f1, x.f2] AS fa, [y.f1, y.f2] AS fb) p)
"""


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    n = read_table(spark, folder, "supplier").agg(F.count("*").alias("n"))
    p = read_table(spark, folder, "part").crossJoin(n)
    home = lambda e: F.concat(F.lit("f"), F.expr(e).cast("string"))
    return p.select(
        F.col("p_partkey").alias("rule"), F.col("p_type").alias("pack"), F.expr("(p_partkey + p_size) % 2").alias("wants"), F.array(home("p_partkey % n"), home("(p_partkey * 3 + 1) % n")).alias("homes"),
        F.expr("p_size % 20").cast("long").alias("lo"), F.expr("if(p_partkey % 3 = 0, 'method', 'function')").alias("kind"), F.expr("p_size % 2 = 0").alias("calls"), F.expr("p_size % 5").cast("long").alias("most"),
    )


def rule_atoms(spark: SparkSession, folder: str) -> DataFrame:
    """The conditions of all parts as rows of atoms."""
    number, text = F.lit(None).cast("array<long>"), F.lit(None).cast("array<string>")

    def atom(branch: int, field: str, op: str, numbers=number, texts=text, binder: int = 0) -> F.Column:
        values = {"branch": F.lit(branch), "binder": F.lit(binder), "relation": F.lit("calls" if binder else ""), "field": F.lit(field), "op": F.lit(op), "numbers": numbers, "texts": texts}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    first = [
        atom(0, "home", "in", texts=F.col("homes")),
        atom(0, "statements", ">=", F.array("lo")),
        atom(0, "statements", "<=", F.array(F.col("lo") + SPAN)),
        atom(0, "kind", "=", texts=F.array("kind")),
    ]
    second = [
        atom(1, "home", "=", texts=F.slice("homes", 1, 1)),
        atom(1, "visibility", "=", texts=F.array(F.lit("private"))),
        atom(1, "kind", "=", texts=F.array(F.lit("method")), binder=1),
        atom(1, "params", "<=", F.array("most"), binder=1),
    ]
    atoms = F.concat(F.array(*first), F.when(F.col("calls"), F.array(*second)).otherwise(F.array().cast("array<struct<branch:int,binder:int,relation:string,field:string,op:string,numbers:array<bigint>,texts:array<string>>>")))
    return _parts(spark, folder).select("rule", F.explode(atoms).alias("a")).select("rule", "a.*")


def _fields(**values: F.Column) -> F.Column:
    """A map of numbers (long columns) and texts by field."""
    entries = []
    for name, (number, value) in values.items():
        entries += [F.lit(name), F.struct((value if number else F.lit(None)).cast("long").alias("number"), (F.lit(None) if number else value).cast("string").alias("text"))]
    return F.create_map(*entries)


def function_values(spark: SparkSession, folder: str, asked: list[str]) -> tuple[DataFrame, C.Elements]:
    """Functions as facts of conditions, and what they call by codes of the fields that are ``asked``."""
    m = Numbered(spark, folder, "pid", "file", "kind", "visibility", "params", "statements")
    f = m.functions.join(relation(spark, folder, "files").select(F.col("path").alias("file"), "fid"), "file")
    own = _fields(statements=(True, F.col("statements")), params=(True, F.col("params")), kind=(False, F.col("kind")), visibility=(False, F.col("visibility")), home=(False, F.concat(F.lit("f"), F.col("fid").cast("string"))))
    f = materialize(f.select("id", "pid", own.alias("fields")))
    subjects = f.select(F.col("pid").alias("subject"), F.lit("").alias("relation"), F.col("pid").alias("element"), "fields")
    kinds, values = C.coded(f, asked)
    # codes of what a function calls are few; they meet its number where they are gathered
    called = m.relation("uses").join(kinds.select(F.col("id").alias("dst"), "code").hint("merge"), "dst").groupBy("src").agg(F.collect_set("code").alias("codes"))
    sets = called.join(f.select(F.col("id").alias("src"), F.col("pid").alias("subject")).hint("merge"), "src").select("subject", F.lit("calls").alias("relation"), "codes")
    return subjects, C.Elements(materialize(sets), values)


def condition_holds(spark: SparkSession, folder: str) -> DataFrame:
    """How many functions each rule's condition holds of, and the first and last of them."""
    atoms = materialize(rule_atoms(spark, folder))
    facts, elements = function_values(spark, folder, C.asked_fields(atoms, "calls"))
    # what was shuffled to make the tables goes before they are joined
    sweep(spark)
    found = C.holding(atoms, facts, elements)
    return found.groupBy("rule").agg(F.count("*").alias("functions"), F.min("subject").alias("first"), F.max("subject").alias("last"))


def condition_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of a pack that want different things and meet at a home: whether both can hold, or one wherever the other does."""
    atoms = materialize(rule_atoms(spark, folder))
    found = materialize(C.boxes(atoms))
    of = _parts(spark, folder).select("rule", "pack", "wants", F.explode(F.array_distinct("homes")).alias("home"))
    a, b = of.select(F.col("rule").alias("a"), "pack", "home", F.col("wants").alias("wa")), of.select(F.col("rule").alias("b"), "pack", "home", F.col("wants").alias("wb"))
    pairs = materialize(a.join(b, ["pack", "home"]).where("a < b and wa <> wb").select("a", "b").distinct())
    return C.compare(pairs, found)


QUERIES = {"condition_holds": condition_holds, "condition_conflicts": condition_conflicts}
ORACLE = {
    "condition_conflicts": "WITH z AS (SELECT 1)" + PAIRS_SQL + "SELECT * FROM pairs",
    "condition_holds": with_sql("functions", "uses", "files") + RULES_SQL + f""", c AS (SELECT DISTINCT u.src, d.kind, d.params FROM uses u JOIN functions d ON d.id = u.dst),
g AS (SELECT f.*, 'f' || CAST(x.fid AS VARCHAR) AS home FROM functions f JOIN files x ON x.path = f.file),
h AS (SELECT r.rule, g.pid FROM r JOIN g ON g.home IN (r.f1, r.f2) WHERE g.kind = r.kind AND g.statements BETWEEN r.lo AND r.lo + {SPAN}
 UNION SELECT r.rule, g.pid FROM r JOIN g ON g.home = r.f1 JOIN c ON c.src = g.id WHERE r.calls AND g.visibility = 'private' AND c.kind = 'method' AND c.params <= r.most)
SELECT rule, count(*) AS functions, min(pid) AS first, max(pid) AS last FROM h GROUP BY rule""",
}
