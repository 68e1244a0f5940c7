"""Decisions as data: a subject to scan, values to compute, a condition that is a violation, and what to say of it.

A decision's expressions are SQL over the fields of its subject's fact table, so a whole decision is one DataFrame plan:
columns that no expression reads are pruned, and the scope is a filter that reaches the scan. ``where`` that is null for a
subject decides nothing; such subjects are counted as incomplete, never as clean.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.text import fingerprint
from sparkwright.operators.conditions import Condition, sql


@dataclass(frozen=True)
class Decision:
    name: str
    severity: str
    select: str
    #: SQL, or a condition as data, which is read as SQL too.
    where: str | Condition
    message: str
    variables: tuple[tuple[str, str], ...] = ()
    identity: str = "id"
    path: str = "file"
    line: str = "line"
    languages: tuple[str, ...] = ()
    tests: bool = True
    generated: bool = False
    #: What the decision's fix does, if it orders code: move or reorder.
    fix: str = ""

    @property
    def condition(self) -> str:
        return self.where if isinstance(self.where, str) else sql(self.where)

    def tier(self) -> tuple[str, str]:
        """How far a decision can be reasoned about without running it, and why: F, a formal condition; O, its fix orders code; T, the rest."""
        if self.fix:
            return "O", f"fix:{self.fix}"
        if isinstance(self.where, str):
            return "T", "outside-fragment"
        return ("T", "two-stage") if self.select == "annotation" else ("F", "formal")

    def scope(self) -> str:
        """Condition of applicability: language, tests, generated files."""
        parts = []
        if self.languages:
            parts.append("lang in (" + ", ".join(f"'{x}'" for x in self.languages) + ")")
        if not self.tests:
            parts.append("not test")
        if not self.generated and self.select in ("function", "test", "file", "symbol"):
            parts.append("not generated")
        return " and ".join(parts) or "true"


def subjects(decision: Decision, facts: DataFrame) -> DataFrame:
    """Subjects in scope with the decision's variables, each of which may read those before it."""
    rows = facts.where(decision.scope())
    for name, expression in decision.variables:
        rows = rows.withColumn(name, F.expr(expression))
    return rows


def evaluate(decision: Decision, facts: DataFrame) -> DataFrame:
    """Findings (decision, severity, path, line, message, fingerprint) of one decision."""
    rows = subjects(decision, facts).where(decision.condition)
    path = F.expr(decision.path)
    return rows.select(
        F.lit(decision.name).alias("decision"),
        F.lit(decision.severity).alias("severity"),
        path.alias("path"),
        F.greatest(F.lit(1), F.expr(decision.line)).cast("long").alias("line"),
        F.expr(decision.message).alias("message"),
        fingerprint(F.lit(decision.name), path, F.expr(decision.identity)).alias("fingerprint"),
    )


def incomplete(decision: Decision, facts: DataFrame) -> DataFrame:
    """One row: how many subjects in scope the condition could not judge."""
    rows = subjects(decision, facts)
    return rows.agg(F.lit(decision.name).alias("decision"), F.count_if(F.expr(decision.condition).isNull()).alias("incomplete"))


def check(decisions: list[Decision], facts: dict[str, DataFrame]) -> DataFrame:
    """Findings of all decisions."""
    return functools.reduce(DataFrame.unionByName, [evaluate(d, facts[d.select]) for d in decisions])


def violations(decisions: list[Decision], facts: DataFrame) -> DataFrame:
    """(decision, severity, path) of the findings of decisions on one fact table, in one pass over it.

    Decisions on tests take the facts of functions, of which tests are those that are marked so.
    """
    rows = facts
    for i, d in enumerate(decisions):
        for name, expression in d.variables:
            if name in facts.columns:
                raise ValueError(f"{d.name}: {name} is a fact and a variable")
            rows = rows.withColumn(name, F.expr(expression))
        scope = d.scope() + (" and test" if d.select == "test" else "")
        finding = F.struct(F.lit(d.name).alias("decision"), F.lit(d.severity).alias("severity"), F.expr(d.path).alias("path"))
        rows = rows.withColumn(f"_{i}", F.when(F.expr(f"({scope}) and ({d.condition})"), finding)).drop(*(n for n, _ in d.variables))
    found = F.filter(F.array(*(F.col(f"_{i}") for i in range(len(decisions)))), lambda x: x.isNotNull())
    return rows.select(F.explode(found).alias("x")).select("x.*")


def options(layers: list[dict[str, str]], path: str, overrides: list[tuple[str, dict[str, str]]]) -> dict[str, str]:
    """Options of a decision for a path: later layers win key by key, then overrides whose glob takes the path, in order."""
    import re

    from sparkwright.functions.text import glob_pattern

    out: dict[str, str] = {}
    for layer in layers:
        out |= layer
    for glob, values in overrides:
        if re.match(glob_pattern(glob), path.replace("::", "/")):
            out |= values
    return out
