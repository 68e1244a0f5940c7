"""Findings: identity, suppression, lifecycle across runs, and standing of judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewest characters of a fingerprint that name a finding.
MIN_PREFIX = 7


def discriminate(fingerprint: Column, discriminator: Column) -> Column:
    return F.sha2(F.concat(fingerprint, F.lit("\x01"), discriminator), 256)


def occurrence(fingerprint: Column, n: Column) -> Column:
    """The nth repeat of a finding that is the same otherwise; the first keeps its fingerprint."""
    return F.when(n == 0, fingerprint).otherwise(F.sha2(F.concat(fingerprint, F.lit("\x02"), n.cast("string")), 256))


def disambiguate(findings: DataFrame, order: list[str]) -> DataFrame:
    """Unique fingerprints: those that collide within a rule and file take in the discriminator, then an ordinal.

    ``order`` is a total order of findings. ``by_ordinal`` marks fingerprints that rest on their place among equals.
    """
    group = Window.partitionBy("rule", "file", "fingerprint")
    same = Window.partitionBy("rule", "file", "fingerprint", "discriminator")
    d = findings.withColumn("_n", F.count("*").over(group)).withColumn("_same", F.count("*").over(same)).withColumn("_i", F.row_number().over(same.orderBy(*order)) - 1)
    base = F.when((F.col("_n") > 1) & (F.col("discriminator") != ""), discriminate(F.col("fingerprint"), F.col("discriminator"))).otherwise(F.col("fingerprint"))
    return d.select(*[c for c in findings.columns if c != "fingerprint"], F.when(F.col("_n") > 1, occurrence(base, F.col("_i"))).otherwise(base).alias("fingerprint"), ((F.col("_n") > 1) & (F.col("_same") > 1)).alias("by_ordinal"))


def _shared(a: Column, b: Column) -> Column:
    """How many characters two texts have in common from the start; 64 at most, the length of a digest."""
    return F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda n: F.when((F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, n) == F.left(b, n)), n).otherwise(0))), F.lit(0))


def prefix_widths(fingerprints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """With ``width``: characters that tell a fingerprint from all others, MIN_PREFIX at least.

    Neighbours in sorted order share the longest prefixes. Texts that share the first MIN_PREFIX characters are compared
    only; a group of these is small for digests, however many there are.
    """
    w = Window.partitionBy(F.left(column, F.lit(MIN_PREFIX))).orderBy(column)
    c = F.col(column)
    near = F.greatest(F.coalesce(_shared(c, F.lag(column).over(w)), F.lit(0)), F.coalesce(_shared(c, F.lead(column).over(w)), F.lit(0)))
    return fingerprints.withColumn("width", F.greatest(F.lit(MIN_PREFIX), near + 1))


def close_ranges(directives: DataFrame) -> DataFrame:
    """Directives (claim, file, rule, form, line, reason, first_code, ...) with kind, line, end and ``closes``.

    A form is line, next-line, disable or enable. ``disable`` opens a range that the next ``enable`` of its rule ends, with
    every other that is open then; above the file's first code it begins at line 1. Without a reason it opens nothing.
    ``closes`` is how many ranges an enable ends, null for the other forms. Directives of a line follow each other by claim.
    """
    order = Window.partitionBy("file", "rule").orderBy("line", "claim")
    is_enable = F.col("form") == "enable"
    opens = (F.col("form") == "disable") & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    d = directives.withColumn("_end", F.min(F.when(is_enable, F.col("line"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
    d = d.withColumn("_since", F.count_if(is_enable).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_open", F.count_if(opens).over(Window.partitionBy("file", "rule", "_since").orderBy("line", "claim").rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.when(F.col("form") == "disable", "range").otherwise(F.col("form"))
    begin = F.when((F.col("form") == "disable") & (F.col("line") < F.col("first_code")), F.lit(1)).otherwise(F.col("line"))
    others = [c for c in directives.columns if c not in ("line", "kind", "end", "closes")]
    return d.select(*others, kind.alias("kind"), begin.alias("line"), F.when(opens, F.col("_end")).alias("end"), F.when(is_enable, F.col("_open")).alias("closes"))


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """``findings`` with ``claim``: the directive that takes each, or null.

    A directive (claim, file, rule, kind, line, end, reason) reaches its own line (``line``), that and the next
    (``next-line``), or the lines from its own up to ``end``, not included and open if null (``range``); an ``enable`` reaches
    none. Where both sides have a ``symbol``, a next-line directive also reaches findings about the symbol that its comment
    documents, wherever that is in the file. Without a reason it claims nothing. Each finding is taken by the first directive
    that reaches it.
    """
    documents = "symbol" in findings.columns and "symbol" in directives.columns
    d = directives.where("trim(coalesce(reason, '')) <> '' and kind <> 'enable'").select(
        "claim", F.col("file").alias("_file"), F.col("rule").alias("_rule"), "kind", F.col("line").alias("_line"), F.col("end").alias("_end"), (F.col("symbol") if documents else F.lit(None).cast("string")).alias("_symbol")
    )
    about = F.coalesce(F.col("_symbol") == F.col("symbol"), F.lit(False)) if documents else F.lit(False)
    reach = (
        F.when(F.col("kind") == "line", F.col("line") == F.col("_line"))
        .when(F.col("kind") == "next-line", F.col("line").isin(F.col("_line"), F.col("_line") + 1) | about)
        .otherwise((F.col("line") >= F.col("_line")) & (F.col("_end").isNull() | (F.col("line") < F.col("_end"))))
    )
    met = findings.join(d, (F.col("file") == F.col("_file")) & (F.col("rule") == F.col("_rule")) & reach, "left")
    return met.groupBy(*findings.columns).agg(F.min_by("claim", F.when(F.col("claim").isNotNull(), F.struct("_line", "claim"))).alias("claim"))


def stale(suppressed: DataFrame, directives: DataFrame) -> DataFrame:
    """Directives with a reason that took no finding."""
    return directives.where("trim(coalesce(reason, '')) <> ''").join(suppressed.where("claim is not null").select("claim").distinct(), "claim", "left_anti")


def ancestors(path: Column) -> Column:
    """A path and all folders above it, the topmost '' included."""
    parts = F.split(path, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))


def unchecked(subjects: DataFrame, scope: DataFrame | None, gaps: DataFrame | None) -> DataFrame:
    """The distinct (decision, path) that a run says nothing of: paths below no folder or file of ``scope`` (path), and what
    ``gaps`` (decision, path) say wasn't finished, at a folder or file; a null decision there means every one.

    Paths meet scope and gaps by equality with one of their ancestors.
    """
    s = subjects.select("decision", "path").distinct()
    up = s.select("decision", "path", F.explode(ancestors(F.coalesce("path", F.lit("")))).alias("above"))
    out = s.limit(0)
    if scope is not None:
        met = up.join(scope.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()
        out = out.union(s.join(met, s["path"].eqNullSafe(met["path"]), "left_anti"))
    if gaps is not None:
        g = gaps.select(F.col("decision").alias("_of"), F.coalesce("path", F.lit("")).alias("above")).distinct()
        out = out.union(up.join(g, "above").where("_of is null or _of = decision").select("decision", "path"))
    return out.distinct()


def record_run(kept: DataFrame, run: DataFrame, ran: Column, active: Column, now: str, scope: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """The snapshot after a run.

    ``kept``: (fingerprint, decision, first_seen, last_seen, resolved_at, inactive_at, reopened). ``run``: (fingerprint,
    decision), each counted once. New findings open, those seen again stay or reopen, those that a decision which ``ran`` no
    longer finds are resolved, and those whose decision isn't ``active`` are inactive until it is again. Both are conditions
    on ``decision``. With ``scope`` or ``gaps`` (see ``unchecked``), snapshot and run have a path, and what wasn't checked
    isn't resolved for being absent.
    """
    at = F.lit(now).cast("timestamp_ntz")
    pathed = scope is not None or gaps is not None or "path" in kept.columns
    places = [F.max("path").alias("now_path")] if pathed else []
    seen = run.groupBy("fingerprint").agg(F.min("decision").alias("now_decision"), *places)
    both = kept.join(seen, "fingerprint", "full_outer").withColumn("_seen", F.col("now_decision").isNotNull()).withColumn("decision", F.coalesce("now_decision", "decision"))
    both = both.withColumn("_checked", F.lit(True))
    if pathed:
        both = both.withColumn("path", F.coalesce("now_path", "path"))
    if scope is not None or gaps is not None:
        u = unchecked(both, scope, gaps).select(F.col("decision").alias("_d"), F.col("path").alias("_p"), F.lit(False).alias("_no"))
        both = both.join(u, F.col("decision").eqNullSafe(F.col("_d")) & F.col("path").eqNullSafe(F.col("_p")), "left").withColumn("_checked", F.coalesce("_no", F.lit(True)))
    gone = ~F.col("_seen") & F.col("resolved_at").isNull() & ran & F.col("_checked")
    resolved = F.when(~F.col("_seen"), F.when(gone, at).otherwise(F.col("resolved_at")))
    out = both.select(
        "fingerprint",
        "decision",
        F.coalesce("first_seen", at).alias("first_seen"),
        F.when(F.col("_seen"), at).otherwise(F.col("last_seen")).alias("last_seen"),
        resolved.alias("resolved_at"),
        F.when(~F.col("_seen"), F.col("inactive_at")).alias("inactive_at"),
        (F.coalesce("reopened", F.lit(0)) + (F.col("_seen") & F.col("resolved_at").isNotNull()).cast("int")).cast("long").alias("reopened"),
        *(["path"] if pathed else []),
    )
    open_or_marked = F.col("resolved_at").isNull() | F.col("inactive_at").isNotNull()
    marked = F.when(open_or_marked, F.when(active, F.lit(None)).otherwise(F.coalesce("inactive_at", at))).otherwise(F.col("inactive_at"))
    return out.withColumn("inactive_at", marked.cast("timestamp_ntz"))


def state(suppressed: Column) -> Column:
    """suppressed, else inactive, else resolved, else open."""
    return F.when(suppressed, "suppressed").when(F.col("inactive_at").isNotNull(), "inactive").when(F.col("resolved_at").isNotNull(), "resolved").otherwise("open")


def standing(findings: DataFrame, judgments: DataFrame) -> DataFrame:
    """``findings`` (fingerprint, meaning, evidence, authored) with the judgment that stands and what it does.

    Judgments (id, fingerprint, judgment, strength, time, meaning, evidence, accepted) under the finding's meaning come first,
    one that names no meaning or evidence agrees with any; then the stronger, the later, the larger id.
    """
    j = judgments.select(*(F.col(c).alias(f"j_{c}") for c in judgments.columns))
    met = findings.join(j, F.col("fingerprint") == F.col("j_fingerprint"), "left")
    agrees = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))
    met = met.withColumn("_same", agrees("j_meaning", "meaning"))
    pick = F.struct("_same", "j_strength", "j_time", "j_id")
    top = met.groupBy(*findings.columns).agg(F.max_by(F.struct("_same", *(f"j_{c}" for c in judgments.columns)), F.when(F.col("j_id").isNotNull(), pick)).alias("t"))
    hides = (F.col("t.j_judgment") != "fail") | F.coalesce("t.j_accepted", F.lit(False))
    evidence = F.col("t.j_evidence").isNull() | (F.col("t.j_evidence") == F.col("evidence"))
    what = (
        F.when(F.col("t.j_id").isNull(), F.lit(None))
        .when(hides & (F.col("authored") == "error"), "unsuppressible")
        .when(~F.col("t._same"), "rule-changed")
        .when(~evidence, "evidence-changed")
        .when(hides, "suppressed")
        .otherwise("judged")
    )
    return top.select(*findings.columns, F.col("t.j_id").alias("judgment_id"), what.alias("standing"))


def prune(snapshot: DataFrame, judgments: DataFrame, before: Column) -> DataFrame:
    """The snapshot without findings that are closed, were last seen before a time, and were never judged."""
    old = (F.col("resolved_at").isNotNull() | F.col("inactive_at").isNotNull()) & (F.col("last_seen") < before)
    gone = snapshot.where(old).join(judgments.select("fingerprint").distinct(), "fingerprint", "left_anti").select("fingerprint")
    return snapshot.join(gone, "fingerprint", "left_anti")


def cofiring(pairs: DataFrame, decision: str, subject: str, least: int = 20, percent: int = 90) -> DataFrame:
    """(a, b, subjects, shared): decisions a that find something on ``least`` subjects or more, of which b finds at least
    ``percent`` per cent too."""
    p = pairs.select(decision, subject).distinct()
    n = p.groupBy(F.col(decision).alias("a")).agg(F.count("*").alias("subjects"))
    met = p.select(F.col(decision).alias("a"), subject).join(p.select(F.col(decision).alias("b"), subject), subject).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return met.join(n, "a").where((F.col("subjects") >= least) & (F.col("shared") * 100 >= F.col("subjects") * percent)).select("a", "b", "subjects", "shared")


def report_groups(findings: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` groups by decision, errors first and larger groups first, and how many findings are left out."""
    groups = findings.groupBy("decision", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.min("file").alias("first_file"))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    shown = groups.withColumn("rank", rank).orderBy("rank", F.desc("n"), "decision").limit(limit)
    total = findings.agg(F.count("*").alias("total"))
    left = shown.agg(F.sum("n").alias("shown")).crossJoin(total).select((F.col("total") - F.coalesce("shown", F.lit(0))).alias("left_out"))
    return shown.drop("rank").crossJoin(left)


def exit_code(findings: DataFrame, incomplete: DataFrame) -> DataFrame:
    """One row: 3 if something wasn't checked, 1 if there are errors, else 0."""
    errors = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    gaps = incomplete.agg(F.count("*").alias("incomplete"))
    return errors.crossJoin(gaps).withColumn("exit_code", F.when(F.col("incomplete") > 0, 3).when(F.col("errors") > 0, 1).otherwise(0))

