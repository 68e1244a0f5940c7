"""Queries on findings: identity, suppression, lifecycle, standing, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.functions import text as T
from sparkwright.operators import findings as O
from sparkwright.sources.scratch import read_table

QUERIES = {}
ORACLE = {}

#: Findings of the tables: an event of kind error or click is a finding of its user (the file) at its minute (the line).
FOUND = """f AS (SELECT event_id, event_type AS rule, 'u' || user_id AS file, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) // 60 % 1440 AS line,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS severity, CAST(floor(value / 10) AS BIGINT) AS bucket, ts FROM events)
"""


def _found(spark, folder):
    e = read_table(spark, folder, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("rule"),
        F.concat(F.lit("u"), "user_id").alias("file"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("line"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warn").otherwise("info").alias("severity"),
        F.floor(F.col("value") / 10).cast("long").alias("bucket"),
        "ts",
    )


def finding_fingerprints(spark, folder):
    """Fingerprints by rule, file and bucket, made unique by hour and then by place, with the width to print them at."""
    f = _found(spark, folder)
    f = f.select("event_id", "rule", "file", "ts", T.fingerprint(F.col("rule"), F.col("file"), F.concat(F.lit("  at\t"), F.col("bucket").cast("string"), F.lit("\n"))).alias("fingerprint"), F.when(F.col("bucket") % 2 == 0, F.hour("ts").cast("string")).otherwise("").alias("discriminator"))
    unique = O.disambiguate(f, ["ts", "event_id"])
    return O.prefix_widths(unique).select("event_id", "fingerprint", "by_ordinal", F.col("width").cast("long").alias("width"))


def _directives(spark, folder):
    e = read_table(spark, folder, "events").where("event_type = 'view' and event_id % 4 < 3")
    kind = F.when(F.col("event_id") % 4 == 0, "line").when(F.col("event_id") % 4 == 1, "next-line").otherwise("range")
    line = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    return e.select(
        F.col("event_id").alias("claim"),
        F.concat(F.lit("u"), "user_id").alias("file"),
        F.when(F.col("event_id") % 3 == 0, "error").otherwise("click").alias("rule"),
        kind.alias("kind"),
        line.alias("line"),
        F.when(F.col("event_id") % 5 > 0, line + 20).alias("end"),
        F.when(F.col("event_id") % 7 > 0, "known").otherwise(" ").alias("reason"),
    )


def suppression(spark, folder):
    """Which directive takes which finding."""
    return O.suppress(_found(spark, folder).select("event_id", "rule", "file", "line"), _directives(spark, folder)).select("event_id", "claim")


def stale_directives(spark, folder):
    d = _directives(spark, folder)
    return O.stale(O.suppress(_found(spark, folder).select("event_id", "rule", "file", "line"), d), d).select("claim", "kind")


def _forms(spark, folder):
    """Directives of four forms; each of the next-line ones documents a symbol, and code begins at line 30."""
    e = read_table(spark, folder, "events").where("event_type = 'view'")
    form = F.element_at(F.array(*map(F.lit, ("line", "next-line", "disable", "disable", "enable"))), (F.col("event_id") % 5 + 1).cast("int"))
    return O.close_ranges(
        e.select(
            F.col("event_id").alias("claim"), F.concat(F.lit("u"), "user_id").alias("file"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("click").alias("rule"), form.alias("form"),
            (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("line"), F.when(F.col("event_id") % 7 > 0, "known").otherwise(" ").alias("reason"), F.lit(30).alias("first_code"),
            F.when(form == "next-line", F.concat(F.lit("s"), (F.col("event_id") * 7 % 50).cast("string"))).alias("symbol"),
        )
    )


def directive_ranges(spark, folder):
    """Where each range ends, and how many each enable closes."""
    return _forms(spark, folder).select("claim", "kind", F.col("line").cast("long").alias("line"), "end", "closes")


def suppression_reach(spark, folder):
    """Which directive takes which finding: by line, by range up to its enable, or by the symbol that it documents."""
    found = _found(spark, folder).select("event_id", "rule", "file", "line", F.concat(F.lit("s"), (F.col("event_id") % 50).cast("string")).alias("symbol"))
    return O.suppress(found, _forms(spark, folder)).select("event_id", "claim")


def lifecycle(spark, folder):
    """Three runs over thirds of the month: findings are users' kinds of events; kinds run and are enabled in turn."""
    e = read_table(spark, folder, "events").withColumn("fingerprint", F.concat_ws("/", F.col("user_id").cast("string"), "event_type")).select("fingerprint", F.col("event_type").alias("decision"), "ts", "user_id")
    kept = spark.createDataFrame([], "fingerprint string, decision string, first_seen timestamp_ntz, last_seen timestamp_ntz, resolved_at timestamp_ntz, inactive_at timestamp_ntz, reopened bigint")
    days = F.dayofmonth("ts")
    some = F.col("user_id") % 3
    runs = [(days <= 10, "2024-01-10", F.lit(True), F.lit(True)), ((days > 10) & (days <= 20) & (some != 1), "2024-01-20", F.col("decision") != "view", F.col("decision") != "signup"), ((days > 20) & (some != 2), "2024-01-30", F.lit(True), F.lit(True))]
    for part, now, ran, active in runs:
        kept = O.record_run(kept, e.where(part), ran, active, f"{now} 00:00:00")
    return kept.select("fingerprint", "decision", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen", "last_seen", "resolved_at", "inactive_at")), "reopened", O.state(F.lit(False)).alias("state"))


def lifecycle_scope(spark, folder):
    """Two runs, the second over some folders only, with gaps, a decision that didn't run and one that is no longer active."""
    e = read_table(spark, folder, "events")
    path = F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string"), F.lit("/h"), (F.col("user_id") % 15).cast("string"), F.lit("/u"), F.col("user_id").cast("string"))
    e = e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("fingerprint"), F.col("event_type").alias("decision"), path.alias("path"), F.dayofmonth("ts").alias("day"), "user_id")
    kept = spark.createDataFrame([], "fingerprint string, decision string, first_seen timestamp_ntz, last_seen timestamp_ntz, resolved_at timestamp_ntz, inactive_at timestamp_ntz, reopened bigint, path string")
    kept = O.record_run(kept, e.where("day <= 15"), F.lit(True), F.lit(True), "2024-01-15 00:00:00")
    scope = spark.createDataFrame([("g0",), ("g1/h1",), ("g2",), ("g3/h8/u8",)], "path string")
    gaps = spark.createDataFrame([("error", "g0/h5"), ("view", None), (None, "g2/h2")], "decision string, path string")
    run = e.where("day > 15 and user_id % 4 = 0 and decision <> 'signup'")
    kept = O.record_run(kept, run, F.col("decision") != "click", F.col("decision") != "signup", "2024-01-30 00:00:00", scope, gaps)
    return kept.select("fingerprint", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("resolved_at", "inactive_at")), O.state(F.lit(False)).alias("state"))


def standing(spark, folder):
    """Customers' order totals judged by their orders: the strongest, latest judgment and what it does."""
    c = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("fingerprint"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_nationkey") % 2).cast("string")).alias("meaning"), F.col("c_mktsegment").substr(1, 1).alias("evidence"), F.when(F.col("c_custkey") % 10 == 0, "error").otherwise("warn").alias("authored"))
    o = read_table(spark, folder, "orders")
    j = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fingerprint"), F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("notApplicable").alias("judgment"),
        F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1).alias("strength"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"),
        F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 2).cast("string")).alias("meaning"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("B")).alias("evidence"), (F.col("o_orderkey") % 6 == 0).alias("accepted"),
    )
    return O.standing(c, j).select("fingerprint", "judgment_id", "standing")


def prune_snapshot(spark, folder):
    """Snapshots of customers' orders: closed, old and never judged ones go."""
    o = read_table(spark, folder, "orders")
    s = o.groupBy(F.col("o_custkey").alias("fingerprint")).agg(F.max("o_orderdate").alias("last_seen"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("resolved_at")).withColumn("inactive_at", F.lit(None).cast("timestamp_ntz"))
    judged = o.where("o_orderpriority = '1-URGENT' and o_orderkey % 3 = 0").select(F.col("o_custkey").alias("fingerprint"))
    return O.prune(s, judged, F.lit("2000-01-01").cast("timestamp_ntz")).select("fingerprint")


def cofiring(spark, folder):
    """Classes of part sizes such that most customers of one buy the other too; a class holds twice the sizes of the one before."""
    t = lambda n: read_table(spark, folder, n)
    size = F.floor(F.log2(F.col("p_size").cast("double")) + 1e-9).cast("int")
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(size.alias("size"), "o_custkey")
    return O.cofiring(bought, "size", "o_custkey")


def report_groups(spark, folder):
    f = _found(spark, folder).select(F.col("rule").alias("decision"), "severity", "file")
    return O.report_groups(f, 3)


def exit_code(spark, folder):
    f = _found(spark, folder)
    return O.exit_code(f, f.where("bucket > 1000000"))


NAMED = (finding_fingerprints, suppression, directive_ranges, suppression_reach, stale_directives, lifecycle, lifecycle_scope, standing, prune_snapshot, cofiring, report_groups, exit_code)
QUERIES |= {f.__name__: f for f in NAMED}

DIRECTIVES = """d AS (SELECT event_id AS claim, 'u' || user_id AS file, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'click' END AS rule, event_id % 4 AS kind,
 CAST(epoch(date_trunc('minute', ts)) AS BIGINT) // 60 % 1440 AS line, CASE WHEN event_id % 5 > 0 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) // 60 % 1440 + 20 END AS "end"
 FROM events WHERE event_type = 'view' AND event_id % 4 < 3 AND event_id % 7 > 0),
s AS (SELECT f.event_id, (SELECT arg_min(claim, {'l': d.line, 'c': claim}) FROM d WHERE d.file = f.file AND d.rule = f.rule AND CASE kind WHEN 0 THEN f.line = d.line
 WHEN 1 THEN f.line IN (d.line, d.line + 1) ELSE f.line >= d.line AND (d."end" IS NULL OR f.line < d."end") END) AS claim FROM f)
"""
FORMS = """d AS (SELECT event_id AS claim, 'u' || user_id AS file, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'click' END AS rule, event_id % 5 AS form, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) // 60 % 1440 AS line,
 event_id % 7 > 0 AS known, CASE WHEN event_id % 5 = 1 THEN 's' || (event_id * 7 % 50) END AS symbol FROM events WHERE event_type = 'view'),
r AS (SELECT d.*, CASE form WHEN 0 THEN 'line' WHEN 1 THEN 'next-line' WHEN 4 THEN 'enable' ELSE 'range' END AS kind, CASE WHEN form IN (2, 3) AND line < 30 THEN 1 ELSE line END AS begin,
 CASE WHEN form IN (2, 3) AND known THEN (SELECT min(e.line) FROM d e WHERE e.form = 4 AND e.file = d.file AND e.rule = d.rule AND (e.line > d.line OR e.line = d.line AND e.claim > d.claim)) END AS "end" FROM d)
"""
ORACLE |= {
    "directive_ranges": "WITH " + FORMS + """, n AS (SELECT e.claim, count(x.claim) AS closes FROM d e LEFT JOIN (SELECT d.*, (SELECT min({'l': y.line, 'c': y.claim}) FROM d y WHERE y.form = 4 AND y.file = d.file AND y.rule = d.rule AND (y.line > d.line OR y.line = d.line AND y.claim > d.claim)) AS by
 FROM d WHERE form IN (2, 3) AND known) x ON x.by.c = e.claim WHERE e.form = 4 GROUP BY e.claim)
SELECT r.claim, kind, begin AS line, "end", n.closes FROM r LEFT JOIN n ON n.claim = r.claim""",
    "suppression_reach": "WITH " + FOUND + ", " + FORMS + """SELECT f.event_id, arg_min(r.claim, {'l': r.begin, 'c': r.claim}) AS claim FROM f LEFT JOIN r ON r.file = f.file AND r.rule = f.rule AND r.known
 AND CASE r.form WHEN 0 THEN f.line = r.line WHEN 1 THEN f.line IN (r.line, r.line + 1) OR r.symbol = 's' || (f.event_id % 50) WHEN 4 THEN false ELSE f.line >= r.begin AND (r."end" IS NULL OR f.line < r."end") END GROUP BY f.event_id""",
    "finding_fingerprints": "WITH " + FOUND + """, h AS (SELECT *, sha256(rule || chr(0) || file || chr(0) || 'at ' || bucket) AS fp, CASE WHEN bucket % 2 = 0 THEN CAST(hour(ts) AS VARCHAR) ELSE '' END AS disc FROM f),
n AS (SELECT *, count(*) OVER (PARTITION BY rule, file, fp) AS n, count(*) OVER (PARTITION BY rule, file, fp, disc) AS same, row_number() OVER (PARTITION BY rule, file, fp, disc ORDER BY ts, event_id) - 1 AS i FROM h),
b AS (SELECT *, CASE WHEN n > 1 AND disc <> '' THEN sha256(fp || chr(1) || disc) ELSE fp END AS base FROM n),
x AS (SELECT event_id, CASE WHEN n > 1 AND i > 0 THEN sha256(base || chr(2) || i) ELSE base END AS fingerprint, n > 1 AND same > 1 AS by_ordinal FROM b),
y AS (SELECT *, lag(fingerprint) OVER (ORDER BY fingerprint) AS p, lead(fingerprint) OVER (ORDER BY fingerprint) AS q FROM x),
z AS (SELECT *, coalesce((SELECT max(k) FROM range(1, 65) t(k) WHERE left(p, k) = left(fingerprint, k)), 0) AS a, coalesce((SELECT max(k) FROM range(1, 65) t(k) WHERE left(q, k) = left(fingerprint, k)), 0) AS c FROM y)
SELECT event_id, fingerprint, by_ordinal, greatest(7, greatest(a, c) + 1) AS width FROM z""",
    "suppression": "WITH " + FOUND + ", " + DIRECTIVES + "SELECT event_id, claim FROM s",
    "stale_directives": "WITH " + FOUND + ", " + DIRECTIVES + "SELECT claim, CASE kind WHEN 0 THEN 'line' WHEN 1 THEN 'next-line' ELSE 'range' END AS kind FROM d WHERE claim NOT IN (SELECT claim FROM s WHERE claim IS NOT NULL)",
    "lifecycle": """WITH e AS (SELECT user_id || '/' || event_type AS fp, event_type AS d, day(ts) AS day, user_id % 3 AS g FROM events),
a AS (SELECT DISTINCT fp, d FROM e WHERE day <= 10), b AS (SELECT DISTINCT fp, d FROM e WHERE day BETWEEN 11 AND 20 AND g <> 1), c AS (SELECT DISTINCT fp, d FROM e WHERE day > 20 AND g <> 2),
u AS (SELECT DISTINCT fp, d FROM (FROM a UNION FROM b UNION FROM c)),
m AS (SELECT fp, d, fp IN (SELECT fp FROM a) AS ia, fp IN (SELECT fp FROM b) AS ib, fp IN (SELECT fp FROM c) AS ic FROM u),
r AS (SELECT *, ia AND NOT ib AND d <> 'view' AS closed2 FROM m)
SELECT fp AS fingerprint, d AS decision, CASE WHEN ia THEN '2024-01-10' WHEN ib THEN '2024-01-20' ELSE '2024-01-30' END AS first_seen,
CASE WHEN ic THEN '2024-01-30' WHEN ib THEN '2024-01-20' ELSE '2024-01-10' END AS last_seen,
CASE WHEN ic THEN NULL WHEN closed2 THEN '2024-01-20' ELSE '2024-01-30' END AS resolved_at,
CAST(NULL AS VARCHAR) AS inactive_at,
CAST(CASE WHEN closed2 AND ic THEN 1 ELSE 0 END AS BIGINT) AS reopened, CASE WHEN ic THEN 'open' ELSE 'resolved' END AS state FROM r""",
    "lifecycle_scope": """WITH e AS (SELECT user_id || '/' || event_type AS fp, event_type AS d, day(ts) AS day, user_id AS u, 'g' || user_id % 5 || '/h' || user_id % 15 || '/u' || user_id AS path FROM events),
k AS (SELECT fp, d, u, path, bool_or(day <= 15) AS before, bool_or(day > 15 AND u % 4 = 0 AND d <> 'signup') AS after FROM e GROUP BY ALL),
r AS (SELECT *, before AND NOT after AND d <> 'click' AND d <> 'view' AND (u % 5 IN (0, 2) OR u % 15 = 1 OR u = 8) AND NOT (d = 'error' AND u % 15 = 5) AND u % 15 <> 2 AS gone FROM k WHERE before OR after)
SELECT fp AS fingerprint, CASE WHEN gone THEN '2024-01-30' END AS resolved_at, CASE WHEN d = 'signup' AND NOT gone THEN '2024-01-30' END AS inactive_at,
CASE WHEN d = 'signup' AND NOT gone THEN 'inactive' WHEN gone THEN 'resolved' ELSE 'open' END AS state FROM r""",
    "standing": """WITH c AS (SELECT c_custkey AS fp, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey % 2 AS VARCHAR) END AS meaning, left(c_mktsegment, 1) AS ev, c_custkey % 10 = 0 AS err FROM customer),
j AS (SELECT o_orderkey AS id, o_custkey AS fp, o_orderstatus AS st, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS strength, strftime(o_orderdate, '%Y-%m-%d') AS t,
 CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 2 AS VARCHAR) END AS m, CASE WHEN o_orderkey % 3 = 0 THEN 'B' END AS je, o_orderkey % 6 = 0 AS acc FROM orders),
x AS (SELECT c.*, j.*, (m IS NULL OR meaning IS NULL OR m = meaning) AS same FROM c LEFT JOIN j ON c.fp = j.fp),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY x.fp ORDER BY same DESC, strength DESC, t DESC, id DESC) = 1)
SELECT fp AS fingerprint, id AS judgment_id, CASE WHEN id IS NULL THEN NULL WHEN (st <> 'F' OR acc) AND err THEN 'unsuppressible' WHEN NOT same THEN 'rule-changed'
WHEN je IS NOT NULL AND je <> ev THEN 'evidence-changed' WHEN st <> 'F' OR acc THEN 'suppressed' ELSE 'judged' END AS standing FROM y""",
    "prune_snapshot": """SELECT o_custkey AS fingerprint FROM orders GROUP BY 1 HAVING NOT (count(*) FILTER (o_orderstatus = 'F') > 0 AND max(o_orderdate) < TIMESTAMP '2000-01-01'
AND count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0) = 0)""",
    "cofiring": """WITH p AS (SELECT DISTINCT CAST(floor(log2(p_size) + 1e-9) AS INT) AS d, o_custkey AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
n AS (SELECT d, count(*) AS n FROM p GROUP BY d)
SELECT x.d AS a, y.d AS b, n.n AS subjects, count(*) AS shared FROM p x JOIN p y ON x.g = y.g AND x.d <> y.d JOIN n ON n.d = x.d WHERE n.n >= 20 GROUP BY ALL HAVING count(*) * 100 >= n.n * 90""",
    "report_groups": "WITH " + FOUND + """, g AS (SELECT rule AS decision, severity, count(*) AS n, count(DISTINCT file) AS files, min(file) AS first_file FROM f GROUP BY ALL),
t AS (SELECT * FROM g ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, n DESC, decision LIMIT 3)
SELECT *, CAST((SELECT count(*) FROM f) - (SELECT sum(n) FROM t) AS BIGINT) AS left_out FROM t""",
    "exit_code": "WITH " + FOUND + """SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (bucket > 1000000) AS incomplete,
CASE WHEN count(*) FILTER (bucket > 1000000) > 0 THEN 3 WHEN count(*) FILTER (severity = 'error') > 0 THEN 1 ELSE 0 END AS exit_code FROM f""",
}
