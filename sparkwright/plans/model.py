"""Queries over the derived code model: measures, ownership, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.operators import joins, metrics, resolve
from sparkwright.sources.scratch import read_table
from sparkwright.sources.tables import Numbered, relation, with_sql

QUERIES = {}
ORACLE = {}


def _measures(spark, folder):
    f = relation(spark, folder, "functions")
    flow = metrics.flows(relation(spark, folder, "flow"))
    empty = F.array().cast("array<struct<at:bigint,kind:string,nesting:bigint,arms:bigint,operators:bigint>>")
    return f.join(flow, f["id"] == flow["symbol"], "left").select(f["*"], F.coalesce("flow", empty).alias("flow"))


def function_metrics(spark, folder):
    """Branching measures of every function."""
    m = _measures(spark, folder)
    return m.select("id", "statements", "params", metrics.cyclomatic(F.col("flow")).alias("cyclomatic"), metrics.cognitive(F.col("flow")).alias("cognitive"), metrics.depth(F.col("flow")).alias("depth"), metrics.dispatcher(F.col("flow")).alias("dispatcher"))


def fan_in_out(spark, folder):
    m = Numbered(spark, folder)
    return m.named(metrics.fans(m.functions, m.uses), "id")


def feature_envy(spark, folder):
    m = Numbered(spark, folder)
    return m.named(metrics.envy(m.functions, m.relation("uses")), "id")


def receiver_affinity(spark, folder):
    m = Numbered(spark, folder)
    return m.named(metrics.receiver_affinity(m.functions, m.relation("uses")), "id")


def cohesion_lcom4(spark, folder):
    m = Numbered(spark, folder)
    return metrics.cohesion(m.functions, m.relation("uses"))


def unit_rollup(spark, folder):
    m = Numbered(spark, folder)
    measured = metrics.measures(m.functions, m.relation("flow")).select("id", F.col("cyclomatic").alias("m"))
    return m.named(metrics.unit_rollup(m.functions, m.relation("uses"), measured), "id")


def split_share(spark, folder):
    m = Numbered(spark, folder)
    return metrics.split_share(m.functions, m.relation("uses"))


def module_stats(spark, folder, known=None):
    m = known or Numbered(spark, folder)
    return metrics.module_stats(relation(spark, folder, "modules"), relation(spark, folder, "files"), m.functions, m.module_edges)


def homonyms(spark, folder):
    """Part names without their number that files of several modules have."""
    f = relation(spark, folder, "functions").where("visibility = 'public'").withColumn("plain", F.regexp_replace("name", "[0-9]+$", ""))
    return metrics.homonyms(f, "plain", "module")


def users_index(spark, folder):
    found = resolve.users(relation(spark, folder, "uses"))
    return found.select("id", F.array_join("users", ",").alias("users"))


def resolve_edges(spark, folder):
    """Texts of five kinds to symbols: ids, modules, ids without kind, names, and paths to nothing."""
    f = relation(spark, folder, "functions")
    u = relation(spark, folder, "uses").where("resolution = 'syntactic'")
    d = f.select(F.col("id").alias("dst"), "pid", "name", "module")
    spelled = F.expr("case pid % 6 when 0 then dst when 1 then substring_index(dst, '#', 1) when 2 then name when 3 then module when 4 then regexp_replace(name, '[0-9]+$', '') else concat('none/', name) end")
    edges = u.join(d, "dst").select("src", "dst", spelled.alias("to"))
    symbols = f.select("id", "name", "kind").union(f.select("id", F.regexp_replace("name", "[0-9]+$", "").alias("name"), "kind"))
    return resolve.resolve_targets(edges, symbols, relation(spark, folder, "modules")).select("src", "dst", "to", "target", "how", "ambiguous")


def dedup_edges(spark, folder):
    """One edge a part and supplier, with the site that comes first."""
    e = read_table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), F.col("l_shipdate").cast("string").substr(1, 10).alias("site"))
    return resolve.dedup_edges(e, ["l_partkey", "l_suppkey"], "site", "ordinal")


def duplicate_ids(spark, folder):
    """Part names that several brands have, with the first three."""
    found = resolve.duplicates(read_table(spark, folder, "part"), "p_name", "p_brand")
    return found.select("p_name", "places", F.array_join("examples", ",").alias("examples"))


def interface_satisfaction(spark, folder):
    """Which suppliers sell every part of an order, by themselves."""
    lines = read_table(spark, folder, "lineitem")
    need = lines.join(read_table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_partkey")
    return joins.provides_all(need, lines.select("l_suppkey", "l_partkey"), "o_orderkey", "l_suppkey", "l_partkey")


def test_credit(spark, folder):
    """Tests named after functions, or after them and a variant, credited to the longest name."""
    f = relation(spark, folder, "functions")
    keys = f.where("not test").select(F.col("id").alias("symbol"), F.col("name").alias("key"), F.col("file").alias("f"))
    tests = f.where("not test and pid % 4 < 2").select(F.concat(F.lit("test_"), "name", F.when(F.col("pid") % 4 == 1, F.lit("_empty_case")).otherwise("")).alias("test"), F.col("file").alias("f"), F.concat("name", F.when(F.col("pid") % 4 == 1, F.lit("_empty_case")).otherwise("")).alias("rest"))
    return joins.credited(tests, keys, ["f"]).select("test", "symbol", "exact")


def siblings(spark, folder, functions=None):
    """Previous and next declaration of a file, and the gap to the previous one of the same owner."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line")
    o = Window.partitionBy("file", "owner").orderBy("line")
    f = relation(spark, folder, "functions") if functions is None else functions
    return f.select("id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"), F.when(F.col("owner").isNotNull(), F.col("line") - F.lag("end_line").over(o)).alias("gap"))


NAMED = (function_metrics, fan_in_out, feature_envy, receiver_affinity, cohesion_lcom4, unit_rollup, split_share, module_stats, homonyms, users_index, resolve_edges, dedup_edges, duplicate_ids, interface_satisfaction, test_credit, siblings)
QUERIES |= {f.__name__: f for f in NAMED}

USED = ", u AS (SELECT DISTINCT src, dst FROM uses WHERE resolution <> 'heuristic' AND src <> dst)\n"
CYCLO = """, m AS (SELECT f.id, CAST(1 + coalesce(sum(CASE WHEN w.kind IN ('if', 'else-if', 'loop', 'catch') THEN 1 WHEN w.kind = 'switch' THEN arms WHEN w.kind = 'logic' THEN operators ELSE 0 END), 0) AS BIGINT) AS m
FROM functions f LEFT JOIN flow w ON w.symbol = f.id GROUP BY f.id)
"""
ORACLE |= {
    "function_metrics": with_sql("functions", "flow") + """SELECT f.id, f.statements, f.params,
CAST(1 + coalesce(sum(CASE WHEN w.kind IN ('if', 'else-if', 'loop', 'catch') THEN 1 WHEN w.kind = 'switch' THEN arms WHEN w.kind = 'logic' THEN operators ELSE 0 END), 0) AS BIGINT) AS cyclomatic,
CAST(coalesce(sum(CASE WHEN w.kind IN ('if', 'switch', 'loop', 'catch') THEN 1 + nesting WHEN w.kind IN ('else-if', 'else', 'logic') THEN 1 ELSE 0 END), 0) AS BIGINT) AS cognitive,
coalesce(max(nesting), 0) AS depth, count(*) FILTER (w.kind = 'switch') = 1 AND count(*) FILTER (w.kind IN ('if', 'loop', 'catch')) = 0 AS dispatcher
FROM functions f LEFT JOIN flow w ON w.symbol = f.id GROUP BY f.id, f.statements, f.params""",
    "fan_in_out": with_sql("functions", "uses") + USED + """SELECT f.id,
(SELECT count(*) FROM u JOIN functions c ON c.id = u.src WHERE u.dst = f.id AND c.module = f.module AND NOT c.test) AS fan_in, (SELECT count(*) FROM u WHERE u.src = f.id) AS fan_out FROM functions f""",
    "feature_envy": with_sql("functions", "uses") + """, c AS (SELECT u.src AS id, d.owner AS target, count(DISTINCT u.dst) AS members FROM uses u JOIN functions s ON s.id = u.src JOIN functions d ON d.id = u.dst
WHERE u.resolution <> 'heuristic' AND d.owner IS NOT NULL AND d.owner IS DISTINCT FROM s.owner GROUP BY ALL)
SELECT id, target, members FROM c WHERE members >= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY members DESC, target) = 1""",
    "receiver_affinity": with_sql("functions", "uses") + USED + """SELECT d.id, min(s.owner) AS owner FROM u JOIN functions s ON s.id = u.src JOIN functions d ON d.id = u.dst
WHERE d.kind = 'function' AND d.visibility = 'private' GROUP BY d.id HAVING count(*) = count(s.owner) AND count(DISTINCT s.owner) = 1""",
    "cohesion_lcom4": with_sql("functions", "uses") + USED + """, ms AS (SELECT id, owner FROM functions WHERE owner IS NOT NULL),
l AS (SELECT a.id AS x, b.id AS y FROM u JOIN ms a ON a.id = u.src JOIN ms b ON b.id = u.dst WHERE a.owner = b.owner
 UNION SELECT a.id, b.id FROM u JOIN u v ON u.dst = v.dst JOIN ms a ON a.id = u.src JOIN ms b ON b.id = v.src WHERE a.owner = b.owner AND a.id <> b.id),
p AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT id AS x, id AS y FROM ms UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT owner, count(*) AS methods, count(DISTINCT c.c) AS groups FROM ms JOIN c ON c.x = ms.id GROUP BY owner""",
    "unit_rollup": with_sql("functions", "uses", "flow") + USED + CYCLO + """, s AS (SELECT u.dst AS id, min(u.src) AS caller FROM u GROUP BY u.dst HAVING count(*) = 1),
t AS (SELECT s.id, s.caller FROM s JOIN functions a ON a.id = s.id JOIN functions b ON b.id = s.caller WHERE a.module = b.module AND a.visibility = 'private'),
q AS (SELECT id, caller AS root FROM t UNION SELECT q.id, t.caller FROM q JOIN t ON q.root = t.id),
h AS (SELECT root, count(*) AS helpers, sum(m.m - 1) AS more FROM q JOIN m ON m.id = q.id WHERE q.id <> q.root GROUP BY root)
SELECT m.id, coalesce(h.helpers, 0) AS helpers, CAST(m.m + coalesce(h.more, 0) AS BIGINT) AS unit FROM m LEFT JOIN h ON h.root = m.id""",
    "module_stats": with_sql("modules", "files", "functions", "module_edges") + """SELECT m.path, (SELECT count(*) FROM files f WHERE f.module = m.path) AS files,
CAST(coalesce((SELECT sum(f.lines) FROM files f WHERE f.module = m.path), 0) AS BIGINT) AS lines, (SELECT count(*) FROM functions f WHERE f.module = m.path) AS declares,
(SELECT count(DISTINCT e.src) FROM module_edges e WHERE e.dst = m.path AND e.src <> e.dst) AS dependents FROM modules m""",
    "homonyms": with_sql("functions") + """, p AS (SELECT DISTINCT regexp_replace(name, '[0-9]+$', '') AS plain, module FROM functions WHERE visibility = 'public')
SELECT plain, module, count(*) OVER (PARTITION BY plain) - 1 AS others FROM p QUALIFY others > 0""",
    "users_index": with_sql("functions", "uses") + "SELECT dst AS id, array_to_string(list_sort(list(DISTINCT src)), ',') AS users FROM uses WHERE src <> dst AND resolution <> 'heuristic' GROUP BY dst",
    "resolve_edges": with_sql("modules", "functions", "uses") + """, e AS (SELECT u.src, u.dst, CASE pid % 6 WHEN 0 THEN f.id WHEN 1 THEN split_part(f.id, '#', 1) WHEN 2 THEN name WHEN 3 THEN module WHEN 4 THEN regexp_replace(name, '[0-9]+$', '') ELSE 'none/' || name END AS "to"
FROM uses u JOIN functions f ON f.id = u.dst WHERE u.resolution = 'syntactic'),
n AS (SELECT id, name FROM functions UNION SELECT id, regexp_replace(name, '[0-9]+$', '') FROM functions),
b1 AS (SELECT split_part(id, '#', 1) AS k, min(id) AS id FROM functions GROUP BY 1 HAVING count(DISTINCT id) = 1),
n1 AS (SELECT name AS k, min(id) AS id FROM n GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT e.src, e.dst, e."to", coalesce(f.id, mo.path, b1.id, n1.id, e."to") AS target,
CASE WHEN f.id IS NOT NULL THEN 'id' WHEN mo.path IS NOT NULL THEN 'module' WHEN b1.id IS NOT NULL THEN 'bare' WHEN n1.id IS NOT NULL THEN 'name' ELSE 'path' END AS how,
coalesce(f.id, mo.path, b1.id, n1.id) IS NULL AND (e."to" IN (SELECT name FROM n) OR e."to" IN (SELECT split_part(id, '#', 1) FROM functions)) AS ambiguous
FROM e LEFT JOIN functions f ON f.id = e."to" LEFT JOIN modules mo ON mo.path = e."to" LEFT JOIN b1 ON b1.k = e."to" LEFT JOIN n1 ON n1.k = e."to" """,
    "dedup_edges": """SELECT l_partkey, l_suppkey, substr(CAST(arg_min(l_shipdate, {'a': l_orderkey * 8 + l_linenumber, 'b': l_shipdate}) AS VARCHAR), 1, 10) AS site FROM lineitem GROUP BY ALL""",
    "duplicate_ids": """SELECT p_name, count(*) AS places, array_to_string(list_sort(list(p_brand))[1:3], ',') AS examples FROM (SELECT DISTINCT p_name, p_brand FROM part) GROUP BY p_name HAVING count(*) > 1""",
    "interface_satisfaction": """WITH need AS (SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
have AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT o_orderkey, count(*) AS n FROM need GROUP BY 1)
SELECT o_orderkey, l_suppkey FROM need JOIN have USING (l_partkey) JOIN n USING (o_orderkey) GROUP BY o_orderkey, l_suppkey, n.n HAVING count(*) = n.n""",
    "test_credit": with_sql("functions") + """, t AS (SELECT 'test_' || name || CASE WHEN pid % 4 = 1 THEN '_empty_case' ELSE '' END AS test, file, name || CASE WHEN pid % 4 = 1 THEN '_empty_case' ELSE '' END AS rest FROM functions WHERE NOT test AND pid % 4 < 2)
SELECT t.test, f.id AS symbol, t.rest = f.name AS exact FROM t JOIN functions f ON f.file = t.file AND NOT f.test AND (t.rest = f.name OR starts_with(t.rest, f.name || '_'))
QUALIFY row_number() OVER (PARTITION BY t.test, t.file ORDER BY length(f.name) DESC, f.id DESC) = 1""",
    "siblings": with_sql("functions") + """SELECT id, lag(id) OVER (PARTITION BY file ORDER BY line) AS prev, lead(id) OVER (PARTITION BY file ORDER BY line) AS next,
CASE WHEN owner IS NOT NULL THEN line - lag(end_line) OVER (PARTITION BY file, owner ORDER BY line) END AS gap FROM functions""",
}
