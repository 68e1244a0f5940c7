"""Queries on graphs: modules of the derived model and suppliers that follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions.components import connected_components
from sparkwright.operators import graphs
from sparkwright.sources.scratch import checkpoint, read_table
from sparkwright.sources.tables import Numbered, with_sql

QUERIES = {}
ORACLE = {}
TOP = 3

SUPPLIERS = f"""WITH RECURSIVE pairs AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
flow AS (SELECT src, dst, count(*) AS n FROM pairs WHERE src <> dst GROUP BY ALL),
e AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM flow) WHERE r <= {TOP}),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src),
comp AS (SELECT node, least(node, (SELECT min(a.dst) FROM reach a JOIN reach b ON a.dst = b.src AND b.dst = node WHERE a.src = node)) AS component FROM nodes)
"""


def supplier_edges(spark: SparkSession, folder: str) -> DataFrame:
    """From each supplier to the TOP whose lines most often follow its own in an order; one node a supplier, so it grows."""
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    flow = read_table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("src"), after.alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return checkpoint(flow.withColumn("r", rank).where(F.col("r") <= TOP).select("src", "dst"))


def graph_closure(spark, folder):
    return graphs.closure(supplier_edges(spark, folder))


def graph_components(spark, folder):
    return graphs.strong_components(supplier_edges(spark, folder))


def graph_cycles(spark, folder):
    found = graphs.cycles(graphs.strong_components(supplier_edges(spark, folder)))
    return found.select("component", F.col("size"), F.array_join("members", ",").alias("members"))


def graph_degrees(spark, folder):
    e = supplier_edges(spark, folder)
    return graphs.instability(graphs.degrees(e, graphs.nodes_of(e)))


def graph_reach(spark, folder):
    e = supplier_edges(spark, folder)
    nodes = graphs.nodes_of(e)
    counted = graphs.condensed_counts(graphs.condensed(e), nodes)
    n = nodes.count()
    return counted.select("node", "vfi", "vfo", (F.floor(F.col("vfi") / n * 10000 + 0.5) / 10000).alias("in_share"), (F.floor(F.col("vfo") / n * 10000 + 0.5) / 10000).alias("out_share"))


def graph_heights(spark, folder):
    e = supplier_edges(spark, folder)
    return graphs.heights(e, graphs.strong_components(e))


def graph_system(spark, folder):
    return graphs.condensed_system(graphs.condensed(supplier_edges(spark, folder)))


def graph_reaches(spark, folder):
    e = supplier_edges(spark, folder)
    owing = read_table(spark, folder, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return graphs.reaches(e, graphs.nodes_of(e), owing)


def module_cycle(spark, folder):
    """Cycles among modules by resolved uses."""
    e = Numbered(spark, folder).module_edges
    found = graphs.strong_components(e)
    size = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(size, "component").select("node", "component", "size")


def weak_components(spark, folder):
    """Files joined by uses, as undirected components."""
    m = Numbered(spark, folder)
    found = connected_components(m.relation("uses").where("resolution = 'semantic'"))
    placed = checkpoint(m.named(found, "node"))
    return placed.join(placed.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))


def event_transitions(spark, folder):
    """Which kind of event follows which for a user, with weights, and what each kind reaches."""
    e = read_table(spark, folder, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    weights = e.select(F.col("event_type").alias("src"), after.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    reach = graphs.closure(weights.where("src <> dst")).groupBy("src").agg(F.count_if(F.col("src") != F.col("dst")).alias("reaches"))
    return weights.join(reach, "src", "left").select("src", "dst", "n", F.coalesce("reaches", F.lit(0)).alias("reaches"))


QUERIES |= {f.__name__: f for f in (graph_closure, graph_components, graph_cycles, graph_degrees, graph_reach, graph_heights, graph_system, graph_reaches, module_cycle, weak_components, event_transitions)}
ORACLE |= {
    "graph_closure": SUPPLIERS + "SELECT src, dst FROM reach",
    "graph_components": SUPPLIERS + "SELECT node, component FROM comp",
    "graph_cycles": SUPPLIERS + """SELECT component, count(*) AS size, array_to_string(list_sort(list(node)), ',') AS members
FROM comp GROUP BY component HAVING count(*) > 1""",
    "graph_degrees": SUPPLIERS + """SELECT node, ca, ce, floor(ce / nullif(ca + ce, 0) * 10000 + 0.5) / 10000 AS instability FROM (
SELECT node, (SELECT count(DISTINCT src) FROM e WHERE dst = node) AS ca, (SELECT count(DISTINCT dst) FROM e WHERE src = node) AS ce FROM nodes)""",
    "graph_reach": SUPPLIERS + """SELECT node, vfi, vfo, floor(vfi / (SELECT count(*) FROM nodes) * 10000 + 0.5) / 10000 AS in_share,
floor(vfo / (SELECT count(*) FROM nodes) * 10000 + 0.5) / 10000 AS out_share FROM (
SELECT node, (SELECT count(*) FROM reach WHERE dst = node AND src <> node) AS vfi, (SELECT count(*) FROM reach WHERE src = node AND dst <> node) AS vfo FROM nodes)""",
    "graph_heights": SUPPLIERS + """, dag AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN comp x ON x.node = src JOIN comp y ON y.node = dst WHERE x.component <> y.component),
h AS (SELECT component, CAST(0 AS BIGINT) AS height FROM comp UNION SELECT dag.a, h.height + 1 FROM h JOIN dag ON dag.b = h.component)
SELECT node, max(height) AS height FROM comp JOIN h USING (component) GROUP BY node""",
    "graph_system": SUPPLIERS + """SELECT n, floor(((SELECT count(*) FROM reach WHERE src <> dst) + n) / (n * n) * 10000 + 0.5) / 10000 AS propagation_cost,
(SELECT component FROM comp GROUP BY component HAVING count(*) > 1 ORDER BY count(*) DESC, component LIMIT 1) AS core,
coalesce((SELECT count(*) FROM comp GROUP BY component HAVING count(*) > 1 ORDER BY count(*) DESC, component LIMIT 1), 0) AS core_size,
floor(coalesce((SELECT count(*) FROM comp GROUP BY component HAVING count(*) > 1 ORDER BY count(*) DESC, component LIMIT 1), 0) / n * 10000 + 0.5) / 10000 AS core_share
FROM (SELECT count(*) AS n FROM nodes)""",
    "graph_reaches": SUPPLIERS + "SELECT DISTINCT src AS node FROM reach JOIN supplier ON dst = s_suppkey WHERE s_acctbal < 0",
    "module_cycle": with_sql("module_edges") + """, nodes AS (SELECT src AS node FROM module_edges UNION SELECT dst FROM module_edges),
reach AS (SELECT src, dst FROM module_edges UNION SELECT reach.src, e.dst FROM reach JOIN module_edges e ON reach.dst = e.src),
comp AS (SELECT node, least(node, (SELECT min(a.dst) FROM reach a JOIN reach b ON a.dst = b.src AND b.dst = node WHERE a.src = node)) AS component FROM nodes)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM comp""",
    "weak_components": with_sql("uses") + """, p AS MATERIALIZED (SELECT src AS a, dst AS b FROM uses WHERE resolution = 'semantic' UNION SELECT dst, src FROM uses WHERE resolution = 'semantic'),
cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM p UNION
 SELECT p.a, min(cc.component) FROM cc JOIN p ON p.b = cc.node JOIN recurring.cc AS old ON old.node = p.a WHERE cc.component < old.component GROUP BY p.a)
SELECT node, component FROM cc""",
    "event_transitions": """WITH RECURSIVE t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
w AS (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY ALL),
reach AS (SELECT src, dst FROM w WHERE src <> dst UNION SELECT reach.src, w.dst FROM reach JOIN w ON reach.dst = w.src AND w.src <> w.dst)
SELECT src, dst, n, (SELECT count(*) FROM reach r WHERE r.src = w.src AND r.dst <> r.src) AS reaches FROM w""",
}
