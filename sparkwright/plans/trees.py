"""Queries on trees: every order with its lines as one JSON document, and what selectors find in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import trees as T
from sparkwright.sources.scratch import read_table

SELECTORS = {
    "parts": "$.lines[*].part",
    "first two": "$.lines[0,1]['qty','flag']",
    "flags": "$..flag",
    "some": "$.lines[*]?(@.flag == 'R' && @.qty != 1 || @.qty == 50).part",
    "head": "$.head.*",
    "few": "$?(@.head.status == 'F' && @..qty != 7).lines[2]..*",
}


def order_trees(spark: SparkSession, folder: str) -> DataFrame:
    li = read_table(spark, folder, "lineitem")
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_returnflag").alias("flag"))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("ls"))
    o = read_table(spark, folder, "orders").join(lines, "o_orderkey")
    body = F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("head"), F.transform("ls", lambda x: F.struct(x["part"].alias("part"), x["qty"].alias("qty"), x["flag"].alias("flag"))).alias("lines"))
    return o.select("o_orderkey", F.to_json(body).alias("body"))


def tree_select(spark: SparkSession, folder: str) -> DataFrame:
    """Per selector and order: how many nodes it selects, and their values in order."""
    found = T.found(order_trees(spark, folder), "o_orderkey", "body", SELECTORS)
    return found.withColumnRenamed("tree", "o_orderkey")


QUERIES = {"tree_select": tree_select}
ORACLE = {
    "tree_select": """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), l_returnflag) - 1 AS i, l_partkey AS part, CAST(l_quantity AS INT) AS qty, l_returnflag AS flag, o_orderstatus AS status, o_orderpriority AS priority
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
v AS (SELECT 'parts' AS selector, k, i AS p, CAST(part AS VARCHAR) AS v FROM l
 UNION ALL SELECT 'first two', k, 2 * i + j, CASE j WHEN 0 THEN CAST(qty AS VARCHAR) ELSE flag END FROM l, (VALUES (0), (1)) x(j) WHERE i < 2
 UNION ALL SELECT 'flags', k, i, flag FROM l
 UNION ALL SELECT 'some', k, i, CAST(part AS VARCHAR) FROM l WHERE flag = 'R' AND qty <> 1 OR qty = 50
 UNION ALL SELECT 'head', k, j, CASE j WHEN 0 THEN status ELSE priority END FROM l, (VALUES (0), (1)) x(j) WHERE i = 0
 UNION ALL SELECT 'few', k, j, CASE j WHEN 0 THEN CAST(part AS VARCHAR) WHEN 1 THEN CAST(qty AS VARCHAR) ELSE flag END FROM l, (VALUES (0), (1), (2)) x(j) WHERE i = 2 AND status = 'F' AND k NOT IN (SELECT k FROM l WHERE qty = 7))
SELECT selector, k AS o_orderkey, count(*) AS n, string_agg(v, ',' ORDER BY p) AS found FROM v GROUP BY selector, k""",
}
