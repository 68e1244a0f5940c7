"""Queries on edits: documents after their operations, and which of many edits stand together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import edits as E
from sparkwright.sources.scratch import materialize, read_table


def document_operations(files: DataFrame) -> DataFrame:
    """For every document: its word "the" in capitals, a new first line, and its second line moved to its end."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))).cast("long")
    none, word = F.lit(None).cast("long"), F.lit(None).cast("string")

    def operation(op: str, priority: int, line=none, to_line=none, of=word, text=word) -> F.Column:
        values = {"op": F.lit(op), "line": line, "end_line": line, "to_line": to_line, "word": of, "text": text, "priority": F.lit(priority).cast("long"), "ordinal": F.col("doc_id") * 4 + priority}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    three = F.array(
        operation("rename", 0, of=F.lit("the"), text=F.lit("THE")),
        operation("replace", 1, line=one, text=F.concat(F.lit("doc "), F.col("doc_id").cast("string"))),
        operation("move", 2, line=two, to_line=n + 1),
    )
    return files.select("file", F.explode(three).alias("o")).select("file", "o.*")


def edited_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Digest and length of every document after its operations; those that collide with an earlier one are left out."""
    d = read_table(spark, folder, "documents").select("doc_id", F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    edits = E.together(materialize(E.lowered(document_operations(d), d)))
    return E.applied(d, edits).select(F.col("file").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def overlapping_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a part as edits on days; of those that overlap, the urgent and then the earlier stays."""
    day = F.datediff("l_shipdate", F.lit("1990-01-01")).cast("long")
    ordinal = F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    e = read_table(spark, folder, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("file"), day.alias("start"), F.col("l_linenumber").cast("long").alias("priority"), ordinal.alias("ordinal"))
    e = e.groupBy("file", "priority", "ordinal").agg(F.min("start").alias("start")).select("file", "start", (F.col("start") + 120).alias("end"), "priority", "ordinal")
    return E.together(materialize(e))


QUERIES = {"edited_documents": edited_documents, "overlapping_edits": overlapping_edits}
ORACLE = {
    "edited_documents": r"""WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+$') AS l FROM documents),
r AS (SELECT doc_id, l, len(l) AS n, list_transform(l, lambda x: array_to_string(list_transform(regexp_extract_all(x, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+'), lambda w: CASE WHEN w = 'the' THEN 'THE' ELSE w END), '')) AS r FROM l),
t AS (SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE concat(CASE WHEN l[1] <> r[1] THEN r[1] ELSE 'doc ' || doc_id || chr(10) END, CASE WHEN n = 2 OR (n > 2 AND l[2] <> r[2]) THEN r[2] ELSE '' END, array_to_string(r[3:], ''),
 CASE WHEN n > 2 AND l[2] = r[2] THEN l[2] ELSE '' END) END AS text FROM r)
SELECT doc_id, length(text) AS n_chars, sha256(text) AS sha256 FROM t""",
    "overlapping_edits": """WITH RECURSIVE e AS (SELECT 'p' || l_partkey AS file, CAST(l_linenumber AS BIGINT) AS priority, l_orderkey * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordinal, min(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))) AS s FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY priority, ordinal) AS i FROM e),
g AS (SELECT file, priority, ordinal, s, i, true AS keep, [s] AS taken FROM o WHERE i = 1
 UNION ALL SELECT o.file, o.priority, o.ordinal, o.s, o.i, len(list_filter(g.taken, lambda t: abs(t - o.s) < 120)) = 0, CASE WHEN len(list_filter(g.taken, lambda t: abs(t - o.s) < 120)) = 0 THEN list_append(g.taken, o.s) ELSE g.taken END
 FROM g JOIN o ON o.file = g.file AND o.i = g.i + 1)
SELECT file, s AS start, s + 120 AS "end", priority, ordinal FROM g WHERE keep""",
}
