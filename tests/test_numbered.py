"""The model by numbers: the same rows as by ids, also where ids collide or are null, and one pass for a whole check."""

from pyspark.sql import functions as F

from sparkwright.operators.decisions import Decision, check, violations
from sparkwright.plans import placement
from sparkwright.sources.tables import Numbered, relation

FOLDER = "/root/testdata/sf0.001"


def odd_tables(spark, folder):
    """The smallest tables with parts whose ids are one, as number and name run together, and parts without name."""
    for name in ("region", "nation", "supplier", "customer", "lineitem"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    n = spark.read.parquet(f"{FOLDER}/supplier.parquet").count()
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    keys = [r[0] for r in lines.groupBy("l_partkey").count().orderBy(F.desc("count")).select("l_partkey").limit(3).collect()]
    home = next(k for k in range(3, 100) if k % n)
    # 'a' 1<home> and 'a1' <home> make one id; both stand in one file
    twin = 10 ** len(str(home)) * n + home
    named = part.withColumn("p_name", F.when(F.col("p_partkey") == keys[2], F.lit(None)).otherwise(F.col("p_name"))).where(F.col("p_partkey") != home)
    one = part.limit(1)
    extra = one.withColumn("p_partkey", F.lit(home).cast(part.schema["p_partkey"].dataType)).withColumn("p_name", F.lit(f"a{n}"))
    more = one.withColumn("p_partkey", F.lit(twin).cast(part.schema["p_partkey"].dataType)).withColumn("p_name", F.lit("a"))
    named.unionByName(extra).unionByName(more).write.parquet(f"{folder}/part.parquet")
    at = F.when(F.col("l_partkey") == keys[0], home).when(F.col("l_partkey") == keys[1], twin).otherwise(F.col("l_partkey"))
    lines.withColumn("l_partkey", at.cast(lines.schema["l_partkey"].dataType)).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")


def rows(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def test_numbers_give_the_rows_of_ids(spark, tmp_path):
    folder = str(tmp_path)
    odd_tables(spark, folder)
    f = relation(spark, folder, "functions")
    assert f.where("id is not null").groupBy("id").count().where("count > 1").count() == 1
    m = Numbered(spark, folder)
    assert rows(m.named(m.uses, "src", "dst"), "src", "dst", "resolution") == rows(relation(spark, folder, "uses"), "src", "dst", "resolution")
    assert rows(m.module_edges, "src", "dst") == rows(relation(spark, folder, "module_edges"), "src", "dst")
    by_ids = placement.P.closest_module(f, relation(spark, folder, "uses"))
    assert rows(placement.closest_module(spark, folder), *by_ids.columns) == rows(by_ids, *by_ids.columns)


def test_no_id_is_joined_where_uses_are(spark):
    """Lines are joined by numbers: no text but the kind of resolution is shuffled for uses."""
    plan = Numbered(spark, FOLDER).relation("uses")._jdf.queryExecution().executedPlan().toString()
    assert "handle_" not in plan and "p_name" not in plan


def test_violations_are_the_findings_of_each_decision(spark):
    facts = spark.createDataFrame([("a", 1, True, False, "x"), ("b", 9, False, False, None), ("c", 9, True, True, "y"), ("d", None, True, False, "z")], "id string, size int, test boolean, generated boolean, file string")
    some = [
        Decision("long", "warn", "function", "size > most", "id", (("most", "CASE WHEN test THEN 0 ELSE 5 END"),), line="1"),
        Decision("small", "info", "function", "size < most", "id", (("most", "5"),), line="1", generated=True),
        Decision("tests", "error", "test", "size > 0", "id", line="1"),
    ]
    slow = check(some, {"function": facts, "test": facts.where("test")}).select("decision", "severity", "path")
    assert rows(violations(some, facts), "decision", "severity", "path") == rows(slow, "decision", "severity", "path") != []
