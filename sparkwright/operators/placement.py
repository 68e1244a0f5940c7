"""Where a declaration belongs: wrappers, held types, load order, and the module that it is closest to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.stats import rate, share
from sparkwright.operators.graphs import condensed, strong_components
from sparkwright.sources.scratch import checkpoint


def forwarding(functions: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, target): private functions that use exactly one other of their module and kind, which doesn't lead back to them.

    A user and what it uses lead to each other exactly if they are in one strongly connected component.
    """
    u = uses.where("src <> dst and resolution <> 'heuristic'").select("src", "dst").distinct()
    one = u.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("target")).where("n = 1").select("id", "target")
    f = functions.select("id", "module", "kind", "visibility")
    t = functions.select(F.col("id").alias("target"), F.col("module").alias("tm"), F.col("kind").alias("tk"))
    met = one.join(f, "id").join(t, "target").where("visibility = 'private' and module = tm and kind = tk").select("id", "target")
    of = strong_components(u)
    placed = met.join(of.select(F.col("node").alias("id"), F.col("component").alias("a")), "id").join(of.select(F.col("node").alias("target"), F.col("component").alias("b")), "target")
    return placed.where("a <> b").select("id", "target")


def holders(fields: DataFrame) -> DataFrame:
    """(held, holders, cyclic): types that others of the file have fields of; a type that holds itself is a cycle."""
    e = fields.select("holder", "held").distinct()
    c = strong_components(e.select(F.col("holder").alias("src"), F.col("held").alias("dst")))
    sizes = c.join(c.groupBy("component").agg(F.count("*").alias("size")), "component").select(F.col("node").alias("held"), "size")
    own = e.where("holder = held").select("held").withColumn("own", F.lit(True))
    counted = e.groupBy("held").agg(F.count_if(F.col("holder") != F.col("held")).alias("holders"))
    return counted.join(sizes, "held").join(own, "held", "left").select("held", "holders", ((F.col("size") > 1) | F.coalesce("own", F.lit(False))).alias("cyclic"))


def load_needs(uses: DataFrame, at_load: Column) -> DataFrame:
    """(src, needs): what a symbol needs while it loads: its load-time uses and all that the functions called there use."""
    first = checkpoint(uses.where(at_load).select("src", "dst").distinct())
    found = condensed(uses.select("src", "dst"), first.select(F.col("dst").alias("node")))
    of = found.of
    placed = checkpoint(first.join(of.withColumnRenamed("node", "dst"), "dst"))
    met = placed.select("src", F.col("component").alias("a")).distinct().join(found.reach, "a").select("src", F.col("b").alias("component")).distinct()
    met = checkpoint(met)
    sums = met.join(found.sizes, "component").select("src", F.col("size").alias("n"))
    # a first use in none of these stands alone; a symbol that needs itself isn't counted
    alone = placed.where("src <> dst").join(met, ["src", "component"], "left_anti").select("src", F.lit(1).cast("long").alias("n"))
    itself = met.join(of.select(F.col("node").alias("src"), "component"), ["src", "component"]).select("src", F.lit(-1).cast("long").alias("n"))
    return sums.union(alone).union(itself).groupBy("src").agg(F.sum("n").alias("needs")).where("needs > 0")


def closest_module(functions: DataFrame, uses: DataFrame, least: int = 2, gain: float = 0.6) -> DataFrame:
    """(id, module, target, uses, distance, target_distance): functions that are closer to another module than to their own.

    The distance to a module is one less the share of a function's uses and users that it holds. The closest module, ties to
    the smaller name, is a target if it has ``least`` of them and is closer than the own one by ``gain`` or more.
    """
    u = uses.where("src <> dst and resolution <> 'heuristic'").select("src", "dst").distinct()
    ties = u.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(u.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()
    of = functions.select(F.col("id").alias("other"), F.col("module").alias("target"))
    n = ties.join(of, "other").groupBy("id", "target").agg(F.count("*").alias("uses"))
    n = n.withColumn("all", F.sum("uses").over(Window.partitionBy("id"))).withColumn("target_distance", 1 - F.col("uses") / F.col("all"))
    own = n.join(functions.select("id", "module"), "id")
    at_home = own.where("module = target").select("id", F.col("target_distance").alias("distance"))
    away = own.where("module <> target").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("target_distance", "target"))).where("r = 1")
    met = away.join(at_home, "id", "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
    return met.where((F.col("uses") >= least) & (F.col("distance") - F.col("target_distance") >= gain)).select("id", "module", "target", "uses", share(F.col("distance")).alias("distance"), share(F.col("target_distance")).alias("target_distance"))


def style_mix(tests: DataFrame) -> DataFrame:
    """``tests`` (file, nesting, style) with whether another style stands at the same nesting of the file."""
    w = Window.partitionBy("file", "nesting")
    return tests.withColumn("mixed", F.min("style").over(w) != F.max("style").over(w))


def takers(functions: DataFrame) -> DataFrame:
    """(type, takers): how many functions take a type among their parameters."""
    return functions.select("id", F.explode(F.array_distinct("params")).alias("type")).groupBy("type").agg(F.count("*").alias("takers"))


def parent_ties(children: DataFrame, uses: DataFrame) -> DataFrame:
    """(child, parent, reaches, called, sole): how often a child module uses its parent and is used by it, and whether the
    parent is its only user. ``uses`` is (src, dst) by module, one row a use."""
    into = uses.where("src <> dst").groupBy(F.col("dst").alias("child")).agg(F.countDistinct("src").alias("users"), F.min("src").alias("first"))
    pairs = uses.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    up = pairs.select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.col("n").alias("reaches"))
    down = pairs.select(F.col("dst").alias("child"), F.col("src").alias("parent"), F.col("n").alias("called"))
    met = children.join(up, ["child", "parent"], "left").join(down, ["child", "parent"], "left").join(into, "child", "left")
    return met.select("child", "parent", F.coalesce("reaches", F.lit(0)).alias("reaches"), F.coalesce("called", F.lit(0)).alias("called"), F.coalesce((F.col("users") == 1) & (F.col("first") == F.col("parent")), F.lit(False)).alias("sole"))


def hub_share(degrees: DataFrame) -> DataFrame:
    """With each node's share of all direct links that end at it."""
    total = degrees.agg(F.sum("ca").alias("total"))
    return degrees.crossJoin(total).select("node", share(rate(F.col("ca"), F.col("total"))).alias("share"))
