"""Measures of functions and modules over the code model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.components import connected_components
from sparkwright.functions.stats import rate, share
from sparkwright.sources.scratch import checkpoint


def _decisions(f) -> Column:
    return F.when(f["kind"].isin("if", "else-if", "loop", "catch"), F.lit(1).cast("long")).when(f["kind"] == "switch", f["arms"]).when(f["kind"] == "logic", f["operators"]).otherwise(F.lit(0).cast("long"))


def _structures(f) -> Column:
    return F.when(f["kind"].isin("if", "switch", "loop", "catch"), 1 + f["nesting"]).when(f["kind"].isin("else-if", "else", "jump", "logic", "recursion"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def cyclomatic(flow: Column) -> Column:
    """One more than the decisions of a control flow array: branches and loops 1, a switch its arms, logic its operators."""
    return F.aggregate(flow, F.lit(1).cast("long"), lambda n, f: n + _decisions(f))


def cognitive(flow: Column) -> Column:
    """Structures count one and their nesting; the rest of the flow counts one."""
    return F.aggregate(flow, F.lit(0).cast("long"), lambda n, f: n + _structures(f))


def depth(flow: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(flow, lambda f: f["nesting"])), F.lit(0).cast("long"))


def dispatcher(flow: Column) -> Column:
    """Exactly one switch and nothing else that nests."""
    return (F.size(F.filter(flow, lambda f: f["kind"] == "switch")) == 1) & (F.size(F.filter(flow, lambda f: f["kind"].isin("if", "loop", "catch"))) == 0)


def flows(rows: DataFrame) -> DataFrame:
    """(symbol, flow): the rows of a flow table as one ordered array a function; bounded by the size of a function."""
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "nesting", "arms", "operators"))).alias("flow"))


def measures(functions: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, cyclomatic, cognitive, depth, dispatcher) of every function from the rows of a flow table, by sums over them."""
    f = {c: F.col(c) for c in ("kind", "nesting", "arms", "operators")}
    kinds = lambda *of: F.count_if(F.col("kind").isin(*of))
    summed = rows.groupBy(F.col("symbol").alias("id")).agg(
        F.sum(_decisions(f)).alias("cyclomatic"), F.sum(_structures(f)).alias("cognitive"), F.max("nesting").alias("depth"),
        ((kinds("switch") == 1) & (kinds("if", "loop", "catch") == 0)).alias("dispatcher"),
    )
    zero = F.lit(0).cast("long")
    return functions.select("id").join(summed, "id", "left").select(
        "id", (1 + F.coalesce("cyclomatic", zero)).alias("cyclomatic"), F.coalesce("cognitive", zero).alias("cognitive"),
        F.coalesce("depth", zero).alias("depth"), F.coalesce("dispatcher", F.lit(False)).alias("dispatcher"),
    )


def fans(functions: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): distinct callers of the same module outside tests, and distinct callees; heuristic uses don't count."""
    u = uses.where("resolution <> 'heuristic' and src <> dst").select("src", "dst").distinct()
    where = functions.select("id", "module", "test")
    callers = u.join(where.select(F.col("id").alias("src"), F.col("module").alias("sm"), F.col("test").alias("st")), "src").join(where.select(F.col("id").alias("dst"), F.col("module").alias("dm")), "dst")
    into = callers.where("sm = dm and not st").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    out = u.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    zero = F.lit(0)
    return functions.select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def envy(functions: DataFrame, uses: DataFrame, least: int = 2) -> DataFrame:
    """(id, target, members): the one other type of which a function uses most members; ties go to the smaller type."""
    u = uses.where("resolution <> 'heuristic'").select("src", "dst").distinct()
    of = functions.select("id", "owner")
    met = u.join(of.select(F.col("id").alias("src"), F.col("owner").alias("own")), "src").join(of.select(F.col("id").alias("dst"), F.col("owner").alias("target")), "dst")
    counted = met.where("target is not null and not (own <=> target)").groupBy(F.col("src").alias("id"), "target").agg(F.count("*").alias("members"))
    best = Window.partitionBy("id").orderBy(F.desc("members"), "target")
    return counted.where(F.col("members") >= least).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def receiver_affinity(functions: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, owner): private functions all of whose callers are methods of one owner."""
    u = uses.where("resolution <> 'heuristic' and src <> dst").select("src", "dst").distinct()
    callers = u.join(functions.select(F.col("id").alias("src"), F.coalesce("owner", F.lit("")).alias("by")), "src")
    one = callers.groupBy(F.col("dst").alias("id")).agg(F.min("by").alias("owner"), F.max("by").alias("o2"))
    free = functions.where("kind = 'function' and visibility = 'private'").select("id")
    return one.where("owner = o2 and owner <> ''").join(free, "id", "left_semi").select("id", "owner")


def cohesion(functions: DataFrame, uses: DataFrame) -> DataFrame:
    """(owner, methods, groups): how many groups the methods of a type fall into when uses of each other or of one
    function join them."""
    methods = functions.where("owner is not null").select("id", "owner")
    u = uses.where("resolution <> 'heuristic' and src <> dst").select("src", "dst").distinct()
    own = checkpoint(u.join(methods.withColumnRenamed("id", "src"), "src").select("src", "owner", "dst"))
    direct = own.join(methods.select(F.col("id").alias("dst"), F.col("owner").alias("b")), "dst").where("owner = b").select("src", "dst")
    # what only one method of a type uses joins nothing; else its users are joined with the first of them
    shared = own.groupBy("owner", "dst").agg(F.min("src").alias("first"), F.max("src").alias("last")).where("first <> last").select("owner", "dst", "first")
    shared = own.join(shared, ["owner", "dst"]).where("src <> first").select("src", F.col("first").alias("dst"))
    found = connected_components(direct.union(shared))
    placed = methods.join(found, methods["id"] == found["node"], "left").select("owner", "id", F.coalesce("component", "id").alias("c"))
    return placed.groupBy("owner").agg(F.count("*").alias("methods"), F.countDistinct("c").alias("groups"))


def unit_rollup(functions: DataFrame, uses: DataFrame, measure: DataFrame) -> DataFrame:
    """(id, helpers, unit): a function's measure with those of private helpers that only it, or its helpers, use.

    A helper has exactly one caller, in the same module; following sole callers upwards gives a forest. Each helper adds its
    measure less one. Cycles of sole callers belong to no unit.
    """
    u = uses.where("resolution <> 'heuristic' and src <> dst").select("src", "dst").distinct()
    sole = u.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("caller")).where("n = 1")
    f = functions.select("id", "module", "visibility")
    sole = sole.join(f.where("visibility = 'private'").select("id", "module"), "id").join(f.select(F.col("id").alias("caller"), F.col("module").alias("cm")), "caller").where("module = cm").select("id", "caller")
    sole = checkpoint(sole)
    above = checkpoint(sole.select("id", F.col("caller").alias("root")))
    pairs, delta = above, above
    while not delta.isEmpty():
        up = delta.join(sole.select(F.col("id").alias("root"), F.col("caller").alias("next")), "root").select("id", F.col("next").alias("root"))
        delta = checkpoint(up.join(pairs, ["id", "root"], "left_anti").distinct())
        pairs = checkpoint(pairs.union(delta))
    pairs = pairs.where("id <> root")
    helped = pairs.join(measure.select("id", "m"), "id").groupBy(F.col("root").alias("id")).agg(F.count("*").alias("helpers"), F.sum(F.col("m") - 1).alias("more"))
    return measure.join(helped, "id", "left").select("id", F.coalesce("helpers", F.lit(0)).alias("helpers"), (F.col("m") + F.coalesce("more", F.lit(0))).alias("unit"))


def module_stats(modules: DataFrame, files: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, files, lines, declares, dependents): sums of a module's files and how many modules import it."""
    f = files.groupBy(F.col("module").alias("path")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    d = functions.groupBy(F.col("module").alias("path")).agg(F.count("*").alias("declares"))
    i = edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"))
    joined = modules.select("path").join(f, "path", "left").join(d, "path", "left").join(i, "path", "left")
    return joined.select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "lines", "declares", "dependents")))


def homonyms(types: DataFrame, name: str, place: str) -> DataFrame:
    """(name, place, others): in how many other places an exported name stands too."""
    per = types.select(name, place).distinct()
    return per.withColumn("others", F.count("*").over(Window.partitionBy(name)) - 1).where("others > 0")


def split_share(functions: DataFrame, uses: DataFrame) -> DataFrame:
    """(file, functions, methods, helpers, share): methods, and functions of the file that only they reach, of all.

    The helpers are the greatest set whose members all have callers, every caller being a method of the file or a helper.
    """
    u = uses.where("resolution <> 'heuristic' and src <> dst").select("src", "dst").distinct()
    f = functions.select("id", "file", "kind")
    calls = checkpoint(u.join(f.select(F.col("id").alias("dst"), F.col("file").alias("df"), F.col("kind").alias("dk")), "dst").where("dk = 'function'").join(f.select(F.col("id").alias("src"), F.col("file").alias("sf"), F.col("kind").alias("sk")), "src"))
    helpers = checkpoint(calls.select(F.col("dst").alias("id")).distinct())
    size = helpers.count()
    while True:
        inside = calls.join(helpers.select(F.col("id").alias("src"), F.lit(True).alias("h")), "src", "left")
        bad = inside.where("sf <> df or not (sk = 'method' or coalesce(h, false))").select(F.col("dst").alias("id")).distinct()
        helpers = checkpoint(helpers.join(bad, "id", "left_anti"))
        new = helpers.count()
        if new == size:
            break
        size = new
    h = helpers.join(f, "id").groupBy("file").agg(F.count("*").alias("helpers"))
    per = f.groupBy("file").agg(F.count("*").alias("functions"), F.count_if(F.col("kind") == "method").alias("methods"))
    return per.join(h, "file", "left").select("file", "functions", "methods", F.coalesce("helpers", F.lit(0)).alias("helpers"), share(rate(F.col("methods") + F.coalesce("helpers", F.lit(0)), F.col("functions"))).alias("share"))
