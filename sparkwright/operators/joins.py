"""Joins on order: as-of, containing interval, prefix, division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.sources.scratch import materialize


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, width: Column, forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with ``value`` of the nearest row of ``right`` at or before (``forward``: after) it in ``on``.

    ``width`` maps ``on`` to an ordered stretch, so that one key's rows are dealt to many tasks: within a stretch a window
    finds the nearest row, and where it has none the last one of the nearest earlier stretch, one row per stretch, stands in.
    Among rows at the same place the greatest value counts.
    """
    order = F.col(on)
    side = F.lit(1 if strict == forward else 0)
    other = F.lit(0 if strict == forward else 1)
    r = right.groupBy(*by, on).agg(F.max(value).alias("_v"))
    both = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_left", F.lit(True)).withColumn("_side", side)
    both = both.unionByName(r.withColumn("_left", F.lit(False)).withColumn("_side", other), allowMissingColumns=True).withColumn("_part", width)
    direction = (lambda c: c.desc()) if forward else (lambda c: c.asc())
    place = F.struct(order.alias("o"), "_side")
    inner = Window.partitionBy(*by, "_part").orderBy(direction(order), direction(F.col("_side"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_near", F.last("_v", ignorenulls=True).over(inner))
    stretch = both.groupBy(*by, "_part").agg((F.min_by if forward else F.max_by)("_v", F.when(F.col("_v").isNotNull(), place)).alias("_edge"))
    outer = Window.partitionBy(*by).orderBy(direction(F.col("_part"))).rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.withColumn("_carried", F.last("_edge", ignorenulls=True).over(outer)).drop("_edge")
    joined = both.where("_left").join(stretch, [*by, "_part"])
    return joined.select(*left.columns, F.coalesce("_near", "_carried").alias(value))


def innermost(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, name: str, width: int) -> DataFrame:
    """``points`` with the ``name`` of the span around them that starts last, null if none; both ends belong to a span.

    Spans are listed under every stretch of ``width`` that they touch, points under theirs, so the join is one of equality.
    """
    p = points.withColumn("_cell", F.floor(F.col(at) / width)).withColumn("_row", F.monotonically_increasing_id())
    s = spans.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_cell"))
    met = p.join(s, [*by, "_cell"], "left")
    inside = (F.col("_s") <= F.col(at)) & (F.col("_e") >= F.col(at))
    found = met.groupBy("_row", *points.columns).agg(F.max_by(name, F.when(inside, F.struct("_s", F.col(name).alias("_n")))).alias(name))
    return found.select(*points.columns, name)


def provides_all(required: DataFrame, provided: DataFrame, need: str, owner: str, item: str) -> DataFrame:
    """Relational division: (need, owner) where the owner provides every item of the need.

    Owners come to a need by its rarest item, and by the second rarest one most of them go again; only those that are left are
    held against all its items.
    """
    r = required.select(need, item).distinct()
    p = materialize(provided.select(owner, item).distinct())
    common = r.join(p.groupBy(item).agg(F.count("*").alias("_owners")), item, "left").withColumn("_owners", F.coalesce("_owners", F.lit(0)))
    sorted_items = F.array_sort(F.collect_list(F.struct("_owners", F.col(item).alias("_item"))))
    wanted = materialize(common.groupBy(need).agg(sorted_items.alias("_items")).where(F.get("_items", F.lit(0))["_owners"] > 0))
    seeds = wanted.select(need, F.get("_items", F.lit(0))["_item"].alias(item), F.get("_items", F.lit(1))["_item"].alias("_second"))
    met = seeds.join(p, item).select(need, owner, "_second")
    second = met.where("_second is not null").withColumnRenamed("_second", item).join(p, [owner, item], "left_semi")
    left = materialize(met.where("_second is null").select(need, owner).union(second.select(need, owner)))
    asked = left.join(wanted, need).select(need, owner, F.size("_items").alias("_n"), F.explode("_items._item").alias(item))
    return asked.join(p, [owner, item]).groupBy(need, owner, "_n").agg(F.count("*").alias("_m")).where("_m = _n").select(need, owner)


def credited(tests: DataFrame, symbols: DataFrame, by: list[str]) -> DataFrame:
    """Tests (test, rest) to symbols (symbol, key): rest is the key, or goes on after it and an underscore.

    The first word is an equality key, so names are compared within it only. The longest key wins.
    """
    head = lambda c: F.substring_index(c, "_", 1)
    t = tests.withColumn("_head", head("rest"))
    s = symbols.withColumn("_head", head("key"))
    exact = F.col("rest") == F.col("key")
    met = t.join(s, [*by, "_head"]).where(exact | F.col("rest").startswith(F.concat("key", F.lit("_"))))
    best = met.groupBy("test", *by).agg(F.max_by(F.struct("symbol", exact.alias("exact")), F.struct(F.length("key"), "symbol")).alias("b"))
    return best.select("test", *by, "b.symbol", "b.exact")
