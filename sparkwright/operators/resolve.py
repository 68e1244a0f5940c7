"""Names of a code model to symbols: targets of edges, duplicates, and maps back to users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_by(symbols: DataFrame, key: str) -> DataFrame:
    """(key, id) for keys that exactly one id has."""
    return symbols.groupBy(key).agg(F.min("id").alias("_id"), F.max("id").alias("_last")).where("_id = _last").select(key, "_id")


def resolve_targets(edges: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """``edges`` with (target, how, ambiguous): what their ``to`` names, by the first rule that fits.

    Rules in order: an id; a module; an id without its kind, if one symbol has it; the same among what can be called; a plain
    name that one symbol has. Else the text stays a path. ambiguous: some symbol has the text but not one alone.
    """
    s = symbols.select("id", F.substring_index("id", "#", 1).alias("bare"), "name", "kind")
    rules = [
        ("id", s.select(F.col("id").alias("to"), F.col("id").alias("t_id")).distinct()),
        ("module", modules.select(F.col("path").alias("to"), F.col("path").alias("t_module")).distinct()),
        ("bare", unique_by(s, "bare").select(F.col("bare").alias("to"), F.col("_id").alias("t_bare"))),
        ("callable", unique_by(s.where(F.col("kind").isin("function", "method")), "bare").select(F.col("bare").alias("to"), F.col("_id").alias("t_callable"))),
        ("name", unique_by(s, "name").select(F.col("name").alias("to"), F.col("_id").alias("t_name"))),
    ]
    out = edges
    for _, table in rules:
        out = out.join(table, "to", "left")
    known = s.select(F.col("bare").alias("to")).union(s.select(F.col("name").alias("to"))).distinct().withColumn("_known", F.lit(True))
    out = out.join(known, "to", "left")
    target = F.coalesce(*(F.col(f"t_{n}") for n, _ in rules))
    how = F.lit("path")
    for n, _ in reversed(rules):
        how = F.when(F.col(f"t_{n}").isNotNull(), n).otherwise(how)
    return out.select(*edges.columns, F.coalesce(target, F.col("to")).alias("target"), how.alias("how"), (target.isNull() & F.coalesce("_known", F.lit(False))).alias("ambiguous"))


def dedup_edges(edges: DataFrame, key: list[str], site: str, order: str) -> DataFrame:
    """One edge a key, with the site that comes first."""
    return edges.groupBy(*key).agg(F.min_by(site, F.struct(order, site)).alias(site))


def users(uses: DataFrame, references: bool = False) -> DataFrame:
    """(id, users): the distinct users of a symbol, ascending; guesses count as references only."""
    u = uses.where("src <> dst") if references else uses.where("src <> dst and resolution <> 'heuristic'")
    return u.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("users"))


def duplicates(rows: DataFrame, key: str, place: str, show: int = 3) -> DataFrame:
    """(key, places, examples): keys in more than one place, with the first few places."""
    found = rows.select(key, place).distinct().groupBy(key).agg(F.count("*").alias("places"), F.array_sort(F.collect_set(place)).alias("all"))
    return found.where("places > 1").select(key, "places", F.slice("all", 1, show).alias("examples"))
