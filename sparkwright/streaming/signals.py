"""Streams: signals of users' turns, sightings of findings, and log records, each with the result of the same batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rules of signals in order: class, pattern (case ignored). Classes but none are tried first.
WORD = r"(^|[^\p{L}\p{N}_])(%s)([^\p{L}\p{N}_]|$)"
RULES = (
    ("directive", WORD % "always|never|must|don't|immer|toujours|siempre"),
    ("correction", WORD % "no|wrong|instead|nicht|pas|pero"),
    ("preference", WORD % "prefer|rather|like|lieber|plutôt"),
    ("finding", WORD % "error|bug|fails?|broken"),
    ("none", WORD % "thanks|ok|the|la|der|el"),
)
EXCERPT = 200


def _matching(pattern: str):
    return lambda sentence: sentence.rlike("(?i)" + pattern)


def classify(text: Column) -> Column:
    """struct (class, rule, excerpt) of a text: sentences without questions are tried against the rules in order."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: ~F.rtrim(s).endswith("?"))
    found = F.lit(None).cast("struct<class:string,rule:int,excerpt:string>")
    for rank, (name, pattern) in reversed(list(enumerate(RULES))):
        hit = F.get(F.filter(sentences, _matching(pattern)), F.lit(0))
        squashed = F.trim(F.regexp_replace(hit, r"\s+", " "))
        short = F.when(F.length(squashed) > EXCERPT, F.concat(F.left(squashed, F.lit(EXCERPT - 1)), F.lit("…"))).otherwise(squashed)
        found = F.when(hit.isNotNull(), F.struct(F.lit(name).alias("class"), F.lit(rank).alias("rule"), short.alias("excerpt"))).otherwise(found)
    return F.coalesce(found, F.struct(F.lit("abstain").alias("class"), F.lit(None).cast("int").alias("rule"), F.lit(None).cast("string").alias("excerpt")))


def scrub(text: Column) -> Column:
    """Secrets in an excerpt as stars."""
    for pattern in (r"AKIA[A-Z0-9]{16}", r"(?i)(password|token|secret|api_?key)\s*[:=]\s*\S+", r"[0-9a-f]{32,}"):
        text = F.regexp_replace(text, pattern, "***")
    return text


def signals(turns: DataFrame) -> DataFrame:
    """Users' turns as signals; works on a stream and on a batch alike."""
    c = classify(F.col("text"))
    return turns.where("role = 'user'").select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.class", "c.rule", scrub(F.col("c.excerpt")).alias("excerpt"))


def distinct_signals(turns: DataFrame, watermark: str) -> DataFrame:
    """Signals once by id: repeats within the watermark are dropped and their state goes with it."""
    return signals_with_time(turns).withWatermark("time", watermark).dropDuplicatesWithinWatermark(["conv_id", "turn"])


def signals_with_time(turns: DataFrame) -> DataFrame:
    c = classify(F.col("text"))
    return turns.where("role = 'user'").select("conv_id", "turn", "time", c.alias("c")).select("conv_id", "turn", "time", "c.class", "c.rule", scrub(F.col("c.excerpt")).alias("excerpt"))


def latest(sightings: DataFrame, key: str, time: str) -> DataFrame:
    """The last sighting of each key, ties to the larger row."""
    rest = [c for c in sightings.columns if c != key]
    return sightings.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("r")).select(key, "r.*")


def upsert_stream(sightings: DataFrame, path: str, key: str, time: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of last sightings: each micro-batch is merged with the version before it and written as the next.

    A batch that is retried writes the same version again, so the table holds each sighting once.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = latest(batch, key, time)
        if epoch:
            new = latest(spark.read.parquet(f"{path}/v{epoch - 1}").unionByName(new), key, time)
        new.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return sightings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").start()


def event_rates(events: DataFrame, window: str, late: str) -> DataFrame:
    """Events by window and kind; rows later than the watermark are dropped by a stream and kept by a batch."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def baseline_diff(findings: DataFrame, session: str, order: str, finding: str, edit: Column) -> DataFrame:
    """Findings of a session after its first edit that it didn't have before."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = findings.withColumn("_after", F.coalesce(F.max(edit.cast("int")).over(w), F.lit(0)) == 1)
    before = rows.where("not _after").select(session, finding).distinct()
    return rows.where("_after").select(session, finding).distinct().join(before, [session, finding], "left_anti")
