"""Queries that run streams to their end, and their batch forms."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.sources.scratch import read_table, shared_folder
from sparkwright.streaming import signals as S

QUERIES = {}
ORACLE = {}


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = read_table(spark, folder, table).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return source.parquet(f"{folder}/{table}.parquet*")


def _finished(query) -> None:
    query.awaitTermination()


def signal_classes(spark, folder):
    """How many user turns fall into each class, by rule, with their share."""
    s = S.signals(read_table(spark, folder, "conversations"))
    total = s.agg(F.count("*").alias("total"))
    return s.groupBy("class").agg(F.count("*").alias("n")).crossJoin(total).select("class", "n", (F.floor(F.col("n") / F.col("total") * 10000 + 0.5) / 10000).alias("share"))


def signal_stream(spark, folder):
    """The same classes from a stream that is read to its end."""
    out, marks = _folder(spark, "signals"), _folder(spark, "marks")
    s = S.signals(_stream(spark, folder, "conversations"))
    _finished(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start())
    return spark.read.schema(s.schema).parquet(out).groupBy("class").agg(F.count("*").alias("n"))


def sightings(spark, folder):
    """The last event of every user and kind."""
    e = read_table(spark, folder, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("fingerprint"), "ts", "event_id")
    return S.latest(e, "fingerprint", "ts").select("fingerprint", "event_id")


def sighting_stream(spark, folder):
    """The last event of every user and kind, kept by a stream that merges batch by batch."""
    out, marks = _folder(spark, "sightings"), _folder(spark, "marks")
    e = _stream(spark, folder, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("fingerprint"), "ts", "event_id")

    def merge(batch: DataFrame, epoch: int) -> None:
        new = S.latest(batch, "fingerprint", "ts")
        if epoch:
            new = S.latest(batch.sparkSession.read.parquet(f"{out}/v{epoch - 1}").unionByName(new), "fingerprint", "ts")
        new.write.mode("overwrite").parquet(f"{out}/v{epoch}")

    query = e.writeStream.foreachBatch(merge).option("checkpointLocation", marks).trigger(availableNow=True).start()
    _finished(query)
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{out}/v{last}").select("fingerprint", "event_id")


def event_rate_stream(spark, folder):
    """Events by day and kind from a stream with a watermark, complete at its end."""
    out, marks = "rates", _folder(spark, "marks")
    import uuid

    out = "rates_" + uuid.uuid4().hex
    rates = S.event_rates(_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "40 days")
    _finished(rates.writeStream.format("memory").queryName(out).outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True).start())
    return spark.table(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def baseline_diff(spark, folder):
    """Kinds of events of a user after the first signup that there were none of before."""
    e = read_table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return S.baseline_diff(e, "user_id", "o", "event_type", F.col("event_type") == "signup")


NAMED = (signal_classes, signal_stream, sightings, sighting_stream, event_rate_stream, baseline_diff)
QUERIES |= {f.__name__: f for f in NAMED}

SIGNALS = r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split_regex(replace(replace(replace(text, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), '\n+'), lambda x: NOT ends_with(rtrim(x), '?')) AS x FROM conversations WHERE role = 'user'),
c AS (SELECT *, CASE """ + " ".join(f"WHEN len(list_filter(x, lambda y: regexp_matches(y, '(?i){p.replace(chr(39), chr(39) * 2)}'))) > 0 THEN '{n}'" for n, p in S.RULES) + " ELSE 'abstain' END AS class FROM s)\n"
ORACLE |= {
    "signal_classes": SIGNALS + "SELECT class, count(*) AS n, floor(count(*) / (SELECT count(*) FROM c) * 10000 + 0.5) / 10000 AS share FROM c GROUP BY class",
    "signal_stream": SIGNALS + "SELECT class, count(*) AS n FROM c GROUP BY class",
    "sightings": "SELECT user_id || '/' || event_type AS fingerprint, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY 1",
    "sighting_stream": "SELECT user_id || '/' || event_type AS fingerprint, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY 1",
    "event_rate_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "baseline_diff": """WITH o AS (SELECT *, coalesce(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS a FROM events)
SELECT DISTINCT user_id, event_type FROM o x WHERE a = 1 AND NOT EXISTS (SELECT 1 FROM o y WHERE y.user_id = x.user_id AND y.event_type = x.event_type AND y.a = 0)""",
}
