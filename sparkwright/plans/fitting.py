"""Queries on fitted models: which candidate the labelled documents support, and what it says of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.stats import fold
from sparkwright.operators import fitting
from sparkwright.sources.scratch import materialize, read_table

#: The features that a candidate reads; the first tells lengths, the second all.
CANDIDATES = [("lengths", (0, 1, 2)), ("shape", tuple(range(8)))]


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, features) of every document; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    features = [F.log1p(F.length(text)) / 10, F.log1p(F.size(words)) / 10, F.length(text) / n / 10, share("[0-9]") * 10, share("[A-Z]") * 10, share("[#*$%&|<>]") * 10, F.size(F.array_distinct(words)) / n, share(r"\n") * 10]
    return read_table(spark, folder, "documents").select("doc_id", F.array(*(f.cast("double") for f in features)).alias("features"))


def _chosen(spark: SparkSession, folder: str):
    every = materialize(document_features(spark, folder))
    labels = read_table(spark, folder, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    group = F.concat(F.lit("d"), (F.floor(F.col("doc_id") / 7)).cast("string"))
    rows = every.join(labels, "doc_id").select("label", F.lit(1.0).alias("weight"), fold(group, fitting.FOLDS).cast("int").alias("fold"), "features")
    return every, fitting.choose(rows, CANDIDATES)


def model_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold Brier score and standard error of each candidate, and which one is chosen."""
    _, (name, _, candidates) = _chosen(spark, folder)
    rows = [(c.name, c.brier, c.error, c.skipped, c.name == name) for c in candidates]
    return spark.createDataFrame(rows, "name string, brier double, error double, skipped string, chosen boolean")


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen model's probability of a good document, for every document."""
    every, (_, model, _) = _chosen(spark, folder)
    return every.select("doc_id", model.probability().alias("p"))


QUERIES = {"model_candidates": model_candidates, "model_scores": model_scores}
ORACLE: dict[str, str] = {}
