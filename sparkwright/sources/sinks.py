"""Findings as reports: SARIF, grouped JSON lines, and training rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of the SARIF format.
LEVELS = {"error": "error", "warn": "warning", "info": "note"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result a finding (rule, severity, file, line, message, fingerprint, suppressed) as JSON, in report order."""
    level = F.lit(None).cast("string")
    for severity, name in LEVELS.items():
        level = F.when(F.col("severity") == severity, name).otherwise(level)
    region = F.struct(F.col("line").cast("int").alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    suppressions = F.when(F.col("suppressed"), F.array(F.struct(F.lit("external").alias("kind"))))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("finding/v1")).alias("partialFingerprints"), suppressions.alias("suppressions"))
    return findings.select("rule", "file", "line", F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str) -> None:
    """A SARIF 2.1.0 log as one run: the results stay distributed as text files of a log each, which readers take together.

    Without any finding there is one log whose run has no results, as a run that found nothing is one too.
    """
    rows = sarif_results(findings).repartitionByRange("file", "line").sortWithinPartitions("file", "line", "rule")
    head = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + '}},"results":['

    def wrap(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([(head if first and i == 0 else ",") + v for i, v in enumerate(values)])], names=["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]}]}"])], names=["value"])

    if rows.isEmpty():
        findings.sparkSession.createDataFrame([(head + "]}]}",)], "value string").coalesce(1).write.text(path)
    else:
        rows.select("result").mapInArrow(wrap, "value string").write.text(path)


def training_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows as canonical JSON (fields by name) in the order of their key, with the SHA-256 that names each."""
    body = F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))))
    return rows.select(F.col(key).alias("key"), body.alias("value")).withColumn("sha256", F.sha2("value", 256)).orderBy("key")
