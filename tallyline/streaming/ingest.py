"""Incremental ingestion: an extension, since the operators themselves are batch.

Files of ledger rows are read as a stream with event time; repeated keys within the watermark are dropped by the state
store, rows that arrive weeks late are kept as long as the watermark allows, and totals per account and day are kept up
to date. ``Trigger.AvailableNow`` takes what is there and stops, so the same code serves a nightly run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.operators.ledger import MONEY


def ledger_stream(spark: SparkSession, path: str, lateness: str = "30 days") -> DataFrame:
    """New files of the ledger table, each key once within the watermark."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    at = F.col("ingested_at").cast("timestamp")
    return rows.withColumn("at", at).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["tx_id"])


def daily_totals(rows: DataFrame) -> DataFrame:
    """Rows and money by document and day of arrival, as tumbling windows."""
    bare = F.regexp_replace("amount", "[,¥]", "")
    amount = F.when(bare.rlike(MONEY), bare).try_cast("decimal(18,2)")
    counted = rows.groupBy(F.window("at", "1 day").alias("w"), F.col("source_document_id").alias("doc"))
    return counted.agg(F.count("*").alias("n_rows"), F.sum(amount).alias("total")).select("doc", F.col("w.start").alias("day"), "n_rows", "total")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is available to Parquet with exactly-once files, and stop."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
