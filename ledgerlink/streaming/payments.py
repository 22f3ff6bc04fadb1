"""Structured Streaming: duplicate payments, snapshot matching against open invoices, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tolerance import classify


def duplicate_stream(payments: DataFrame, keep: str = "30 days") -> DataFrame:
    """Payments whose fingerprint was not seen within `keep` of event time; state is evicted by the watermark. payments: ts, fingerprint, ..."""
    return payments.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["fingerprint"])


def match_stream(payments: DataFrame, invoices: DataFrame, debtors: DataFrame) -> DataFrame:
    """Tolerance bands of a payment stream against a static portfolio: every pair that fits, stateless. The first invoice is taken downstream, per payment."""
    rich = payments.join(debtors.drop("iban", "name"), "did", "left").join(invoices.select("did", "ord", "a"), "did")
    return rich.withColumn("hit", classify()).where("hit is not null").select("ts", "seq", "ord", "hit.*")


def windowed_counts(events: DataFrame, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and key; windows close when the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there, once, as a parquet table; exactly-once by the file sink's log."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
