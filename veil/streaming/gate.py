"""Every record is checked before it leaves a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veil.operators.verify import gate, write_gated


def gate_stream(df: DataFrame, body: str = "body", known: str | None = None) -> DataFrame:
    """Stateless verdict per record."""
    return gate(df, body, known)


def start_gate(df: DataFrame, keys: list[str], allowed_path: str, quarantine_path: str, manifest_path: str, checkpoint: str, body: str = "body",
               known: str | None = None) -> StreamingQuery:
    """Allowed bodies to one sink, value-free reasons to the other, and a batch into the manifest once both are written.

    Each batch has folders of its own, replaced when it is replayed after a failure, so nothing is written twice; a batch that broke off
    between the two sinks is in no manifest, and ``committed`` does not show it.
    """
    def write(batch: DataFrame, number: int) -> None:
        write_gated(batch, keys, f"{allowed_path}/batch={number}", f"{quarantine_path}/batch={number}", body, "overwrite")
        batch.sparkSession.range(1).selectExpr("true AS written").write.mode("overwrite").parquet(f"{manifest_path}/batch={number}")

    return gate_stream(df, body, known).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str, manifest_path: str) -> DataFrame:
    """The rows of one sink whose batches are whole, with their ``batch``. The manifest has one row a batch."""
    return spark.read.parquet(path).join(spark.read.parquet(manifest_path).select("batch"), "batch", "left_semi")
