"""Tailing the append-only judge checkpoints: a stream of records, latest per key upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rajut.sources.files import CHECKPOINT


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Records of new JSON-line files as they come, malformed lines dropped."""
    lines = spark.readStream.text(path)
    return lines.select(F.from_json("value", CHECKPOINT).alias("r")).where(F.coalesce(F.col("r.checkpoint_key"), F.lit("")) != "").select("r.*")


def upsert_to(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``table_path`` at the latest record per key; each micro-batch writes a new version folder.

    Versions make the write atomic: readers take the largest version, and a batch
    that runs again overwrites its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("checkpoint_key").agg(F.max_by(F.struct(*batch.columns), F.struct(*[F.coalesce(c, F.lit("")) for c in batch.columns])).alias("v")).select("v.*")
        old = f"{table_path}/v={number - 1}"
        if number > 0:
            kept = spark.read.schema(CHECKPOINT).parquet(old).join(new.select("checkpoint_key"), "checkpoint_key", "left_anti")
            new = kept.select(*batch.columns).unionByName(new.select(*batch.columns))
        new.write.mode("overwrite").parquet(f"{table_path}/v={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
