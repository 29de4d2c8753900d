"""Event streams: named JSON or Parquet messages in, rows per audience out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tiffin.sources.schemas import MESSAGES


def read_events(
    spark: SparkSession, path: str, kind: str, fmt: str = "json", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of one message kind with its declared schema."""
    reader = spark.readStream.schema(MESSAGES[kind]).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def room_rows(routed: DataFrame) -> DataFrame:
    """Adds ``audience``: admins, customers or user.

    The sink is partitioned by audience. A folder per room would mean one folder
    per user; ``room`` stays a column, which readers filter on.
    """
    return routed.withColumn("audience", F.when(F.col("room").startswith("user:"), "user").otherwise(F.col("room")))


def write_by_room(routed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write routed events once per micro-batch; a replayed batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = room_rows(batch).hint("rebalance", "audience")
        rows.sortWithinPartitions("room").write.mode("overwrite").partitionBy("audience").parquet(
            f"{path}/batch={batch_id}"
        )

    return routed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run the stream over everything available and read back what it wrote.

    Append mode uses the exactly-once file sink. Update mode writes one folder per
    micro-batch with its number, so that a reader can take the newest row of a key.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    target = f"{path}/rows"
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", target).start()
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        query = writer.outputMode("update").foreachBatch(write).start()
    query.awaitTermination()
    batch = [] if mode == "append" else [StructField("batch", LongType())]
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, *batch])).parquet(target)
