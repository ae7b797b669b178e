"""Running a stream over what has arrived so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidewatch.sources.storage import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain_to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process all available input into a parquet table in shared storage and read that. Repeating the
    call with the same ``path`` continues where the last run stopped."""
    spark = stream.sparkSession
    base = path or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def drain_in_turn(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run a stream over parts of a table that arrive one after the other: each part is written, by as many tasks as it has, and
    the stream takes in what is new, from the state it left off with. A table of what has come out."""
    spark = parts[0].sparkSession
    base = scratch_path(spark, name)
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = drain_to_table(transform(spark.readStream.schema(part.schema).parquet(f"{base}/in")), name, f"{base}/out")
    return out


def drain_changes(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """As ``drain_in_turn`` for a stream in update mode: the table holds what changed in each batch, under its number, so that a
    batch that runs again overwrites its own rows."""
    spark = parts[0].sparkSession
    base = scratch_path(spark, name)
    schema = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        changes = transform(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        schema = changes.schema
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
        writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/changes/batch={batch}")).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/changes/batch=*")
