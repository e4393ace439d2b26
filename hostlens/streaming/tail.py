"""S1 and streaming Q9.

S1, the import-log tail: rows whose key is above the last seen key, and the
next cursor.  The batch form is a filter and a one-row max; the streaming form
is a file-source stream with its own checkpoint (the source tracks which files
were seen, so each file is read once even across restarts).

Q9 on a stream: event-time buckets with a watermark in append mode; a bucket
is emitted once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_rows(df: DataFrame, key: str, cursor) -> DataFrame:
    return df.where(F.col(key) > F.lit(cursor)) if cursor is not None else df


def tail_cursor(df: DataFrame, key: str, cursor) -> DataFrame:
    """Batch S1: the next cursor, always one row: the largest key of the new rows, or ``cursor`` if there is none.
    Only rows behind the cursor are read, where the source can push the filter down."""
    return new_rows(df, key, cursor).agg(F.coalesce(F.max(key), F.lit(cursor)).alias("next_cursor"))


def tail_after(df: DataFrame, key: str, cursor) -> DataFrame:
    """Batch S1: rows with ``key > cursor``, each with ``next_cursor``; with no new row there is none, and
    ``tail_cursor`` tells the cursor."""
    return new_rows(df, key, cursor).crossJoin(F.broadcast(tail_cursor(df, key, cursor)))


def tail_stream(spark: SparkSession, source_dir: str, schema: StructType, key: str, cursor,
                sink_dir: str, checkpoint_dir: str, fmt: str = "parquet") -> None:
    """Streaming S1: copy rows above ``cursor`` from a file source to a file sink
    for everything available now, then stop."""
    src = new_rows(spark.readStream.format(fmt).schema(schema).load(source_dir), key, cursor)
    q = (src.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()


def stream_time_buckets(spark: SparkSession, source_dir: str, schema: StructType, *, time_col: str,
                        host_col: str, value_col: str, seconds: int, delay: str, sink_dir: str,
                        checkpoint_dir: str, fmt: str = "parquet", pos_col: str | None = None) -> None:
    """Streaming Q9: ``withWatermark`` + ``window`` per host, append mode, file sink.  With ``pos_col``, which
    orders rows of one time, the buckets hold all five aggregations."""
    src = spark.readStream.format(fmt).schema(schema).load(source_dir)
    # watermarks need an instant type; with the session zone at UTC the wall time is unchanged
    src = src.withColumn(time_col, F.col(time_col).cast("timestamp"))
    made = [F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean_value"), F.max(value_col).alias("max_value")]
    if pos_col:
        at = F.struct(time_col, pos_col)
        made += [F.min(value_col).alias("min_value"), F.min_by(value_col, at).alias("first_value"), F.max_by(value_col, at).alias("last_value")]
    agg = src.withWatermark(time_col, delay).groupBy(F.col(host_col), F.window(F.col(time_col), f"{int(seconds)} seconds")).agg(*made)
    names = ["n", "mean_value", "max_value", *(["min_value", "first_value", "last_value"] if pos_col else [])]
    out = agg.select(host_col, F.col("window.start").alias("bucket_start"), *names)
    q = (out.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
