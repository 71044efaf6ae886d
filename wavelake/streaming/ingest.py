"""Structured Streaming: image files as they arrive, tiles as their parts complete, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources import headers
from ..sources.raster_source import scratch


def image_headers(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, format, geometry fields) of the codestreams that arrive in a folder; only headers are read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = files.withColumn("siz", F.get(F.filter(headers.segments(F.col("content")), lambda m: m["code"] == headers.SIZ), F.lit(0)))
    return files.select("path", headers.sniff(F.col("content")).alias("format"), *headers.siz_fields(F.col("content"), F.col("siz")))


def complete_tiles(parts: DataFrame) -> DataFrame:
    """Of a stream of tile-parts (image_id, tileno, part, parts) the tiles of which all parts have come; parts may come
    in any order and more than once. Update or complete mode."""
    seen = parts.groupBy("image_id", "tileno").agg(F.collect_set("part").alias("have"), F.max("parts").alias("parts"))
    return seen.where(F.size("have") == F.col("parts")).select("image_id", "tileno", F.col("parts").cast("long").alias("parts"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, top) of a stream of events (ts, event_type, value): counts and largest values of each
    window; state is dropped when the watermark has passed a window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "top")


def run_once(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Everything that is there, through the stream: each batch's updates are written, the last of each key counts. A
    stream without any input gives no rows. State and batches lie in the folder that the cluster shares."""
    path = scratch(spark, "stream")
    done: list[str] = []

    def write(df: DataFrame, k: int) -> None:
        df.withColumn("_batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/out/{k}")
        done.append(f"{path}/out/{k}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.parquet(*done) if done else spark.createDataFrame([], StructType([*stream.schema.fields, StructField("_batch", IntegerType())]))
    rest = [c for c in out.columns if c not in [*keys, "_batch"]]
    return out.groupBy(*keys).agg(*(F.max_by(c, "_batch").alias(c) for c in rest))
