"""Structured Streaming: idempotent document ingest, sessions and repeat guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import store


def ingest_documents(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string, source string"):
    """Upsert new document files into a versioned store, by source and content hash; a batch that runs again changes nothing."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        w = Window.partitionBy("doc_id").orderBy(F.desc("hash"))
        new = df.withColumn("hash", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        store.publish_changes(new, target, "doc_id")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events, value) of sessions that a gap ends; works on a batch and, with its watermark, on a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def session_stream(spark: SparkSession, source: str, target: str, checkpoint: str, gap: str = "30 minutes"):
    """sessions() over event files as an available-now stream into Parquet."""
    schema = spark.read.parquet(source).schema
    out = sessions(spark.readStream.schema(schema).parquet(source), gap)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
