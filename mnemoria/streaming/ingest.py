"""Structured Streaming: documents from files or Kafka into an engine, and access logs folded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DOCUMENT = "doc_id string, text string, content string"


def from_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """JSON lines that appear in a folder; ``content`` stands in for a missing ``text``."""
    raw = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", per_trigger).json(path)
    return raw.select("doc_id", F.coalesce("text", "content").alias("text"))


def from_kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1000) -> DataFrame:
    """JSON documents of a Kafka topic from its beginning; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    doc = F.from_json(F.col("value").cast("string"), DOCUMENT)
    return raw.select(F.coalesce(doc["doc_id"], F.col("key").cast("string")).alias("doc_id"), F.coalesce(doc["text"], doc["content"]).alias("text"))


def to_kafka(docs: DataFrame, servers: str, topic: str) -> None:
    docs.select(F.col("doc_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def run(engine, docs: DataFrame, checkpoint: str, every: str | None = "5 seconds", communities: bool = False) -> StreamingQuery:
    """Every micro-batch is ingested; with ``every`` None, what is there is taken and the query ends.

    Ingestion is an upsert by key, so a batch that is repeated after a failure changes nothing twice.
    """
    out = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: engine.ingest(batch, communities=communities))
    return (out.trigger(availableNow=True) if every is None else out.trigger(processingTime=every)).start()


def folded_accesses(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, id, access_count, accessed_at) of an access log (id, ts), final once ``late`` has passed."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("accessed_at"))
