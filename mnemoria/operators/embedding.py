"""Embedding each distinct text once, against a cache of what is embedded already."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoria.functions.providers import Embedder


def text_hash(text_col: str):
    return F.substring(F.sha2(F.col(text_col), 256), 1, 16)


def distinct_texts(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, first_id, n): the hash of each distinct text, its least id and how often it occurs."""
    return rows.where(F.col(text_col).isNotNull()).groupBy(text_hash(text_col).alias("h")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))


def embed(texts: DataFrame, embedder: Embedder, key: str = "h", text_col: str = "text") -> DataFrame:
    """(key, embedding); blank texts have a null one, so rows stay aligned."""
    own = texts.select(F.col(key).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(embedder.embed(b.column("text").to_pylist()), pa.list_(pa.float32()))], ["key", "embedding"])

    return own.mapInArrow(run, f"key {own.schema['key'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("key", key)


def embed_all(rows: DataFrame, embedder: Embedder, cache: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """rows with ``embedding``: texts that the cache (h, embedding) lacks are embedded once each."""
    own = rows.withColumn("h", text_hash(text_col))
    wanted = own.where(F.col("h").isNotNull()).select("h", text_col).dropDuplicates(["h"])
    if cache is None:
        known = embed(wanted, embedder, "h", text_col)
    else:
        known = cache.select("h", "embedding").unionByName(embed(wanted.join(cache, "h", "left_anti"), embedder, "h", text_col))
    return own.join(known, "h", "left").drop("h")
