"""Documents to nodes and edges: chunks, extraction, resolution, endpoints, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoria.conf import EngineConfig
from mnemoria.functions import exprs as X
from mnemoria.functions import text as N
from mnemoria.functions.providers import Embedder, Extractor
from mnemoria.operators import chunking, embedding, extraction, resolve
from mnemoria.operators.lineage import cut


def extract(docs: DataFrame, extractor: Extractor, conf: EngineConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, content, response, error) of every chunk of every valid document."""
    valid = docs.where(X.valid_text(text_col))
    chunks = chunking.sentences(valid, conf.chunk_size, conf.chunk_overlap, id_col, text_col)
    return extraction.call(chunks, extractor, conf.max_triplets, conf.max_retries)


def graph_of(docs: DataFrame, extractor: Extractor, embedder: Embedder, conf: EngineConfig, as_of, id_col: str = "doc_id", text_col: str = "text", coreferences: Extractor | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, failures) of documents for the configuration's tenant.

    Mentions of one entity are merged; an edge's priority is that of the numbered fact it comes from.
    """
    said = cut(extract(docs, extractor, conf, id_col, text_col))
    keep = ["doc_id", "chunk_index"]
    entities, relations = extraction.parsed(said, keep)
    mentions = entities.join(said.select(*keep, "content"), keep)
    mentions = mentions.select(
        F.concat_ws("/", "doc_id", F.format_string("%06d", "chunk_index"), F.format_string("%06d", "line_no")).alias("id"), "name", "entity_type", "description", "aliases", F.array("content").alias("source_chunks"),
    ).withColumn("about", F.concat_ws(": ", "name", "description"))
    mentions = cut(embedding.embed_all(mentions, embedder, None, "about").drop("about"))
    owner = resolve.resolve(mentions, least_token=conf.resolve_token, least_fuzzy=conf.resolve_fuzzy, least_embedding=conf.resolve_embedding)
    merged = resolve.merge_entities(mentions.join(owner, "id"), ["entity_id"])
    types = mentions.join(owner, "id").groupBy("entity_id").agg(F.min_by("entity_type", "id").alias("entity_type"))
    tenant = {"user_id": F.lit(conf.user_id), "memory_id": F.lit(conf.memory_id)}
    stamp = {c: as_of for c in ("created_at", "updated_at", "accessed_at")}
    node_id = N.entity_key("name")
    nodes = merged.join(types, "entity_id").withColumns({"id": X.hash_id(node_id, F.lower("entity_type")), "canonical_name": F.col("name"), "importance": F.lit(5.0), "state": F.lit("ACTIVE"), "access_count": F.lit(0).cast("long"), **tenant, **stamp}).drop("entity_id", "first_id")
    nodes = resolve.latest(nodes, ["id"], ("occurrence_count",))
    if coreferences is not None:
        links = extraction.parse_coreferences(extract(docs, coreferences, conf, id_col, text_col), keep)
        nodes = resolve.apply_coreferences(nodes, links).drop("coreference")
    nodes = cut(nodes)
    order = extraction.fact_order(docs.where(X.valid_text(text_col)).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")))
    relations = extraction.fact_priority(relations, order, "doc_id")
    edges = relations.select(
        X.hash_id("source", "relation_type", "target").alias("id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relation_type", "description", "priority",
        N.temporal_timestamp("valid_from").alias("valid_from"), N.temporal_timestamp("valid_until").alias("valid_until"),
    )
    edges = resolve.latest(edges, ["id"], ("priority",)).withColumns({"weight": F.lit(1.0), "confidence": F.lit(1.0), "importance": X.priority_importance("priority").cast("double"), "state": F.lit("ACTIVE"), "access_count": F.lit(0).cast("long"), **tenant, **stamp})
    edges = cut(resolve.resolve_endpoints(edges, nodes).where("source_id <> target_id"))
    return nodes, edges, said.where("error is not null").select(*keep, "error")


def merge_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """New nodes with the counters and creation of the known ones they replace, whose aliases and chunks they keep.

    Mentions in chunks that the known node has already don't count again, so a repeated document changes no count.
    """
    none = F.array().cast("array<string>")
    old = known.select("id", F.col("access_count").alias("__a"), F.col("created_at").alias("__c"), F.col("aliases").alias("__al"), F.col("occurrence_count").alias("__o"), F.col("importance").alias("__i"), F.coalesce("source_chunks", none).alias("__s"))
    out = new.join(old, "id", "left").withColumns({"__s": F.coalesce("__s", none), "__n": F.array_distinct(F.coalesce("source_chunks", none))})
    share = F.when(F.size("__n") > 0, F.size(F.array_except("__n", "__s")) / F.size("__n")).otherwise(1.0)
    return out.withColumns({
        "access_count": F.col("access_count") + F.coalesce("__a", F.lit(0)), "created_at": F.coalesce("__c", "created_at"), "importance": F.greatest("importance", F.coalesce("__i", F.lit(0.0))),
        "aliases": F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("__al", none)))), "source_chunks": F.array_union("__s", "__n"),
        "occurrence_count": F.round(F.col("occurrence_count") * share).cast("long") + F.coalesce("__o", F.lit(0)),
    }).drop("__a", "__c", "__al", "__o", "__i", "__s", "__n")
