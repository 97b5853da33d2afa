"""Evolution of a graph: consolidate, reinforce, infer, decay, settle conflicts, score anew; with a log of each change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoria.conf import EngineConfig
from mnemoria.functions import exprs as X
from mnemoria.operators import graph, resolve, scoring
from mnemoria.operators.lineage import cut


@dataclass
class Evolution:
    nodes: DataFrame
    edges: DataFrame
    events: DataFrame


def _events(rows: DataFrame, kind, nodes, edges, before, after, reason: str, as_of) -> DataFrame:
    none = F.array().cast("array<string>")
    state = lambda c: F.create_map(F.lit("value"), c.cast("string")) if c is not None else F.create_map().cast("map<string,string>")
    out = rows.select(kind.alias("evolution_type"), (none if nodes is None else F.array(nodes.cast("string"))).alias("affected_nodes"), (none if edges is None else F.array(edges.cast("string"))).alias("affected_edges"), state(before).alias("before"), state(after).alias("after"), F.lit(reason).alias("reason"), as_of.alias("ts"))
    return out.withColumn("id", X.hash_id("evolution_type", F.concat_ws(",", "affected_nodes"), F.concat_ws(",", "affected_edges"), F.lit(reason), F.col("ts").cast("string")))


def evolve(nodes: DataFrame, edges: DataFrame, as_of, conf: EngineConfig | None = None, consolidate: bool = True, infer: bool = True) -> Evolution:
    """The graph of one tenant at ``as_of`` (a timestamp column); stages run in a fixed order.

    nodes and edges have the columns of schema.NODES and schema.EDGES.  Applied again at the same time it
    changes nothing but weights that decay.
    """
    conf = conf or EngineConfig()
    log: list[DataFrame] = []
    age = lambda c: F.greatest(F.lit(0.0), X.days_between(as_of, F.col(c)))
    if consolidate:
        pairs = resolve.consolidation_pairs(nodes, last_name=conf.consolidate_last_name, tokens=conf.consolidate_tokens, embedding=conf.consolidate_cosine)
        roots = graph.components(cut(pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))))
        groups = cut(roots.select("id", F.col("component").alias("canon")))
        merged = resolve.merge_nodes(nodes, groups).select("id", F.col("name").alias("__name"), F.col("description").alias("__d"), F.col("aliases").alias("__al"), F.col("importance").alias("__i"), F.col("access_count").alias("__ac"))
        kept = nodes.join(groups.where("id <> canon").select("id"), "id", "left_anti").join(merged, "id")
        nodes = cut(kept.withColumns({"name": F.col("__name"), "description": F.col("__d"), "aliases": F.col("__al"), "importance": F.col("__i"), "access_count": F.col("__ac")}).select(*nodes.columns))
        edges = resolve.rewire(edges, groups)
        log.append(_events(groups.where("id <> canon"), F.lit("CONSOLIDATION"), F.col("id"), None, F.col("id"), F.col("canon"), "merged", as_of))
    strong = resolve.reinforce(edges).select(F.col("id").alias("__id"), F.col("weight").alias("__w"), F.col("confidence").alias("__c"), "n")
    edges = cut(edges.join(strong, F.col("id") == F.col("__id")).withColumns({"weight": F.col("__w"), "confidence": F.col("__c")}))
    log.append(_events(edges.where("n > 1"), F.lit("REINFORCEMENT"), None, F.col("id"), None, F.col("weight"), "repeated", as_of))
    edges = edges.drop("__id", "__w", "__c", "n")
    if infer:
        new = resolve.transitive(edges).withColumns({"id": X.hash_id("source_id", "relation_type", "target_id"), "importance": F.lit(5.0), "state": F.lit("ACTIVE"), "access_count": F.lit(0).cast("long"), "created_at": as_of, "updated_at": as_of, "accessed_at": as_of}).drop("via")
        tenant = nodes.select("user_id", "memory_id").limit(1)
        new = cut(new.crossJoin(F.broadcast(tenant)))
        edges = edges.unionByName(new, allowMissingColumns=True)
        log.append(_events(new, F.lit("SYNTHESIS"), None, F.col("id"), None, F.col("confidence"), "inferred", as_of))
    before = nodes.withColumn("age_days", age("accessed_at"))
    decayed = cut(scoring.decay_nodes(before, conf.half_life_days, conf.archive_strength, conf.delete_strength, conf.keep_importance))
    log.append(_events(decayed.where("event is not null"), F.col("event"), F.col("id"), None, F.col("strength"), F.col("state"), "forgotten", as_of))
    weak = cut(scoring.decay_edges(edges.withColumn("age_days", age("accessed_at")), decayed, conf.half_life_days, conf.delete_strength))
    edges = weak.withColumn("weight", F.col("new_weight")).drop("new_weight", "strength", "age_days")
    named = edges.join(decayed.select(F.col("id").alias("source_id"), F.col("name").alias("__src")), "source_id", "left")
    named = named.withColumns({"__sid": F.col("source_id"), "source_id": F.coalesce("__src", "source_id")})
    settled = cut(scoring.conflicts(named).withColumn("source_id", F.col("__sid")).drop("__sid", "__src"))
    log.append(_events(settled.where("lost"), F.lit("DECAY"), None, F.col("id"), None, F.col("state"), "superseded", as_of))
    edges = settled.drop("lost")
    rank = graph.pagerank(decayed, edges)
    scored = decayed.join(rank, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    changed = cut(scoring.rescored(scored))
    log.append(_events(changed, F.lit("REINFORCEMENT"), F.col("id"), None, F.col("before"), F.col("after"), "scored", as_of))
    level = X.importance_bucket(F.round(X.node_importance("age_days", "access_count", "rank", "importance"), 9))
    nodes = scored.withColumn("importance", F.when(F.col("state").isin("ARCHIVED", "DELETED") | (F.col("importance") >= 10), F.col("importance")).otherwise(level)).withColumn("updated_at", as_of).select(*nodes.columns)
    events = log[0]
    for more in log[1:]:
        events = events.unionByName(more)
    return Evolution(cut(nodes), cut(edges), events)
