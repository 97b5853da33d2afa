"""Access logs, importance and strength of nodes and edges, decay and conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoria.functions import exprs as X


def fold_accesses(log: DataFrame, key: list[str], ts: str = "ts") -> DataFrame:
    """Access counts and last accesses of an append-only log."""
    return log.groupBy(*key).agg(F.count(F.lit(1)).alias("access_count"), F.max(ts).alias("accessed_at"))


def decay_nodes(nodes: DataFrame, half_life: float = 30.0, archive: float = 0.2, delete: float = 0.05, keep: float = 1.0) -> DataFrame:
    """Nodes (age_days, importance, access_count, state) with strength, the new state and an event.

    Only live nodes below CRITICAL decay; only those below ``keep`` importance are archived or deleted.
    """
    eligible = ~F.col("state").isin("ARCHIVED", "DELETED") & (F.col("importance") < 10)
    strength = X.node_strength("age_days", "importance", "access_count", half_life)
    weak = eligible & (F.col("importance") < keep)
    out = nodes.withColumn("strength", strength)
    event = F.when(weak & (F.col("strength") <= delete), "PRUNING").when(weak & (F.col("strength") <= archive), "DECAY")
    out = out.withColumn("event", event)
    return out.withColumn("state", F.when(F.col("event") == "PRUNING", "DELETED").when(F.col("event") == "DECAY", "ARCHIVED").otherwise(F.col("state")))


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is DELETED; a missing node isn't deleted."""
    dead = nodes.where("state = 'DELETED'").select(F.col("id").alias("__dead")).distinct()
    touched = edges.join(dead, F.col("source_id") == F.col("__dead"), "left_semi").unionByName(edges.join(dead, F.col("target_id") == F.col("__dead"), "left_semi"))
    return touched.dropDuplicates(["id"])


def decay_edges(edges: DataFrame, nodes: DataFrame, half_life: float = 30.0, delete: float = 0.05) -> DataFrame:
    """Edges (age_days, weight, confidence, state): deleted with an endpoint or when too weak; weakened below half."""
    dead = nodes.where("state = 'DELETED'").select("id").distinct()
    a, b = dead.select(F.col("id").alias("source_id"), F.lit(True).alias("__a")), dead.select(F.col("id").alias("target_id"), F.lit(True).alias("__b"))
    out = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    strength = X.edge_strength("age_days", "weight", "confidence", half_life)
    live = ~F.col("state").isin("ARCHIVED", "DELETED")
    out = out.withColumn("strength", strength)
    gone = F.col("__a").isNotNull() | F.col("__b").isNotNull() | (F.col("strength") <= delete)
    state = F.when(live & gone, "DELETED").otherwise(F.col("state"))
    weight = F.when(live & ~gone & (F.col("strength") < 0.5), F.col("weight") * F.col("strength")).otherwise(F.col("weight"))
    return out.withColumn("new_weight", weight).withColumn("state", state).drop("__a", "__b")


def conflicts(edges: DataFrame) -> DataFrame:
    """Of each (source, relation) with several targets, edges below the top priority are archived.

    Adds ``importance`` 0 and state ARCHIVED to the losers; groups with one target stay as they are.  A group's top is
    aggregated before the shuffle and joined back, so a source with a large share of the edges isn't one task.
    """
    s, r, priority = F.lower("source_id"), F.lower("relation_type"), F.coalesce(F.col("priority"), F.lit(0))
    groups = edges.groupBy(s.alias("__s"), r.alias("__r")).agg(F.min(F.lower("target_id")).alias("__a"), F.max(F.lower("target_id")).alias("__b"), F.max(priority).alias("__top")).where("__a <> __b")
    out = edges.join(groups, s.eqNullSafe(F.col("__s")) & r.eqNullSafe(F.col("__r")), "left").withColumn("lost", F.coalesce(priority < F.col("__top"), F.lit(False))).drop("__s", "__r", "__a", "__b", "__top")
    return out.withColumn("importance", F.when(F.col("lost"), 0.0).otherwise(F.col("importance"))).withColumn("state", F.when(F.col("lost"), "ARCHIVED").otherwise(F.col("state")))


def rescored(nodes: DataFrame, change: float = 2.0) -> DataFrame:
    """(id, before, after) of nodes (age_days, access_count, rank, importance) whose level changes by ``change`` or more."""
    after = X.importance_bucket(F.round(X.node_importance("age_days", "access_count", "rank", "importance"), 9))
    out = nodes.select("id", F.col("importance").alias("before"), after.alias("after"))
    return out.where(F.abs(F.col("after") - F.col("before")) >= change)


def rehydrate(nodes: DataFrame, query: list[float], threshold: float = 0.75, most: int = 100) -> DataFrame:
    """The ``most`` nodes nearest to a query vector become ACTIVE; archived ones count 10 % nearer."""
    similarity = X.cosine("embedding", F.array(*[F.lit(float(x)) for x in query]))
    out = nodes.withColumn("__sim", similarity).where(F.col("__sim") >= threshold)
    out = out.withColumn("score", F.when(F.col("state") == "ARCHIVED", F.col("__sim") * 1.1).otherwise(F.col("__sim"))).drop("__sim")
    out = out.orderBy(F.desc("score"), "id").limit(most)
    return out.withColumn("restored", F.col("state").isin("ARCHIVED", "DECAYING")).withColumn("state", F.when(F.col("restored"), "ACTIVE").otherwise(F.col("state"))).withColumn("access_count", F.col("access_count") + 1)


def rehydrate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that aren't ACTIVE and touch one of the nodes, made ACTIVE."""
    ids = nodes.select(F.col("id").alias("__id")).distinct()
    idle = edges.where("state <> 'ACTIVE'")
    touched = idle.join(ids, F.col("source_id") == F.col("__id"), "left_semi").unionByName(idle.join(ids, F.col("target_id") == F.col("__id"), "left_semi"))
    return touched.dropDuplicates(["id"]).withColumn("state", F.lit("ACTIVE"))
