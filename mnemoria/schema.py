"""Tables of a memory graph.  (user_id, memory_id) is the tenant and leads every table."""

from __future__ import annotations

from pyspark.sql import types as T

IMPORTANCE = {"CRITICAL": 10.0, "VERY_HIGH": 8.0, "HIGH": 6.0, "MEDIUM": 5.0, "LOW": 3.0, "VERY_LOW": 1.0, "EPHEMERAL": 0.0}
STATES = ("ACTIVE", "CONSOLIDATING", "DECAYING", "ARCHIVED", "DELETED")
EVENTS = ("CONSOLIDATION", "DECAY", "REINFORCEMENT", "SYNTHESIS", "REHYDRATION", "PRUNING", "CREATION")
TENANT = ["user_id", "memory_id"]


_TEXTS = T.ArrayType(T.StringType())
_KINDS = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "texts": _TEXTS, "vector": T.ArrayType(T.FloatType()), "map": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """``name kind, ...``; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(","))])


NODES = _schema(
    "user_id string, memory_id string, id string, name string, entity_type string, description string, canonical_name string, aliases texts,"
    "embedding vector, properties map, source_chunks texts, occurrence_count long, importance double, state string,"
    "created_at timestamp, updated_at timestamp, accessed_at timestamp, access_count long"
)
EDGES = _schema(
    "user_id string, memory_id string, id string, source_id string, target_id string, relation_type string, description string, weight double, confidence double,"
    "priority long, importance double, state string, valid_from timestamp, valid_until timestamp, created_at timestamp, updated_at timestamp, accessed_at timestamp,"
    "access_count long, properties map"
)
CLUSTERS = _schema("user_id string, memory_id string, cluster_id long, summary string, entities texts, edges texts, importance double, coherence_score double, density double, algorithm string")
CHUNKS = _schema("doc_id string, chunk_index int, content string, start_char int, end_char int, modality string, metadata map")
EVENT_LOG = _schema("id string, evolution_type string, user_id string, memory_id string, affected_nodes texts, affected_edges texts, before map, after map, reason string, ts timestamp")
CACHE = _schema("key string, user_id string, memory_id string, value string, expires_at timestamp")
ACCESSES = _schema("user_id string, memory_id string, id string, ts timestamp")
TABLES = {"accesses": ACCESSES, "nodes": NODES, "edges": EDGES, "clusters": CLUSTERS, "events": EVENT_LOG, "cache": CACHE}
KEYS = {"accesses": ["id", "ts"], "nodes": ["id"], "edges": ["id"], "clusters": ["cluster_id"], "events": ["id"], "cache": ["key"]}
