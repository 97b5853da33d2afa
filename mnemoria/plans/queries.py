"""One query for each operator over the driver's tables, with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoria.functions import exprs as X
from mnemoria.functions import text as N
from mnemoria.operators import chunking, embedding, evaluate, extraction, graph, resolve, retrieve, scoring, temporal, vectors
from mnemoria.sources import documents as D
from mnemoria.sources import projection as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c):
    return F.round(X.col(c), 6)


table = P.table

# --- tenants, predicates, counts


@query(f"with {P.HIERARCHY}, n as (select id from hn where user_id is null or user_id = 'u1') select id, source_id, target_id from he where source_id in (select id from n) and target_id in (select id from n)")
def tenant_scope(spark, sf):
    nodes = P.hierarchy_nodes(spark, sf).where(X.in_tenant("u1"))
    return graph.within_nodes(P.hierarchy_edges(spark, sf), nodes).select("id", "source_id", "target_id")


@query(f"with {P.HIERARCHY} select id, importance, state from he where importance <> 0 and state not in ('ARCHIVED', 'DELETED')")
def live_edges(spark, sf):
    return P.hierarchy_edges(spark, sf).where(X.live_edge()).select("id", "importance", "state")


@query("select doc_id, length(text) as n from documents where regexp_matches(coalesce(text, ''), '\\S')")
def valid_docs(spark, sf):
    return table(spark, sf, "documents").where(X.valid_text("text")).select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"with {P.HIERARCHY} select coalesce(user_id, 'shared') as owner, count(*) as n_nodes, count(distinct entity_type) as n_types, count(*) filter (state = 'ARCHIVED') as n_archived from hn group by 1")
def memory_stats(spark, sf):
    return P.hierarchy_nodes(spark, sf).groupBy(F.coalesce("user_id", F.lit("shared")).alias("owner")).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("entity_type").alias("n_types"), F.count_if(F.col("state") == "ARCHIVED").alias("n_archived"))


@query(f"with {P.HIERARCHY} select entity_type, importance, count(*) as n from hn group by 1, 2")
def importance_distribution(spark, sf):
    return P.hierarchy_nodes(spark, sf).groupBy("entity_type", "importance").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {P.HIERARCHY} select entity_type, count(*) as n, count(*) filter (state = 'ACTIVE') as n_active, count(*) filter (state = 'ARCHIVED') as n_archived, count(*) filter (state = 'DELETED') as n_deleted, round(avg(importance), 6) as mean_importance from hn group by 1")
def evolution_stats(spark, sf):
    of = lambda s: F.count_if(F.col("state") == s)
    return P.hierarchy_nodes(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), of("ACTIVE").alias("n_active"), of("ARCHIVED").alias("n_archived"), of("DELETED").alias("n_deleted"), r6(F.avg("importance")).alias("mean_importance"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def upsert_latest(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return resolve.latest(rows, ["o_custkey"], ("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


# --- time

T0 = "1998-06-01"


@query(f"with {P.FACTS} select id, source_id, target_id from fa where valid_from <= timestamp '{T0}' and (valid_until is null or valid_until >= timestamp '{T0}')")
def edges_at_time_closed(spark, sf):
    return temporal.edges_at(P.facts(spark, sf), F.lit(T0).cast("timestamp")).select("id", "source_id", "target_id")


@query(f"with {P.FACTS} select id, source_id, target_id from fa where valid_from <= timestamp '{T0}' and (valid_until is null or valid_until > timestamp '{T0}')")
def edges_at_time_halfopen(spark, sf):
    return temporal.edges_at(P.facts(spark, sf), F.lit(T0).cast("timestamp"), "halfopen", "has_priority").select("id", "source_id", "target_id")


@query(
    f"with {P.FACTS}, i as (select unnest(generate_series(date_trunc('year', min(o_orderdate))::timestamp, max(o_orderdate)::timestamp, interval 3 month)) as t from orders) "
    "select strftime(t, '%Y-%m-%d') as t, count(*) as n, max(priority) as top from i join fa on valid_from <= t and (valid_until is null or valid_until > t) group by 1"
)
def asof_batch(spark, sf):
    when = F.col("o_orderdate").cast("timestamp")
    instants = table(spark, sf, "orders").agg(F.sequence(F.date_trunc("year", F.min(when)), F.max(when), F.expr("interval 3 month")).alias("s")).select(F.explode("s").alias("t"))
    met = temporal.edges_at_each(P.facts(spark, sf).select("valid_from", "valid_until", "priority"), instants)
    return met.groupBy(F.date_format("t", "yyyy-MM-dd").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.max("priority").alias("top"))


@query(f"with {P.FACTS} select id, strftime(valid_until, '%Y-%m-%d') as valid_until from fa")
def supersede_chain(spark, sf):
    return P.facts(spark, sf).select("id", F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"))


@query(f"with {P.FACTS} select id, case when target_id = '1-URGENT' and valid_until is null then 'ARCHIVED' else 'ACTIVE' end as state, strftime(case when target_id = '1-URGENT' and valid_until is null then timestamp '1999-01-01' else valid_until end, '%Y-%m-%d') as valid_until from fa")
def supersede_edge(spark, sf):
    chosen = (F.col("target_id") == "1-URGENT") & F.col("valid_until").isNull()
    out = temporal.supersede(P.facts(spark, sf).withColumn("state", F.lit("ACTIVE")).withColumn("__c", chosen), F.col("__c"), F.lit("1999-01-01").cast("timestamp"))
    return out.select("id", "state", F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"))


@query(f"with {P.TRADE} select id, round(least(10, weight * 1.1), 6) as w_up, round(least(1, confidence * 1.1), 6) as c_up, round(greatest(0.1, weight * 0.9), 6) as w_down, round(greatest(0.1, confidence * 0.9), 6) as c_down from te")
def edge_strengthen_weaken(spark, sf):
    (a, b), (c, d) = X.strengthen(), X.weaken()
    return P.trade_edges(spark, sf).select("id", r6(a).alias("w_up"), r6(b).alias("c_up"), r6(c).alias("w_down"), r6(d).alias("c_down"))


@query("select o_orderkey, case when o_orderkey % 150 >= 100 then 10.0 when o_orderkey % 150 >= 50 then 8.0 when o_orderkey % 150 >= 20 then 6.0 else 5.0 end::double as importance from orders")
def priority_importance(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.priority_importance(F.col("o_orderkey") % 150).cast("double").alias("importance"))


# --- vectors


def first_vector(spark, sf) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"with {P.VECTORS} select a.id as a, b.id as b, round(list_cosine_similarity(a.v, b.v), 6) as similarity from ve a join ve b on a.entity_type = b.entity_type and a.id < b.id where list_cosine_similarity(a.v, b.v) >= 0.3")
def cosine_pairs(spark, sf):
    return vectors.pairs(P.vectors(spark, sf), "entity_type", 0.3).withColumn("similarity", r6("similarity"))


@query(f"with {P.VECTORS} select id, round(list_cosine_similarity(v, qv), 6) as similarity from ve, q order by round(list_cosine_similarity(v, qv), 9) desc, id limit 10")
def vector_topk(spark, sf):
    return vectors.top_k(P.vectors(spark, sf), first_vector(spark, sf)).select("id", r6("similarity").alias("similarity"))


@query(
    f"with {P.VECTORS}, p as (select a.id as query_id, b.id, round(list_cosine_similarity(a.v, b.v), 9) as s from ve a, ve b), r as (select *, row_number() over (partition by query_id order by s desc, id) as rank from p) "
    "select query_id, id, round(s, 6) as similarity, rank::int as rank from r where rank <= 5"
)
def vector_topk_each(spark, sf):
    nodes = P.vectors(spark, sf)
    return vectors.top_k_each(nodes, nodes.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 5).withColumn("similarity", r6("similarity"))


_S = "round(list_cosine_similarity(v, qv), 9)"
_BOOSTS = "case when hours < 24 then 0.1 * (1 - hours / 24) else 0 end + least(0.1, 0.01 * access_count)"


@query(f"with {P.VECTORS}, s as (select *, {_S} as sim from ve, q) select id, round(sim, 6) as similarity, round(0.6 * sim + 0.25 * importance / 10 + {_BOOSTS}, 6) as score from s where importance <> 0 and sim >= 0.1 order by round(0.6 * sim + 0.25 * importance / 10 + {_BOOSTS}, 12) desc, id limit 20")
def vector_score_store(spark, sf):
    return retrieve.store_search(P.vectors(spark, sf), first_vector(spark, sf), 20, 0.1).select("id", r6("similarity").alias("similarity"), r6("score").alias("score"))


@query(f"with {P.VECTORS} select id, entity_type, importance from ve where entity_type = 'type_3' and importance >= 3 and state = 'ACTIVE' and (lang is null or lang = 'en')")
def filtered_search(spark, sf):
    return P.vectors(spark, sf).where(X.matches_filters({"entity_type": "TYPE_3", "min_importance": 3, "state": "ACTIVE", "lang": "en", "missing": "x"})).select("id", "entity_type", "importance")


QUESTION = "where is the cold widget next to a red gear"


def named_vectors(spark, sf) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    none = F.array().cast("array<string>")
    return P.vectors(spark, sf).join(names, "id").withColumns({"canonical_name": F.col("name"), "aliases": none, "source_chunks": F.array(F.concat(F.lit("chunk_"), F.col("entity_type")))})


_NAMED = f"{P.VECTORS}, nv as (select ve.*, p_name as name, p_type as description from ve join part on p_partkey = id)"
_BOOST = f"case when contains('{QUESTION}', lower(name)) then 0.3 when len(list_intersect(string_split(lower(name), ' '), string_split('{QUESTION}', ' '))) > 0 then 0.15 else 0 end"


@query(
    f"with {_NAMED}, s as (select *, {_S} as sim, {_BOOST} as boost from nv, q), t as (select id, sim, boost, 0.5 * sim + 0.25 * importance / 10 + 0.15 * (boost * 3.33) + {_BOOSTS} as score from s where importance <> 0 and least(1, sim + boost) >= 0.2) "
    "select id, round(sim, 6) as similarity, boost::double as boost, round(score, 6) as score from t order by round(score, 12) desc, id limit 20"
)
def hybrid_search(spark, sf):
    out = retrieve.hybrid_search(named_vectors(spark, sf), QUESTION, first_vector(spark, sf), 20, 0.2)
    return out.select("id", r6("similarity").alias("similarity"), "boost", r6("score").alias("score"))


# --- scores

_TRADE_AS_OF = "1999-01-01"


def aged_trade(spark, sf) -> DataFrame:
    return P.trade_edges(spark, sf).withColumn("age_days", F.greatest(F.lit(0.0), X.days_between(F.lit(_TRADE_AS_OF).cast("timestamp"), F.col("accessed_at"))))


_AGED = f"{P.TRADE}, ta as (select *, greatest(0, (epoch_us(timestamp '{_TRADE_AS_OF}') - epoch_us(accessed_at)) / 86400000000.0) as age_days from te)"
_FREQ = "case when access_count <= 0 then 0 else least(1, ln(1 + access_count) / ln(101)) end"
_NODE = f"least(10, greatest(0, 10 * (0.3 * exp(-0.693 * age_days / 30) + 0.3 * {_FREQ} + 0.2 * least(1, access_count / 100) + 0.2 * importance / 10)))"


def _bucket(x: str) -> str:
    return f"case when {x} >= 9 then 10.0 when {x} >= 7 then 8.0 when {x} >= 5.5 then 6.0 when {x} >= 4 then 5.0 when {x} >= 2 then 3.0 when {x} >= 0.5 then 1.0 else 0.0 end::double"


def ranked_accesses(spark, sf) -> DataFrame:
    return P.accesses(spark, sf).withColumn("rank", F.least(F.lit(1.0), F.col("access_count") / 100))


@query("select user_id, count(*) as access_count, strftime(max(ts), '%Y-%m-%d %H:%M') as accessed_at from events group by 1")
def access_fold(spark, sf):
    log = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return scoring.fold_accesses(log, ["user_id"]).withColumn("accessed_at", F.date_format("accessed_at", "yyyy-MM-dd HH:mm"))


@query(f"with {P.ACCESSES} select id, round(exp(-0.693 * age_days / 30), 6) as recency, round({_FREQ}, 6) as frequency from ac")
def recency(spark, sf):
    return P.accesses(spark, sf).select("id", r6(X.recency("age_days")).alias("recency"), r6(X.frequency("access_count")).alias("frequency"))


_STRENGTH = "exp(-0.693 * age_days / (30 * (0.5 + importance / 20) * least(1, 0.5 + ln(1 + access_count) / 10)))"
_EDGE_STRENGTH = "exp(-0.693 * age_days / greatest(1, 30 * least(1, weight / 5) * confidence))"


@query(f"with {P.ACCESSES} select id, round({_STRENGTH}, 6) as strength from ac")
def node_strength(spark, sf):
    return P.accesses(spark, sf).select("id", r6(X.node_strength("age_days", "importance", "access_count")).alias("strength"))


@query(f"with {_AGED} select id, round({_EDGE_STRENGTH}, 6) as strength from ta")
def edge_strength(spark, sf):
    return aged_trade(spark, sf).select("id", r6(X.edge_strength("age_days", "weight", "confidence")).alias("strength"))


@query(f"select o_orderkey, {_bucket('o_totalprice / 50000')} as level from orders")
def importance_bucket(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.importance_bucket(F.col("o_totalprice") / 50000).alias("level"))


@query(f"with {P.ACCESSES} select id, round({_NODE}, 6) as score from ac")
def node_importance(spark, sf):
    return ranked_accesses(spark, sf).select("id", r6(X.node_importance("age_days", "access_count", "rank", "importance")).alias("score"))


@query(
    f"with {P.HIERARCHY}, {_AGED}, j as (select ta.id, age_days, weight, confidence, weight as access_count, coalesce((a.importance + b.importance) / 2, 5) as ends from ta left join hn a on a.id = source_id left join hn b on b.id = target_id) "
    f"select id, round(least(10, greatest(0, 10 * (0.25 * exp(-0.693 * age_days / 30) + 0.2 * {_FREQ} + 0.2 * least(1, weight / 5) + 0.15 * confidence + 0.2 * ends / 10))), 6) as score from j"
)
def edge_importance(spark, sf):
    nodes = P.hierarchy_nodes(spark, sf).select("id", "importance")
    a, b = (nodes.select(F.col("id").alias(end), F.col("importance").alias(i)) for end, i in (("source_id", "ia"), ("target_id", "ib")))
    rows = aged_trade(spark, sf).drop("importance").join(a, "source_id", "left").join(b, "target_id", "left")
    ends = F.coalesce((F.col("ia") + F.col("ib")) / 2, F.lit(5.0))
    return rows.select("id", r6(X.edge_importance("age_days", "weight", "weight", "confidence", ends)).alias("score"))


@query(f"with {P.ACCESSES}, s as (select id, importance as before, {_bucket(f'round({_NODE}, 9)')} as after from ac) select * from s where abs(after - before) >= 2")
def reinforcement_events(spark, sf):
    return scoring.rescored(ranked_accesses(spark, sf))


@query(
    f"with {P.ACCESSES}, s as (select *, {_STRENGTH} as strength, state not in ('ARCHIVED', 'DELETED') and importance < 10 and importance < 6 as weak from ac) "
    "select id, round(strength, 6) as strength, case when weak and strength <= 0.05 then 'PRUNING' when weak and strength <= 0.2 then 'DECAY' end as event, case when weak and strength <= 0.05 then 'DELETED' when weak and strength <= 0.2 then 'ARCHIVED' else state end as state from s"
)
def decay_nodes(spark, sf):
    return scoring.decay_nodes(P.accesses(spark, sf), keep=6.0).select("id", r6("strength").alias("strength"), "event", "state")


_DEAD = "(source_id in (select id from hn where state = 'DELETED') or target_id in (select id from hn where state = 'DELETED'))"


@query(
    f"with {P.HIERARCHY}, {_AGED}, s as (select id, weight, state, {_EDGE_STRENGTH} as strength, state not in ('ARCHIVED', 'DELETED') as live, {_DEAD} or {_EDGE_STRENGTH} <= 0.05 as gone from ta) "
    "select id, round(case when live and not gone and strength < 0.5 then weight * strength else weight end, 6) as new_weight, case when live and gone then 'DELETED' else state end as state from s"
)
def decay_edges(spark, sf):
    return scoring.decay_edges(aged_trade(spark, sf), P.hierarchy_nodes(spark, sf)).select("id", r6("new_weight").alias("new_weight"), "state")


@query(f"with {P.HIERARCHY}, {P.TRADE} select id from te where {_DEAD}")
def orphan_edges(spark, sf):
    return scoring.orphan_edges(P.trade_edges(spark, sf).select("id", "source_id", "target_id"), P.hierarchy_nodes(spark, sf)).select("id")


@query(
    f"with {P.FACTS}, w as (select id, priority < max(priority) over k and min(lower(target_id)) over k <> max(lower(target_id)) over k as lost from fa window k as (partition by lower(source_id), lower(relation_type))) "
    "select id, lost, case when lost then 0.0 else 5.0 end::double as importance, case when lost then 'ARCHIVED' else 'ACTIVE' end as state from w"
)
def conflict_resolution(spark, sf):
    edges = P.raw_facts(spark, sf).withColumns({"importance": F.lit(5.0), "state": F.lit("ACTIVE")})
    return scoring.conflicts(edges).select("id", "lost", "importance", "state")


@query(
    f"with {P.VECTORS}, s as (select *, list_cosine_similarity(v, qv) as sim from ve, q), t as (select *, case when state = 'ARCHIVED' then sim * 1.1 else sim end as score from s where sim >= 0.15) "
    "select id, round(score, 6) as score, state = 'ARCHIVED' as restored, case when state = 'ARCHIVED' then 'ACTIVE' else state end as state, access_count + 1 as access_count from t order by score desc, id limit 100"
)
def rehydrate_nodes(spark, sf):
    return scoring.rehydrate(P.vectors(spark, sf), first_vector(spark, sf), 0.15).select("id", r6("score").alias("score"), "restored", "state", "access_count")


@query(f"with {P.HIERARCHY}, n as (select id from hn where importance = 10) select id, 'ACTIVE' as state from he where state <> 'ACTIVE' and (source_id in (select id from n) or target_id in (select id from n))")
def rehydrate_edges(spark, sf):
    return scoring.rehydrate_edges(P.hierarchy_edges(spark, sf), P.hierarchy_nodes(spark, sf).where("importance = 10")).select("id", "state")


# --- resolution and consolidation


@query(
    f"with {P.MENTIONS} select source_id, target_id, relation_type, min({{'w': -weight, 'c': -confidence, 'i': id}}).i as id, count(*) as n, least(10, sum(weight)) as weight, "
    "round(case when count(*) > 1 then least(1, 1.1 * avg(confidence)) else max(confidence) end, 6) as confidence from me group by 1, 2, 3"
)
def reinforce_edges(spark, sf):
    return resolve.reinforce(P.mentions(spark, sf)).withColumn("confidence", r6("confidence"))


@query(
    f"with {P.TRADE}, s as materialized (select * from te where confidence >= 0.7), p as (select x.source_id, y.target_id, 0.8 * x.confidence * y.confidence as confidence, 0.5 * least(x.weight, y.weight) as weight, x.target_id as via from s x join s y on x.target_id = y.source_id where x.source_id <> y.target_id), "
    "b as (select source_id, target_id, max({'c': confidence, 'w': weight, 'v': via}) as m from p group by 1, 2) "
    "select source_id, target_id, round(m.c, 6) as confidence, m.w as weight, m.v as via from b where not exists (select 1 from te where te.source_id = b.source_id and te.target_id = b.target_id) order by m.c desc, source_id, target_id limit 10"
)
def transitive_edges(spark, sf):
    return resolve.transitive(P.trade_edges(spark, sf)).select("source_id", "target_id", r6("confidence").alias("confidence"), "weight", "via")


def part_nodes(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(F.concat(F.lit("part_"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("entity_type"), F.col("p_type").alias("description"), F.array("p_brand").alias("aliases"), P.level(k).alias("importance"), F.col("p_size").cast("long").alias("access_count"))


def part_groups(spark, sf) -> DataFrame:
    rows = part_nodes(spark, sf).select("id", N.entity_key("name").alias("k"))
    return rows.join(rows.groupBy("k").agg(F.min("id").alias("canon")), "k").select("id", "canon")


_KEY = "regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g')[1:64]"
_GROUPS = f"pg as (select 'part_' || p_partkey as id, min('part_' || p_partkey) over (partition by {_KEY}) as canon from part)"


@query(
    f"with {_GROUPS}, n as (select pg.canon, p_name, p_type, p_brand, {P._level('p_partkey')} as importance, p_size::bigint as access_count from part join pg on pg.id = 'part_' || p_partkey) "
    "select canon as id, max({'l': length(p_name), 'c': access_count, 'n': p_name}).n as name, max({'l': length(p_type), 'd': p_type}).d as description, array_to_string(list_sort(list_distinct(list_concat(list(p_brand), list(p_name)))), '|') as aliases, max(importance) as importance, sum(access_count)::bigint as access_count, count(*) as merge_count from n group by 1"
)
def merge_nodes(spark, sf):
    out = resolve.merge_nodes(part_nodes(spark, sf), part_groups(spark, sf))
    return out.select("id", "name", "description", F.array_join("aliases", "|").alias("aliases"), "importance", "access_count", "merge_count")


@query(f"with {P.TRADE}, {_GROUPS} select te.id, coalesce(a.canon, source_id) as source_id, coalesce(b.canon, target_id) as target_id from te left join pg a on a.id = source_id left join pg b on b.id = target_id")
def rewire_edges(spark, sf):
    return resolve.rewire(P.trade_edges(spark, sf).select("id", "source_id", "target_id"), part_groups(spark, sf))


@query(
    f"with {_NAMED} select lower(name) as k, min(id) as first_id, max({{'l': length(description), 'd': description}}).d as description, array_to_string(list_sort(list_distinct(list('chunk_' || entity_type))), '|') as chunks, count(*) as n, round(avg(v[1]), 6) as v1, round(avg(v[64]), 6) as v64 from nv group by 1"
)
def merge_entities(spark, sf):
    out = resolve.merge_entities(named_vectors(spark, sf).withColumn("k", F.lower("name")), ["k"])
    return out.select("k", "first_id", "description", F.array_join("source_chunks", "|").alias("chunks"), F.col("occurrence_count").alias("n"), r6(F.element_at("embedding", 1)).alias("v1"), r6(F.element_at("embedding", 64)).alias("v64"))


_WORDS = "regexp_extract_all(lower({0}), '[a-z]{{2,}}')"


@query(
    f"with {_NAMED}, p as (select a.id as a, b.id as b, lower(a.name) as na, lower(b.name) as nb, list_cosine_similarity(a.v, b.v) as s from nv a join nv b on a.entity_type = b.entity_type and a.id < b.id), "
    f"w as (select *, list_distinct({_WORDS.format('na')}) as wa, list_distinct({_WORDS.format('nb')}) as wb, {_WORDS.format('na')}[-1] as la, {_WORDS.format('nb')}[-1] as lb from p) "
    "select a, b, round(s, 6) as similarity from w where na = nb or contains(na, nb) or contains(nb, na) or (la = lb and length(la) >= 3 and s >= 0.65) or (len(list_intersect(wa, wb)) >= 0.5 * least(len(wa), len(wb)) and s >= 0.6) or s >= 0.75"
)
def consolidate_pairs(spark, sf):
    return resolve.consolidation_pairs(named_vectors(spark, sf)).withColumn("similarity", r6("similarity"))


_PAIRS = "n as (select distinct p_name as name, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))) as t from part), p as (select a.name as a, b.name as b, a.t as ta, b.t as tb, len(list_intersect(a.t, b.t)) as i from n a join n b on a.name < b.name)"


@query(
    f"with {_PAIRS}, s as (select a, b, greatest(i / (len(ta) + len(tb) - i), case when i = least(len(ta), len(tb)) then 0.9 else 0 end, case when ta[-1] = tb[-1] then 0.7 else 0 end) as similarity from p where i > 0) select a, b, round(similarity, 6) as similarity from s where similarity >= 0.3"
)
def token_similarity(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.lit("part").alias("entity_type"))
    return resolve.name_pairs(names, 0.3).select("a", "b", r6("similarity").alias("similarity"))


@query()
def resolve_pairs(spark, sf):
    own = part_nodes(spark, sf).groupBy("name", "entity_type").agg(F.min("id").alias("id")).withColumn("embedding", F.lit(None).cast("array<float>"))
    return resolve.resolve_pairs(own).select("a", "b", r6("token").alias("token"), r6("fuzzy").alias("fuzzy"))


@query()
def resolve_entities(spark, sf):
    return resolve.resolve(part_nodes(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>")))


@query("with n as (select distinct p_name as name, regexp_extract_all(p_name, '[A-Za-z]{2,}')[-1] as l from part) select a.name as a, b.name as b from n a join n b on a.name < b.name and a.l = b.l and length(a.l) >= 3")
def share_last_name(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().withColumn("l", N.last_name("name")).where(F.length("l") >= 3)
    a, b = names.select(F.col("name").alias("a"), "l"), names.select(F.col("name").alias("b"), "l")
    return a.join(b, "l").where("a < b").select("a", "b")


@query(f"select p_partkey, {_KEY} as k, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))), ' ') as tokens from part")
def entity_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.entity_key("p_name").alias("k"), F.array_join(N.name_tokens("p_name"), " ").alias("tokens"))


# --- graph algorithms


@query(
    f"with recursive {P.HIERARCHY}, l as (select * from he where importance <> 0 and state not in ('ARCHIVED', 'DELETED')), u as (select source_id as a, target_id as b from l union select target_id, source_id from l), "
    "w as (select 'region_0' as id, 0 as hop union select b, hop + 1 from w join u on a = w.id where hop < 2) select id, min(hop)::int as hop from w group by 1"
)
def bfs_expand(spark, sf):
    seeds = spark.createDataFrame([("region_0",)], "id string")
    return graph.expand(seeds, P.hierarchy_edges(spark, sf), 2)


@query(
    f"with recursive {P.HIERARCHY}, u as (select source_id as a, target_id as b from he union select target_id, source_id from he), w as (select id as root, id from hn union select w.root, b from w join u on a = w.id) "
    "select id, min(root) as component from w group by 1"
)
def connected_components(spark, sf):
    return graph.components(P.hierarchy_edges(spark, sf), P.hierarchy_nodes(spark, sf))


@query(f"with {P.TRADE}, e as (select unnest([source_id, target_id]) as id from te) select id, count(*) as degree, round(least(1, ln(1 + count(*)) / ln(51)), 6) as score from e group by 1")
def degree_score(spark, sf):
    return graph.degrees(P.trade_edges(spark, sf)).withColumn("score", r6("score"))


@query(
    f"with {P.HIERARCHY}, {P.TRADE}, u as (select source_id as a, target_id as b from te union select target_id, source_id from te), z as (select count(*) as n, count(distinct entity_type) as t from hn), "
    "g as (select a as id, count(*) as neighbours, count(distinct entity_type) as types from u join hn on hn.id = b where a <> b group by 1) select id, neighbours, types, round(least(1, (types / greatest(5, t) + neighbours / greatest(10, n)) / 2), 6) as score from g, z"
)
def centrality(spark, sf):
    return graph.centrality(P.hierarchy_nodes(spark, sf), P.trade_edges(spark, sf)).withColumn("score", r6("score"))


def nation_clusters(spark, sf) -> DataFrame:
    """(id, name, importance, cluster_id): customers, suppliers and the nation of each nation."""
    edges = P.hierarchy_edges(spark, sf).where("relation_type = 'LOCATED_IN'")
    inside = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("c")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("target_id").alias("c")).distinct())
    return inside.select("id", F.substring_index("c", "_", -1).cast("long").alias("cluster_id"))


_MEMBERS = "nm as (select source_id as id, split_part(target_id, '_', 2)::bigint as cluster_id from he where relation_type = 'LOCATED_IN' union select target_id, split_part(target_id, '_', 2)::bigint from he where relation_type = 'LOCATED_IN')"
_INSIDE = "ce as (select he.id, source_id, target_id, a.cluster_id from he join nm a on a.id = source_id join nm b on b.id = target_id and a.cluster_id = b.cluster_id)"


@query(f"with {P.HIERARCHY}, {_MEMBERS}, {_INSIDE} select * from ce")
def community_edges(spark, sf):
    return graph.cluster_edges(nation_clusters(spark, sf), P.hierarchy_edges(spark, sf))


@query(
    f"with {P.HIERARCHY}, {_MEMBERS}, {_INSIDE}, e as (select cluster_id, count(*) as n_edges from ce group by 1), n as (select cluster_id, count(*) as n_nodes from nm group by 1) "
    "select n.cluster_id, coalesce(n_edges, 0) as n_edges, n_nodes, round(case when n_nodes <= 1 then 1 else coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1) / 2) end, 6) as density, round(least(1, case when n_nodes <= 1 then 1 else coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1) / 2) end), 6) as coherence_score from n left join e using (cluster_id)"
)
def community_metrics(spark, sf):
    out = graph.cluster_metrics(nation_clusters(spark, sf), P.hierarchy_edges(spark, sf))
    return out.withColumns({"density": r6("density"), "coherence_score": r6("coherence_score")})


@query(f"with {P.HIERARCHY}, {_MEMBERS} select distinct cluster_id from nm join hn using (id) where name in (select name from hn where importance = 10 and state = 'DELETED')")
def relevant_clusters(spark, sf):
    nodes, edges = P.hierarchy_nodes(spark, sf), P.hierarchy_edges(spark, sf)
    clusters = graph.clusters(nation_clusters(spark, sf), nodes, edges, "given")
    return graph.relevant_clusters(clusters, nodes.where("importance = 10 and state = 'DELETED'")).select("cluster_id")


def _pagerank_sql(rounds: int) -> str:
    out = f"with {P.HIERARCHY}, {P.TRADE}, w as (select source_id, target_id, weight * confidence as w from te), p as materialized (select source_id, target_id, w / sum(w) over (partition by source_id) as p from w), n as materialized (select id, count(*) over () as n from hn), x0 as (select id, 1.0 / n as x from n)"
    for i in range(rounds):
        out += f", c{i} as materialized (select target_id, sum(x * p) as c from p join x{i} on id = source_id group by 1), x{i + 1} as materialized (select id, 0.85 * (coalesce(c, 0) + (1 - (select sum(c) from c{i})) / n) + 0.15 / n as x from n left join c{i} on target_id = id)"
    return out + f" select id, round(x / (select max(x) from x{rounds}), 6) as rank from x{rounds}"


@query()
def pagerank(spark, sf):
    """To the operator's tolerance; tested against brute force, as SQL can't stop by itself."""
    return graph.pagerank(P.hierarchy_nodes(spark, sf), P.trade_edges(spark, sf)).withColumn("rank", r6("rank"))


@query(_pagerank_sql(4))
def pagerank_steps(spark, sf):
    """Four steps from even ranks, which SQL can follow."""
    return graph.pagerank(P.hierarchy_nodes(spark, sf), P.trade_edges(spark, sf), iterations=4, tolerance=0).withColumn("rank", r6("rank"))


def _label_sql(rounds: int) -> str:
    out = f"with {P.HIERARCHY}, {P.TRADE}, u as materialized (select source_id as a, target_id as b from te union select target_id, source_id from te), l0 as (select id, id as label from hn)"
    for i in range(rounds):
        out += f", v{i} as (select a, label, count(*) as n from u join l{i} on id = b group by 1, 2), l{i + 1} as materialized (select l.id, coalesce(m.label, l.label) as label from l{i} l left join (select a, min({{'n': -n, 'label': label}}).label as label from v{i} group by 1) m on m.a = l.id)"
    return out + f" select id, label from l{rounds}"


@query(_label_sql(10))
def label_propagation(spark, sf):
    return graph.label_propagation(P.hierarchy_nodes(spark, sf), P.trade_edges(spark, sf))


@query()
def communities(spark, sf):
    return graph.communities(P.hierarchy_nodes(spark, sf), P.hierarchy_edges(spark, sf), "greedy_modularity", most=10_000)


# --- retrieval and context


def questions(spark, sf) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), "p_name", (F.col("p_partkey") % 25).alias("k"))
    return parts.join(nations, "k").select("question_id", F.concat(F.lit("Which supplier of "), "p_name", F.lit(" is in "), F.initcap("n_name"), F.lit("?")).alias("question"))


@query(f"with {P.HIERARCHY}, qs as (select p_partkey as question_id, lower('which supplier of ' || p_name || ' is in ' || n_name || '?') as q from part join nation on n_nationkey = p_partkey % 25) select question_id, id from qs join hn on length(name) > 0 and contains(q, lower(name))")
def exact_name_match(spark, sf):
    nodes = P.hierarchy_nodes(spark, sf).select("id", "name", F.col("name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    return retrieve.exact_matches(nodes, questions(spark, sf))


@query()
def potential_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(N.potential_names("text"), "|").alias("names"))


@query(
    f"with {P.VECTORS}, ex as (select a.id as question_id, b.id from ve a join ve b on a.entity_type = b.entity_type where b.importance = 10 and a.access_count < 6), "
    "p as (select a.id as question_id, b.id, round(list_cosine_similarity(a.v, b.v), 9) as s from ve a, ve b), se as (select * from (select *, row_number() over (partition by question_id order by s desc, id) as k from p) where k <= 5), "
    "f as (select coalesce(ex.question_id, se.question_id) as question_id, coalesce(ex.id, se.id) as id, ex.id is not null as named, s from ex full join se on ex.question_id = se.question_id and ex.id = se.id), "
    "h as (select *, bool_or(named) over (partition by question_id) as named_any from f) select question_id, id, round(case when named then least(1, 1 + 0.2 * coalesce(s, 0)) when named_any then 0.8 * s else s end, 6) as score from h where named or not named_any or s >= 0.75"
)
def retrieve_fusion(spark, sf):
    nodes = P.vectors(spark, sf)
    exact = nodes.where("access_count < 6").select(F.col("id").alias("question_id"), "entity_type").join(nodes.where("importance = 10").select("id", "entity_type"), "entity_type").select("question_id", "id")
    near = vectors.top_k_each(nodes, nodes.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 5)
    return retrieve.fuse(exact, near.select(F.col("query_id").alias("question_id"), "id", F.col("similarity").alias("score"))).withColumn("score", r6("score"))


@query(
    "with a as (select user_id as question_id, event_id, event_type, (event_id % 10)::double as confidence from events), r as (select *, row_number() over (partition by question_id order by confidence desc, event_id) as k from a), "
    "g as (select question_id, count(*) as n, max(confidence) as best, max(event_type) filter (k = 1) as top, avg(confidence) filter (k <= 3) as mean3, string_agg(event_type, ' | ' order by k) as joined from r where k <= 5 group by 1) "
    "select question_id, case when n = 1 or best >= 9 then top else joined end as answer, round(case when n = 1 or best >= 9 then best else mean3 end / 10, 6) as confidence from g"
)
def answer_aggregate(spark, sf):
    answers = table(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("answer_id"), F.col("event_type").alias("answer"), (F.col("event_id") % 10).cast("double").alias("confidence"))
    return retrieve.aggregate_answers(answers).withColumn("confidence", r6("confidence"))


@query(
    f"with {P.HIERARCHY}, l as (select entity_type, id, importance, '• ' || name || ' (' || entity_type || '): ' || name[1:200] as line from hn), t as (select entity_type, id, sum(floor((length(line) + 1) * 0.25)::bigint) over (partition by entity_type order by importance desc, id rows unbounded preceding)::bigint as tokens from l) select * from t where tokens <= 5600"
)
def context_pack(spark, sf):
    nodes = P.hierarchy_nodes(spark, sf).withColumn("description", F.lit(None).cast("string")).withColumn("line", retrieve.entity_line())
    return retrieve.pack(nodes, 5600, ["entity_type"], [F.desc("importance"), "id"]).select("entity_type", "id", "tokens")


# --- chunks, extraction, documents


@query(
    "with s as (select doc_id, text, case when length(text) <= 2000 then [0] else generate_series(0, length(text) - 1, 1800) end as st from documents where text is not null), x as (select doc_id, text, generate_subscripts(st, 1) - 1 as chunk_index, unnest(st) as a from s) "
    "select doc_id, chunk_index::int as chunk_index, substring(text, a::int + 1, 2000) as content from x"
)
def chunk_fixed(spark, sf):
    return chunking.fixed(table(spark, sf, "documents"))


@query()
def chunk_sentences(spark, sf):
    return chunking.sentences(table(spark, sf, "documents")).select("doc_id", "chunk_index", "content")


@query()
def chunk_document(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"), chunking.chunk_text).select("doc_id", "chunk_index", "content", "start_char", "end_char")


def fact_texts(spark, sf) -> DataFrame:
    lines = table(spark, sf, "part").select("p_size", "p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(". "), F.initcap("p_name"), F.lit(" ships with Supplier")).alias("line"))
    return lines.groupBy(F.col("p_size").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("text"))


_ORDER = "fo as (select p_size as doc_id, unnest([lower(p_name), 'supplier']) as entity, p_partkey as p from part)"


@query(f"with {_ORDER} select doc_id, entity, max(p) as priority from fo group by 1, 2")
def fact_order(spark, sf):
    return extraction.fact_order(fact_texts(spark, sf))


@query(
    f"with {_ORDER}, g as (select doc_id, entity, max(p) as p from fo group by 1, 2), e as (select distinct p_size as doc_id, p_brand as source, 'box of ' || p_name as target from part), "
    "m as (select e.*, max(case when contains(lower(target), entity) or contains(entity, lower(target)) then p end) as t, max(case when contains(lower(source), entity) or contains(entity, lower(source)) then p end) as s from e left join g using (doc_id) group by all) select doc_id, source, target, coalesce(case when t > 0 then t end, s, 0) as priority from m"
)
def fact_priority(spark, sf):
    edges = table(spark, sf, "part").select(F.col("p_size").alias("doc_id"), F.col("p_brand").alias("source"), F.concat(F.lit("box of "), "p_name").alias("target")).distinct()
    return extraction.fact_priority(edges, extraction.fact_order(fact_texts(spark, sf)), "doc_id")


def responses(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    m = F.lit("$$$$")
    entity = F.concat(F.lit('("entity"'), m, "s_name", m, F.lit("Supplier"), m, F.lit("trades from "), "n_name", m, F.concat_ws(", ", F.lower("s_name"), F.lit("none"), F.upper("s_name")), F.lit(")"))
    relation = F.concat(F.lit('("relationship"'), m, "s_name", m, "n_name", m, F.lit("located_in"), m, F.lit("an entity's seat"), m, (F.lit(1950) + F.col("s_suppkey") % 50).cast("string"), m, F.lit("present)"))
    return s.select("s_suppkey", F.concat(entity, F.lit("\nnoise\n"), relation).alias("response"))


@query(
    "select s_suppkey, 'entity' as kind, s_name as a, 'Supplier' as b, array_to_string(list_sort(list_distinct([lower(s_name), upper(s_name)])), ',') as c, null::varchar as valid_from, null::varchar as valid_until from supplier "
    "union all select s_suppkey, 'relationship', s_name, n_name, 'located_in', (1950 + s_suppkey % 50)::varchar, 'present' from supplier join nation on n_nationkey = s_nationkey"
)
def parse_triples(spark, sf):
    said = responses(spark, sf)
    none = F.lit(None).cast("string")
    e = extraction.parse_entities(said, ["s_suppkey"]).select("s_suppkey", F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("entity_type").alias("b"), F.array_join("aliases", ",").alias("c"), none.alias("valid_from"), none.alias("valid_until"))
    r = extraction.parse_relationships(said, ["s_suppkey"]).select("s_suppkey", F.lit("relationship").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation_type").alias("c"), "valid_from", "valid_until")
    return e.unionByName(r)


@query(
    "with t as (select o_orderkey, case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y') when 2 then 'Since ' || strftime(o_orderdate, '%Y') when 3 then 'Present' when 4 then 'None' else 'in Spring' end as s, o_orderdate as d from orders) "
    "select o_orderkey, case o_orderkey % 6 when 0 then s when 1 then s when 2 then s[7:10] when 3 then 'present' when 5 then 'in spring' end as parsed, case o_orderkey % 6 when 0 then s when 1 then s || '-01-01' when 2 then s[7:10] || '-01-01' end as ts from t"
)
def temporal_parse(spark, sf):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate").cast("timestamp")
    year = F.date_format(d, "yyyy")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, year).when(k == 2, F.concat(F.lit("Since "), year)).when(k == 3, "Present").when(k == 4, "None").otherwise("in Spring")
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("s"))
    return rows.select("o_orderkey", N.temporal("s").alias("parsed"), F.date_format(N.temporal_timestamp("s"), "yyyy-MM-dd").alias("ts"))


@query(
    f"with {P.HIERARCHY}, b as (select lower(name) as n, max(id) as id from hn where entity_type <> 'part' group by 1), e as (select 's' || s_suppkey as id, upper(s_name) as s, lower(n_name) as t from supplier join nation on n_nationkey = s_nationkey union all select 'x' || s_suppkey, s_name, 'nowhere' from supplier) "
    "select e.id, x.id as source_id, y.id as target_id from e join b x on x.n = lower(s) join b y on y.n = lower(t)"
)
def edge_resolve(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    k = F.col("s_suppkey").cast("string")
    known = s.select(F.concat(F.lit("s"), k).alias("id"), F.upper("s_name").alias("source_id"), F.lower("n_name").alias("target_id"))
    lost = s.select(F.concat(F.lit("x"), k).alias("id"), F.col("s_name").alias("source_id"), F.lit("nowhere").alias("target_id"))
    none = F.array().cast("array<string>")
    nodes = P.hierarchy_nodes(spark, sf).where("entity_type <> 'part'").select("id", "name", F.col("name").alias("canonical_name"), none.alias("aliases"))
    return resolve.resolve_endpoints(known.unionByName(lost), nodes)


@query("select s_suppkey as id, case when s_suppkey % 10 >= 7 then 'House ' || s_nationkey else s_name end as name, s_suppkey % 10 >= 7 as coreference, case when s_suppkey % 10 >= 7 then s_name || '|House ' || s_nationkey else '' end as aliases from supplier")
def coref_apply(spark, sf):
    s = table(spark, sf, "supplier")
    house = F.concat(F.lit("House "), F.col("s_nationkey").cast("string"))
    links = s.select(F.upper("s_name").alias("mention"), house.alias("canonical"), ((F.col("s_suppkey") % 10) / 10).alias("confidence"))
    nodes = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return resolve.apply_coreferences(nodes, links).select("id", "name", "coreference", F.array_join("aliases", "|").alias("aliases"))


@query("with k as (select event_id as id, props, unnest(json_keys(props)) as key from events) select id, key, json_extract_string(props, '$.\"' || key || '\"') as value from k")
def json_flatten(spark, sf):
    return D.flat_json(table(spark, sf, "events"), "event_id", "props")


@query("select n_nationkey, 'Row ' || (n_nationkey + 1) || ': n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey as text from nation")
def rows_to_text(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", D.row_text(["n_nationkey", "n_name", "n_regionkey"], F.col("n_nationkey") + 1).alias("text"))


@query()
def webpage_text(spark, sf):
    return D.pages_text(table(spark, sf, "pages"))


@query("select substr(sha256(text), 1, 16) as h, min(doc_id) as first_id, count(*) as n from documents where text is not null group by 1")
def embed_dedup(spark, sf):
    return embedding.distinct_texts(table(spark, sf, "documents"))


@query("select event_id, user_id from events where ts + to_seconds((event_id % 90000)::double) > timestamp '2024-01-15' and user_id % 3 <> 1")
def cache_live_entries(spark, sf):
    from mnemoria.sources.store import live_entries

    rows = table(spark, sf, "events").select("event_id", "user_id", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("tenant"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(F.col("event_id") % 90000).cast("decimal(18,6)"))).alias("expires_at"))
    return live_entries(rows, F.lit("2024-01-15").cast("timestamp"), invalidated=[("tenant", "u1")]).select("event_id", "user_id")


@query("select source, count(*) as n_docs, count(*) filter (regexp_matches(coalesce(text, ''), '\\S')) as n_valid, sum(length(coalesce(text, '')))::bigint as n_chars from documents group by 1")
def ingest_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(X.valid_text("text")).alias("n_valid"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def predictions(spark, sf) -> DataFrame:
    """Every document with one item of the whole benchmark: items are numbered by id, from 0."""
    items = table(spark, sf, "benchmark").select(F.col("text").alias("truth"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("k"))
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("prediction"), F.col("n_chars").cast("double").alias("latency_ms"), F.pmod("doc_id", F.lit(max(1, items.count()))).alias("k"))
    return docs.join(items, "k")


_NORMAL = "list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w <> '' and w not in ('a', 'an', 'the'))"
_METRICS = (
    f"pt as materialized (select doc_id, source, n_chars::double as latency_ms, {_NORMAL.format('d.text')} as p, {_NORMAL.format('b.text')} as t from documents d join (select text, row_number() over (order by item_id) - 1 as k, count(*) over () as size from benchmark) b on k = doc_id % size), "
    "pc as (select doc_id, w, count(*) as n from (select doc_id, unnest(p) as w from pt) group by 1, 2), tc as (select doc_id, w, count(*) as n from (select doc_id, unnest(t) as w from pt) group by 1, 2), "
    "sm as (select doc_id, sum(least(pc.n, tc.n)) as s from pc join tc using (doc_id, w) group by 1), "
    "am as (select doc_id, source, latency_ms, (array_to_string(p, ' ') = array_to_string(t, ' '))::int::double as exact_match, contains(array_to_string(p, ' '), array_to_string(t, ' '))::int::double as substring_match, coalesce(2 * (s / len(p)) * (s / len(t)) / (s / len(p) + s / len(t)), 0) as f1 from pt left join sm using (doc_id))"
)


@query(f"with {_METRICS} select doc_id, exact_match, substring_match, round(f1, 6) as f1 from am")
def answer_f1(spark, sf):
    return evaluate.answer_metrics(predictions(spark, sf), ["doc_id"]).withColumn("f1", r6("f1"))


@query(f"with {_METRICS} select source as task, count(*) as n, round(avg(exact_match), 6) as exact_match, round(avg(f1), 6) as f1, round(avg(substring_match), 6) as substring_match, round(quantile_cont(latency_ms, 0.5), 6) as p50_latency from am group by 1")
def task_metrics(spark, sf):
    results = evaluate.answer_metrics(predictions(spark, sf), ["doc_id", "source", "latency_ms"]).withColumnRenamed("source", "task")
    return evaluate.task_metrics(results).select("task", "n", *[r6(c).alias(c) for c in ("exact_match", "f1", "substring_match", "p50_latency")])
