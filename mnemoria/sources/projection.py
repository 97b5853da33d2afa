"""Memory graphs projected from the star-schema tables, and the same as SQL common table expressions.

hierarchy: customers and suppliers in nations in regions.  facts: each order says a customer's
priority from its date until the next order's.  trade: customer -> part -> supplier, weighted by
line items.  mentions: each line item says supplier nation -> customer nation.  accesses: events by user.
vectors: the embeddings as entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoria.functions import exprs as X

AS_OF = "2024-02-01"
LEVELS = (0.0, 1.0, 3.0, 5.0, 6.0, 8.0, 10.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def level(key):
    return F.element_at(F.array(*[F.lit(v) for v in LEVELS]), (F.pmod(key, F.lit(7)) + 1).cast("int"))


def _level(key: str) -> str:
    return f"([{', '.join(map(str, LEVELS))}])[(({key}) % 7 + 1)::int]"


def state_of(key):
    return F.when(key % 5 == 3, "ARCHIVED").when(key % 11 == 7, "DELETED").otherwise("ACTIVE")


def _state(key: str) -> str:
    return f"case when {key} % 5 = 3 then 'ARCHIVED' when {key} % 11 = 7 then 'DELETED' else 'ACTIVE' end"


_KINDS = (("customer", "c_custkey", "c_name", True), ("supplier", "s_suppkey", "s_name", True), ("part", "p_partkey", "p_name", True), ("nation", "n_nationkey", "n_name", False), ("region", "r_regionkey", "r_name", False))


def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, id, name, entity_type, importance, state); nations and regions belong to no user."""
    out = None
    for kind, key, name, owned in _KINDS:
        k = F.col(key).cast("long")
        user = F.concat(F.lit("u"), (k % 3).cast("string")) if owned else F.lit(None).cast("string")
        part = table(spark, sf_dir, kind).select(user.alias("user_id"), F.concat(F.lit(kind + "_"), k.cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"), level(k).alias("importance"), state_of(k).alias("state"))
        out = part if out is None else out.unionByName(part)
    return out


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, target_id, relation_type, importance, state)"""
    out = None
    for kind, key, up, fk, rel in (("customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN"), ("supplier", "s_suppkey", "nation", "s_nationkey", "LOCATED_IN"), ("nation", "n_nationkey", "region", "n_regionkey", "PART_OF")):
        k = F.col(key).cast("long")
        part = table(spark, sf_dir, kind).select(F.concat(F.lit(kind + "_"), k.cast("string")).alias("source_id"), F.concat(F.lit(up + "_"), F.col(fk).cast("string")).alias("target_id"), F.lit(rel).alias("relation_type"), level(k + 2).alias("importance"), state_of(k + 1).alias("state"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("id", X.hash_id("source_id", "relation_type", "target_id"))


HIERARCHY = (
    "hn as ("
    + " union all ".join(
        f"select {'concat(chr(117), (' + k + ' % 3)::varchar)' if owned else 'null::varchar'} as user_id, '{t}_' || {k} as id, {n} as name, '{t}' as entity_type, {_level(k)} as importance, {_state(k)} as state from {t}" for t, k, n, owned in _KINDS
    )
    + "), he0 as ("
    + " union all ".join(
        f"select '{t}_' || {k} as source_id, '{up}_' || {fk} as target_id, '{rel}' as relation_type, {_level(k + ' + 2')} as importance, {_state('(' + k + ' + 1)')} as state from {t}"
        for t, k, up, fk, rel in (("customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN"), ("supplier", "s_suppkey", "nation", "s_nationkey", "LOCATED_IN"), ("nation", "n_nationkey", "region", "n_regionkey", "PART_OF"))
    )
    + "), he as (select *, substr(sha256(source_id || ':' || relation_type || ':' || target_id), 1, 16) as id from he0)"
)


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, target_id, relation_type, valid_from, priority) without ends."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.col("o_orderpriority").alias("target_id"), F.lit("HAS_PRIORITY").alias("relation_type"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.col("o_orderkey").cast("long").alias("priority"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemoria.operators.temporal import supersede_chain

    return supersede_chain(raw_facts(spark, sf_dir), ["source_id", "relation_type"], ["valid_from", "priority"])


FACTS = (
    "rf as (select 'order_' || o_orderkey as id, 'customer_' || o_custkey as source_id, o_orderpriority as target_id, 'HAS_PRIORITY' as relation_type, o_orderdate::timestamp as valid_from, o_orderkey::bigint as priority from orders),"
    "fa as (select *, lead(valid_from) over (partition by source_id, relation_type order by valid_from, priority) as valid_until from rf)"
)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, target_id, relation_type, weight, confidence, importance, state, accessed_at) of customer -> part -> supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    name = lambda kind, c: F.concat(F.lit(kind + "_"), F.col(c).cast("string"))
    both = None
    for rows, key, source, target, relation in ((lines.join(orders, "l_orderkey"), "o_custkey", ("customer", "o_custkey"), ("part", "l_partkey"), "BOUGHT"), (lines, "l_suppkey", ("part", "l_partkey"), ("supplier", "l_suppkey"), "SUPPLIED_BY")):
        # keys stay numbers until after the shuffle; each kind of edge has its own names, so the two don't meet
        g = rows.groupBy(key, "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.round(1 - 5 * F.avg("l_discount"), 9).alias("confidence"), F.max("l_shipdate").cast("timestamp").alias("accessed_at"))
        part = g.select(name(*source).alias("source_id"), name(*target).alias("target_id"), F.lit(relation).alias("relation_type"), "l_partkey", "weight", "confidence", "accessed_at")
        both = part if both is None else both.unionByName(part)
    k = F.col("l_partkey")
    return both.select(X.hash_id("source_id", "relation_type", "target_id").alias("id"), "source_id", "target_id", "relation_type", "weight", "confidence", level(k).alias("importance"), state_of(k).alias("state"), "accessed_at")


TRADE = (
    "t0 as (select 'customer_' || o_custkey as source_id, 'part_' || l_partkey as target_id, 'BOUGHT' as relation_type, l_partkey, l_discount, l_shipdate from lineitem join orders on l_orderkey = o_orderkey "
    "union all select 'part_' || l_partkey, 'supplier_' || l_suppkey, 'SUPPLIED_BY', l_partkey, l_discount, l_shipdate from lineitem),"
    "t1 as (select source_id, target_id, relation_type, l_partkey, count(*)::double as weight, round(1 - 5 * avg(l_discount), 9) as confidence, max(l_shipdate)::timestamp as accessed_at from t0 group by all),"
    f"te as (select substr(sha256(source_id || ':' || relation_type || ':' || target_id), 1, 16) as id, source_id, target_id, relation_type, weight, confidence, {_level('l_partkey')} as importance, {_state('l_partkey')} as state, accessed_at from t1)"
)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, target_id, relation_type, weight, confidence): one row for each line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_discount")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").join(customers, "c_custkey")
    return j.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("source_id"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("target_id"),
        F.col("l_returnflag").alias("relation_type"), F.lit(1.0).alias("weight"), F.round(1 - F.col("l_discount"), 9).alias("confidence"),
    )


MENTIONS = (
    "me as (select l_orderkey || '_' || l_linenumber as id, 'nation_' || s_nationkey as source_id, 'nation_' || c_nationkey as target_id, l_returnflag as relation_type, 1.0::double as weight, round(1 - l_discount, 9) as confidence "
    "from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey)"
)


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, access_count, accessed_at, age_days, importance) of the users in events."""
    from mnemoria.operators.scoring import fold_accesses

    log = table(spark, sf_dir, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    folded = fold_accesses(log, ["id", "user_id"])
    age = X.days_between(F.lit(AS_OF).cast("timestamp"), F.col("accessed_at"))
    return folded.select("id", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("user_id"), "access_count", "accessed_at", age.alias("age_days"), level(F.col("user_id")).alias("importance"), state_of(F.col("user_id")).alias("state"))


ACCESSES = (
    "ac0 as (select 'user_' || user_id as id, user_id, count(*) as access_count, max(ts)::timestamp as accessed_at from events group by user_id),"
    f"ac as (select id, 'u' || (user_id % 3) as user_id, access_count, accessed_at, (epoch_us(timestamp '{AS_OF}') - epoch_us(accessed_at)) / 86400000000.0 as age_days, {_level('user_id')} as importance, {_state('user_id')} as state from ac0)"
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, entity_type, importance, state, properties, access_count, hours) of the embeddings as entities."""
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        k.alias("id"), "embedding", F.concat(F.lit("type_"), F.col("label").cast("string")).alias("entity_type"), level(k).alias("importance"), state_of(k).alias("state"),
        F.when(k % 2 == 0, F.create_map(F.lit("lang"), F.when(k % 4 == 0, "en").otherwise("de"))).otherwise(F.create_map().cast("map<string,string>")).alias("properties"),
        (k % 13).alias("access_count"), (k % 48).cast("double").alias("hours"),
    )


VECTORS = (
    f"ve as (select vec_id as id, embedding::double[] as v, 'type_' || label as entity_type, {_level('vec_id')} as importance, {_state('vec_id')} as state, "
    "case when vec_id % 4 = 0 then 'en' when vec_id % 2 = 0 then 'de' end as lang, vec_id % 13 as access_count, (vec_id % 48)::double as hours from embeddings),"
    "q as (select v as qv from ve where id = 0)"
)
