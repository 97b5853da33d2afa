"""Entity resolution, consolidation, and rewiring of edges.

Two ways: *exact* reads a tenant's mentions in order and keeps the first of each entity, as one task
a tenant; *scalable* joins mentions by type and blocking tokens, links similar ones, and
merges connected components.  They differ where similarity isn't transitive: the exact way compares with an
entity's first name only, the scalable way follows chains.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoria.functions import exprs as X
from mnemoria.functions import text as N
from mnemoria.functions.fuzzy import fuzzy, ratio
from mnemoria.operators.graph import components
from mnemoria.operators import vectors
from mnemoria.operators.lineage import cut


PATHS, MOST_PATHS = 1 << 10, 1 << 18  # best paths of transitive that are taken at first and at most; beyond, all are


def name_pairs(names: DataFrame, least: float = 0.7, type_col: str = "entity_type") -> DataFrame:
    """(a, b, similarity) of distinct names of one type with a token in common and token similarity >= least.

    Pairs meet on (type, token), each once: at the first token in order that they share.
    """
    own = names.select(F.lower(type_col).alias("t"), "name").distinct().withColumn("tokens", N.name_tokens("name"))
    rows = own.withColumn("token", F.explode("tokens"))
    left = rows.select("t", "token", F.col("name").alias("a"), F.col("tokens").alias("ta"))
    right = rows.select("t", "token", F.col("name").alias("b"), F.col("tokens").alias("tb"))
    met = left.join(right, ["t", "token"]).where("a < b").where(F.col("token") == F.array_min(F.array_intersect("ta", "tb")))
    return met.select("a", "b", F.col("t").alias("entity_type"), N.token_similarity("ta", "tb").alias("similarity")).where(F.col("similarity") >= least)


def match_rule(token, fuzzy_score, embedding, least_token: float = 0.7, least_fuzzy: float = 0.92, least_embedding: float = 0.85):
    """Whether two mentions are one entity, from their three similarities."""
    t, f, e = X.col(token), X.col(fuzzy_score), X.col(embedding)
    return (f >= least_fuzzy) | (t >= least_token) | ((t >= 0.6) & (e >= least_embedding)) | ((e >= 0.92) & (f >= 0.85))


def resolve_pairs(mentions: DataFrame, **limits) -> DataFrame:
    """(a, b, token, fuzzy, embedding) of mentions (id, name, entity_type, embedding) that are one entity.

    Candidates share a type and a name token, or an entity key; difflib only sees candidates.
    """
    own = mentions.select("id", "name", F.lower(F.coalesce("entity_type", F.lit("unknown"))).alias("t"), "embedding").withColumn("tokens", N.name_tokens("name"))
    keys = F.explode(F.array_distinct(F.array_append("tokens", F.concat(F.lit("="), N.entity_key("name")))))
    rows = own.withColumn("k", keys)
    side = lambda s: rows.select("t", "k", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "name", "tokens", "embedding")])
    met = side("a").join(side("b"), ["t", "k"]).where("id_a < id_b").drop("k").dropDuplicates(["id_a", "id_b"])
    scored = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), N.token_similarity("tokens_a", "tokens_b").alias("token"), fuzzy("name_a", "name_b").alias("fuzzy"), X.cosine("embedding_a", "embedding_b").alias("embedding"))
    return scored.where(match_rule("token", "fuzzy", "embedding", **limits))


def merge_entities(mentions: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: longest name by tokens, all aliases, longest description, mean embedding, chunks, counts."""
    size = F.size(F.split(F.col("name"), r"\s+"))
    longest = lambda c: F.max_by(c, F.struct(F.length(c), F.col(c)))
    best = F.max_by("name", F.struct(size.alias("w"), F.length("name").alias("l"), F.col("name").alias("n")))
    rows = mentions.withColumn("__aliases", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name", N.clean_name("name"))))
    out = rows.groupBy(*key).agg(
        best.alias("name"), F.min("id").alias("first_id"), longest("description").alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__aliases")))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_chunks")))).alias("source_chunks"), F.count(F.lit(1)).alias("occurrence_count"),
    )
    parts = rows.where("embedding is not null").select(*key, F.posexplode("embedding").alias("pos", "x")).groupBy(*key, "pos").agg(F.avg("x").alias("x"))
    mean = parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))
    return out.join(mean, key, "left")


def resolve(mentions: DataFrame, **limits) -> DataFrame:
    """(id, entity_id) of mentions (id, name, entity_type, embedding), the scalable way."""
    by_key = mentions.groupBy(F.lower(F.coalesce("entity_type", F.lit("unknown"))).alias("entity_type"), N.entity_key("name").alias("k"))
    one = cut(by_key.agg(F.min_by("name", "id").alias("name"), F.min_by("embedding", "id").alias("embedding"), F.min("id").alias("id")))
    pairs = resolve_pairs(one, **limits).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    roots = components(pairs, one).join(one.select("id", "entity_type", "k"), "id").select("entity_type", "k", F.col("component").alias("entity_id"))
    own = mentions.select("id", F.lower(F.coalesce("entity_type", F.lit("unknown"))).alias("entity_type"), N.entity_key("name").alias("k"))
    return own.join(roots, ["entity_type", "k"]).select("id", "entity_id")


_STOP = set(N.NAME_STOPWORDS)


def _tokens(name: str | None) -> set[str]:
    return set(re.findall("[a-z0-9]+", (name or "").lower())) - _STOP


def token_score(a: set[str], b: set[str]) -> float:
    if not a or not b:
        return 0.0
    score = len(a & b) / len(a | b)
    if a <= b or b <= a:
        score = max(score, 0.9)
    return max(score, 0.7) if max(a) == max(b) else score


def _cos(a, b) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / n if n else 0.0


def resolve_in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """(id, entity_id) of one tenant's mentions in order of id: the exact way."""
    frame = frame.sort_values("id")
    kept: list[tuple] = []  # id, name, type, tokens, embedding
    alias: dict[tuple[str, str], object] = {}
    out = []
    for r in frame.itertuples(index=False):
        name, kind = r.name or "", (r.entity_type or "").lower()
        key = re.sub("[^a-z0-9]", "_", re.sub(r"\s+", " ", name).strip(" \"'“”‘’").lower())[:64]
        own = _tokens(name)
        v = None if r.embedding is None else np.asarray(r.embedding, float)
        found = alias.get((kind, name.lower())) or alias.get((kind, "=" + key))
        if found is None:
            best = 0.0
            for cid, cname, ctype, ctokens, cv in kept:
                if kind and ctype and kind != ctype:
                    continue
                t, f, e = token_score(own, ctokens), ratio(name, cname), _cos(v, cv)
                if f >= 0.92 or t >= 0.7 or (t >= 0.6 and e >= 0.85) or (e >= 0.92 and f >= 0.85):
                    score = max(f, t, 0.4 * t + 0.6 * e if e else 0.0)
                    if score > best:
                        found, best = cid, score
        if found is None:
            found = r.id
            kept.append((r.id, name, kind, own, v))
        alias.setdefault((kind, name.lower()), found)
        alias.setdefault((kind, "=" + key), found)
        out.append((r.id, found))
    return pd.DataFrame(out, columns=["id", "entity_id"])


def resolve_exact(mentions: DataFrame, tenant: list[str]) -> DataFrame:
    """(id, entity_id): every tenant's mentions in order; a tenant has to fit in a task."""
    kind = mentions.schema["id"].dataType.simpleString()
    own = mentions.select(*tenant, "id", "name", "entity_type", "embedding")
    return own.groupBy(*tenant).applyInPandas(lambda f: resolve_in_order(f), f"id {kind}, entity_id {kind}")


def consolidation_pairs(nodes: DataFrame, last_name: float = 0.65, tokens: float = 0.60, embedding: float = 0.75) -> DataFrame:
    """(a, b, similarity) of nodes (id, name, aliases, entity_type, embedding) of one type to merge, a < b.

    Every pair of a type is compared, as containment and embeddings have no key to meet on: one matrix product for each
    pair of pieces of a type, and each pair of their distinct names once.  What leaves a task are pairs that are similar
    by name or vector; where that leaves it to a shared word, they take their names along.
    """
    key = lambda c: F.trim(F.lower(c))
    named = F.array_distinct(F.array_compact(F.array_append(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), key), key("name"))))
    own = nodes.select("id", "name", F.lower(F.coalesce("entity_type", F.lit("unknown"))).alias("t"), key("name").alias("n"), named.alias("keys"), F.col("embedding").alias("v"))
    kind = nodes.schema["id"].dataType.simpleString()
    met = vectors.in_pieces(own, ["t"], vectors.BLOCK).groupBy("t", "lo", "hi").applyInArrow(_similar_in(min(last_name, tokens, embedding), embedding), f"a {kind}, b {kind}, similarity double, name_a string, name_b string, sure boolean")
    ta, tb = N.significant_tokens("name_a"), N.significant_tokens("name_b")
    overlap = (F.size(ta) > 0) & (F.size(tb) > 0) & (F.size(F.array_intersect(ta, tb)) >= 0.5 * F.least(F.size(ta), F.size(tb)))
    c = F.col("similarity")
    return met.where(F.col("sure") | (N.share_last_name("name_a", "name_b") & (c >= last_name)) | (overlap & (c >= tokens))).select("a", "b", "similarity")


def cosines(left: list, right: list) -> np.ndarray:
    """Cosine of every pair; 0 where a vector is null or zero, or their lengths differ."""
    out = np.zeros((len(left), len(right)))
    sizes = [np.array([-1 if v is None else len(v) for v in side]) for side in (left, right)]
    for n in set(sizes[0].tolist()) & set(sizes[1].tolist()) - {-1, 0}:
        i, j = (np.flatnonzero(s == n) for s in sizes)
        x, y = (vectors.unit(pa.array([side[k] for k in at], pa.list_(pa.float64()))) for side, at in ((left, i), (right, j)))
        out[np.ix_(i, j)] = np.nan_to_num(x @ y.T)
    return out


def _same_names(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Whether one of two nodes' names (name, keys) holds the other, or they have a key in common."""
    out = np.zeros((len(left), len(right)), bool)
    by_key: dict[str, list[int]] = {}
    for j, (_, keys) in enumerate(right):
        for k in keys:
            by_key.setdefault(k, []).append(j)
    for i, (n, keys) in enumerate(left):
        for k in keys:
            out[i, by_key.get(k, [])] = True
        if n is not None:
            out[i, [j for j, (m, _) in enumerate(right) if m is not None and (m in n or n in m)]] = True
    return out


def _similar_in(least: float, embedding: float):
    """applyInArrow function for one pair of pieces of a type."""

    def similar_in(table: pa.Table) -> pa.Table:
        ids, names, p = table["id"].combine_chunks(), table["name"].combine_chunks(), table["p"].to_numpy()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right = np.flatnonzero(p == lo), np.flatnonzero(p == hi)
        vs, who = table["v"].to_pylist(), list(zip(table["n"].to_pylist(), map(tuple, table["keys"].to_pylist())))
        sim = cosines([vs[i] for i in left], [vs[j] for j in right])
        (la, lc), (ra, rc) = (_coded([who[i] for i in side]) for side in (left, right))
        same = _same_names(la, ra)[lc][:, rc]
        i, j = np.nonzero(same | (sim >= least))
        a, b = ids.take(pa.array(left[i])), ids.take(pa.array(right[j]))
        first = pc.less(a, b)
        sure = same[i, j] | (sim[i, j] >= embedding)
        some = lambda at: pc.if_else(pa.array(sure), pa.scalar(None, names.type), names.take(pa.array(at)))
        swap = lambda x, y: (pc.if_else(first, x, y), pc.if_else(first, y, x))
        (a1, b1), (na, nb) = swap(a, b), swap(some(left[i]), some(right[j]))
        out = pa.table({"a": a1, "b": b1, "similarity": pa.array(sim[i, j]), "name_a": na, "name_b": nb, "sure": pa.array(sure)})
        return out.filter(first) if lo == hi else out.filter(pc.not_equal(a, b))

    return similar_in


def _coded(rows: list[tuple]) -> tuple[list[tuple], np.ndarray]:
    codes: dict[tuple, int] = {}
    at = np.array([codes.setdefault(r, len(codes)) for r in rows], int)
    return list(codes), at


def leaders(frame: pd.DataFrame) -> pd.DataFrame:
    """(id, leader): greedy leader clustering of one block's pairs (a, b), in order of id; not transitive."""
    near: dict = {}
    for a, b in zip(frame["a"], frame["b"]):
        near.setdefault(a, []).append(b)
        near.setdefault(b, [])
    done, out = set(), []
    for seed in sorted(near):
        if seed in done:
            continue
        group = [seed, *[x for x in sorted(near[seed]) if x not in done]]
        if len(group) > 1:
            done.update(group)
            out += [(x, seed) for x in group]
    return pd.DataFrame(out, columns=["id", "leader"])


def merge_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes merged by groups (id, canon): canon is the id that stays; nodes in no group pass through.

    The name is that of the longest name, then most accesses; counters add up, importance is the
    greatest, aliases unite, created_at is the first.
    """
    own = nodes.join(groups, "id", "left").withColumn("canon", F.coalesce("canon", "id"))
    longest = F.max_by("description", F.struct(F.length("description"), F.col("description")))
    return own.groupBy("canon").agg(
        F.max_by("name", F.struct(F.length("name").alias("l"), F.col("access_count").alias("c"), F.col("name").alias("n"))).alias("name"), F.min("entity_type").alias("entity_type") if "entity_type" in nodes.columns else F.lit(None).alias("entity_type"),
        longest.alias("description"), F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))), F.collect_set("name")))).alias("aliases"),
        F.max("importance").alias("importance"), F.sum("access_count").alias("access_count"), F.count(F.lit(1)).alias("merge_count"),
    ).withColumnRenamed("canon", "id")


def rewire(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges whose endpoints are replaced by the ids that stay; edges that become loops by it are dropped."""
    a = groups.select(F.col("id").alias("source_id"), F.col("canon").alias("__a"))
    b = groups.select(F.col("id").alias("target_id"), F.col("canon").alias("__b"))
    out = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    moved = F.col("__a").isNotNull() | F.col("__b").isNotNull()
    source, target = F.coalesce("__a", "source_id"), F.coalesce("__b", "target_id")
    return out.where(~(moved & (source == target))).withColumns({"source_id": source, "target_id": target}).select(*edges.columns)


def reinforce(edges: DataFrame) -> DataFrame:
    """Repeated edges become one: the strongest's id, weights summed up to 10, confidence 1.1 times the mean up to 1."""
    strongest = F.min(F.struct((-F.col("weight")).alias("w"), (-F.col("confidence")).alias("c"), "id"))["id"]
    g = edges.groupBy("source_id", "target_id", "relation_type").agg(strongest.alias("id"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.avg("confidence").alias("c"), F.max("weight").alias("w1"), F.max("confidence").alias("c1"))
    more = F.col("n") > 1
    return g.select("id", "source_id", "target_id", "relation_type", "n", F.when(more, F.least(F.lit(10.0), "w")).otherwise(F.col("w1")).alias("weight"), F.when(more, F.least(F.lit(1.0), 1.1 * F.col("c"))).otherwise(F.col("c1")).alias("confidence"))


def transitive(edges: DataFrame, least: float = 0.7, most: int | None = 10) -> DataFrame:
    """New edges A -> C where A -> B and B -> C hold with confidence ``least``, and A -> C is unknown.

    Of several paths that with the greatest confidence counts.  ``most`` limits the edges that one run
    adds, the most confident first (a setting of the operator; None for all).  Then only the best paths leave the join:
    what comes before the last of them in order is complete, so if it holds ``most`` new edges, these are they; else more are taken.
    """
    sure = edges.where(F.col("confidence") >= least).select("source_id", "target_id", "weight", "confidence")
    sure = sure if most is None else cut(sure)
    ab = sure.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").alias("w1"), F.col("confidence").alias("c1"))
    bc = sure.select(F.col("source_id").alias("b"), F.col("target_id").alias("c"), F.col("weight").alias("w2"), F.col("confidence").alias("c2"))
    paths = ab.join(bc, "b").where("a <> c").select("a", "c", (0.8 * F.col("c1") * F.col("c2")).alias("confidence"), (0.5 * F.least("w1", "w2")).alias("weight"), F.col("b").alias("via"))
    known = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("c"))
    size = PATHS
    while most is not None and size <= MOST_PATHS:
        order = [F.desc("confidence"), "a", "c"]
        found = cut(paths.orderBy(*order).limit(size))
        whole = found.count() < size
        last = None if whole else found.orderBy(F.asc("confidence"), F.desc("a"), F.desc("c")).first()
        own = found if whole else found.where((F.col("confidence") != last["confidence"]) | (F.col("a") != last["a"]) | (F.col("c") != last["c"]))
        pairs = own.select("a", "c").distinct()
        taken = cut(known.join(F.broadcast(pairs), ["a", "c"], "left_semi").distinct())
        new = _inferred(own, taken)
        if whole or new.count() >= most:
            return new.orderBy(F.desc("confidence"), "source_id", "target_id").limit(most)
        size *= 16
    new = _inferred(paths, known.distinct())
    return new if most is None else new.orderBy(F.desc("confidence"), "source_id", "target_id").limit(most)


def _inferred(paths: DataFrame, known: DataFrame) -> DataFrame:
    best = paths.groupBy("a", "c").agg(F.max(F.struct("confidence", "weight", "via")).alias("p")).join(known, ["a", "c"], "left_anti")
    return best.select(F.col("a").alias("source_id"), F.col("c").alias("target_id"), F.lit("INFERRED").alias("relation_type"), F.col("p.confidence").alias("confidence"), F.col("p.weight").alias("weight"), F.col("p.via").alias("via"))


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by name become edges by id; those with an unknown end are dropped.  The last id in order wins a name."""
    names = F.explode(F.array_distinct(F.transform(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name", F.coalesce("canonical_name", "name"))), F.lower)))
    by_name = nodes.select("id", names.alias("n")).groupBy("n").agg(F.max("id").alias("id"))
    a = by_name.select(F.col("n").alias("__s"), F.col("id").alias("__sid"))
    b = by_name.select(F.col("n").alias("__t"), F.col("id").alias("__tid"))
    out = edges.join(a, F.lower("source_id") == F.col("__s")).join(b, F.lower("target_id") == F.col("__t"))
    return out.withColumns({"source_id": F.col("__sid"), "target_id": F.col("__tid")}).select(*edges.columns)


def apply_coreferences(nodes: DataFrame, links: DataFrame, least: float = 0.7) -> DataFrame:
    """Nodes renamed by links (mention, canonical, confidence): the old name becomes an alias, the id stays."""
    sure = links.where(F.coalesce("confidence", F.lit(0.5)) >= least)
    best = sure.groupBy(F.lower("mention").alias("__m")).agg(F.max_by("canonical", F.struct("confidence", "canonical")).alias("__to"))
    out = nodes.join(best, F.lower("name") == F.col("__m"), "left")
    hit = F.col("__to").isNotNull()
    alias = F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name", "__to")))
    return out.withColumns({"aliases": F.when(hit, alias).otherwise(F.col("aliases")), "name": F.coalesce("__to", "name"), "coreference": hit}).drop("__m", "__to")


def latest(rows: DataFrame, key: list[str], by: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The row of each key that was updated last; of equal ones any, but the same in every run."""
    order = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in by], F.xxhash64(*[c for c, k in rows.dtypes if not k.startswith("map")]))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
