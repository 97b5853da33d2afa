"""Graph operators, resolution and consolidation on small graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.operators import graph, resolve, vectors


def edges_of(spark, pairs, **more):
    rows = [(f"e{i}", a, b) for i, (a, b) in enumerate(pairs)]
    out = spark.createDataFrame(rows, "id string, source_id string, target_id string").withColumns({"weight": F.lit(1.0), "confidence": F.lit(1.0), "importance": F.lit(5.0), "state": F.lit("ACTIVE"), "relation_type": F.lit("R")})
    return out.withColumns(more)


def nodes_of(spark, ids):
    return spark.createDataFrame([(i, f"name {i}", "t", 5.0) for i in ids], "id string, name string, entity_type string, importance double")


CLIQUES = [(a, b) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w")]


def power(ids, pairs, alpha=0.85, rounds=100):
    n = len(ids)
    at = {v: i for i, v in enumerate(ids)}
    m = np.zeros((n, n))
    for a, b in pairs:
        m[at[b], at[a]] = 1
    out = m.sum(0)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        x = alpha * (m @ np.divide(x, out, out=np.zeros(n), where=out > 0) + x[out == 0].sum() / n) + (1 - alpha) / n
    return dict(zip(ids, x))


@pytest.mark.parametrize("ids,pairs", [("abcde", [("b", "a"), ("c", "a"), ("d", "a"), ("a", "b")]), ("abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")]), ("ab", [])])
def test_pagerank(spark, ids, pairs):
    got = {r["id"]: r["rank"] for r in graph.pagerank(nodes_of(spark, ids), edges_of(spark, pairs), normalise=False, iterations=4, tolerance=0).collect()}
    want = power(list(ids), pairs, rounds=4)
    assert sum(got.values()) == pytest.approx(1) and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in ids)


def test_pagerank_stops_or_is_uniform(spark):
    nodes, edges = nodes_of(spark, "abc"), edges_of(spark, [("a", "b"), ("c", "b"), ("b", "a")])
    assert {r["rank"] for r in graph.pagerank(nodes, edges, iterations=1).collect()} == {1.0}
    assert max(r["rank"] for r in graph.pagerank(nodes, edges, tolerance=0.1).collect()) == 1


def test_expansion(spark):
    chain = [("a", "b"), ("c", "b"), ("c", "d"), ("d", "e")]
    edges = edges_of(spark, chain, state=F.when(F.col("id") == "e3", "ARCHIVED").otherwise("ACTIVE"))
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in graph.expand(seeds, edges, 9).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert graph.expand(seeds, edges, 2, nodes_of(spark, "abd")).count() == 2
    reached = graph.expand(seeds, edges, 2)
    assert {r["id"] for r in graph.expanded_edges(edges, reached, 2).collect()} == {"e0", "e1"}


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(12)] + [("x", "y"), ("z", "z")]
    out = {r["id"]: r["component"] for r in graph.components(edges_of(spark, chain), nodes_of(spark, [*{v for p in chain for v in p}, "alone"])).collect()}
    assert {v for k, v in out.items() if k.startswith("n")} == {"n000"} and (out["y"], out["z"], out["alone"]) == ("x", "z", "alone")


@pytest.mark.parametrize("algorithm", ["label_propagation", "greedy_modularity"])
def test_communities(spark, algorithm):
    nodes, edges = nodes_of(spark, "abcdwxyz1"), edges_of(spark, CLIQUES)
    got = graph.communities(nodes, edges, algorithm)
    groups = {}
    for r in got.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [list("abcd"), list("wxyz")]
    metrics = graph.cluster_metrics(got, edges).collect()
    assert [(m["n_edges"], m["density"], m["coherence_score"]) for m in metrics] == [(6, 1.0, 1.0)] * 2
    assert {len(r["entities"]) for r in graph.clusters(got, nodes, edges, algorithm).collect()} == {4}
    assert max(r["count"] for r in graph.communities(nodes, edges, algorithm, most=3, least=1).groupBy("cluster_id").count().collect()) == 3


def test_degrees_and_loops(spark):
    got = {r["id"]: r["degree"] for r in graph.degrees(edges_of(spark, [("a", "a"), ("a", "b")])).collect()}
    assert got == {"a": 2, "b": 1}


def test_reinforce_and_transitive(spark):
    rows = [("x", "a", "b", 1.0, 0.9), ("y", "a", "b", 9.0, 0.9), ("z", "a", "b", 2.0, 0.9)]
    one = resolve.reinforce(spark.createDataFrame(rows, "id string, source_id string, target_id string, weight double, confidence double").withColumn("relation_type", F.lit("R"))).first()
    assert (one["id"], one["weight"]) == ("y", 10.0) and one["confidence"] == pytest.approx(0.99)
    rows = [("1", "A", "B", 2.0, 0.8), ("2", "B", "C", 1.0, 0.9), ("3", "B", "D", 1.0, 0.5), ("4", "C", "A", 1.0, 0.9), ("5", "A", "E", 1.0, 0.9), ("6", "E", "B", 1.0, 0.9)]
    new = {(r["source_id"], r["target_id"]): r for r in resolve.transitive(spark.createDataFrame(rows, "id string, source_id string, target_id string, weight double, confidence double")).collect()}
    assert new["A", "C"]["weight"] == 0.5 and new["A", "C"]["confidence"] == pytest.approx(0.576) and ("A", "B") not in new and ("A", "D") not in new


MENTIONS = ["Alexander Chen", "Dr. Alexander Chen", "alexander chen", "Helix Quantum Inc", "Helix Quantum", "Borealis", "Alexandra Ruiz", "Quantum Helix", "Rome"]


def test_resolution_both_ways(spark):
    rows = spark.createDataFrame([("u", i, n, "T", None) for i, n in enumerate(MENTIONS)], "user_id string, id int, name string, entity_type string, embedding array<float>")
    exact = {r["id"]: r["entity_id"] for r in resolve.resolve_exact(rows, ["user_id"]).collect()}
    fast = {r["id"]: r["entity_id"] for r in resolve.resolve(rows).collect()}
    assert exact == fast and exact[2] == 0 and exact[4] == 3 and exact[7] == 3 and exact[5] == 5
    again = spark.createDataFrame([("u", i, MENTIONS[e], "T", None) for i, e in exact.items()], rows.schema)
    assert len({r["entity_id"] for r in resolve.resolve(again).collect()}) == len(set(exact.values()))


def test_merge_and_rewire(spark):
    nodes = spark.createDataFrame([("a", "Bob", ["B"], "x", 5.0, 1), ("b", "Bobby Lee", None, "longer", 8.0, 2), ("c", "Eve", [], None, 1.0, 0)], "id string, name string, aliases array<string>, description string, importance double, access_count long").withColumn("entity_type", F.lit("P"))
    groups = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, canon string")
    out = {r["id"]: r for r in resolve.merge_nodes(nodes, groups).collect()}
    assert set(out) == {"a", "c"} and (out["a"]["name"], out["a"]["description"], out["a"]["importance"], out["a"]["access_count"], out["a"]["aliases"]) == ("Bobby Lee", "longer", 8.0, 3, ["B", "Bob", "Bobby Lee"])
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "c")])
    assert {(r["source_id"], r["target_id"]) for r in resolve.rewire(edges, groups).collect()} == {("a", "c"), ("c", "c")}


def test_endpoints_and_coreference(spark):
    nodes = spark.createDataFrame([("1", "Acme", "Acme Corp", ["ACM"]), ("2", "Rome", None, None)], "id string, name string, canonical_name string, aliases array<string>")
    edges = spark.createDataFrame([("e", "acm", "ROME"), ("f", "acme corp", "Mars")], "id string, source_id string, target_id string")
    assert [tuple(r) for r in resolve.resolve_endpoints(edges, nodes).collect()] == [("e", "1", "2")]
    links = spark.createDataFrame([("rome", "Roma", 0.9), ("Acme", "X", 0.3)], "mention string, canonical string, confidence double")
    got = {r["id"]: (r["name"], r["coreference"]) for r in resolve.apply_coreferences(nodes, links).collect()}
    assert got == {"1": ("Acme", False), "2": ("Roma", True)}


def test_vector_pairs_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6))
    rows = [(i, f"t{i % 2}", v.tolist()) for i, v in enumerate(x)] + [(500, "t0", None)]
    nodes = spark.createDataFrame(rows, "id int, entity_type string, embedding array<double>")
    got = {(r["a"], r["b"]): r["similarity"] for r in vectors.pairs(nodes, "entity_type", 0.5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j): u[i] @ u[j] for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and u[i] @ u[j] >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    near = vectors.top_k_each(nodes, nodes.where("embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 3)
    by = {}
    for r in near.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert len(by) == 120
    for q, found in by.items():
        assert [i for _, i in sorted(found)] == np.argsort(-np.round(u[q] @ u.T, 9), kind="stable")[:3].tolist()
