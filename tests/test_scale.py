"""Steps whose cost grew faster than their input, against brute force on small pieces."""

import time
from collections import Counter

import numpy as np
import pytest

from mnemoria.operators import graph, resolve, retrieve, vectors


def test_top_k_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "STRIP", 5)
    monkeypatch.setattr(vectors, "GROUP", 4)
    x = np.random.default_rng(1).integers(-1, 2, (90, 3)).astype(float)  # few directions, so many ties
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id int, embedding array<double>")
    got = {}
    for r in vectors.top_k_each(nodes, nodes.selectExpr("id as query_id", "embedding as vector"), 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    u = np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
    assert got == {q: dict(enumerate(np.argsort(-np.round(u[q] @ u.T, 9), kind="stable")[:4].tolist(), 1)) for q in range(90)}


def test_consolidation_compares_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(2)
    names = ["Ann Lee", "Bob Lee", "lee", "Rome", "rome ", "City of Rome", None, "Kim Park", "Park Kim", "Zed"]
    rows = [(f"n{i:02d}", names[i % 10], ["Kim"] if i % 9 == 0 else None, "T" if i % 3 else None, None if i % 11 == 0 else rng.normal(size=3).tolist()) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id string, name string, aliases array<string>, entity_type string, embedding array<double>")
    pairs = resolve.consolidation_pairs(nodes)
    assert "FlatMapGroupsInArrow" in pairs._jdf.queryExecution().toString()

    def cos(a, b):
        return 0.0 if a is None or b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    def similar(a, b):
        c, x, y = cos(a[4], b[4]), *((r[1] or "").lower().strip() for r in (a, b))
        keys = [{w.lower() for w in r[2] or []} | ({n} if r[1] else set()) for r, n in ((a, x), (b, y))]
        s, t = set(x.split()), set(y.split())
        return bool(keys[0] & keys[1]) or bool(a[1] and b[1] and (x in y or y in x)) or c >= 0.75 or bool(s and t and x.split()[-1] == y.split()[-1] and c >= 0.65) or bool(s and t and len(s & t) >= 0.5 * min(len(s), len(t)) and c >= 0.6)

    want = {(a[0], b[0]): cos(a[4], b[4]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[3] == b[3] and similar(a, b)}
    got = {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion_in_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "PART", 50)
    rng = np.random.default_rng(3)
    exact = sorted({(int(q), int(i)) for q, i in rng.integers(0, 20, (300, 2)) if q % 4})
    near = {(q, int(i)): float(s) for q in range(25) for i, s in zip(rng.permutation(30)[:3], rng.uniform(-1, 1, 3))}
    got = retrieve.fuse(spark.createDataFrame(exact, "question_id int, id int"), spark.createDataFrame([(*k, s) for k, s in near.items()], "question_id int, id int, score double"))
    assert got.rdd.getNumPartitions() == len(exact) // 50 + 1
    some = {q for q, _ in exact}
    want = {k: min(1.0, 1 + 0.2 * near.get(k, 0.0)) for k in exact} | {k: 0.8 * s if k[0] in some else s for k, s in near.items() if k not in exact and (k[0] not in some or s >= 0.75)}
    assert {(r["question_id"], r["id"]): r["score"] for r in got.collect()} == want


def test_names_in_questions_in_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "SPREAD", 3)
    rng = np.random.default_rng(4)
    words = ["ab", "a", "é", "bé", "ñandú", "x", "abé x", "zz"]
    nodes = [(i, str(rng.choice(words)), None if i % 3 else str(rng.choice(words)).upper(), [str(rng.choice(words)) * 2, "x"]) for i in range(40)] + [(90, "", None, None)]
    asked = [(q, " ".join(rng.choice([*words, "Ab", "q"], 5))) for q in range(30)] + [(77, None), (78, "")]
    got = retrieve.exact_matches(spark.createDataFrame(nodes, "id long, name string, canonical_name string, aliases array<string>"), spark.createDataFrame(asked, "question_id int, question string")).collect()
    forms = {i: {w.lower() for w in (n, c) if w} | {a.lower() for a in al or [] if len(a) >= 3} for i, n, c, al in nodes}
    want = {(q, i) for q, t in asked if t for i, own in forms.items() if any(w in t.lower() for w in own)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_transitive_takes_more_paths_until_enough_are_new(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = sorted({(f"n{a}", f"n{b}"): (float(rng.integers(1, 4)), float(rng.integers(6, 11)) / 10) for a, b in rng.integers(0, 25, (220, 2))}.items())
    rows = spark.createDataFrame([(a, b, w, c) for (a, b), (w, c) in edges], "source_id string, target_id string, weight double, confidence double")
    best = {}
    for (a, b), (w1, c1) in edges:
        for (b2, c), (w2, c2) in edges:
            if b == b2 and a != c and min(c1, c2) >= 0.7 and (a, c) not in dict(edges):
                best[a, c] = max(best.get((a, c), (0.0, 0.0, "")), (0.8 * c1 * c2, 0.5 * min(w1, w2), b))
    want = [(a, c, *p) for (a, c), p in sorted(best.items(), key=lambda x: (-x[1][0], x[0]))]
    get = lambda most: [tuple(r) for r in resolve.transitive(rows, most=most).select("source_id", "target_id", "confidence", "weight", "via").collect()]
    for size, most_paths in ((1, 1 << 18), (3, 50)):
        monkeypatch.setattr(resolve, "PATHS", size)
        monkeypatch.setattr(resolve, "MOST_PATHS", most_paths)
        assert get(10) == want[:10]
    assert get(10_000) == want and sorted(get(None)) == sorted(want)


@pytest.mark.parametrize("labels", [1 << 24, 5])
def test_labels_packed_and_joined(spark, monkeypatch, labels):
    monkeypatch.setattr(graph, "BLOCK", 7)
    monkeypatch.setattr(graph, "LABELS", labels)
    rng = np.random.default_rng(6)
    ids = [f"v{i}" for i in range(60)]
    pairs = [(ids[a], ids[b]) for a, b in rng.integers(0, 55, (110, 2))] + [("v1", "lost")]
    near = {i: {y for x in pairs for y in x if i in x and y != i and y in ids} for i in ids}
    want = {i: i for i in ids}
    for _ in range(3):
        votes = {i: Counter(want[j] for j in near[i]) for i in ids}
        want = {i: min(votes[i], key=lambda k: (-votes[i][k], k)) if votes[i] else want[i] for i in ids}
    got = graph.label_propagation(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source_id string, target_id string"), 3)
    assert {r["id"]: r["label"] for r in got.collect()} == want


def test_greedy_modularity_of_a_large_star_and_all_merges():
    star = [(f"c{5 * i + j}", f"n{j}") for j in range(5) for i in range(2000)] + [(f"n{j}", "r") for j in range(5)]
    began = time.time()
    groups = graph.greedy_modularity(star)
    assert time.time() - began < 20 and sorted(map(len, groups)) == [2001] * 4 + [2002]

    def slow(pairs):
        own = {v: {v} for p in pairs for v in p}
        m, deg = len(pairs), Counter(v for p in pairs for v in p)
        while True:
            gains = []
            for x in own:
                for y in own:
                    if x < y and (n := sum((a in own[x]) & (b in own[y]) | (b in own[x]) & (a in own[y]) for a, b in pairs)):
                        gains.append((-(2 * m * n - sum(deg[v] for v in own[x]) * sum(deg[v] for v in own[y])), x, y))
            if not gains or min(gains)[0] >= 0:
                return sorted(map(sorted, own.values()), key=lambda c: (-len(c), c))
            _, x, y = min(gains)
            own[x] |= own.pop(y)

    rng = np.random.default_rng(7)
    for n in range(4, 24):
        pairs = sorted({tuple(sorted((f"v{a}", f"v{b}"))) for a, b in rng.integers(0, n, (2 * n, 2)) if a != b})
        assert graph.greedy_modularity(pairs) == slow(pairs)
