"""PageRank and label propagation with production defaults, against brute force."""

from collections import Counter

from mnemoria.plans import queries
from mnemoria.sources import projection as P


def graph_of(spark, sf):
    ids = [r[0] for r in P.hierarchy_nodes(spark, sf).select("id").collect()]
    return ids, P.trade_edges(spark, sf).select("id", "source_id", "target_id", "weight", "confidence").collect()


def test_pagerank(spark, sf):
    ids, edges = graph_of(spark, sf)
    last = {(e["source_id"], e["target_id"]): float(e["weight"]) * float(e["confidence"]) for e in sorted(edges, key=lambda e: e["id"])}
    total = Counter()
    for (a, _), w in last.items():
        total[a] += w
    x, step = dict.fromkeys(ids, 1 / len(ids)), 1.0
    while step >= 1e-6 * len(ids):
        c = Counter()
        for (a, b), w in last.items():
            c[b] += x[a] * w / total[a]
        rest = (1 - sum(c.values())) / len(ids)
        new = {i: 0.85 * (c[i] + rest) + 0.15 / len(ids) for i in ids}
        x, step = new, sum(abs(new[i] - x[i]) for i in ids)
    top = max(x.values())
    got = {r["id"]: r["rank"] for r in queries.pagerank(spark, sf).collect()}
    assert set(got) == set(ids) and all(abs(got[i] - x[i] / top) < 2e-6 for i in ids)


def test_label_propagation(spark, sf):
    ids, edges = graph_of(spark, sf)
    near = {i: set() for i in ids}
    for e in edges:
        if e["source_id"] != e["target_id"]:
            near[e["source_id"]].add(e["target_id"])
            near[e["target_id"]].add(e["source_id"])
    label, early = {i: i for i in ids}, None
    for n in range(10):
        votes = {i: Counter(label[j] for j in near[i]) for i in ids}
        label = {i: min(votes[i], key=lambda k: (-votes[i][k], k)) if votes[i] else label[i] for i in ids}
        early = label if n == 1 else early
    assert {r["id"]: r["label"] for r in queries.label_propagation(spark, sf).collect()} == label != early
