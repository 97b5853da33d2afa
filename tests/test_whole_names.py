"""Names of all nodes in all questions, against brute force."""

from mnemoria.plans import queries
from mnemoria.sources import projection as P


def test_exact_name_match(spark, sf):
    nodes = [(r["id"], r["entity_type"], r["name"].lower()) for r in P.hierarchy_nodes(spark, sf).collect() if r["name"]]
    want = {(r["question_id"], i) for r in queries.questions(spark, sf).collect() for i, _, n in nodes if n in r["question"].lower()}
    got = {(r["question_id"], r["id"]) for r in queries.exact_name_match(spark, sf).collect()}
    kinds = {i: t for i, t, _ in nodes}
    assert got == want and {kinds[i] for _, i in got} >= {"nation", "part"}
