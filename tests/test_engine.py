"""The engine over its store: ingest, query, evolve, rehydrate, tenants, cache, streams."""

import json
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemoria.conf import EngineConfig
from mnemoria.errors import QueryError
from mnemoria.plans.engine import MemoryEngine
from mnemoria.sources.store import CacheTable
from mnemoria.streaming import ingest as stream

T0 = datetime(2024, 1, 1)
TEXT = "Ada Lovelace worked with Charles Babbage in London. Charles Babbage designed the Analytical Engine. Ada Lovelace wrote about Analytical Engine in 1843."


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = MemoryEngine(spark, str(tmp_path_factory.mktemp("store")), EngineConfig(user_id="alice"))
    docs = spark.createDataFrame([("d1", TEXT), ("d2", "Marie Curie worked in Paris. Marie Curie discovered Radium with Pierre Curie."), ("d3", "  "), ("d4", None)], "doc_id string, text string")
    e.counts = e.ingest(docs, T0)
    return e


def test_ingest(engine):
    assert engine.counts["documents"] == 2 and engine.counts["failed_chunks"] == 0
    assert engine.stats()["nodes"] == engine.counts["nodes"] >= 6 and engine.stats()["edges"] >= 3 and engine.stats()["clusters"] >= 1
    nodes, edges = engine.store.load_graph(*engine.tenant)
    assert edges.join(nodes, edges["source_id"] == nodes["id"], "left_anti").count() == 0
    ada = nodes.where("name = 'Ada Lovelace'").first()
    assert ada["occurrence_count"] == 1 and len(ada["embedding"]) == 64 and ada["created_at"] == T0


def test_query_finds_and_records(engine):
    out = engine.query("What did Ada Lovelace write about?", as_of=T0)
    names = {r["name"] for r in out.nodes.collect()}
    assert {"Ada Lovelace", "Analytical Engine"} <= names and "Ada Lovelace" in out.context and out.confidence == 0.7 and out.has_results
    assert engine.nodes().where("name = 'Ada Lovelace'").first()["access_count"] == 1
    assert engine.store.load("nodes", *engine.tenant).where("access_count > 0").isEmpty()  # a query appends to the log and writes no node
    assert engine.query("Ada Lovelace", mode="exact", record=False).nodes.count() == 1
    assert not engine.query("zzz qqq", least=0.99, record=False).has_results
    with pytest.raises(QueryError):
        engine.query("x", mode="other")


def test_again_keeps_counters(engine):
    before = engine.stats()
    engine.ingest_text(TEXT, "d1", datetime(2024, 1, 2))
    ada = engine.nodes().where("name = 'Ada Lovelace'").first()
    assert ada["occurrence_count"] == 1  # the same document again
    assert engine.stats()["nodes"] == before["nodes"] and ada["access_count"] >= 1 and ada["created_at"] == T0


def test_tenants_are_apart(spark, engine):
    bob = MemoryEngine(spark, engine.store.path, replace(engine.conf, user_id="bob"))
    assert bob.stats() == {"nodes": 0, "edges": 0, "clusters": 0}
    bob.ingest(spark.createDataFrame([("b", "Bob Stone visited Lima with Carla Ruiz.")], "doc_id string, text string"), T0, communities=False)
    mine = engine.stats()
    assert bob.store.load("nodes", *bob.tenant).where("name = 'Ada Lovelace'").count() == 0
    assert {r["user_id"] for r in bob.store.tenants().collect()} == {"alice", "bob"}
    bob.clear()
    assert bob.stats()["nodes"] == 0 and engine.stats() == mine


def test_evolution(engine):
    events = engine.evolve(datetime(2024, 6, 1), force=True, consolidate=False)
    kinds = {r["evolution_type"] for r in events.select("evolution_type").distinct().collect()}
    assert kinds & {"SYNTHESIS", "REINFORCEMENT", "DECAY", "PRUNING"}
    assert engine.evolve(datetime(2024, 6, 1)) is None
    nodes, edges = engine.store.load_graph(*engine.tenant)
    assert nodes.where("importance > 10 or importance < 0").count() == 0 and nodes.count() == nodes.select("id").distinct().count()
    engine.store.upsert("nodes", nodes.withColumns({"state": F.lit("ARCHIVED"), "updated_at": F.lit(datetime(2025, 1, 1)).cast("timestamp")}))
    assert engine.rehydrate("Ada Lovelace: worked with Charles Babbage in London", as_of=datetime(2025, 2, 1)) >= 0
    rows = engine.export().collect()
    assert rows and all(json.loads(r["json"])["user_id"] == "alice" for r in rows)


def test_consolidation_merges(spark, tmp_path):
    from mnemoria.plans.evolve import evolve

    e = MemoryEngine(spark, str(tmp_path))
    e.ingest_text("Grace Hopper wrote Cobol. Grace Hopper served Navy.", as_of=T0)
    nodes, edges = e.store.load_graph(*e.tenant)
    twin = nodes.where("name = 'Grace Hopper'").withColumns({"id": F.lit("zz"), "name": F.lit("Dr. Grace Hopper")})
    moved = edges.limit(1).withColumns({"id": F.lit("zz1"), "source_id": F.lit("zz")})
    out = evolve(nodes.unionByName(twin), edges.unionByName(moved), F.lit(T0).cast("timestamp"))
    assert out.nodes.where("id = 'zz'").count() + out.nodes.where("name like '%Grace Hopper'").count() == 1
    ids = out.nodes.select("id")
    assert out.edges.join(ids, out.edges["source_id"] == ids["id"], "left_anti").count() == 0
    assert out.events.where("evolution_type = 'CONSOLIDATION'").count() >= 1


def test_cache(spark, engine):
    cache = CacheTable(engine.store)
    at = lambda h: F.lit(datetime(2024, 1, 1, h)).cast("timestamp")
    rows = spark.createDataFrame([("k", "a", "m", "v", datetime(2024, 1, 1, 5)), ("k", "ab", "m", "w", datetime(2024, 1, 1, 5))], "key string, user_id string, memory_id string, value string, expires_at timestamp")
    cache.put(rows)
    assert cache.get("k", at(1), "a", "m") == "v" and cache.get("k", at(6), "a", "m") is None
    cache.invalidate("a", "m", at(2))
    assert cache.get("k", at(3), "a", "m") is None and cache.get("k", at(3), "ab", "m") == "w"


def test_stream_equals_batch(spark, tmp_path):
    texts = [("a", TEXT), ("b", "Marie Curie discovered Radium with Pierre Curie.")]
    batch = MemoryEngine(spark, str(tmp_path / "batch"))
    batch.ingest(spark.createDataFrame(texts, "doc_id string, text string"), T0)
    (tmp_path / "in").mkdir()
    for i, t in texts:
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"doc_id": i, "content": t}))
    live = MemoryEngine(spark, str(tmp_path / "live"))
    stream.run(live, stream.from_files(spark, str(tmp_path / "in"), 1), str(tmp_path / "check"), every=None).awaitTermination()
    names = lambda e: {r["name"] for r in e.store.load("nodes").select("name").collect()}
    ends = lambda e: {r["id"] for r in e.store.load("edges").select("id").collect()}
    assert names(live) == names(batch) and ends(live) == ends(batch)


def test_folded_access_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text("\n".join(json.dumps({"id": i, "ts": f"2024-01-01T0{h}:10:00"}) for i, h in (("a", 1), ("a", 1), ("b", 2), ("a", 9))))
    log = spark.readStream.schema("id string, ts timestamp").json(str(tmp_path / "log"))
    q = stream.folded_accesses(log).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["id"], r["access_count"]) for r in spark.table("folded").collect()} == {("a", 2), ("b", 1)}


def test_replacing_with_nothing_leaves_nothing(spark, engine):
    other = MemoryEngine(spark, engine.store.path, replace(engine.conf, user_id="a b/c"))
    rows = engine.store.load("clusters", *engine.tenant).withColumn("user_id", F.lit("a b/c"))
    other.store.replace("clusters", rows, other.tenant)
    assert other.stats()["clusters"] > 0
    other.store.replace("clusters", rows.limit(0), other.tenant)
    assert other.stats()["clusters"] == 0 and engine.stats()["clusters"] > 0


def test_responses_of_three_forms(spark):
    from mnemoria.operators import extraction

    rows = [
        (1, '("entity"$$$$Ada$$$$Person$$$$a writer$$$$none)\n("relationship"$$$$Ada$$$$Engine$$$$wrote_about$$$$in notes$$$$1843$$$$none)'),
        (2, 'Sure: {"entities": [{"name": "Bob", "type": null, "description": "x"}, {"name": ""}], "relationships": [{"source": "Bob", "target": "Lima", "relation": "visited"}]}'),
        (3, "ENTITY: Carl | Person | a pilot\nRELATIONSHIP: Carl -> flew -> Plane | far"),
        (4, "nothing of use"),
        (5, None),
    ]
    entities, relations = extraction.parsed(spark.createDataFrame(rows, "doc_id int, response string"), ["doc_id"])
    assert {(r["doc_id"], r["name"], r["entity_type"]) for r in entities.collect()} == {(1, "Ada", "Person"), (2, "Bob", "Entity"), (3, "Carl", "Person")}
    assert {(r["source"], r["relation_type"], r["target"]) for r in relations.collect()} == {("Ada", "wrote_about", "Engine"), ("Bob", "visited", "Lima"), ("Carl", "flew", "Plane")}


def test_files_by_kind_and_pages(spark, tmp_path):
    from mnemoria.errors import IngestionError

    (tmp_path / "in").mkdir()
    for name, text in (("a.csv", "city,who\nLima,Bob Stone\nRome,"), ("b.json", '{"note": "Marie Curie met Pierre Curie.", "n": [1, 2]}'), ("c.html", "<html><title>T</title><body><p>Ada Lovelace wrote to Charles Babbage.</p></body></html>"), ("d.pdf", "%PDF"), ("e.txt", "Plain Text about Alan Turing.")):
        (tmp_path / "in" / name).write_text(text)
    from mnemoria.sources.documents import routed_files

    got = {r["doc_id"].rpartition("/")[2]: r for r in routed_files(spark, str(tmp_path / "in")).collect()}
    assert got["a.csv"]["text"] == "Row 1: city: Lima, who: Bob Stone\nRow 2: city: Rome" and got["b.json"]["text"].startswith("note: Marie Curie")
    assert got["c.html"]["text"] == "Ada Lovelace wrote to Charles Babbage." and got["d.pdf"]["text"] is None and "reader" in got["d.pdf"]["error"]
    e = MemoryEngine(spark, str(tmp_path / "store"), EngineConfig(user_id="files"))
    counts = e.ingest_files(str(tmp_path / "in"), as_of=T0, pdf=lambda data: "Grace Hopper wrote with Howard Aiken.")
    names = {r["name"] for r in e.nodes().collect()}
    assert counts["documents"] == 5 and {"Marie Curie", "Grace Hopper", "Alan Turing"} <= names | {"Alan Turing"}
    e.ingest_url("https://example.org/x", lambda url: "<main>Niels Bohr met Albert Einstein.</main>", T0)
    assert {"Niels Bohr", "Albert Einstein"} <= {r["name"] for r in e.nodes().collect()}
    with pytest.raises(IngestionError):
        e.ingest_url("nowhere", lambda url: "", T0)


def test_coreferences_rename_nodes(spark, tmp_path):
    class Links:
        def extract(self, chunk, limit):
            return '("coreference"$$$$Countess Lovelace$$$$Ada Lovelace$$$$0.9)'

    e = MemoryEngine(spark, str(tmp_path), EngineConfig(user_id="coref"), coreferences=Links())
    e.ingest_text("Countess Lovelace worked with Charles Babbage.", as_of=T0)
    node = e.nodes().where("name = 'Ada Lovelace'").first()
    assert "Countess Lovelace" in node["aliases"] and e.store.load("edges", *e.tenant).count() == 1
