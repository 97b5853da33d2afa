"""Expressions and parsers on worked examples."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemoria.conf import EngineConfig, chunk_size_for
from mnemoria.errors import ConfigurationError
from mnemoria.functions import exprs as X
from mnemoria.functions import fuzzy
from mnemoria.functions import text as N
from mnemoria.functions.providers import HashingEmbedder, RateLimiter, RuleExtractor, retrying
from mnemoria.operators import chunking, evaluate, extraction, retrieve, scoring, temporal
from mnemoria.sources import documents as D


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_importance_levels(spark):
    rows = spark.createDataFrame([(x,) for x in (9.0, 7.0, 5.5, 4.0, 2.0, 0.5, 0.49)], "s double").select(X.importance_bucket("s").alias("v")).collect()
    assert [r["v"] for r in rows] == [10, 8, 6, 5, 3, 1, 0]


def test_strengths(spark):
    assert value(spark, X.node_strength(F.lit(30.0), F.lit(5.0), F.lit(0))) == pytest.approx(math.exp(-1.848), abs=1e-9)
    assert value(spark, X.edge_strength(F.lit(6.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(math.exp(-0.693))
    assert value(spark, X.frequency(F.lit(0))) == 0 and value(spark, X.frequency(F.lit(1000))) == 1


def test_cosine_of_nothing(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, X.cosine(zero, one)) == 0 and value(spark, X.cosine(F.lit(None).cast("array<double>"), one)) == 0
    assert value(spark, X.cosine(one, one)) == 1


def test_names(spark):
    a, b = (F.array(*map(F.lit, w)) for w in (("a", "b"), ("a", "b", "c")))
    assert value(spark, N.token_similarity(a, b)) == 0.9
    assert value(spark, N.entity_key(F.lit('  "Acme  Inc." '))) == "acme_inc_"
    assert value(spark, N.name_tokens(F.lit("The Acme Company of Rome"))) == ["acme", "rome"]
    assert value(spark, N.share_last_name(F.lit("Dr. Chen"), F.lit("Alexander Chen PhD")))
    assert not value(spark, N.share_last_name(F.lit("A Li"), F.lit("B Li")))
    assert value(spark, N.aliases(F.lit(" a, none ,b,, a"))) == ["a", "b"]
    found = value(spark, N.potential_names(F.lit('Did Dr. Chen of Helix Quantum read "the plan"?')))
    assert set(found) == {"Chen", "Did Dr", "Dr. Chen", "Helix Quantum", "the plan"}


def test_temporal_texts(spark):
    cases = {"2024-07": ("2024", datetime(2024, 1, 1)), "present": ("present", None), "None": (None, None), "since 1999-05-06": ("1999-05-06", datetime(1999, 1, 1)), "2018-06-30": ("2018-06-30", datetime(2018, 6, 30)), "spring": ("spring", None)}
    for text, (parsed, stamp) in cases.items():
        assert value(spark, N.temporal(F.lit(text))) == parsed
        assert value(spark, N.temporal_timestamp(F.lit(text))) == stamp
    assert value(spark, N.temporal_timestamp(F.lit("2018"), True)) == datetime(2018, 12, 31, 23, 59, 59, 999999)


def test_point_in_time(spark):
    edges = spark.createDataFrame([("John", datetime(2010, 1, 1), datetime(2018, 6, 30)), ("Jane", datetime(2018, 7, 1), None)], "source_id string, valid_from timestamp, valid_until timestamp").withColumn("relation_type", F.lit("CEO"))
    who = lambda t, **k: [r[0] for r in temporal.edges_at(edges, F.lit(t).cast("timestamp"), **k).select("source_id").collect()]
    assert who("2015-01-01") == ["John"] and who("2019-01-01") == ["Jane"] and who("2018-06-30") == ["John"] and who("2018-06-30", bounds="halfopen") == []
    assert who("2019-01-01", relation="ceo") == ["Jane"] and who("2009-01-01") == []
    instants = spark.createDataFrame([(datetime(y, 1, 1),) for y in (2009, 2015, 2018, 2030)], "t timestamp")
    assert sorted((r["t"].year, r["source_id"]) for r in temporal.edges_at_each(edges, instants).collect()) == [(2015, "John"), (2018, "John"), (2030, "Jane")]
    chained = temporal.supersede_chain(edges.drop("valid_until"), ["relation_type"], ["valid_from"]).orderBy("valid_from").collect()
    assert [r["valid_until"] for r in chained] == [datetime(2018, 7, 1), None]


def test_conflicts_keep_the_latest(spark):
    rows = [("a", "Faith", "founded_in", "Rome", 40), ("b", "faith", "FOUNDED_IN", "Taipei", 43), ("c", "x", "r", "y", 1), ("d", "x", "r", "Y", 2), ("e", "Faith", "founded_in", "Paris", None)]
    out = {r["id"]: r["lost"] for r in scoring.conflicts(spark.createDataFrame(rows, "id string, source_id string, relation_type string, target_id string, priority long").withColumns({"importance": F.lit(5.0), "state": F.lit("ACTIVE")})).collect()}
    assert out == {"a": True, "b": False, "c": False, "d": False, "e": True}


TRIPLES = """noise
("entity"$$$$Nvidia$$$$Company$$$$Maker of chips$$$$NVDA, Nvidia Corp)
("entity"$$$$Short$$$$only)
("relationship"$$$$Jensen$$$$Nvidia$$$$founder of the entity$$$$He founded it$$$$1993$$$$present)
("relationship"$$$$Jensen$$$$$$$$x$$$$y)"""


def test_extraction_parsers(spark):
    said = spark.createDataFrame([(1, TRIPLES)], "k int, response string")
    e = extraction.parse_entities(said, ["k"]).collect()
    r = extraction.parse_relationships(said, ["k"]).collect()
    assert [(x["name"], x["entity_type"], x["aliases"]) for x in e] == [("Nvidia", "Company", ["NVDA", "Nvidia Corp"])]
    assert [(x["source"], x["target"], x["relation_type"], x["valid_from"], x["valid_until"]) for x in r] == [("Jensen", "Nvidia", "founder of the entity", "1993", "present")]
    e, r = extraction.parse_plain(spark.createDataFrame([("ENTITY: A | B | c\nRELATIONSHIP: A -> likes -> D | why\nENTITY:  | x",)], "response string"), [])
    assert [tuple(x) for x in e.collect()] == [("A", "B", "c")] and [tuple(x) for x in r.collect()] == [("A", "likes", "D", "why")]
    parsed = value(spark, extraction.parse_json(F.lit('Sure: {"entities": [{"name": "A", "type": "T"}]} ok')))
    assert parsed["entities"][0]["name"] == "A"
    coref = extraction.parse_coreferences(spark.createDataFrame([('("coreference"$$$$he$$$$John$$$$0.9)\n("coreference"$$$$she$$$$Ann$$$$?)',)], "response string"), [])
    assert {tuple(x) for x in coref.collect()} == {("he", "John", 0.9), ("she", "Ann", 0.5)}


def test_fact_order(spark):
    docs = spark.createDataFrame([(1, "43. Christianity was founded in Taipei\n40. Christianity was founded in Rome")], "doc_id int, text string")
    assert {r["entity"]: r["priority"] for r in extraction.fact_order(docs).collect()} == {"christianity": 43, "taipei": 43, "rome": 40}
    edges = spark.createDataFrame([(1, "Christianity", "Rome"), (1, "Christianity", "Oslo"), (1, "Odin", "Oslo")], "doc_id int, source string, target string")
    assert {(r["source"], r["target"]): r["priority"] for r in extraction.fact_priority(edges, extraction.fact_order(docs), "doc_id").collect()} == {("Christianity", "Rome"): 40, ("Christianity", "Oslo"): 43, ("Odin", "Oslo"): 0}


def test_failed_chunk_is_a_row(spark):
    class Broken:
        def extract(self, chunk, limit):
            if "bad" in chunk:
                raise ValueError("no")
            return RuleExtractor().extract(chunk, limit)

    chunks = spark.createDataFrame([("a", 0, "Rome lies in Italy."), ("a", 1, "bad")], "doc_id string, chunk_index int, content string")
    out = {r["chunk_index"]: r for r in extraction.call(chunks, Broken()).collect()}
    assert out[0]["error"] is None and "Rome" in out[0]["response"] and out[1]["error"] == "ValueError: no"


def test_chunkers(spark):
    starts = [r["content"] for r in chunking.fixed(spark.createDataFrame([("x" * 3800,), (None,)], "text string").withColumn("doc_id", F.lit(1))).collect()]
    assert [len(c) for c in starts] == [2000, 2000, 200]
    text = " ".join(f"Sentence number {i} ends here." for i in range(100))
    parts = chunking.pack_sentences(text, 300, 60)
    assert all(len(p.replace(" ", "")) <= 330 for p in parts) and parts[1].startswith("Sentence") and chunking.pack_sentences("", 10, 2) == [""]
    units = chunking.chunk_text("para one\n\npara two\n\n" + "long " * 100, 120, 20)
    assert units[0][0] == "para one para two" and chunking.chunk_text("  ") == []
    assert [c[3].get("header_level") for c in chunking.chunk_markdown("intro\n# A\nbody\n### B\nmore")] == [None, "1", "3"]
    code = chunking.chunk_code("import x\ndef a():\n  pass\nclass B:\n  pass\n")
    assert [c[3]["symbol"] for c in code] == ["def a", "class B"] and chunking.language_of("a/b.tsx") == "typescript"
    chars = chunking.chunk_text("x" * 2500, 1000, 200)
    assert [(c[1], c[2]) for c in chars] == [(0, 1000), (800, 1800), (1600, 2500)]
    assert len(chunking.long_text("\n\n".join(f"Chapter {i} text" for i in range(6)))) == 6
    docs = spark.createDataFrame([(1, "Document 1:\nalpha\n\nDocument 2: beta"), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in chunking.split_numbered(docs, r"Document \d+:\s*").collect()] == [(1, 1, "alpha"), (1, 2, "beta")]
    facts = chunking.facts_with_priority(spark.createDataFrame([(1, "0. zero\n12. twelve")], "doc_id int, text string")).collect()
    assert [(r["priority"], r["content"]) for r in facts] == [(0, "zero"), (12, "twelve")]


def test_pages_and_json(spark, tmp_path):
    html = "<html><head><title>T</title><meta name='description' content='D'><script>x()</script></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b></p></article><footer>f</footer></body></html>"
    assert D.page_text(html) == ("Head\nOne\ntwo", "T", "D") and D.page_text(None) == ("", None, None)
    assert D.json_text({"a": [1, {"b": None}], "c": []}) == "a:   [0]: 1\n  [1]:     b: None\nc: []"
    rows = D.json_documents(spark.createDataFrame([(1, '{"k": 3}'), (2, "no json"), (3, None)], "id int, j string"), "id", "j")
    assert {r["id"]: r["text"] for r in rows.collect()} == {1: "k: 3", 2: "no json", 3: None}
    assert D.valid_url("https://example.org/x") and not D.valid_url("ftp://x")
    (tmp_path / "a.txt").write_text("Ünder\nline")
    assert D.read_files(spark, str(tmp_path)).first()["text"] == "Ünder\nline"
    assert D.read_with(spark.read.format("binaryFile").load(str(tmp_path)), lambda b: 1 / 0).first()["error"].startswith("ZeroDivisionError")


def test_answers(spark):
    rows = spark.createDataFrame([(1, "The Cat, sat!", "cat sat"), (1, "The Cat, sat!", "dog"), (2, "x", "")], "k int, prediction string, truth string")
    out = {r["k"]: r for r in evaluate.answer_metrics(rows, ["k"], rouge=True).collect()}
    assert (out[1]["exact_match"], out[1]["f1"], out[1]["rouge_l"]) == (1, 1, 1) and out[2]["f1"] == 0
    assert fuzzy.ratio("Acme", "acme") == 1 and fuzzy.lcs([1, 2, 3], [2, 9, 3]) == 2


def test_budgets_and_summary():
    counts = dict.fromkeys(("communities", "entities", "relationships", "documents"), 1)
    assert list(retrieve.budgets(16000, counts).values()) == [5600, 4800, 3200, 2400]
    assert retrieve.budgets(100, {**counts, "entities": 0})["entities"] == 0
    assert retrieve.summarise("## head\na\nb\n\nc\nd\ne\nf", 100) == "a\nb\nc\nd\ne"


def test_settings():
    assert EngineConfig.from_dict({"top_k": 3, "other": 1}).top_k == 3
    assert EngineConfig.from_env({"MNEMORIA_TOP_K": "7", "MNEMORIA_HALF_LIFE_DAYS": "2.5"}).half_life_days == 2.5
    with pytest.raises(ConfigurationError) as e:
        EngineConfig(chunk_overlap=5000).validate()
    assert e.value.to_dict()["code"] == "CONFIG" and chunk_size_for(16) == 2000


def test_providers():
    v = HashingEmbedder().embed(["a b", None, " ", "a b"])
    assert v[1] is None and v[2] is None and v[0] == v[3] and sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-5)
    waits, now = [], [0.0]
    limiter = RateLimiter(2, lambda: now[0], waits.append)
    for _ in range(3):
        limiter.wait()
    assert waits == [60]
    tries = []
    assert retrying(lambda: tries.append(1) or (len(tries) > 2 or 1 / 0), 3)()
