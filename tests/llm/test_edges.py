"""Every operator and stage on the tables that break things: nulls, empty and long texts, repeats, no rows, clashing names."""

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from mnemoria.llm import decontaminate, language_id, license_scan, line_dedup, quality_rules, sentencepiece, sharding, simhash_dedup, span_dedup, sstable

PASSAGE = " ".join(f"Alpha beta gamma delta number {i} walks over the old bridge." for i in range(12))
CLASHING = ["id", "th", "sig", "label", "line", "gone", "row", "spans", "bucket", "shard_id", "language", "ids", "__id", "__key", "a.b"]


def model():
    return sentencepiece.load(sentencepiece.MODEL)


def items(spark):
    return spark.createDataFrame([(1, "What is the long distance between the northern town and the southern town in miles?"), (2, None), (3, ""), (None, "short one")], "item_id long, text string")


CLEANERS = {
    "quality": lambda s, d: quality_rules.clean(d),
    "lines": lambda s, d: line_dedup.clean(d),
    "near": lambda s, d: simhash_dedup.keep_first(d),
    "spans": lambda s, d: span_dedup.clean(d),
    "leaks": lambda s, d: decontaminate.clean(d, items(s)),
    "shard": lambda s, d: sharding.shard(d, target=10_000),
}
REPORTS = {
    "licenses": lambda s, d: license_scan.scan(d),
    "span report": lambda s, d: span_dedup.removals(d),
    "sstable": lambda s, d: sstable.build(d, value_cols=["text", "lang", "source", "n_chars"], target=10_000),
    "near report": lambda s, d: simhash_dedup.near_duplicates(d),
    "tokens": lambda s, d: sentencepiece.encoded(d, model()),
    "leak report": lambda s, d: decontaminate.leaks(d, items(s)),
    "language": lambda s, d: language_id.identify(d, language_id.trained(d)),
    "quality report": lambda s, d: quality_rules.report(d),
}


def nasty(spark, rows=True):
    fields = [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in CLASHING])
    long_text = " ".join(f"word{i % 997} and thing{i % 31}." for i in range(60_000))
    texts = [(1, PASSAGE, "en"), (1, PASSAGE, "en"), (2, PASSAGE, "en"), (3, None, None), (None, PASSAGE + " More.", "en"), (None, None, None), (4, "", "de"), (5, "   \n\n ", "de"), (6, long_text, "de"), (7, "!!! ???", None), (8, "ñandú İstanbul ﬁn\u0000 a b.", "es"), (9, PASSAGE.upper(), "en"), (1, "another text of the same number, that ends here.", "en")]
    data = [(i, t, lang, None if i == 3 else "s", None if t is None else len(t), *("x" for _ in CLASHING)) for i, t, lang in texts]
    return spark.createDataFrame(data if rows else [], schema)


@pytest.mark.parametrize("name", CLEANERS)
def test_cleaners_keep_the_columns(spark, name):
    docs = nasty(spark)
    out = CLEANERS[name](spark, docs)
    assert [c for c in out.columns if c != "shard_id"] == [c for c in docs.columns if c != "shard_id"]
    rows = out.collect()
    assert rows and all(r["a.b"] == "x" for r in rows)
    assert CLEANERS[name](spark, nasty(spark, False)).count() == 0


@pytest.mark.parametrize("name", REPORTS)
def test_reports_take_anything(spark, name):
    REPORTS[name](spark, nasty(spark)).collect()
    assert REPORTS[name](spark, nasty(spark, False)).count() == 0


def test_stages_take_anything(spark, sf):
    for rows in (True, False):
        docs = nasty(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "encoding" or out.columns == docs.columns
            out.collect()


def test_defined_results(spark):
    docs = nasty(spark)
    kept = [tuple(r) for r in simhash_dedup.keep_first(docs).select("doc_id", "text").collect()]
    assert (3, None) in kept and (4, "") in kept and sum(t is not None and t.lower().startswith("alpha") for _, t in kept) == 1
    tokens = {r["doc_id"]: r for r in sentencepiece.encoded(docs.where("doc_id in (3, 4, 8)"), model()).collect()}
    assert tokens[3]["ids"] is None and tokens[4]["ids"] == [] and tokens[8]["exact"]
    assert {r["doc_id"] for r in quality_rules.clean(docs).collect()}.isdisjoint({3, 4, 5})
