"""Documents are scored against every item of the benchmark."""

from mnemoria.plans import queries


def test_answers_use_every_item(spark, tmp_path):
    spark.createDataFrame([(100 + 2 * i, f"truth {i}") for i in range(50)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, "s", f"truth {i % 50}", 8) for i in range(120)], "doc_id long, source string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.answer_f1(spark, str(tmp_path)).collect()
    assert len(rows) == 120 and all(r["exact_match"] == 1 for r in rows)
    assert [r["n"] for r in queries.task_metrics(spark, str(tmp_path)).collect()] == [120]
