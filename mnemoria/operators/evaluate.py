"""Answer metrics and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoria.functions import text as N
from mnemoria.functions.fuzzy import rouge_l, token_f1


def answer_metrics(rows: DataFrame, key: list[str], prediction: str = "prediction", truth: str = "truth", rouge: bool = False) -> DataFrame:
    """(key, exact_match, f1, substring_match[, rouge_l]): the best over a key's rows, one for each accepted truth.

    F1 counts tokens as often as both have them, row by row, so no token is shuffled.  key names a prediction; rows repeat it with each truth.
    """
    own = rows.select(*key, N.normal_answer(prediction).alias("p"), N.normal_answer(truth).alias("t"))
    best = [F.max((F.col("p") == F.col("t")).cast("double")).alias("exact_match"), F.coalesce(F.max(token_f1("p", "t")), F.lit(0.0)).alias("f1"), F.max(F.col("p").contains(F.col("t")).cast("double")).alias("substring_match")]
    return own.groupBy(*key).agg(*best, *([F.max(rouge_l("p", "t")).alias("rouge_l")] if rouge else []))


def task_metrics(results: DataFrame, task: str = "task", latency: str = "latency_ms") -> DataFrame:
    """(task, n, mean of each metric, median latency)."""
    metrics = [c for c in ("exact_match", "f1", "substring_match", "rouge_l") if c in results.columns]
    return results.groupBy(task).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in metrics], F.percentile(latency, F.lit(0.5)).alias("p50_latency"))
