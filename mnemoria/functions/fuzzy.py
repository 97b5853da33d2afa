"""Similarities that need Python: Ratcliff-Obershelp and longest common subsequence, in Arrow batches."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoria.functions.exprs import col


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0


def fuzzy(a, b) -> Column:
    """Ratcliff-Obershelp ratio of two names in lower case."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y)], dtype=float)

    return run(col(a), col(b))


def token_f1(prediction, truth) -> Column:
    """F1 of the tokens of two normal answers, each counted as often as both have it."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out, known = [], {}
        for p, q in zip(x, y):
            a = (p or "").split()
            if q not in known:
                known = known if len(known) < 10_000 else {}
                known[q] = Counter((q or "").split())
            b = known[q]
            same = sum(min(n, b[w]) for w, n in Counter(a).items() if w in b)
            precision, recall = (same / len(a), same / b.total()) if same else (0.0, 0.0)
            out.append(2 * precision * recall / (precision + recall) if same else 0.0)
        return pd.Series(out, dtype=float)

    return run(col(prediction), col(truth))


def lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(prediction, truth) -> Column:
    """ROUGE-L F of two normal answers (see text.normal_answer)."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            a, b = (p or "").split(), (q or "").split()
            n = lcs(a, b)
            out.append(2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b)) if n else 0.0)
        return pd.Series(out, dtype=float)

    return run(col(prediction), col(truth))
