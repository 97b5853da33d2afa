"""Sharding by sampled splitters.

Records are ordered by (key, hash of the tie-breaking columns); the hash spreads records of equal
keys, so a hot key can be cut.  Each record enters the sample with a chance in proportion to its
size, ``OVERSAMPLE`` draws for each shard's worth of bytes, and every ``OVERSAMPLE``-th sampled key
is a splitter.  The bytes of every range are then counted; a range above ``slack`` times the target
is sampled anew, in proportion to its excess, and cut by new splitters, until none is too full or
no range can be cut (one record, or equal records); where equal records fill a range's sample, each key counts once.  Shards are numbered in key order.

Only (key, hash, size) is gathered: those compact rows are written once to the shared folder and
every round reads them.  The splitters, one key for each shard, are all that the tasks are sent;
at 100 TB and 128 MB a shard that is 800,000 keys.  The records move once.

Defined cases.  A null key comes first; null tie-breakers hash as nulls.  A null or empty text has
``OVERHEAD`` bytes, so that empty records are spread as well.  Equal records stay in one shard.
A record above the target is a shard's only one, or shares it with smaller ones next to it.  An
empty table gives no rows.  A column that is named like the shard column is replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoria.llm.cluster import cut

TARGET_BYTES, OVERSAMPLE, SLACK, OVERHEAD = 128 << 20, 32, 1.25, 16


def _order_key(v: tuple) -> tuple:
    return (False, 0, v[1]) if v[0] is None else (True, v[0], v[1])


def _ranger(splitters: list[tuple]):
    """Pandas UDF: the number of splitters that are at most (key, tie)."""
    nulls = [s[1] for s in splitters if s[0] is None]
    keys = [s[0] for s in splitters if s[0] is not None]
    distinct: list = []
    begin: list[int] = []
    for i, k in enumerate(keys):
        if not distinct or distinct[-1] != k:
            distinct.append(k)
            begin.append(i)
    begin.append(len(keys))
    ties = np.array([s[1] for s in splitters if s[0] is not None], np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(key, use_na_sentinel=True)
        out = np.empty(len(key), np.int32)
        t = tie.to_numpy(np.int64)
        none = codes < 0
        out[none] = np.searchsorted(np.array(nulls, np.int64), t[none], "right")
        by = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[by], np.arange(len(uniques) + 1))
        for c, u in enumerate(uniques):
            rows = by[edges[c] : edges[c + 1]]
            j = bisect_right(distinct, u)
            if j and distinct[j - 1] == u:
                a, e = begin[j - 1], begin[j]
                out[rows] = len(nulls) + a + np.searchsorted(ties[a:e], t[rows], "right")
            else:
                out[rows] = len(nulls) + begin[j]
        return pd.Series(out)

    return range_of


def _size(text_col: str):
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + OVERHEAD


def splitters(docs: DataFrame, key: str, ties: list[str], size: Column, target: int = TARGET_BYTES, slack: float = SLACK, seed: int = 3) -> list[tuple]:
    """The (key, tie hash) pairs that begin every shard but the first, in order."""
    rows = cut(docs.select(F.col(key).alias("k"), F.xxhash64(*ties).alias("t"), size.alias("s")))
    found: list[tuple] = []
    step, boost = 0, 1.0
    while True:
        ranged = rows.withColumn("r", _ranger(found)("k", "t")) if found else rows.withColumn("r", F.lit(0))
        ends = F.struct("k", "t")
        sizes = ranged.groupBy("r").agg(F.sum("s").alias("n"), (F.min(ends) < F.max(ends)).alias("cuttable"))
        full = {r["r"]: r["n"] for r in sizes.where((F.col("n") > slack * target) & F.col("cuttable")).toLocalIterator()}
        if not full:
            break
        drawn = ranged.where(F.col("r").isin(list(full)) if len(full) <= 1000 else F.lit(True)).select("r", "k", "t", "s")
        if boost > 1:  # equal records hid the others: each counts once now, and is drawn more often
            drawn = drawn.groupBy("r", "k", "t").agg(F.sum("s").alias("s"))
        chance = F.least(F.lit(1.0), F.col("s") * F.lit(boost * OVERSAMPLE / target))
        draw = F.pmod(F.xxhash64("k", "t", F.lit(seed + step)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = drawn.where(draw < chance).select("r", "k", "t", F.greatest(F.lit(1.0), F.col("s") * F.lit(boost * OVERSAMPLE / target)).alias("w"))
        by: dict[int, list] = {}
        for r in drawn.toLocalIterator():
            if r["r"] in full:
                by.setdefault(r["r"], []).append((r["k"], r["t"], r["w"]))
        new: set[tuple] = set(found)
        for r, sample in by.items():
            sample.sort(key=_order_key)
            pieces = max(2, round(full[r] / target))
            weight = np.cumsum([x[2] for x in sample])
            other = next((i for i, x in enumerate(sample) if x[:2] != sample[0][:2]), len(sample))  # the range's first key can't cut it
            for q in range(1, pieces):
                at = max(other, int(np.searchsorted(weight, weight[-1] * q / pieces)))
                if at < len(sample):
                    new.add(tuple(sample[at][:2]))
        step += 1
        if len(new) > len(found):
            found, boost = sorted(new, key=_order_key), 1.0
        elif boost * OVERSAMPLE * OVERHEAD >= target:  # every key was drawn
            break
        else:
            boost *= 16
    return found


def shard(docs: DataFrame, key: str = "source", ties: list[str] | None = None, text_col: str | None = "text", target: int = TARGET_BYTES, slack: float = SLACK, shard_col: str = "shard_id", size: Column | None = None) -> DataFrame:
    """docs with ``shard_col``, each shard whole in one partition and partitions in shard order.
    A record has the bytes of its text and OVERHEAD, or ``size`` and OVERHEAD."""
    ties = ties or ["doc_id"]
    size = _size(text_col) if size is None else size.cast("long") + OVERHEAD
    found = splitters(docs, key, ties, size, target, slack)
    number = _ranger(found)(F.col(key), F.xxhash64(*ties)) if found else F.lit(0)
    own = docs.drop(shard_col).withColumn(shard_col, number)
    return own.repartitionById(len(found) + 1, F.col(shard_col))
