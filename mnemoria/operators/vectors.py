"""Vector similarity: exact top-k, and all pairs within blocks by matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.functions import exprs as X

BLOCK = 2048  # vectors on a side of one matrix product of all pairs
TILE, STRIP, GROUP = 16384, 256, 64  # of top_k_each: vectors on a side of a task, queries in one product, columns with one maximum


def constant(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(nodes: DataFrame, query: list[float], k: int = 10, least: float | None = None) -> DataFrame:
    """The k nodes (id, embedding) nearest to a vector, with their similarity: one pass, k rows a task."""
    out = nodes.withColumn("similarity", F.round(X.cosine("embedding", constant(query)), 9))
    if least is not None:
        out = out.where(F.col("similarity") >= least)
    return out.orderBy(F.desc("similarity"), "id").limit(k)


def top_k_each(nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, similarity, rank) of the k nodes nearest to each row of queries (query_id, vector).

    Nodes and queries are cut into pieces of about TILE vectors; a task has one piece of each and multiplies them STRIP
    queries at a time, so its memory is bounded, and what is shuffled next is k rows for each query and piece of nodes.
    """
    own = nodes.select("id", F.col("embedding").alias("v")).where("v is not null")
    asked = queries.select("query_id", F.col("vector").alias("v")).where("v is not null")
    many, more = (max(1, -(-rows.count() // TILE)) for rows in (own, asked))
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("i", piece("id", many)).withColumn("j", each(more))
    right = asked.withColumn("j", piece("query_id", more)).withColumn("i", each(many))
    kinds = (asked.schema["query_id"].dataType, own.schema["id"].dataType)
    out = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("similarity", T.DoubleType())])
    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_nearest(k), out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def unit(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero vectors stay."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count or len(pc.unique(pc.list_value_length(col))) != 1:
        x = np.array(col.to_pylist(), float)
    else:
        x = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _nearest(k: int):
    def nearest(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        ids, qids = nodes["id"].combine_chunks(), asked["query_id"].combine_chunks()
        parts = [pa.table({"query_id": qids[:0], "id": ids[:0], "similarity": pa.array([], pa.float64())})]
        if len(ids) and len(qids):
            by = pc.sort_indices(ids)  # of equal similarities the least id counts
            ids, a, q = ids.take(by), unit(nodes["v"].take(by)), unit(asked["v"])
            for at in range(0, len(qids), STRIP):
                row, place, sim = best(q[at : at + STRIP] @ a.T, k)
                parts.append(pa.table({"query_id": qids.take(pa.array(row + at)), "id": ids.take(pa.array(place)), "similarity": pa.array(sim)}))
        return pa.concat_tables(parts)

    return nearest


def best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity to 9 places) of the k greatest of each row; of equal ones the first columns.

    The k-th greatest of the maxima of GROUP columns each bounds the k-th greatest of all from below, so few are sorted.
    """
    n = sim.shape[1]
    tops = np.maximum.reduceat(sim, np.arange(0, n, GROUP), axis=1)
    least = np.partition(tops, tops.shape[1] - k, axis=1)[:, -k, None] if tops.shape[1] > k else np.full((len(sim), 1), -np.inf)
    row, column = np.nonzero(sim >= least - 1e-9)
    found = np.round(sim[row, column], 9)
    order = np.lexsort((column, -found, row))
    row, column, found = row[order], column[order], found[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep], found[keep]


def in_pieces(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """Rows once for each pair of pieces (lo, hi) of their key that theirs, ``p``, is part of; a piece has about ``block`` rows."""
    size = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("__pieces"))
    own = rows.join(size, by).withColumn("p", F.pmod(F.xxhash64("id"), F.col("__pieces")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1))
    return own.withColumn("__q", other).withColumns({"lo": F.least("p", "__q"), "hi": F.greatest("p", "__q")}).drop("__pieces", "__q")


def pairs(nodes: DataFrame, block: str | list[str], least: float) -> DataFrame:
    """(a, b, similarity) of nodes (id, embedding) with a < b in one block and a cosine of ``least`` or more.

    A block is cut into pieces of about BLOCK vectors; each pair of pieces is one matrix product, so
    a large block is spread over many tasks.
    """
    by = [block] if isinstance(block, str) else block
    spread = in_pieces(nodes.where("embedding is not null").select(*by, "id", F.col("embedding").alias("v")), by, BLOCK)
    kind = nodes.schema["id"].dataType

    def near(table: pa.Table) -> pa.Table:
        ids, p = table["id"].combine_chunks(), table["p"].to_numpy()
        x = unit(table["v"])
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right = np.flatnonzero(p == lo), np.flatnonzero(p == hi)
        sim = x[left] @ x[right].T
        i, j = np.nonzero(sim >= least - 1e-12)
        a, b = ids.take(pa.array(left[i])), ids.take(pa.array(right[j]))
        s = sim[i, j]
        first = np.array([m < n for m, n in zip(a.to_pylist(), b.to_pylist())], bool)
        if lo == hi:
            keep = pa.array(first)
            return pa.table({"a": a.filter(keep), "b": b.filter(keep), "similarity": pa.array(s[first])})
        flip = pa.array(~first)
        return pa.table({"a": pc.if_else(flip, b, a), "b": pc.if_else(flip, a, b), "similarity": pa.array(s)})

    return spread.groupBy(*by, "lo", "hi").applyInArrow(near, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())]))
