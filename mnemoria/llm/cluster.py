"""Checkpoints, connected components and bucket searches shared by the dedup operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from urllib.parse import unquote, urlparse
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoria.llm.kernel import U, groups_of, hamming


def shared_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` use the cluster's folder; a temporary one only on local cores where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from the shared folder from now on; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is ``cut`` here go as soon as it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def shared_array(spark: SparkSession, array: np.ndarray) -> Iterator[Callable[[], np.ndarray]]:
    """A function that gives tasks the array: one file in the shared folder, mapped into memory, which takes no copy in
    every executor and task; a broadcast where the folder isn't in a file system that Python can open."""
    shared_dir(spark)
    folder = urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    if folder.scheme in ("", "file"):
        path = f"{unquote(folder.path)}/{uuid4().hex}.npy"
        np.save(path, array)
        del array  # the driver keeps none
        try:
            yield partial(np.load, path, mmap_mode="r")
        finally:
            os.unlink(path)
    else:
        sent = spark.sparkContext.broadcast(array)
        try:
            yield lambda: sent.value
        finally:
            sent.destroy()


def whole_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, th): every row of docs as one struct, so that its columns may have any name, with its id and the hash of its text."""
    return docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text_col}`"]).alias("th"))


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def same_document(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["__id"]) & (a["th"] == b["__th"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the least node of its component.

    Alternates large-star and small-star steps until no edge changes, which takes
    O(log^2 n) rounds on any graph; each round is two windows over the edges.  Nulls aren't
    allowed; no edges give no rows.  A node's own label is included.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state = mark(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = F.min("b").over(Window.partitionBy("a"))
        small = large.withColumn("m", low)
        star = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(star.select("e.a", "e.b").where("a <> b").distinct())
        before, state = state, mark(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()) if state[0] else spark.createDataFrame([], nodes.schema)


FILTER_BITS = 26  # log2 of the bits of a filter: 8 MB however many keys there are


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash over the only column, 64-bit hashes: 2**FILTER_BITS bits, so that its size never
    grows.  More keys let more strangers pass; whoever uses it joins with the keys afterwards."""
    k = keys.columns[0]
    words = keys.select(F.shiftrightunsigned(k, 6).bitwiseAND((1 << (FILTER_BITS - 6)) - 1).cast("int").alias("word"), F.col(k).bitwiseAND(63).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), U)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U)
    return out


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(U)
    return (bits[((h >> U(6)) & U(len(bits) - 1)).astype(np.int64)] >> (h & U(63))) & U(1) > 0


def touched(rows: DataFrame, keys: DataFrame, column: str = "th") -> tuple[DataFrame, DataFrame]:
    """rows in two: those whose ``column`` (64-bit) may be among the only column of keys, and those where it isn't.
    Only the first need a join, so rows that nothing happens to are never shuffled."""
    bits = bit_filter(keys)
    near = F.arrow_udf(lambda h: pa.array(passing(bits, h.to_numpy(zero_copy_only=False))), "boolean")
    return rows.where(near(column)), rows.where(~near(column))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key in, tables of whole runs of equal keys out; a run is never split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k != k[-1], False)) if k[0] == k[-1] else int(np.flatnonzero(k != k[-1])[-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def sampled_bits(sig: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The chosen bit positions of (n, words) signatures, packed into an integer."""
    key = np.zeros(len(sig), U)
    for j, b in enumerate(bits):
        key |= ((sig[:, b >> 6] >> U(b & 63)) & U(1)) << U(j)
    return key


def within(sig: np.ndarray, k: int) -> np.ndarray:
    """Component of each signature in the graph "distance <= k", exact: a breadth-first search
    that compares reached signatures with those not reached yet, so that large clusters of
    copies cost little more than one comparison each."""
    n = len(sig)
    root = np.arange(n)
    left = np.arange(n)
    while len(left):
        front, left = left[:1], left[1:]
        seed = front[0]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, 2_000_000 // len(left))
            for at in range(0, len(front), step):
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    break
                near = (hamming(sig[front[at : at + step], None, :], sig[left[rest]][None, :, :]) <= k).any(0)
                hit[rest[near]] = True
            front, left = left[hit], left[~hit]
            root[front] = seed
    return root


def bucket_links(key: np.ndarray, sig: np.ndarray, k: int, cap: int, extra: int, draws: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that join all signatures within distance k in one bucket (runs of key).

    Small buckets compare every pair, larger ones search by ``within``.  A bucket above ``cap``
    is split by ``extra`` more sampled bits in ``draws`` independent ways; where that doesn't
    split it (a cluster of close copies), ``within`` handles it exactly.  A pair at distance d is in
    one piece of a split with probability ``1 - (1 - (1 - d/bits)**extra)**draws``.
    """
    n = len(key)
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, int)
    size = np.diff(np.append(head, n))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    small = np.repeat((size > 1) & (size <= 64), size)
    idx = np.flatnonzero(small)
    end = np.repeat(head + size, size)
    shift = 1
    while len(idx := idx[idx + shift < end[idx]]):
        near = hamming(sig[idx], sig[idx + shift]) <= k
        a.append(idx[near])
        b.append(idx[near] + shift)
        shift += 1
    for h, s in zip(head[size > 64], size[size > 64]):
        part = sig[h : h + s]
        if s <= cap:
            root = within(part, k)
            i = np.flatnonzero(root != np.arange(s))
            a.append(h + root[i])
            b.append(h + i)
            continue
        for d in range(draws):
            bits = np.random.default_rng((depth, d, 77)).choice(sig.shape[1] * 64, extra, replace=False)
            sub = sampled_bits(part, bits)
            order = np.argsort(sub, kind="stable")
            most = int(np.unique(sub, return_counts=True)[1].max())
            x, y = bucket_links(sub[order], part[order], k, s if most > 0.5 * s else cap, extra, draws, depth + 1)
            a.append(h + order[x])
            b.append(h + order[y])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def linker(k: int, cap: int, extra: int, draws: int):
    """mapInArrow function: (bucket, sig) sorted by bucket in, spanning edges (a, b) out."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "bucket"):
            key = t["bucket"].to_numpy()
            col = t["sig"].combine_chunks()
            buf = np.frombuffer(col.buffers()[2], np.uint8)
            width = len(col[0].as_py())
            at = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
            sig = buf[at : at + width * len(col)].reshape(len(col), width).view(U)
            a, b = bucket_links(key, sig, k, cap, extra, draws)
            if len(a):
                root = groups_of(len(key), a, b)
                i = np.flatnonzero(root != np.arange(len(key)))
                yield pa.RecordBatch.from_arrays([col.take(pa.array(i)), col.take(pa.array(root[i]))], ["a", "b"])

    return link
