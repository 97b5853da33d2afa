"""SimHash near-dedup by random bit sampling.

A document's signature has 256 SimHash bits of its distinct lower-cased words.  Each of several
tables groups the signatures by a random sample of the bit positions; signatures in one bucket
are compared, and pairs within ``max_distance`` bits are duplicates.  Groups are the connected
components of such pairs; the least (id, text hash) of each stays.

Equal signatures are collapsed before the search, so copies cost one row however many there are.
With d differing bits, a pair meets in one of ``tables`` tables of ``bits`` bits with probability
``1 - (1 - (1 - d/256)**bits)**tables``: 0.999 at 20 bits, 0.97 at 30, 0.78 at the limit of 38, and
0.95 or more over the pairs of documents with up to 6 % of their words changed.  A bucket above ``CAP`` signatures
is split by ``EXTRA_BITS`` more bits in ``DRAWS`` ways; a pair that met in it meets again with probability
``1 - (1 - (1 - d/256)**EXTRA_BITS)**DRAWS``, 0.999 at the limit of 38, at each level of splitting.

Defined cases.  A document without a word (null, empty, only punctuation) has no signature, is
never a duplicate and stays.  Rows equal in id and text are one document; ``keep_first`` leaves
one of them.  A null id is a value like any other and comes first.  Whole texts count, however
long.  Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.llm import kernel as K
from mnemoria.llm.cluster import components, cut, linker, sampled_bits, same_document, unwrapped, whole_rows

WORDS = 4  # 64-bit words of a signature
TABLES, BITS, MAX_DISTANCE = 40, 20, 38
CAP, EXTRA_BITS, DRAWS = 4096, 6, 16


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = K.lower(batch.column("text"))
        for a, b in K.chunks(text):
            w = K.Words(text[a:b], hashes=True)
            h, first = K.distinct_by_row(w.hash, w.row, b - a)
            sig = K.simhash(h, first, WORDS)
            some = np.flatnonzero(np.diff(first))
            col = pa.array([x.tobytes() for x in sig[some]], pa.binary())
            part = batch.select(["id", "th"]).slice(a, b - a).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), col], ["id", "th", "sig"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, sig): th is the hash of the whole text, sig the 32-byte signature."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["id"], T.StructField("th", T.LongType()), T.StructField("sig", T.BinaryType())])
    return own.mapInArrow(K.tidy(_sign), schema)


def _probe(tables: int, bits: int, seed: int):
    picks = [np.random.default_rng((seed, t)).choice(WORDS * 64, bits, replace=False) for t in range(tables)]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("sig")
            sig = np.frombuffer(b"".join(col.to_pylist()), K.U).reshape(-1, WORDS)
            for t, p in enumerate(picks):
                key = (sampled_bits(sig, p) | (K.U(t) << K.U(48))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), col], ["bucket", "sig"])

    return probe


def links(sigs: DataFrame, max_distance: int = MAX_DISTANCE, tables: int = TABLES, bits: int = BITS, cap: int = CAP, extra: int = EXTRA_BITS, draws: int = DRAWS, seed: int = 5) -> DataFrame:
    """Spanning edges (a, b) between distinct signatures (column sig) within max_distance."""
    rows = sigs.mapInArrow(K.tidy(_probe(tables, bits, seed)), "bucket long, sig binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(K.tidy(linker(max_distance, cap, extra, draws)), "a binary, b binary").distinct()


def groups(signed: DataFrame, **search) -> DataFrame:
    """(id, th, first_id, first_th, distance, group_size) of the distinct documents in groups of two or more."""
    nodes = cut(signed.groupBy("sig").agg(F.min(F.struct("id", "th")).alias("first"), F.count_distinct(F.struct("id", "th")).alias("n")))
    labels = components(links(nodes.select("sig"), **search))
    labelled = nodes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", "n", F.coalesce("label", "sig").alias("label"))
    whole = labelled.groupBy("label").agg(F.min(F.struct("first", "sig")).alias("top"), F.sum("n").alias("group_size")).where("group_size > 1")
    member = labelled.select("sig", "label").join(whole, "label").select("sig", "group_size", F.col("top.first").alias("first"), F.col("top.sig").alias("first_sig"))
    parts = [F.bit_count(F.conv(F.hex(F.substring("sig", 8 * i + 1, 8)), 16, -10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring("first_sig", 8 * i + 1, 8)), 16, -10).cast("long"))) for i in range(WORDS)]
    return signed.join(member, "sig").select("id", "th", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"), sum(parts[1:], parts[0]).cast("int").alias("distance"), "group_size").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """(doc_id, duplicate_of, distance, group_size) for every document that isn't the first of its
    group; distance is that between the two signatures, which a chain may put above max_distance."""
    g = groups(cut(signatures(docs, id_col, text_col)), **search)
    return g.where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")))).select(F.col("id").alias("doc_id"), F.col("first_id").alias("duplicate_of"), "distance", "group_size")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """docs without all but the first document of each group, with their own columns."""
    signed = cut(signatures(docs, id_col, text_col))
    g = groups(signed, **search)
    gone = g.where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")))).select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    again = cut(signed.groupBy("id", "th").count().where("count > 1").select(F.col("id").alias("__id"), F.col("th").alias("__th")))
    rows = whole_rows(docs, id_col, text_col)
    kept = rows.join(gone, same_document(rows, gone), "left_anti")
    if not again.isEmpty():
        once = kept.join(again, same_document(kept, again), "left_semi").dropDuplicates(["id", "th"])
        kept = kept.join(again, same_document(kept, again), "left_anti").unionByName(once)
    return unwrapped(kept, docs.columns)
