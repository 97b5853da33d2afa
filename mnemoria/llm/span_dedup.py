"""Substring dedup over sliding runs of consecutive sentences.

A sentence ends at ``. ! ?`` (and a closing quote or bracket) before white space, and at a line's end; one
without a word belongs to the sentence before it.  The spans of a text are runs of several consecutive
sentences: for every sentence the shortest run of two or more that begins there and has ``MIN_WORDS`` words or
more, and the shortest such run that ends there; any longer repeated run consists of them.  A sentence of
``ALONE`` words or more is a span by itself.  Spans are equal when their lower-cased words are, by a hash of
128 bits.  Of each repeated span the occurrence with the least (id, text hash, place) is the first; sentences
that any other occurrence covers are removed.

A passage that begins and ends inside sentences is found by the whole sentences in it, which is why MIN_WORDS is low.

Scale.  First only span hashes travel, counted once within each batch and again before the shuffle, so
that a span with a third of all occurrences is one row a task.  The hashes that occur again become a
filter of fixed size, and only their spans are emitted with ids and places; their firsts are an
aggregation with partial results, joined back under skew handling.  Only documents that lose sentences are shuffled.

Defined cases.  Null and empty texts, and texts of fewer than MIN_WORDS words, have no spans and
never change.  Rows equal in id and text are one document and share its fate; rows equal in id only
are two.  A null id is a value like any other and comes first.  A span that recurs within one
document counts as repeated.  Texts count whole.  Other columns of any name pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.llm import kernel as K
from mnemoria.llm.cluster import bit_filter, cut, passing, same_document, touched, unwrapped, whole_rows

MIN_WORDS, ALONE = 16, 40
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[34, 39, 41, 93]] = True


def sentence_starts(w: K.Words) -> np.ndarray:
    """Indices of the words that begin a sentence."""
    b = w.buf
    stop = np.flatnonzero(_STOP[b])
    after = np.append(b, np.uint8([32, 32]))
    closed = _CLOSE[after[stop + 1]] & K.IS_SPACE[after[stop + 2]]
    marks = np.union1d(stop[K.IS_SPACE[after[stop + 1]] | closed], np.flatnonzero(b == 10))
    starts = np.ones(len(w.start), bool)
    starts[1:] = (np.searchsorted(marks, w.start[1:]) > np.searchsorted(marks, w.end[:-1])) | (w.row[1:] != w.row[:-1])
    return np.flatnonzero(starts)


def spans(w: K.Words, least: int, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence bounds (n+1 word indices), each row's first sentence (rows+1), and the spans: begin, end sentence, hash."""
    s = sentence_starts(w)
    bound = np.append(s, len(w.start))
    first = np.searchsorted(s, w.first)
    n = len(s)
    if not n:
        return bound, first, s, s, np.zeros(0, K.U)
    row = w.row[s]
    i = np.arange(n)
    ahead = np.maximum(np.searchsorted(bound, bound[:-1] + least), i + 2)
    fit = ahead <= first[row + 1]
    back = np.minimum(np.searchsorted(bound, bound[1:] - least, "right") - 1, i - 1)
    fits = back >= first[row]
    long = np.flatnonzero(np.diff(bound) >= alone)
    pair = np.unique(np.concatenate((i[fit] * (n + 1) + ahead[fit], back[fits] * (n + 1) + i[fits] + 1, long * (n + 1) + long + 1)))
    a, e = pair // (n + 1), pair % (n + 1)
    return bound, first, a, e, K.run_hash(w.hash, bound[a], bound[e])


def _count(least: int, alone: int):
    """mapInArrow function: (h, n), how often each span hash occurs in a piece of a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = K.lower(batch.column("text"))
            for x, y in K.chunks(text):
                h, n = np.unique(spans(K.Words(text[x:y]), least, alone)[4], return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    return count


def _emit(least: int, alone: int, bits: np.ndarray):
    """mapInArrow function: (h, g, id, th, place) of the spans whose hash h passes the filter; g is a second hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = K.lower(batch.column("text"))
            for x, y in K.chunks(text):
                w = K.Words(text[x:y])
                bound, first, a, e, h = spans(w, least, alone)
                some = np.flatnonzero(passing(bits, h))
                if not len(some):
                    continue
                a, e, h = a[some], e[some], h[some]
                g = K.run_hash(K.mix(w.hash, 3), bound[a], bound[e])
                row = w.row[bound[a]]
                part = batch.select(["id", "th"]).slice(x, y - x).take(pa.array(row))
                place = ((a - first[row]) << 32) | (e - first[row])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), part.column("id"), part.column("th"), pa.array(place)], ["h", "g", "id", "th", "place"])

    return emit


def _cut(extra: list[str], place: int):
    """mapInArrow function: documents with their repeated spans in ``__spans``; sentences those cover go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            out, total, gone = [], [], []
            lower = K.lower(texts)
            for x, y in K.chunks(lower):
                w, own = K.Words(lower[x:y], hashes=False), K.Words(texts[x:y], hashes=False, cased=True)
                s = sentence_starts(w)
                first = np.searchsorted(s, w.first)
                for r in range(y - x):
                    marks = batch.column("__spans")[x + r].values
                    drop = np.zeros(int(first[r + 1] - first[r]) + 1, np.int64)
                    p = marks.to_numpy()
                    np.add.at(drop, p >> 32, 1)
                    np.add.at(drop, p & 0xFFFFFFFF, -1)
                    drop = np.cumsum(drop)[:-1] > 0
                    cuts = own.start[s[first[r] : first[r + 1]]]
                    edges = np.concatenate(([own.off[r]], cuts[1:], [own.off[r + 1]]))
                    edges[0] = cuts[0]
                    kept = [bytes(own.buf[own.off[r] : cuts[0]])] + [bytes(own.buf[edges[k] : edges[k + 1]]) for k in np.flatnonzero(~drop)]
                    out.append(b"".join(kept).decode("utf-8", "replace").rstrip())
                    total.append(len(drop))
                    gone.append(int(drop.sum()))
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("__spans",)}
            columns[batch.schema.names[place]] = pa.array(out, pa.string())
            columns |= {"n_sentences": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())} if extra else {}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return cut


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, alone: int = ALONE) -> DataFrame:
    """(id, th, spans, first_ids) of the documents with spans that occur before: places packed as
    begin << 32 | end sentence, and the ids of the documents with the first occurrences."""
    own = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text_col}`"]).alias("th"), docs[f"`{text_col}`"].cast("string").alias("text"))
    counted = own.select("text").mapInArrow(K.tidy(_count(least, alone)), "h long, n int")
    again = cut(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    bits = bit_filter(again)
    rows = own.mapInArrow(K.tidy(_emit(least, alone, bits)), T.StructType([*T._parse_datatype_string("h long, g long").fields, own.schema["id"], *T._parse_datatype_string("th long, place long").fields]))
    rows = cut(rows)
    place = F.struct("id", "th", "place")
    firsts = rows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = rows.join(firsts, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set("place").alias("spans"), F.collect_set("first.id").alias("first_ids"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, alone: int = ALONE) -> DataFrame:
    """(doc_id, first_doc_ids, text, n_sentences, n_removed) of every document that loses sentences; text is what
    stays.  A first occurrence in a document whose id is null has no entry in first_doc_ids."""
    hit = cut(repeated(docs, id_col, text_col, least, alone)).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "spans", "first_ids")
    own = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text_col}`"]).alias("th"), docs[f"`{text_col}`"].cast("string").alias("text"))
    own = touched(own, hit.select("__th"))[0]
    both = own.join(hit, same_document(own, hit)).select(F.col("id").alias("doc_id"), F.array_sort("first_ids").alias("first_doc_ids"), "text", F.col("spans").alias("__spans"))
    return both.mapInArrow(K.tidy(_cut(["counts"], 2)), T.StructType([*both.schema.fields[:3], *T._parse_datatype_string("n_sentences long, n_removed long").fields]))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, alone: int = ALONE) -> DataFrame:
    """docs without the sentences that repeated spans cover, with their own columns."""
    hit = cut(repeated(docs, id_col, text_col, least, alone)).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "spans")
    near, rest = touched(whole_rows(docs, id_col, text_col), hit.select("__th"))
    both = near.join(hit, same_document(near, hit), "left")
    text = F.col("row").getField(text_col).cast("string")
    changed = both.where("spans is not null").select("row", text.alias("text"), F.col("spans").alias("__spans"))
    changed = changed.mapInArrow(K.tidy(_cut([], 1)), T.StructType(changed.schema.fields[:2]))
    changed = changed.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
    return unwrapped(rest, docs.columns).unionByName(unwrapped(both.where("spans is null"), docs.columns)).unionByName(changed)
