"""Language identification with string kernels.

The kernel of two texts is the share of byte n-grams (n from 1 to ``MAX_N``, over lower-cased words with
single blanks) that both have: the blended-spectrum presence kernel |A & B| / sqrt(|A| |B|).  ``LANDMARKS``
training texts span the Nyström features ``k(x, landmarks) (K_mm)^-1/2``, on which one kernel ridge
regression for each language is fitted against the rest, both sides weighted alike.  n-grams are
hashed to ``WIDTH`` places, so a batch of texts is a 0/1 matrix, its kernel with all landmarks one
matrix product, and its scores another.

The model is fitted on a bounded sample: the ``PER_LANGUAGE`` documents of each language whose ids hash
lowest, found with a top-k that keeps at most that many rows a language in any task.  Fitting happens on the
driver; scoring reads each text once, whole, and shuffles nothing.

Defined cases.  A text without a word (null, empty, punctuation) gets ``und`` and a null score and
isn't trained on, nor is one without a language.  Rows with equal ids that are in the sample are all
trained on.  With no training document every text is ``und``.  Equal scores go to the language
that sorts first.  Other columns of any name are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.llm import kernel as K

MAX_N, WIDTH, LANDMARKS, PER_LANGUAGE, RIDGE, ROWS = 4, 1 << 14, 128, 256, 1e-2, 64


def presence(text: pa.Array) -> np.ndarray:
    """(rows, WIDTH) float32 of 0 and 1: which hashed n-grams each lower-cased text has."""
    w = K.Words(text, hashes=False)
    # a blank, then each word and a blank after it, row by row
    size = w.end - w.start + 1
    head = np.diff(w.first) > 0
    lead = np.zeros(len(w.start), np.int64)
    lead[w.first[:-1][head]] = 1
    total = size + lead
    to = np.concatenate(([0], np.cumsum(total)))
    src = np.arange(to[-1]) - np.repeat(to[:-1] + lead - w.start, total)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    inside[to[:-1][lead == 1]] = False
    b = np.full(to[-1], 32, K.U)
    b[inside] = w.buf[src[inside]]
    row = np.repeat(w.row, total).astype(np.uint32)
    out = np.zeros(len(text) * WIDTH, bool)
    gram = np.zeros(len(b), K.U)
    for n in range(1, MAX_N + 1):
        gram = gram[: len(b) - n + 1] | (b[n - 1 :] << K.U(8 * (n - 1)))
        same = row[n - 1 :] == row[: len(gram)]
        place = ((gram * K.U(K.P) + K.U(n * 0x632BE59BD9B4E019 & (2**64 - 1))) * K.U(0xBF58476D1CE4E5B9)) >> K.U(50)
        out[(row[: len(gram)].astype(np.int64) * WIDTH + place.astype(np.int64))[same]] = True
    return out.reshape(len(text), WIDTH).astype(np.float32)


def pieces(text: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in K.chunks(text):
        for x in range(a, b, ROWS):
            yield x, min(b, x + ROWS)


class Model:
    """Landmarks (unit rows) and the matrix from kernels to scores."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.names = sorted(set(labels))
        if not self.names:
            return
        low = K.lower(pa.array(texts, pa.string()))
        x = np.concatenate([presence(low[a:b]) for a, b in pieces(low)])
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        y = np.array([self.names.index(v) for v in labels])
        turn = np.concatenate([np.flatnonzero(y == k) for k in range(len(self.names))])
        nth = np.concatenate([np.arange((y == k).sum()) for k in range(len(self.names))])
        pick = turn[np.argsort(nth, kind="stable")][: max(LANDMARKS, len(self.names))]  # as many of each language
        self.landmarks = x[pick]
        value, vector = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(np.float64))
        use = value > 1e-6 * value[-1]
        root = vector[:, use] / np.sqrt(value[use])
        z = np.concatenate(((x @ self.landmarks.T).astype(np.float64) @ root, np.ones((len(x), 1))), axis=1)
        weights = []
        for k in range(len(self.names)):
            own = y == k
            s = np.where(own, 0.5 / own.sum(), 0.5 / max(1, (~own).sum())) * len(y)
            a = (z * s[:, None]).T @ z + RIDGE * len(y) * np.diag([1.0] * root.shape[1] + [0.0])
            weights.append(np.linalg.solve(a + 1e-9 * np.eye(len(a)), (z * s[:, None]).T @ np.where(own, 1.0, -1.0)))
        w = np.stack(weights, axis=1)
        self.to_scores, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def scores(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) scores of lower-cased texts, and which have a word."""
        x = presence(text)
        size = x.sum(1, keepdims=True)
        kernel = (x @ self.landmarks.T) / np.sqrt(np.maximum(size, 1))
        return kernel @ self.to_scores + self.bias, size[:, 0] > 0


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages to train on; at most about per_language of each."""
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = [r[0] for r in own.select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("id").distinct().toLocalIterator()]
    rows = own.where(F.col("id").isin(ids)).where(F.col("text").rlike(r"[\p{L}\p{N}]")).orderBy("id", "lang", "text").collect() if ids else []
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, score, margin): margin is the lead over the second language, null with one."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array([*m.names, "und"])
        for batch in batches:
            text = K.lower(batch.column("text"))
            for a, b in pieces(text):
                if m.names:
                    s, some = m.scores(text[a:b])
                    best = s.argmax(1)
                    top = np.sort(s, axis=1)
                else:
                    best, some, top = np.zeros(b - a, np.int64), np.zeros(b - a, bool), np.zeros((b - a, 1), np.float32)
                best = np.where(some, best, len(m.names))
                lead = pa.array((top[:, -1] - top[:, -2]).astype(np.float64), mask=~some) if top.shape[1] > 1 else pa.nulls(b - a, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], names.take(pa.array(best)), pa.array(top[:, -1].astype(np.float64), mask=~some), lead], ["doc_id", "language", "score", "margin"])

    return own.mapInArrow(K.tidy(run), T.StructType([own.schema["doc_id"], *T._parse_datatype_string("language string, score double, margin double").fields]))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    return Model(*sample(docs, id_col, text_col, lang_col, per_language))
