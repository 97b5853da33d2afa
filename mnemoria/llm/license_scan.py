"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

A text is its lower-cased words.  Of every ``WINDOW`` consecutive ``GRAM``-word hashes of a template
the least is a fingerprint, so any shared run of GRAM + WINDOW - 1 words has one; an inverted index
maps fingerprints to (template, place).  All GRAM-word hashes of a document are looked up in it.  Hits of
a template whose shifts (place in the document less place in the template) are within its band, none of whose
places recurs, are one candidate if they are at least ``MIN_SHARE`` of its fingerprints.

A candidate is aligned: the whole template with a free part of the document, shifts limited to the band,
+2 for an equal word, -1 for a changed, added or missing one; ``<>`` in a template gives the band that many
free words more.  It matches if equal words are at least ``COVERAGE`` of the template's and the required
ones are among them.  Where matches of one document overlap, the one with more equal words stays, then that with
the higher coverage, then the template that is named first.  All candidates of a batch that
have the same template are aligned at once, one NumPy step for each word of the template.

Templates are the program's, not the data's: what is sent to tasks doesn't grow, and nothing is shuffled.

Defined cases.  A null, empty or wordless text has no license.  Repeated rows are scanned alike and each
reported.  A null id is kept.  A license that occurs several times is reported for each place.  Texts count
whole, however long.  No documents, or no templates, give no rows.  Other columns of any name are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.llm import kernel as K
from mnemoria.llm.license_texts import TEMPLATES

GRAM, WINDOW, MIN_SHARE, COVERAGE = 3, 3, 0.1, 0.75
FREE = 8  # words that a <> may stand for
AT_ONCE = 16_000_000  # cells of an alignment held at once
SCHEMA = "license string, template int, coverage double, matched_words int, template_words int, start long, end long, spans array<struct<start:long,end:long>>"


class Template:
    """A template's word hashes, which of them are required, and its fingerprints' places."""

    def __init__(self, name: str, text: str):
        self.name = name
        w = K.Words(K.lower(pa.array([text], pa.string())))
        self.code = w.hash
        self.size = len(w.hash)
        self.must = np.array([s > 0 and w.buf[s - 1] == 123 for s in w.start.tolist()], bool)
        self.band = max(4, self.size // 8) + FREE * text.count("<>")
        n = self.size - GRAM + 1
        self.grams = K.run_hash(self.code, np.arange(n), np.arange(n) + GRAM) if n > 0 else np.zeros(0, K.U)
        self.prints = winnow(self.grams)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints: the last least hash of every window of hashes (one if there are fewer)."""
    if not len(h):
        return np.zeros(0, np.int64)
    w = min(window, len(h))
    view = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(1))


class Index:
    """Fingerprint -> (template, place), with a bitmap in front."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [Template(*t) for t in templates]
        rows = sorted((int(t.grams[p]), n, int(p)) for n, t in enumerate(self.templates) for p in t.prints)
        self.key = np.array([r[0] for r in rows], K.U)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.key >> K.U(44)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position among grams, template, place) of every fingerprint met."""
        some = np.flatnonzero(self.filter[(grams >> K.U(44)).astype(np.int64)])
        a, b = np.searchsorted(self.key, grams[some]), np.searchsorted(self.key, grams[some], "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(some, n), self.template[at], self.place[at]


def align(t: Template, code: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each candidate the (template word, document word) pairs of equal words on its best alignment.

    ``low``/``high`` bound the candidate's document; ``shift`` is the first of ``width`` shifts allowed.
    """
    n, m = len(low), t.size
    step = np.zeros((m, n, width), np.int8)  # 0 equal or changed, 1 missing in the document, 2 added in it, 3 start
    column = np.arange(width)
    best = np.zeros((n, width), np.int32)  # score before any template word: the document's start is free
    for i in range(m):
        j = shift[:, None] + column[None, :] + i
        inside = (j >= low[:, None]) & (j < high[:, None])
        same = inside & (code[np.clip(j, 0, len(code) - 1)] == t.code[i])
        diagonal = best + np.where(same, 2, np.where(inside, -1, -9999))
        missing = np.full((n, width), -9999, np.int32)
        missing[:, :-1] = best[:, 1:] - 1  # the same document word, one template word on
        now = np.maximum(diagonal, missing)
        # added document words: from a lower shift at the same template word, -1 each
        run = np.maximum.accumulate(now + column, axis=1) - column
        step[i] = np.where(now < run, 2, np.where(diagonal >= missing, 0, 1))
        best = run
    out = []
    end = (best * (2 * width) - np.abs(column - t.band)).argmax(1)  # of equal scores the one nearest to the candidate's own shift
    for c in range(n):
        k, i = int(end[c]), m - 1
        x, y = [], []
        while i >= 0:
            s = step[i, c, k]
            if s == 2:
                k -= 1
            elif s == 1:
                k, i = k + 1, i - 1
            else:
                j = int(shift[c]) + k + i
                if low[c] <= j < high[c] and code[j] == t.code[i]:
                    x.append(i)
                    y.append(j)
                i -= 1
        out.append((np.array(x[::-1], np.int64), np.array(y[::-1], np.int64)))
    return out


def _candidates(row: np.ndarray, template: np.ndarray, place: np.ndarray, shift: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(template, row, first shift) of groups of hits within a template's band."""
    order = np.lexsort((shift, row, template))
    row, template, place, shift = row[order], template[order], place[order], shift[order]
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (template[1:] != template[:-1]), [True])))
    for s, e in zip(head[:-1].tolist(), head[1:].tolist()):
        t = index.templates[template[s]]
        least = max(1.0, MIN_SHARE * len(t.prints))
        while s < e:
            end = s + int(np.searchsorted(shift[s:e], shift[s] + t.band, "right"))
            seen: set[int] = set()
            for k, p in enumerate(place[s:end].tolist(), s):  # a place met again is the next copy's
                if p in seen:
                    end = k
                    break
                seen.add(p)
            if end - s >= least and len(np.unique(place[s:end])) >= least:
                yield int(template[s]), int(row[s]), int(shift[s])
            s = end


def matches(text: pa.Array, index: Index) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, template, template words, document words) of every match in lower-cased texts; words are of the batch."""
    w = K.Words(text)
    n = len(w.start) - GRAM + 1
    if n <= 0 or not len(index.key):
        return []
    i = np.arange(n)
    i = i[w.row[i] == w.row[i + GRAM - 1]]
    at, template, place = index.hits(K.run_hash(w.hash, i, i + GRAM))
    if not len(at):
        return []
    word = i[at]
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, row, shift in _candidates(w.row[word], template, place, word - place, index):
        by[t].append((row, shift))
    found: dict[int, list[tuple[int, float, int, np.ndarray, np.ndarray]]] = defaultdict(list)
    for n, cases in by.items():
        t = index.templates[n]
        width = 3 * t.band + 1
        size = max(1, AT_ONCE // (t.size * width))
        must = set(np.flatnonzero(t.must).tolist())
        for c in range(0, len(cases), size):
            rows = np.array([x[0] for x in cases[c : c + size]])
            shift = np.array([x[1] for x in cases[c : c + size]]) - t.band
            for r, (x, y) in zip(rows.tolist(), align(t, w.hash, w.first[rows], w.first[rows + 1], shift, width)):
                if len(x) >= COVERAGE * t.size and must <= set(x.tolist()):
                    found[r].append((-len(x), -len(x) / t.size, n, x, y))
    out = []
    for r in sorted(found):
        taken: list[tuple[int, int]] = []
        for _, _, n, x, y in sorted(found[r], key=lambda f: (*f[:3], int(f[4][0]))):
            if all(y[-1] < a or y[0] > b for a, b in taken):
                taken.append((int(y[0]), int(y[-1])))
                out.append((r, n, x, y))
    return sorted(out, key=lambda o: (o[0], int(o[3][0])))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, coverage, matched_words, template_words, start, end, spans) of every license found.
    start and end bound it in the text, in characters; spans are its runs of consecutive equal words."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = TEMPLATES if templates is None else templates
    schema = T.StructType([own.schema["doc_id"], *T._parse_datatype_string(SCHEMA).fields])
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(names)
        for batch in batches:
            text = batch.column("text")
            lower = K.lower(text)
            for a, b in K.chunks(lower):
                found = matches(lower[a:b], index)
                if not found:
                    continue
                own = K.Words(text[a:b], hashes=False, cased=True)
                letter = np.concatenate(([0], np.cumsum((own.buf & 0xC0) != 0x80)))
                base = letter[own.off]
                rows = []
                for r, n, x, y in found:
                    t = index.templates[n]
                    s, e = letter[own.start[y]] - base[r], letter[own.end[y]] - base[r]
                    cut = np.flatnonzero((np.diff(x) != 1) | (np.diff(y) != 1)) + 1
                    spans = [{"start": int(s[p[0]]), "end": int(e[p[-1]])} for p in np.split(np.arange(len(y)), cut)]
                    rows.append((t.name, n, round(len(x) / t.size, 6), len(x), t.size, int(s[0]), int(e[-1]), spans))
                ids = batch.column("doc_id").take(pa.array([a + f[0] for f in found]))
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], columns)

    return own.mapInArrow(K.tidy(run), schema)
