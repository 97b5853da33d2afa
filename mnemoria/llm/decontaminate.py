"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: lower-cased words, with numbers, units that follow a number and
capitalised words inside a sentence (names) replaced by the typed placeholders NUM, UNIT and NAME;
adjacent numbers or names count as one.  Windows of ``WINDOW`` tokens, at least half of them words,
are hashed and joined with those of the benchmark's items; an item with fewer tokens, but at
least ``LEAST``, is one window of its length.  The same is done without placeholders, for copies whose
capitals changed.  Matched windows are grouped by the shift between text and item; an item leaks
where they cover at least ``COVERAGE`` of its tokens and its slots are consistent: equal values in
the item stand against equal values in the text.  A question with other numbers, names and
units, used consistently, is so caught as well as a copy; one whose equal slots differ isn't.

The benchmark is the build side of the hash join: it is sent to the tasks in blocks of at most
``BLOCK`` windows, one pass over the corpus for each (one block holds about 50,000 questions), so
what is sent is bounded whatever its size, and the corpus is never shuffled.

Defined cases.  Null, empty and short texts (under LEAST tokens) match nothing, as do such items.
Repeated rows and items are reported once for each pair of ids and text.  A null id is kept as it is.
Texts count whole.  Other columns of any name pass through ``clean``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.llm import kernel as K
from mnemoria.llm.cluster import same_document, unwrapped, whole_rows

WINDOW, LEAST, COVERAGE, BLOCK = 8, 5, 0.5, 2_000_000
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons tonnes ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years mph kmh percent dollar dollars cent cents euro euros usd eur gbp degree degrees celsius fahrenheit watt watts kw volt volts hz mb gb kb".split()
NUM, UNIT, NAME = (K.mix(np.array([x], K.U), 91)[0] for x in (1, 2, 3))

_UNIT = np.sort(K.Words(pa.array([" ".join(UNITS)])).hash)
_BREAK = np.zeros(256, bool)
_BREAK[[10, 33, 46, 58, 63]] = True


class Tokens:
    """Canonical tokens of a batch: ``code``, ``row``, ``first`` and each one's span of words ``word[i]:word[i+1]``."""

    def __init__(self, text: pa.Array, template: bool, words: K.Words | None = None):
        self.words = w = words or K.Words(K.lower(text))
        n = len(w.start)
        code, keep = w.hash.copy(), np.ones(n, bool)
        self.slot = np.zeros(n, bool)
        if template and n:
            own = K.Words(text, hashes=False, cased=True)
            inner = np.concatenate(([False], w.row[1:] == w.row[:-1]))
            number = (w.buf[w.start] >= 48) & (w.buf[w.start] <= 57)
            unit = inner & np.concatenate(([False], number[:-1])) & np.isin(w.hash, _UNIT) & ~number
            name = np.zeros(n, bool)
            if len(own.start) == n:
                b = own.buf
                upper = ((b >= 65) & (b <= 90)) | np.append((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E), False)
                marks = np.concatenate(([0], np.cumsum(_BREAK[w.buf], dtype=np.int64)))
                inside = inner.copy()
                inside[1:] &= marks[w.start[1:]] == marks[w.end[:-1]]
                wide = own.end - own.start > 1
                second = np.minimum(own.start + 1, len(b) - 1)
                name = upper[own.start] & inside & ~(wide & (b[second] >= 65) & (b[second] <= 90)) & ~number
            gap = np.concatenate(([9], w.start[1:] - w.end[:-1]))
            joined = inner & (gap == 1)
            for kind, mask in ((NUM, number), (NAME, name)):
                code[mask] = kind
                keep &= ~(mask & joined & np.concatenate(([False], mask[:-1])))
            code[unit] = UNIT
            self.slot = number | unit | name
        at = np.flatnonzero(keep)
        self.word = np.append(at, n)
        self.code, self.row, self.slot = code[at], w.row[at], self.slot[at]
        self.first = np.searchsorted(at, w.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows of ``size`` tokens, at least half of them words."""
        if len(self.code) < size:
            return np.zeros(0, np.int64), np.zeros(0, K.U)
        i = np.arange(len(self.code) - size + 1)
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        i = i[(self.row[i] == self.row[i + size - 1]) & (2 * (slots[i + size] - slots[i]) <= size)]
        return i, K.run_hash(self.code, i, i + size)

    def surface(self, i: int) -> str:
        w = self.words
        a, e = int(self.word[i]), int(self.word[i + 1])
        return bytes(w.buf[w.start[a] : w.end[e - 1]]).decode("utf-8", "replace")


class Side:
    """One form (template or not) of a block of items, ready to be sent to the tasks."""

    def __init__(self, texts: list[str], template: bool):
        t = Tokens(pa.array(texts, pa.string()), template)
        self.template = template
        self.size = np.diff(t.first)
        at = defaultdict(list)
        for size in sorted({WINDOW} | {int(x) for x in self.size if LEAST <= x < WINDOW}):
            i, h = t.windows(size)
            row = t.row[i]
            mine = self.size[row] == size if size < WINDOW else self.size[row] >= WINDOW
            for k, x in zip(i[mine].tolist(), h[mine].tolist()):
                at[size, x].append((int(t.row[k]), k - int(t.first[t.row[k]])))
        self.at = dict(at)
        self.sizes = sorted({s for s, _ in at})
        self.keys = {s: np.sort(np.array([x for z, x in at if z == s], K.U)) for s in self.sizes}
        self.filter = {}
        for s in self.sizes:
            self.filter[s] = np.zeros(1 << 22, bool)
            self.filter[s][(self.keys[s] >> K.U(42)).astype(np.int64)] = True
        self.slots = {r: {k - int(t.first[r]): t.surface(k) for k in np.flatnonzero(t.slot[t.first[r] : t.first[r + 1]]) + int(t.first[r])} for r in range(len(texts))}

    def leaks(self, text: pa.Array, words: K.Words | None = None) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row, item) -> (coverage, slots, changed slots) of every leak in a batch of texts."""
        t = Tokens(text, self.template, words)
        hits: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for size in self.sizes:
            i, h = t.windows(size)
            some = np.flatnonzero(self.filter[size][(h >> K.U(42)).astype(np.int64)])
            some = some[np.isin(h[some], self.keys[size])]
            for k, x in zip(i[some].tolist(), h[some].tolist()):
                for item, place in self.at[size, x]:
                    hits[int(t.row[k]), item].append((k, place, size))
        found = {}
        for (row, item), own in hits.items():
            by_shift = Counter(k - p for k, p, _ in own)
            slack = max(1, int(self.size[item]) // 10)
            best = None
            for shift in by_shift:
                near = [x for x in own if abs(x[0] - x[1] - shift) <= slack]
                cover: dict[int, int] = {}
                for k, p, size in sorted(near, key=lambda x: abs(x[0] - x[1] - shift)):
                    for d in range(size):
                        cover.setdefault(p + d, k + d)
                share = len(cover) / int(self.size[item])
                if share < COVERAGE or best and share <= best[0]:
                    continue
                value: dict[str, str] = {}
                slots = {p: v for p, v in self.slots[item].items() if p in cover}
                if all(value.setdefault(v, (x := t.surface(cover[p]))) == x for p, v in slots.items()):
                    best = (share, len(slots), sum(v != value[v] for v in slots.values()))
            if best:
                found[row, item] = best
        return found


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for r in items.select(F.col(item_col), F.col(text_col).cast("string")).distinct().toLocalIterator():
        if r[1]:
            ids.append(r[0])
            texts.append(r[1])
            size += r[1].count(" ") + 1
            if size >= BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _search(sides: list[Side], ids: list, kind: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in K.chunks(text):
                found: dict[tuple[int, int], tuple[float, int, int]] = {}
                words = K.Words(K.lower(text[a:b]))
                for side in sides:
                    for k, v in side.leaks(text[a:b], words).items():
                        found[k] = max(found.get(k, v), v)
                if found:
                    rows = sorted(found)
                    part = batch.select(["doc_id", "th"]).slice(a, b - a).take(pa.array([r for r, _ in rows]))
                    share, slots, changed = zip(*(found[k] for k in rows))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([ids[i] for _, i in rows], kind), pa.array([round(x, 6) for x in share]), pa.array(slots, pa.int32()), pa.array(changed, pa.int32())], ["doc_id", "th", "item_id", "coverage", "slots", "changed_slots"])

    return search


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType
    schema = T.StructType([own.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("item_id", kind), *T._parse_datatype_string("coverage double, slots int, changed_slots int").fields])
    out = None
    for ids, texts in _blocks(items, item_col, item_text):
        part = own.mapInArrow(K.tidy(_search([Side(texts, True), Side(texts, False)], ids, to_arrow_type(kind))), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out.distinct()


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, slots, changed_slots) of every item that leaks into a document."""
    return _found(docs, items, id_col, text_col, item_col, item_text).drop("th")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents into which no item leaks, with their own columns."""
    gone = _found(docs, items, id_col, text_col, item_col, item_text).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    rows = whole_rows(docs, id_col, text_col)
    return unwrapped(rows.join(gone, same_document(rows, gone), "left_anti"), docs.columns)
