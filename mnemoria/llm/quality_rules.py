"""Line-first cleaning: drop the lines that fail a rule, then documents that lost too much.

A line that isn't blank fails when, after trimming blanks (words are the pieces between single blanks),

* ``navigation``: it has at least 2 of the separators ``| » › • ·``, one for every 4 words or more;
* ``boilerplate``: it has at most 25 words and one of the phrases of ``PHRASES``;
* ``punctuation``: it has fewer than 8 words, none of them with ``. ! ? : ; …`` or a closing
  quote or bracket at its end, and no character outside the Latin and punctuation blocks;
* ``symbols``: over 15 % of its characters are neither letters, marks, digits, white space nor usual punctuation;
* ``shouting``: 10 letters or more, over 60 % of them upper case;
* ``exclaiming``: 3 exclamation marks or more, one for every 3 words or more;
* ``repetition``: 20 words or more, under 20 % of them distinct.

A document whose kept lines have under ``KEEP_SHARE`` of the characters of its trimmed lines is
rejected, as is one with no such characters.

One table maps each code point to its classes, and running sums over a batch's code points give
every line's counts, so no expression runs per line or per rule.

Defined cases.  A null, empty or blank text is rejected.  Repeated rows are judged alike.  Whole
texts count.  Blank lines neither count nor fail, and stay.  Other columns pass through ``clean``
unchanged whatever their names; no state is shared between rows, so nothing is shuffled.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.llm import kernel as K

KEEP_SHARE = 0.5
SEPARATORS, ENDS, USUAL = "|»›•·", ".!?:;…。！？)”’»", ".,;:!?()/%–—…«»„“”‘’¿¡-"
PHRASES = "cookie policy|privacy policy|terms of (use|service)|accept (all )?cookies|uses cookies|enable javascript|javascript is (disabled|required)|subscribe to|sign up|log in|click here|read more|share on|follow us|powered by|all rights reserved|back to top|skip to content"

LETTER, UPPER, PLAIN, SEPARATOR, END, FOREIGN = (1 << i for i in range(6))
_tables: list[np.ndarray] = []


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes and lower case of every code point."""
    if not _tables:
        cls, low = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for i in range(sys.maxunicode + 1):
            c = unicodedata.category(chr(i))
            if c[0] in "LMN":
                cls[i] = PLAIN | (LETTER if c[0] == "L" else 0) | (UPPER if c == "Lu" else 0)
                if len(x := chr(i).lower()) == 1:
                    low[i] = ord(x)
        for chars, bit in ((SEPARATORS, SEPARATOR), (ENDS, END), (USUAL + " \t\n\f\r", PLAIN)):
            for x in chars:
                cls[ord(x)] |= bit
        cls[0x250:0x1E00] |= FOREIGN
        cls[0x20D0:] |= FOREIGN
        _tables.extend((cls, low))
    return _tables[0], _tables[1]


def failing(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each line of text, whether it fails, and its trimmed length."""
    cls, low = _classes()
    cp = np.frombuffer((text + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = cls[cp]
    feed = np.flatnonzero(cp == 10)
    ink = np.flatnonzero((cp != 32) & (cp != 10))
    i, j = np.searchsorted(ink, np.append(0, feed[:-1] + 1)), np.searchsorted(ink, feed)
    some = j > i
    start = np.where(some, ink[np.minimum(i, len(ink) - 1)], 0) if len(ink) else np.zeros(len(feed), int)
    end = np.where(some, ink[j - 1] + 1, 0) if len(ink) else start
    size = end - start

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(cp) + 1, np.int32)
        np.cumsum(flags, out=sums[1:], dtype=np.int32)
        return sums[end] - sums[start]

    blank = cp == 32
    words = count(blank) + 1
    separators = count(kind & SEPARATOR != 0)
    letters = count(kind & LETTER != 0)
    marks = count(cp == 33)
    ends = kind & END != 0
    ended = ends.copy()
    ended[:-1] &= blank[1:] | (cp[1:] == 10)
    ended = (count(ended) > 0) | ends[np.maximum(end - 1, 0)]
    bad = (separators >= 2) & (separators * 4 >= words)
    bad |= (words < 8) & ~ended & (count(kind & FOREIGN != 0) == 0)
    bad |= size - count(kind & PLAIN != 0) > 0.15 * size
    bad |= (letters >= 10) & (count(kind & UPPER != 0) > 0.6 * letters)
    bad |= (marks >= 3) & (marks * 3 >= words)
    lowered = text.lower()
    if _phrase.search(lowered):
        for n, line in enumerate(lowered.split("\n")):
            bad[n] |= words[n] <= 25 and bool(_phrase.search(line))
    long = np.flatnonzero(some & (words >= 20) & ~bad)
    if len(long):
        gap = np.flatnonzero(blank)
        a, b = np.searchsorted(gap, start[long]), np.searchsorted(gap, end[long])
        per = b - a + 1
        line = np.repeat(np.arange(len(long)), per)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(per) - per, per)
        where = np.minimum(a[line] + nth, max(len(gap) - 1, 0))
        e = np.where(nth == per[line] - 1, end[long][line], gap[where])
        s = np.where(nth == 0, start[long][line], gap[np.maximum(a[line] + nth - 1, 0)] + 1)
        _, first = K.distinct_by_row(K.span_hash(low[cp], s, e), line, len(long))
        bad[long[np.diff(first) < 0.2 * words[long]]] = True
    return bad & some, size


_phrase = re.compile(PHRASES)


def _judge(texts: list[str | None], share: float) -> Iterator[tuple[int, str, int, int]]:
    """(row, cleaned text, lines, kept lines) of the texts that stay."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end] or "") <= K.CHUNK_BYTES // 2):
            total += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        bad, size = failing("\n".join(part))
        first = np.concatenate(([0], np.cumsum([t.count("\n") + 1 for t in part])))
        full, lost = np.add.reduceat(size, first[:-1]), np.add.reduceat(np.where(bad, size, 0), first[:-1])
        for i in np.flatnonzero((full > 0) & (full - lost >= share * full)).tolist():
            a, b = int(first[i]), int(first[i + 1])
            gone = bad[a:b]
            n = int(gone.sum())
            yield at + i, "\n".join(x for x, out in zip(part[i].split("\n"), gone) if not out) if n else part[i], b - a, b - a - n
        at = end


def clean(docs: DataFrame, text_col: str = "text", share: float = KEEP_SHARE) -> DataFrame:
    """The documents that stay, with the failing lines out of their text and all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_judge(batch.column(place).to_pylist(), share))
            out = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            columns = out.columns
            columns[place] = pa.array([r[1] for r in rows], out.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=out.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # a column may have any name
    return plain.mapInArrow(K.tidy(run), plain.schema).toDF(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = KEEP_SHARE) -> DataFrame:
    """(doc_id, text, n_lines, n_kept) of the documents that stay."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_judge(batch.column(1).to_pylist(), share))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64())))], ["doc_id", "text", "n_lines", "n_kept"])

    return own.mapInArrow(K.tidy(run), T.StructType([own.schema["doc_id"], *T._parse_datatype_string("text string, n_lines long, n_kept long").fields]))


def _sql() -> str:
    def left(keep: str) -> str:
        return f"length(regexp_replace(l, '[^{keep}]', '', 'g'))"

    words, ends = f"({left(' ')} + 1)", ENDS
    rules = (
        f"{left(SEPARATORS)} >= 2 and {left(SEPARATORS)} * 4 >= {words}",
        f"{words} <= 25 and regexp_matches(lower(l), '{PHRASES}')",
        f"{words} < 8 and not regexp_matches(l, '[{ends}]( |$)') and not regexp_matches(l, '[^\\x00-\\x{{24F}}\\x{{1E00}}-\\x{{20CF}}]')",
        f"length(l) - {left(f'\\p{{L}}\\p{{M}}\\p{{N}} \\t\\n\\f\\r{USUAL}')} > 0.15 * length(l)",
        f"{left('\\p{L}')} >= 10 and {left('\\p{Lu}')} > 0.6 * {left('\\p{L}')}",
        f"{left('!')} >= 3 and {left('!')} * 3 >= {words}",
        f"{words} >= 20 and len(list_distinct(string_split(lower(l), ' '))) < 0.2 * {words}",
    )
    fails = " or ".join(f"({x})" for x in rules)
    return f"""
with split as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
judged as (select doc_id, lines, list_filter(lines, lambda x: len(list_filter([trim(x)], lambda l: l <> '' and ({fails}))) = 0) as kept from split),
sized as (select *, coalesce(list_sum(list_transform(lines, lambda x: length(trim(x)))), 0) as n_all, coalesce(list_sum(list_transform(kept, lambda x: length(trim(x)))), 0) as n_left from judged)
select doc_id, array_to_string(kept, chr(10)) as text, len(lines)::bigint as n_lines, len(kept)::bigint as n_kept
from sized where n_all > 0 and n_left >= {KEEP_SHARE} * n_all
"""


SQL = _sql()
