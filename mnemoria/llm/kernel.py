"""Vectorised text kernels shared by the operators of this subpackage.

Spark hands each Python worker Arrow batches; everything here works on the raw UTF-8 bytes of
such a batch with NumPy, never on one row or one word at a time.  A *word* is a maximal run of
``[a-z0-9]`` or non-ASCII bytes after Unicode lower-casing, so case, punctuation and white space
do not matter.  A word's hash is a polynomial in its bytes, read from one running sum per batch:
``(C[end] - C[start]) * P**-start`` modulo 2**64 (P is odd, so it has an inverse), then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
CHUNK_BYTES = 2_000_000

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
IS_CASED_WORD = IS_WORD.copy()
IS_CASED_WORD[65:91] = True
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for the usual chunk size only."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser, elementwise."""
    x = np.asarray(x, U) + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n+1 offsets into them; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2] if len(arr) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``limit`` bytes; one longer text is a range of its own."""
    _, off = raw(arr)
    at = 0
    while at < len(arr):
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end
        at = end


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow that gives its freed memory back at the end: workers outlive tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lower(arr: pa.Array) -> pa.Array:
    return pc.utf8_lower(arr)


class Words:
    """The words of a batch: ``start``/``end`` byte positions, ``hash``, ``row`` and ``first``
    (n+1 positions of each row's first word).  Takes lower-cased text, or any text if ``cased``;
    a text has as many words either way."""

    def __init__(self, arr: pa.Array, hashes: bool = True, cased: bool = False):
        self.buf, self.off = raw(arr)
        n = len(self.buf)
        word = (IS_CASED_WORD if cased else IS_WORD)[self.buf]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = word[:-1], word[1:]
            inner = self.off[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.row = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))
        if hashes:
            self.hash = span_hash(self.buf, self.start, self.end)


def byte_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums of the polynomial of ``buf``, from which ``gram_hash`` reads any span's hash."""
    n = len(buf)
    sums = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers(P, n), out=sums[1:])
    return sums


def gram_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``span_hash`` of spans of the bytes that ``byte_sums`` has seen."""
    return mix((sums[end] - sums[start]) * powers(P_INV, len(sums))[start])


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, equal for equal bytes wherever they stand."""
    return gram_hash(byte_sums(buf), start, end)


def ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start..start+size of every range, one after the other, and the range of each."""
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.asarray(start)[own], own


def run_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run start..end of the hashes h, in order."""
    n = len(h)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * powers(P, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(P_INV, n + 1)[start], 7)


def _lanes() -> np.ndarray:
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(U)[:, 0].copy()


LANES = _lanes()


def bit_sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 64) counts of set bits per row, where row r has the hashes first[r]..first[r+1].

    A table spreads the 8 bits of one hash byte over 8 byte lanes of an integer, so one addition
    counts 8 bits; pieces of at most 255 hashes keep a lane from overflowing.
    """
    rows = len(first) - 1
    out = np.zeros((rows, 64), np.int32)
    size = np.diff(first)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    pieces = -(-size[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[:-1][full][owner] + nth * 255
    base = int(at[0])
    h = h[base : int(first[-1])]
    piece = np.empty((len(at), 8), U)
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for j in range(8):
        piece[:, j] = np.add.reduceat(LANES[octets[:, j]], at - base)
    counts = piece.view(np.uint8).reshape(len(at), 64).astype(np.int32)
    out[full] = np.add.reduceat(counts, np.cumsum(pieces) - pieces, axis=0)
    return out


def simhash(h: np.ndarray, first: np.ndarray, words: int = 1) -> np.ndarray:
    """(rows, words) uint64: 64*words SimHash bits of each row's feature hashes; ties give 0."""
    out = np.zeros((len(first) - 1, words), U)
    size = np.diff(first)[:, None]
    for k in range(words):
        ones = bit_sums(mix(h, k + 11), first)
        out[:, k] = np.packbits(2 * ones > size, axis=1, bitorder="little").view(U)[:, 0]
    return out


def distinct_by_row(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes (their upper 40 bits, in any batch), and n+1 positions; row ascends."""
    most = 1 << 24
    if rows > most:
        edges = np.searchsorted(row, np.arange(0, rows + most, most))
        parts = [distinct_by_row(h[a:b], row[a:b] - k * most, min(most, rows - k * most)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        sizes = np.concatenate([np.diff(first) for _, first in parts])
        return np.concatenate([k for k, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))
    key = np.sort((row.astype(U) << U(40)) | (h >> U(24)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    own = (key >> U(40)).astype(np.int64)
    return key << U(24), np.searchsorted(own, np.arange(rows + 1))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def groups_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index joined to each of n nodes by the edges (a, b): hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        keep = ra != rb
        if not keep.any():
            break
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


class Lines:
    """The lines of a batch of Words: ``row``, ``number`` within the row, ``first`` (n+1 positions of
    their words), ``words`` and ``size``, the bytes of the normal form: words with single blanks between."""

    def __init__(self, w: Words):
        self.w = w
        feeds = np.flatnonzero(w.buf == 10)
        per_row = np.diff(np.searchsorted(feeds, w.off)) + 1
        head = np.cumsum(per_row) - per_row
        self.row = np.repeat(np.arange(len(w.off) - 1), per_row)
        self.number = np.arange(len(self.row)) - np.repeat(head, per_row)
        start = np.empty(len(self.row), np.int64)
        rest = np.ones(len(start), bool)
        rest[head] = False
        start[head], start[rest] = w.off[:-1], feeds + 1
        self.first = np.append(np.searchsorted(w.start, start), len(w.start))
        self.words = np.diff(self.first)
        sums = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))
        self.size = np.maximum(np.diff(sums[self.first]) - 1, 0)

    def texts(self, some: np.ndarray) -> pa.Array:
        """The normal forms of the lines ``some``."""
        form, begin = self.forms()
        at, _ = ranges(begin[some], self.size[some])
        off = np.concatenate(([0], np.cumsum(self.size[some]))).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(form[at].tobytes())])

    def forms(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all normal forms, and where each line's begins; ``size`` says how long it is."""
        w = self.w
        ends = np.cumsum(w.end - w.start + 1)
        blank = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        blank[ends - 1] = True
        out = np.full(len(blank), 32, np.uint8)
        out[~blank] = w.buf[IS_WORD[w.buf]]
        return out, np.concatenate(([0], ends))[self.first[:-1]]

    def simhash(self, some: np.ndarray, words: int) -> np.ndarray:
        """SimHash of the distinct words of the lines ``some``, in ``words`` integers of 64 bits."""
        at, row = ranges(self.first[some], self.words[some])
        h, first = distinct_by_row(self.w.hash[at], row, len(some))
        return simhash(h, first, words)
