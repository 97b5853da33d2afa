"""SentencePiece models on the Tokenizers library.

The model file is read as a protobuf by hand (pieces with scores and types, the trainer's model
type, the normaliser's settings) and rebuilt: its normaliser, the metaspace marker, unigram scores
or the merges that BPE scores imply, and byte fallback.  The ids equal SentencePiece's own.

Where no piece continues across a marker, words can be encoded one by one without changing any id.
A batch then encodes each new word once, in one multithreaded call, and ids are gathered with NumPy;
otherwise whole texts go through the same backend.  Decoding joins the pieces' bytes.

Defined cases.  A null text has null ids; an empty one has none.  Repeated rows are encoded alike.
Texts count whole, however long.  Bytes that aren't valid UTF-8 after decoding become U+FFFD.  Ids
outside the vocabulary raise a ValueError, as they can't come from this model.  Other columns of any
name are dropped; nothing is shuffled.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.llm import kernel as K

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
KNOWN_WORDS = 150_000  # words whose ids a worker keeps; it starts anew beyond them


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = struct.unpack("<d" if size == 8 else "<f", data[at : at + size])[0], at + size
        yield tag >> 3, value


class Model:
    """A parsed model file: ``pieces`` (text, score, type) and the settings that matter."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        norm: dict[int, object] = {}
        for n, v in _fields(data):
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                norm = dict(_fields(v))
        self.kind = {1: "unigram", 2: "bpe"}[trainer.get(3, 1)]
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_space = bool(trainer.get(24, 0))
        self.charsmap = norm.get(2, b"")
        self.prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        inner = any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER))
        self.by_word = self.escape and not inner
        self.plain = self.by_word and self.prefix and not (self.charsmap or self.squeeze or self.suffix_space) and not any(t == USER for *_, t in self.pieces)

    def bytes_of(self) -> list[bytes]:
        """What each id decodes to."""
        special = {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}
        return [special.get(t, bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode()) for p, _, t in self.pieces]


def tokenizer(model: Model, prefix: bool):
    """A Tokenizer equal to the model; without ``prefix`` the caller puts the leading blank."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == "unigram":
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk, model.byte_fallback))
    else:
        merges = []
        for p, score, kind in model.pieces:
            if kind in (NORMAL, USER) and len(p) > 1:
                cuts = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in vocab and p[i:] in vocab]
                merges += [(-score, c) for c in sorted(cuts, key=lambda c: (vocab[c[0]], vocab[c[1]]))]
        merges.sort(key=lambda m: m[0])
        t = Tokenizer(models.BPE(vocab, [m for _, m in merges], unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and model.prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if model.by_word:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.prefix else [])])
    if users := [AddedToken(p, normalized=True) for p, _, k in model.pieces if k == USER]:
        t.add_tokens(users)
    return t


class Codec:
    """Encodes and decodes Arrow arrays."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = Model(data)
        self.whole = tokenizer(self.model, True)
        self.word = tokenizer(self.model, False)
        self._forget()
        table = self.model.bytes_of()
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in table])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n+1 offsets; a null counts as empty."""
        flat: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for a, b in K.chunks(texts):
            ids, size = self._encode(pc.fill_null(texts[a:b], ""))
            flat.append(ids)
            sizes.append(size)
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *flat]), np.concatenate(([0], np.cumsum(np.concatenate([none, *sizes]), dtype=np.int64)))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.model.plain or pc.any(pc.match_substring(texts, MARK)).as_py():
            ids = [e.ids for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((x for e in ids for x in e), np.int32), np.array([len(e) for e in ids], np.int64)
        some = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        buf, off = K.raw(some)
        blank = buf == 32
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(buf))[: len(start)]
        h, one, which = np.unique(K.span_hash(buf, start, end), return_index=True, return_inverse=True)
        which = self._slots(h, one, buf, start, end)[which]
        per = self.ends[which + 1] - self.ends[which]
        to = np.concatenate(([0], np.cumsum(per)))
        took = self.known_ids[np.arange(to[-1]) + np.repeat(self.ends[which] - to[:-1], per)]
        return took, np.diff(to[np.searchsorted(start, off)])

    def _slots(self, h: np.ndarray, one: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each distinct word's ids stand among the known ones; new words are encoded first."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        slots = [self.known.get(x, -1) for x in h.tolist()]
        new = [i for i, x in enumerate(slots) if x < 0]
        if new:
            data, at = buf.tobytes(), one[new]
            words = [data[a:e].decode() for a, e in zip(start[at].tolist(), end[at].tolist())]
            ids = [e.ids for e in self.word.encode_batch_fast(words, add_special_tokens=False)]
            base = len(self.ends) - 1
            for k, i in enumerate(new):
                slots[i] = base + k
            self.known.update(zip(h[new].tolist(), range(base, base + len(new))))
            self.known_ids = np.concatenate((self.known_ids, np.fromiter(chain.from_iterable(ids), np.int32)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
        return np.array(slots, np.int64)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.known_ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def decode(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and n+1 offsets of the texts that ids encode."""
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.at) - 1):
            raise ValueError("an id is outside the vocabulary")
        size = np.diff(self.at)[flat]
        to = np.concatenate(([0], np.cumsum(size)))
        out = self.table[np.arange(to[-1]) + np.repeat(self.at[flat] - to[:-1], size)]
        ends = to[off]
        if self.model.prefix:  # the blank that encoding put first
            lead = ends[:-1][(np.diff(ends) > 0)]
            lead = lead[out[lead] == 32]
            keep = np.ones(len(out), bool)
            keep[lead] = False
            ends = np.concatenate(([0], np.cumsum(keep)))[ends]
            out = out[keep]
        return out, ends


@lru_cache(2)
def _codec(data: bytes, threads: int) -> Codec:
    return Codec(data, threads)


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): exact says that decoding the ids gives back the text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, threads)
        for batch in batches:
            whole = batch.column("text")
            for x, y in K.chunks(whole):
                text = whole[x:y]
                flat, off = codec.encode(text)
                gone = text.is_null()
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), mask=gone)
                back, ends = codec.decode(flat, off)
                buf, at = K.raw(text)
                exact = np.diff(ends) == np.diff(at)
                if exact.all():
                    wrong = np.concatenate(([0], np.cumsum(back != buf)))
                    exact &= np.diff(wrong[ends]) == 0
                else:
                    exact &= np.array([e and bytes(back[a:b]) == bytes(buf[c:d]) for e, a, b, c, d in zip(exact, ends, ends[1:], at, at[1:])], bool)
                null = gone.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[x:y], lists, pa.array(np.diff(off), pa.int64(), mask=null), pa.array(exact, mask=null)], ["doc_id", "ids", "n_tokens", "exact"])

    return own.mapInArrow(K.tidy(run), T.StructType([own.schema["doc_id"], *T._parse_datatype_string("ids array<int>, n_tokens long, exact boolean").fields]))


def decoded(tokens: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of token ids; null ids give a null text."""
    own = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    sent = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, THREADS)
        for batch in batches:
            ids = batch.column("ids")
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            out, ends = codec.decode(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size, dtype=np.int64))))
            data = out.tobytes()
            texts = [None if n else data[a:b].decode("utf-8", "replace") for n, a, b in zip(ids.is_null().to_pylist(), ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return own.mapInArrow(K.tidy(run), T.StructType([own.schema["doc_id"], T.StructField("text", T.StringType())]))
