"""Sorted-string-table shards of documents, keyed by identifier.

A shard is the bytes of a file: data blocks, a sparse index with each block's first key, a Bloom
filter over the keys, and a footer of fixed size that says where they are.  A block has entries
(shared prefix length, rest length, value length, rest of the key, value) with a restart, a whole
key, every ``RESTART`` entries, then the restarts' offsets; it is compressed and has a checksum.
Looking up a key asks the Bloom filter, searches the index, then one block's restarts.

``build`` range-partitions the documents by key into shards of about ``target`` bytes (the splitters
of ``sharding``), sorts within each, and streams its blocks: (shard_id, part, kind, offset, entries,
first_key, payload), whose payloads in the order of ``part`` are the file.  A task holds one block
at a time.  ``write`` stores the files, ``Table`` reads one, ``lookup`` finds keys in a built DataFrame.

Keys.  A null is 00; integers are 01 and 8 big-endian bytes with the sign bit flipped; texts
are 02 and UTF-8; so byte order is the order of Spark's ascending sort; dates and timestamps are their texts,
and keys of other types are refused when the plan is made.  Values hold the named columns: null, text, integer
up to 64 bits, double, boolean, binary or arrays of non-negative 32-bit integers such as token ids, little-endian.
Dates, timestamps and decimals are packed as their exact texts, maps, structs and other arrays as JSON.

Defined cases.  A null key is a key; equal keys keep all their entries, in the order of a hash of their
values, so that shards are the same bytes in every run, and a lookup gives all of them.  Null and empty values are told apart.  A value above the block size has a
block of its own.  An empty table gives no shard.  Columns not named are left out, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoria.llm import kernel as K
from mnemoria.llm.sharding import shard

BLOCK, RESTART, BLOOM_BITS, BLOOM_HASHES, LEVEL = 64 << 10, 16, 10, 7, 3
TARGET = 64 << 20
MAGIC = b"SSTSHRD1"
FOOTER = struct.Struct("<QQQQQII8s")  # index at, size, Bloom at, size, entries, hashes, blocks, magic
SCHEMA = "shard_id int, part int, kind string, offset long, entries long, first_key binary, payload binary"


def key_bytes(key) -> bytes:
    if key is None:
        return b"\0"
    if isinstance(key, int):
        return b"\1" + struct.pack(">Q", (key + (1 << 63)) & (2**64 - 1))
    return b"\2" + (key if isinstance(key, bytes) else key.encode())


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def pack(values) -> bytes:
    """The bytes of a record's values."""
    out = []
    for v in values:
        if v is None:
            out.append(b"\0")
        elif isinstance(v, str):
            x = v.encode("utf-8", "surrogatepass")
            out += [b"\1", varint(len(x)), x]
        elif isinstance(v, bool):
            out.append(b"\6" if v else b"\5")
        elif isinstance(v, int):
            out += [b"\2", struct.pack("<q", v)]
        elif isinstance(v, float):
            out += [b"\3", struct.pack("<d", v)]
        elif isinstance(v, (bytes, bytearray)):
            out += [b"\4", varint(len(v)), bytes(v)]
        else:
            x = np.asarray(v, "<u4").tobytes()
            out += [b"\7", varint(len(x)), x]
    return b"".join(out)


def unpack(data: bytes) -> list:
    out: list = []
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind in (0, 5, 6):
            out.append({0: None, 5: False, 6: True}[kind])
        elif kind in (2, 3):
            out.append(struct.unpack_from("<q" if kind == 2 else "<d", data, at)[0])
            at += 8
        else:
            n, at = read_varint(data, at)
            x, at = data[at : at + n], at + n
            out.append(x.decode("utf-8", "surrogatepass") if kind == 1 else np.frombuffer(x, "<u4").tolist() if kind == 7 else x)
    return out


def _key_hashes(keys: list[bytes]) -> np.ndarray:
    arr = pa.array(keys, pa.binary())
    buf, off = K.raw(arr)
    return K.span_hash(buf, off[:-1], off[1:])


def bloom(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8), bool)
    step = K.mix(hashes, 1) | K.U(1)
    for i in range(BLOOM_HASHES):
        bits[((hashes + K.U(i) * step) % K.U(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def maybe(data: bytes, key: bytes) -> bool:
    h = _key_hashes([key])
    step = K.mix(h, 1) | K.U(1)
    at = [int(((h + K.U(i) * step) % K.U(8 * len(data)))[0]) for i in range(BLOOM_HASHES)]
    return all(data[i >> 3] >> (i & 7) & 1 for i in at)


class Block:
    """A data block under construction."""

    def __init__(self):
        self.parts, self.size, self.count, self.restarts, self.last, self.first = [], 0, 0, [], b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        if not self.count:
            self.first = key
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.count += 1
        self.last = key

    def bytes(self) -> bytes:
        plain = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        data = zstandard.ZstdCompressor(level=LEVEL).compress(plain)
        return data + struct.pack("<I", zlib.crc32(data))


def open_block(data: bytes) -> tuple[bytes, list[int]]:
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block's checksum is wrong")
    plain = zstandard.ZstdDecompressor().decompress(data[:-4])
    n = struct.unpack("<I", plain[-4:])[0]
    return plain[: len(plain) - 4 - 4 * n], list(struct.unpack(f"<{n}I", plain[len(plain) - 4 - 4 * n : -4]))


def entries(plain: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    key = b""
    while at < len(plain):
        shared, at = read_varint(plain, at)
        rest, at = read_varint(plain, at)
        size, at = read_varint(plain, at)
        key = key[:shared] + plain[at : at + rest]
        at += rest
        yield key, plain[at : at + size]
        at += size


def seek(plain: bytes, restarts: list[int], key: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The entries from the last restart before key on."""
    lo, hi = 0, len(restarts) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if next(entries(plain, restarts[mid]))[0] < key:
            lo = mid
        else:
            hi = mid - 1
    return entries(plain, restarts[lo])


def _index(blocks: list[tuple[bytes, int, int]]) -> bytes:
    return b"".join(varint(len(k)) + k + varint(at) + varint(size) for k, at, size in blocks)


def read_index(data: bytes) -> list[tuple[bytes, int, int]]:
    out, at = [], 0
    while at < len(data):
        n, at = read_varint(data, at)
        key, at = data[at : at + n], at + n
        place, at = read_varint(data, at)
        size, at = read_varint(data, at)
        out.append((key, place, size))
    return out


class Writer:
    """Turns sorted (key, value) pairs into the parts of one shard: (kind, offset, entries, first key, payload)."""

    def __init__(self):
        self.block, self.blocks, self.at, self.hashes, self.count, self.keys = Block(), [], 0, [], 0, []

    def _flush(self) -> Iterator[tuple]:
        if self.block.count:
            data, b = self.block.bytes(), self.block
            self.blocks.append((b.first, self.at, len(data)))
            yield "data", self.at, b.count, b.first, data
            self.at += len(data)
            self.hashes.append(_key_hashes(self.keys))
            self.block, self.keys = Block(), []

    def add(self, key: bytes, value: bytes) -> Iterator[tuple]:
        if self.block.count and self.block.size + len(key) + len(value) > BLOCK:
            yield from self._flush()
        self.block.add(key, value)
        self.keys.append(key)
        self.count += 1

    def finish(self) -> Iterator[tuple]:
        yield from self._flush()
        if not self.count:
            return
        first, index_at = self.blocks[0][0], self.at
        index, filter_ = _index(self.blocks), bloom(np.concatenate(self.hashes))
        yield "index", self.at, len(self.blocks), first, index
        self.at += len(index)
        yield "bloom", self.at, self.count, first, filter_
        footer = FOOTER.pack(index_at, len(index), self.at, len(filter_), self.count, BLOOM_HASHES, len(self.blocks), MAGIC)
        self.at += len(filter_)
        yield "footer", self.at, self.count, first, footer


class Table:
    """One shard's bytes, open for reading."""

    def __init__(self, data: bytes):
        index_at, index_size, bloom_at, bloom_size, self.count, _, _, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.data, self.index = data, read_index(data[index_at : index_at + index_size])
        self.filter = data[bloom_at : bloom_at + bloom_size]

    def get(self, key) -> list[list]:
        """The values of every entry with this key."""
        k = key_bytes(key)
        if not maybe(self.filter, k):
            return []
        out = []
        at = max(0, bisect_left(self.index, k, key=lambda b: b[0]) - 1)
        for first, place, size in self.index[at:]:
            if first > k:
                break
            for x, v in seek(*open_block(self.data[place : place + size]), k):
                if x == k:
                    out.append(unpack(v))
                elif x > k:
                    return out
        return out

    def __iter__(self) -> Iterator[tuple[bytes, list]]:
        for _, place, size in self.index:
            for k, v in entries(open_block(self.data[place : place + size])[0]):
                yield k, unpack(v)


def _stream(names: list[str]):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard_id, part, rows, size = Writer(), None, 0, [], 0

        def note(new):
            nonlocal part, size
            for kind, at, n, first, data in new:
                rows.append((shard_id, part, kind, at, n, first, data))
                part += 1
                size += len(data)

        def batch_of():
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard_id", "part", "kind", "offset", "entries", "first_key", "payload"])
            rows, size = [], 0
            return out

        for batch in batches:
            keys, shards = batch.column("__key").to_pylist(), batch.column("__shard").to_pylist()
            values = zip(*(batch.column(f"__v{i}").to_pylist() for i in range(len(names)))) if names else iter([()] * len(keys))
            for key, s, value in zip(keys, shards, values):
                if s != shard_id:
                    note(writer.finish())
                    writer, shard_id, part = Writer(), s, 0
                note(writer.add(key_bytes(key), pack(value)))
                if size > 4 << 20:
                    yield batch_of()
        note(writer.finish())
        if rows:
            yield batch_of()

    return stream


def _packable(name: str, kind: T.DataType):
    """The column as a type that ``pack`` knows."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType, T.IntegralType)):
        return c
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    if isinstance(kind, T.NullType):
        return c.cast("string")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        return c.cast("string")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegralType):
        plain = F.coalesce(F.forall(c, lambda x: x.between(0, 2**32 - 1)), F.lit(True))
        return F.when(c.isNull() | plain, c.cast("array<long>")).otherwise(F.raise_error(F.lit(f"{name}: token ids are 32-bit and not null"))) if kind.containsNull or not isinstance(kind.elementType, T.ByteType) else c.cast("array<long>")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    raise TypeError(f"column {name} of type {kind.simpleString()} can't be packed")


def _key(name: str, kind: T.DataType):
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)):
        return F.col(f"`{name}`").cast("string")
    if isinstance(kind, (T.StringType, T.BinaryType, T.IntegralType)):
        return F.col(f"`{name}`")
    raise TypeError(f"key {name} of type {kind.simpleString()} has no byte order here; use an integer, text, binary, date or timestamp")


def build(docs: DataFrame, id_col: str = "doc_id", value_cols: list[str] | None = None, target: int = TARGET) -> DataFrame:
    """The parts of every shard, as SCHEMA."""
    names = value_cols if value_cols is not None else [c for c in docs.columns if c != id_col]
    own = docs.select(_key(id_col, docs.schema[id_col].dataType).alias("__key"), *[_packable(c, docs.schema[c].dataType).alias(f"__v{i}") for i, c in enumerate(names)])
    values = [f"__v{i}" for i in range(len(names))]
    sizes = [F.coalesce(F.octet_length(v), F.lit(0)) for v in values if own.schema[v].dataType.typeName() in ("string", "binary")]
    sizes += [4 * F.greatest(F.size(v), F.lit(0)) for v in values if own.schema[v].dataType.typeName() == "array"]
    own = own.withColumn("__bytes", sum(sizes, F.lit(0))).withColumn("__tie", F.xxhash64(*values) if values else F.lit(0))
    placed = shard(own, "__key", ["__key"], None, target, shard_col="__shard", size=F.col("__bytes")).drop("__bytes")
    return placed.sortWithinPartitions("__shard", "__key", "__tie").drop("__tie").mapInArrow(K.tidy(_stream(names)), SCHEMA)


def tables(parts: DataFrame, shard_ids: list[int] | None = None) -> Iterator[tuple[int, Table]]:
    """(shard id, Table) of the built shards, one at a time."""
    wanted = parts if shard_ids is None else parts.where(F.col("shard_id").isin(shard_ids))
    for i in sorted(r[0] for r in wanted.select("shard_id").distinct().collect()):
        yield i, Table(b"".join(r[0] for r in parts.where(F.col("shard_id") == i).orderBy("part").select("payload").toLocalIterator()))


def write(parts: DataFrame, path: str) -> None:
    """One file ``shard-<id>.sst`` for each shard, in a folder that all executors share."""

    def store(key, table):
        import os

        os.makedirs(path, exist_ok=True)
        name = f"{path}/shard-{key[0].as_py():06d}.sst"
        order = np.argsort(table["part"].to_numpy())
        with open(f"{name}.{os.getpid()}", "wb") as f:
            for i in order.tolist():
                f.write(table["payload"][i].as_py())
        os.replace(f"{name}.{os.getpid()}", name)  # a task that runs again replaces its own file whole
        return pa.table({"shard_id": pa.array([key[0].as_py()], pa.int32())})

    parts.groupBy("shard_id").applyInArrow(store, "shard_id int").count()


def lookup(parts: DataFrame, keys: list) -> dict:
    """key -> list of values, for keys in the shards.  The tasks ask each shard's filter and index, then search
    only the blocks in question; the driver gets the entries found."""
    wanted = {key_bytes(k): k for k in keys}
    found: dict = {k: [] for k in keys}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, index, filter_ in zip(batch.column("shard_id").to_pylist(), batch.column("index").to_pylist(), batch.column("bloom").to_pylist()):
                firsts, at = read_index(index), set()
                for k in wanted:
                    if firsts[0][0] <= k and maybe(filter_, k):
                        n = max(0, bisect_left(firsts, k, key=lambda b: b[0]) - 1)
                        while n < len(firsts) and firsts[n][0] <= k:
                            at.add(firsts[n][1])
                            n += 1
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(at), pa.int32()), pa.array(sorted(at), pa.int64())], ["shard_id", "offset"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(k, v) for data in batch.column("payload").to_pylist() for k, v in entries(open_block(data)[0]) if k in wanted]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*hits)], ["key", "value"])

    def of(kind: str):
        return F.max(F.when(F.col("kind") == kind, F.col("payload"))).alias(kind)

    heads = parts.where(F.col("kind").isin("index", "bloom")).groupBy("shard_id").agg(of("index"), of("bloom"))
    near = heads.mapInArrow(blocks, "shard_id int, offset long")
    data = parts.where("kind = 'data'").join(near, ["shard_id", "offset"]).select("payload")
    for k, v in data.mapInArrow(search, "key binary, value binary").toLocalIterator():
        found[wanted[bytes(k)]].append(unpack(bytes(v)))
    return found
