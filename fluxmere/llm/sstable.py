"""Sorted-string-table shards of token ids: format, writer, reader, and the operator.

File: data blocks, then index, Bloom filter and a fixed footer.

* block: entries ``shared | unshared | value size`` (varints), key suffix, value; every
  16th entry is a restart with a whole key; restart offsets and their number end the
  block; the block is zstd-compressed.
* index: for each block its last key, offset and size, themselves prefix-compressed.
* Bloom filter: 10 bits a key, 7 probes by double hashing.
* footer: offsets and sizes of both, entries, ids, bytes per id, magic.

Keys sort as bytes: null flag, sign-flipped big-endian identifier, and a running number
that keeps repeated identifiers apart.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"FLUXSST1"
FOOTER = struct.Struct("<QQQQQQI4x8s")
RESTART, BITS, PROBES = 16, 10, 7


def key_of(doc_id: int | None, run: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")) + run.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


class _Block:
    def __init__(self):
        self.out, self.restarts, self.last, self.count = bytearray(), [], b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.out))
        self.out += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1

    def finish(self) -> bytes:
        return bytes(self.out) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()


def _entries(block: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    n = int.from_bytes(block[-4:], "little")
    end, key = len(block) - 4 * (n + 1), b""
    while at < end:
        shared, at = _read_varint(block, at)
        fresh, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:shared] + block[at : at + fresh]
        at += fresh
        yield key, block[at : at + size]
        at += size


def _seek(block: bytes, key: bytes) -> bytes | None:
    """Binary search over the restarts, then a walk of at most RESTART entries."""
    n = int.from_bytes(block[-4:], "little")
    restarts = np.frombuffer(block[-4 * (n + 1) : -4], "<u4")
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if next(_entries(block, int(restarts[mid])))[0] <= key:
            lo = mid
        else:
            hi = mid - 1
    for k, v in _entries(block, int(restarts[lo])):
        if k >= key:
            return v if k == key else None
    return None


def _probes(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key[:9])
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % n_bits for i in range(PROBES)]


class Writer:
    """Writes entries in ascending key order to an open binary sink."""

    def __init__(self, sink, block_bytes: int = 65536, id_bytes: int = 2):
        self.sink, self.block_bytes, self.id_bytes = sink, block_bytes, id_bytes
        self.block, self.index, self.hashes = _Block(), _Block(), []
        self.at = self.entries = self.ids = 0
        self.press = zstandard.ZstdCompressor(level=1)

    def _flush(self) -> None:
        if self.block.count:
            data = self.press.compress(self.block.finish())
            self.sink.write(data)
            self.index.add(self.block.last, struct.pack("<QQ", self.at, len(data)))
            self.at += len(data)
            self.block = _Block()

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.id_bytes:
            raise OverflowError(f"id {int(ids.max())} doesn't fit {self.id_bytes} bytes")
        self.block.add(key, ids.astype(f"<u{self.id_bytes}").tobytes())
        self.hashes.append(key)
        self.entries += 1
        self.ids += len(ids)
        if len(self.block.out) >= self.block_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        n_bits = max(64, BITS * len(self.hashes))
        bits = np.zeros(n_bits, bool)
        for k in self.hashes:
            bits[_probes(k, n_bits)] = True
        index, bloom = self.index.finish(), np.packbits(bits).tobytes()
        self.sink.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), n_bits, self.entries, self.id_bytes, MAGIC))


class Reader:
    """Looks up and scans a shard; holds its index and filter and one block at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        i_at, i_size, b_at, b_size, self.n_bits, self.entries, self.id_bytes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string-table shard")
        source.seek(i_at)
        pairs = list(_entries(source.read(i_size)))
        self.last = [k for k, _ in pairs]
        self.blocks = [struct.unpack("<QQ", v) for _, v in pairs]
        source.seek(b_at)
        self.bloom = np.unpackbits(np.frombuffer(source.read(b_size), np.uint8))
        self.press = zstandard.ZstdDecompressor()

    def _block(self, i: int) -> bytes:
        at, size = self.blocks[i]
        self.source.seek(at)
        return self.press.decompress(self.source.read(size))

    def may_hold(self, key: bytes) -> bool:
        return bool(self.bloom[_probes(key, self.n_bits)].all())

    def get(self, key: bytes) -> np.ndarray | None:
        i = bisect_left(self.last, key)
        if i == len(self.last) or not self.may_hold(key):
            return None
        v = _seek(self._block(i), key)
        return None if v is None else np.frombuffer(v, f"<u{self.id_bytes}").astype(np.uint32)

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            for k, v in _entries(self._block(i)):
                yield k, np.frombuffer(v, f"<u{self.id_bytes}").astype(np.uint32)


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where, path


MANIFEST = "part int, shard int, path string, entries long, ids long"


def write_shards(docs: DataFrame, out: str, path: str | None = None, end_id: int | None = 1, shard_bytes: int = 64 << 20, id_bytes: int | None = None) -> DataFrame:
    """Encode whole texts and write them as shards in ascending ``doc_id`` order.

    Rows are range-partitioned by ``doc_id`` and sorted within partitions; each partition
    writes one shard after another, cut at ``shard_bytes`` of ids. A shard is written under
    a name of its own per attempt and moved into place whole, so that a retried or
    speculative task leaves the same file. Null ids come first, null texts are empty,
    repeated ids keep all their rows, ordered by text. An empty table gives no shards. Ids
    take 2 bytes each, or 4 if the vocabulary or ``end_id`` needs them; a given ``id_bytes``
    that an id doesn't fit raises. Returns the manifest: part, shard, path, entries, ids.
    """
    path = path or tokens.default_path()
    id_bytes = id_bytes or (2 if max(tokens.largest_id(path), end_id or 0) < 1 << 16 else 4)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, ctx = tokens.codec(path), TaskContext.get()
        part = ctx.partitionId()
        where, base = _open(out)
        where.create_dir(base, recursive=True)
        shard, sink, w, done = 0, None, None, []
        last, run = (), 0

        def close():
            nonlocal sink, w, shard
            w.close()
            sink.close()
            name = f"{base}/part-{part:06d}-{shard:04d}.sst"
            where.move(f"{name}.{ctx.taskAttemptId()}", name)
            done.append((part, shard, f"{out}/part-{part:06d}-{shard:04d}.sst", w.entries, w.ids))
            shard, sink, w = shard + 1, None, None

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in common.chunks(pc.binary_length(texts).to_pylist(), 16_000_000):
                flat, counts = codec.encode(texts.slice(a, b - a))
                at = 0
                for doc_id, n in zip(ids_of[a:b], counts.tolist()):
                    ids = flat[at : at + n] if end_id is None else np.append(flat[at : at + n], np.uint32(end_id))
                    at += n
                    run = run + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    if w is None:
                        sink = where.open_output_stream(f"{base}/part-{part:06d}-{shard:04d}.sst.{ctx.taskAttemptId()}")
                        w = Writer(sink, id_bytes=id_bytes)
                    w.add(key_of(doc_id, run), ids)
                    if w.ids * id_bytes >= shard_bytes:
                        close()
        if w is not None:
            close()
        cols = list(zip(*done)) or [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "shard", "path", "entries", "ids"])

    return common.id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32, in no given order.

    The manifest has a row per shard (64 MB of ids), so its running sum is one small window.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, path = _open(uri)
                with where.open_input_file(path) as source:
                    rows = []
                    for key, ids in Reader(source).scan():
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # as many tasks as shards: adaptive coalescing would see a tiny manifest and read all in one
    return manifest.select("path", before.alias("start")).repartition(max(1, manifest.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the ``doc_id`` values in ``wanted`` (first row of repeated ones), by binary search.

    Every shard is offered the whole of ``wanted``, which therefore must be a stated small
    set of identifiers (at most 100,000; more raise), and its filter turns most away unread.
    """
    ids = [r[0] for r in wanted.select("doc_id").distinct().limit(100_001).collect()]
    if len(ids) > 100_000:
        raise ValueError("look up at most 100,000 identifiers at once; join read_shards() for more")

    def find(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = _open(uri)
                with where.open_input_file(path) as source:
                    r = Reader(source)
                    got = [(i, x.astype(np.int64).tolist()) for i in ids if (x := r.get(key_of(i))) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(find, "doc_id long, ids array<long>")


def op10_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` encoded, written as sorted-string-table shards and read back."""
    out = common.work_path(spark, "sst")
    manifest = common.stored(write_shards(common.documents(spark, sf_dir), out), "sst-manifest")
    return read_shards(manifest)
