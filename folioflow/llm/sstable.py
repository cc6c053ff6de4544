"""Sorted-string-table shards of token ids: a file format, its writer as a Spark job, and lookup by binary search.

A shard holds documents in ascending order of their key (doc_id as eight bytes whose order is the order of the numbers):

    data block*   zstd of records: shared varint, unshared varint, value length varint, rest of key, value
    index         zstd of: per block its first key, offset, length, records
    Bloom filter  bit array over the keys
    footer        fixed size: offsets and lengths of index and filter, counts, smallest and largest key, magic

Keys within a block share prefixes with the record before; the first record of a block shares none. A reader opens the
footer, tests the filter, bisects the index and reads one block. Values are ids as little-endian unsigned 32-bit.

Shards are written beside each other under names of their own for each task attempt, so a task that runs again never
touches a file that another has finished; the table of shards (a Parquet table) names those that count. Documents are
range-partitioned by doc_id and text hash, so one repeated doc_id may cross shards. Null doc_ids sort first and are
kept under a key that sorts before all others. Null text is empty text. Repeated rows are kept, in the order of their text
hashes within a doc_id; an empty table makes no shards; other columns are not read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.common import new_path, small_batches, text_groups
from folioflow.llm.tokenize import CHARS, word_tokens

MAGIC = b"FFSST001"
_FOOTER = struct.Struct("<QQQQQQQ9s9s8s")
NULL_KEY = b"\x00" + bytes(8)
BLOCK_BYTES, SHARD_BYTES, BITS_A_KEY, PROBES = 64 << 10, 64 << 20, 10, 7
#: Bytes of text that a task encodes and writes.
PART_BYTES = 128 << 20
SHARDS = "part int, shard int, path string, n_docs long, n_ids long, n_bytes long, min_id long, max_id long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return NULL_KEY if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _probes(key: bytes, bits: int) -> list[int]:
    hashed = xxhash.xxh3_64_intdigest(key)
    one, two = hashed & 0xFFFFFFFF, hashed >> 32 | 1
    return [(one + i * two) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard to a binary stream; add() wants keys in ascending order."""

    def __init__(self, out: io.RawIOBase, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes = out, block_bytes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.block, self.n_block, self.first, self.last = bytearray(), 0, b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.n_ids = self.n_docs = 0
        self.least = b""

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = _shared(self.last, key) if self.n_block else 0
        if not self.n_block:
            self.first = key
        if not self.n_docs:
            self.least = key
        rest = key[shared:]
        self.block += _varint(shared) + _varint(len(rest)) + _varint(len(value)) + rest + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last, self.n_block, self.n_docs, self.n_ids = key, self.n_block + 1, self.n_docs + 1, self.n_ids + len(value) // 4
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.n_block:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.first, self.at, len(data), self.n_block))
            self._put(data)
            self.block, self.n_block = bytearray(), 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> int:
        """Bytes of the shard."""
        self._flush()
        index_at = self.at
        self._put(self.zip.compress(b"".join(k + struct.pack("<QQQ", *x) for k, *x in self.index)))
        bloom_at = self.at
        bits = max(64, BITS_A_KEY * len(self.keys))
        filled = np.zeros(bits, bool)
        for key in self.keys:
            filled[_probes(key, bits)] = True
        self._put(np.packbits(filled).tobytes())
        self._put(_FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, bits, self.n_docs, self.n_ids, self.least.ljust(9, b"\0"), self.last.ljust(9, b"\0"), MAGIC))
        return self.at


class ShardReader:
    """Reads one shard from a seekable binary stream."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.bits, self.n_docs, self.n_ids, self.least, self.most, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.unzip = zstandard.ZstdDecompressor()
        file.seek(index_at)
        data = self.unzip.decompress(file.read(index_len))
        self.index = [(data[i : i + 9], *struct.unpack_from("<QQQ", data, i + 9)) for i in range(0, len(data), 33)]
        file.seek(bloom_at)
        self.bloom = file.read(bloom_len)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, length, n = self.index[i]
        self.file.seek(at)
        data, pos, key = self.unzip.decompress(self.file.read(length)), 0, b""
        for _ in range(n):
            shared, pos = _read_varint(data, pos)
            unshared, pos = _read_varint(data, pos)
            size, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + unshared]
            pos += unshared
            yield key, data[pos : pos + size]
            pos += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & 0x80 >> (p & 7) for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that key."""
        key, found = key_of(doc_id), []
        if not self.index or not self.may_hold(key):
            return found
        firsts = [k for k, *_ in self.index]
        i = max(0, bisect_right(firsts, key) - 1)
        while i > 0 and firsts[i] == key:  # a repeated key may begin in a block before
            i -= 1
        while i < len(firsts) and firsts[i] <= key:
            found += [np.frombuffer(v, "<u4") for k, v in self.block(i) if k == key]
            i += 1
        return found


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def _write_part(folder: str, path: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _open_fs(folder)
        tokens, end = word_tokens(path), np.array([end_id], "<u4").tobytes()
        part, rows = TaskContext.get().partitionId(), []
        writer = out = name = None

        def close():
            nonlocal writer
            if writer:
                n = writer.close()
                out.close()
                rows.append((part, len(rows), name, writer.n_docs, writer.n_ids, n, id_of(writer.least), id_of(writer.last)))
                writer = None

        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_groups(batch.column(1), CHARS):
                for i, data in enumerate(tokens.encode(texts), first):
                    if not writer:
                        fs.create_dir(base, recursive=True)
                        name = f"{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.sst"
                        out = fs.open_output_stream(f"{base}/{name}")
                        writer = ShardWriter(out)
                    writer.add(key_of(ids[i].as_py()), data + end)
                    if writer.at >= shard_bytes:
                        close()
        close()
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SHARDS.split(", ")])

    return run


def write_shards(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 1, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> tuple[str, DataFrame]:
    """Encodes every document, writes the shards in ascending doc_id order and returns (folder, table of shards). There are
    spark.sql.shuffle.partitions tasks, or more where those would get over part_bytes of text each."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "sst")
    salt = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", salt.alias("_salt"))
    parts = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "_salt").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_salt")
    made = ordered.select("doc_id", "text").mapInArrow(_write_part(f"{folder}/data", path, end_id, shard_bytes), SHARDS)
    with small_batches(spark):
        made.write.parquet(f"{folder}/shards")
    return folder, spark.read.schema(SHARDS).parquet(f"{folder}/shards")


def _read_part(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/{name}") as file:
                    rows = []
                    for key, value in ShardReader(file, size):
                        rows.append((id_of(key), start, len(value) // 4, zlib.crc32(value)))
                        start += len(value) // 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return run


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    # ids before each shard: over the parts, then within the part; both hold a row for each shard or part only
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = parts.select("part", (F.sum("_ids").over(W.orderBy("part")) - F.col("_ids")).alias("_before"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    placed = shards.withColumn("_within", within).join(before, "part")
    files = placed.select("path", "n_bytes", (F.col("_before") + F.col("_within")).alias("start"))
    # a task for each shard: what they read is far more than what the rows that name them weigh
    return files.repartition(max(1, files.count()), "path").mapInArrow(_read_part(f"{folder}/data"), RECORDS)


def _look_up(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        for batch in batches:
            for name, size, doc_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/{name}") as file:
                    reader = ShardReader(file, size)
                    found = [(d, ids.astype(np.int64)) for d in doc_ids for ids in reader.get(d)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return run


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: prunes shards by key range, then filter, index and one block of each; shards are read
    beside each other."""
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    wanted = spark.createDataFrame([(d,) for d in doc_ids], "doc_id long")
    # a shard that starts with documents without an id has no min_id
    hits = shards.join(F.broadcast(wanted), (F.col("min_id").isNull() | (F.col("doc_id") >= F.col("min_id"))) & (F.col("doc_id") <= F.col("max_id")))
    files = hits.groupBy("path", "n_bytes").agg(F.collect_set("doc_id").alias("doc_ids"))
    return files.mapInArrow(_look_up(f"{folder}/data"), "doc_id long, ids array<long>")
