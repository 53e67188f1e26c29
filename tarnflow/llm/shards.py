"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order. Numbers are little-endian; a varint has seven bits a byte, low first.

    block*   zstd frame of entries, then 0x0A. An entry: varint shared, varint rest, varint size, the last `rest` bytes of
             the key (the first `shared` are those of the key before it), then `size` bytes of ids, four each.
    index    zstd frame of (key of 17 bytes, uint64 offset, uint32 bytes) for the first key of each block, then 0x0A
    bloom    uint8 number of hashes and the bits, then 0x0A
    footer   uint64 x 7: offsets and sizes of index and bloom, documents, ids, number of blocks; the magic, then 0x0A

A key is 0 for a null doc_id and 1 for any other, the number, biased to sort as bytes, and the hash of the text in the
same form, which orders repeated numbers. 0x0A ends each part because Spark's text writer puts it there: shards are
written by Spark's own committer, to any store it knows.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Memory, Pieces, slices
from .common import scratch, stored

MAGIC = b"TARNSST1"
FOOTER = struct.Struct("<7Q8s")
ENTRY = struct.Struct("<17sQI")
KEY = struct.Struct(">BQQ")
#: So many bytes of a key name the document; the Bloom filter holds these.
DOCUMENT = 9


def key_of(doc_id: int | None, order: int = 0) -> bytes:
    return KEY.pack(doc_id is not None, (doc_id or 0) + (1 << 63) if doc_id is not None else 0, order + (1 << 63))


def of_key(key: bytes) -> tuple[int | None, int]:
    """(doc_id, hash of the text) of a key."""
    known, biased, order = KEY.unpack(key)
    return biased - (1 << 63) if known else None, order - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[bytes], per_key: int = 10, hashes: int = 7) -> Bloom:
        bits = np.zeros(max(8, -(-len(keys) * per_key // 8)), np.uint8)
        out = cls(bits, hashes)
        for k in keys:
            for i in out.places(k):
                bits[i >> 3] |= 1 << (i & 7)
        return out

    def places(self, key: bytes) -> list[int]:
        h = xxhash.xxh128_intdigest(key)
        a, b = h >> 64, h & (1 << 64) - 1 | 1
        return [(a + i * b) % (len(self.bits) * 8) for i in range(self.hashes)]

    def may_hold(self, key: bytes) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self.places(key))


class ShardWriter:
    """Turns sorted (key, ids as bytes) into the parts of one shard, in order."""

    def __init__(self, block_bytes: int = 256 << 10):
        self.block_bytes = block_bytes
        self.zstd = zstandard.ZstdCompressor(1)
        self.at = self.ids = 0
        self.block: list[bytes] = []
        self.size = 0
        self.first = self.last = b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = b"".join((varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value))
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key[:DOCUMENT])
        self.ids += len(value) // 4
        if self.size >= self.block_bytes:
            yield self.flush()

    def flush(self) -> bytes:
        part = self.zstd.compress(b"".join(self.block))
        self.index.append((self.first, self.at, len(part)))
        self.at += len(part) + 1
        self.block, self.size = [], 0
        return part

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self.flush()
        index = self.zstd.compress(b"".join(ENTRY.pack(*x) for x in self.index))
        bloom = Bloom.of(list(dict.fromkeys(self.keys)))
        filter_ = bytes([bloom.hashes]) + bloom.bits.tobytes()
        yield index
        yield filter_
        yield FOOTER.pack(self.at, len(index), self.at + len(index) + 1, len(filter_), len(self.keys), self.ids, len(self.index), MAGIC)


class Shard:
    """A shard file's content: iteration in key order, and lookup by Bloom filter, sparse index and one block."""

    def __init__(self, content: bytes):
        self.content = content
        index_at, index_n, bloom_at, bloom_n, self.documents, self.ids, blocks, magic = FOOTER.unpack(content[-FOOTER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a shard: the footer's magic is missing")
        raw = self.opened(content[index_at : index_at + index_n])
        self.index = [ENTRY.unpack_from(raw, i * ENTRY.size) for i in range(blocks)]
        self.firsts = [k[:DOCUMENT] for k, _, _ in self.index]
        filter_ = content[bloom_at : bloom_at + bloom_n]
        self.bloom = Bloom(np.frombuffer(filter_, np.uint8)[1:], filter_[0])

    @staticmethod
    def opened(frame: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(frame)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, n = self.index[i]
        raw, at, key = self.opened(self.content[offset : offset + n]), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids stored under a doc_id, the first of repeated ones, or None."""
        key = key_of(doc_id)[:DOCUMENT]
        if not self.index or not self.bloom.may_hold(key):
            return None
        # The first entry stands in the last block that begins before it, or begins the next one.
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        return next((np.frombuffer(v, "<u4") for n in range(i, min(i + 2, len(self.index))) for k, v in self.block(n) if k[:DOCUMENT] == key), None)

    def range(self) -> tuple[bytes, bytes]:
        """The first and the last key."""
        return self.index[0][0], list(self.block(len(self.index) - 1))[-1][0]


class Tokens:
    """Texts to ids as bytes by the tokenizers library; each distinct piece of a slice is encoded once, recent ones are remembered.

    Pieces are cut where a byte-level pre-tokenizer always cuts, lone spaces; the library does the rest, so text that spells
    a special token becomes that token. Such a token must not reach over a space: ValueError otherwise.

    The library's answer for a piece is many times its ids (texts and places of tokens, masks), so `batch` pieces are
    asked for at a time.
    """

    def __init__(self, path: str, kept: int = 250_000, batch: int = 16_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        state = json.loads(self.tokenizer.to_str())
        if "ByteLevel" not in state["pre_tokenizer"].values():
            raise ValueError(f"{path} is not a byte-level tokenizer")
        if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in state["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on the spaces beside them")
        self.known, self.batch = Memory(kept), batch

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), self.batch):
            for e in self.tokenizer.encode_batch_fast(pieces[at : at + self.batch], add_special_tokens=False):
                ids = e.ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        pieces = Pieces(texts)
        return pieces.joined(self.known.all_of(pieces, self.encode_pieces), pa.binary(), b"")


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_bytes: int = 32_000_000, path: str | None = None) -> str:
    """Encodes every row's whole text, appends end_id, and writes shards of about shard_bytes bytes of text; gives the folder.

    docs has doc_id and text; null text is empty, a null doc_id comes first, repeated doc_ids keep every row (in the order
    of their texts' hashes, so that they may fill several shards). Key ranges are dealt by Spark's range partitioning, so
    each task writes one shard from one sorted range and holds a slice of it at a time. The tokenizer file must stand on
    every worker.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // shard_bytes))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer = tokens(tokenizer), ShardWriter()

        def parts(out: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["part"])

        for b in batches:
            for some in slices(b, "text", 4_000_000):
                out: list[bytes] = []
                for doc_id, order, value in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), coder.encode(some.column(2))):
                    out += writer.add(key_of(doc_id, order), value.as_py() + end)
                if out:
                    yield parts(out)
        if writer.keys:
            yield parts(list(writer.finish()))

    path = path or scratch(spark, "shards")
    keyed = source.select("doc_id", F.xxhash64("text").alias("order"), "text")
    ordered = keyed.repartitionByRange(parts, "doc_id", "order").sortWithinPartitions("doc_id", "order")
    ordered.mapInArrow(run, "part binary").select(F.col("part").cast("string").alias("value")).write.text(path)
    return path


def shard_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(first_key, doc_id, place, ids binary) of every document in the shards of a folder, place being its turn in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in opened(batches):
            for first, place, ids, values in shard_blocks(shard):
                yield pa.RecordBatch.from_pydict({"first_key": pa.array([first] * len(ids)), "doc_id": pa.array(ids, pa.int64()), "place": place, "ids": pa.array(values, pa.binary())})

    return shard_files(spark, path).select("content").mapInArrow(run, "first_key string, doc_id long, place long, ids binary")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for b in batches:
        for content in b.column(b.num_columns - 1):
            yield Shard(content.as_py())


def shard_blocks(shard: Shard) -> Iterator[tuple[str, pa.Array, list[int | None], list[bytes]]]:
    """(the shard's first key, places in the shard, doc_ids, values) of each block."""
    at = 0
    for i in range(len(shard.index)):
        keys, values = zip(*shard.block(i))
        yield shard.index[0][0].hex(), pa.array(np.arange(at, at + len(keys))), [of_key(k)[0] for k in keys], list(values)
        at += len(keys)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, first, last): the key range of each shard of a folder, from a table kept beside the shards; made if it is not there yet."""
    at = f"{path}/_ranges"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ranges = [Shard(c.as_py()).range() for c in b.column(1)]
                yield pa.RecordBatch.from_pydict({"path": b.column(0), "first": pa.array([x for x, _ in ranges], pa.binary()), "last": pa.array([x for _, x in ranges], pa.binary())})

        shard_files(spark, path).mapInArrow(run, "path string, first binary, last binary").write.parquet(at)
    return spark.read.schema("path string, first binary, last binary").parquet(at)


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids array) of the wanted documents that are there, the first of repeated ones; null asks for the null doc_id.

    Only shards whose key range holds a wanted key are opened; each is searched by its Bloom filter, its sparse index and
    one or two blocks.
    """
    wanted = list(dict.fromkeys(doc_ids))
    asked = spark.createDataFrame([(key_of(d)[:DOCUMENT],) for d in wanted], "k binary")
    ranges = manifest(spark, path)
    inside = (F.expr(f"substring(first, 1, {DOCUMENT})") <= asked["k"]) & (F.expr(f"substring(last, 1, {DOCUMENT})") >= asked["k"])
    paths = sorted(r.path for r in ranges.join(F.broadcast(asked), inside, "left_semi").select("path").collect())  # the asked keys are the caller's list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in opened(batches):
            found = [(d, ids.tolist()) for d in wanted if (ids := shard.get(d)) is not None]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in found], pa.int64()), "ids": pa.array([x for _, x in found], pa.list_(pa.int64()))})

    if not paths:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    return shard_files(spark, paths).select("content").mapInArrow(run, "doc_id long, ids array<long>").dropDuplicates(["doc_id"])


def shard_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a shard folder, read back from its files; none of an empty folder.

    start counts the ids of all documents before it. Running sums are taken inside each shard and over the shards'
    totals, of which there is one row a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in opened(batches):
            before = 0
            for first, _, ids, values in shard_blocks(shard):
                n = np.fromiter((len(x) // 4 for x in values), np.int64, len(values))
                inside = before + np.cumsum(n) - n
                before += int(n.sum())
                crc = pa.array([zlib.crc32(x) for x in values], pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {"first_key": pa.array([first] * len(ids)), "doc_id": pa.array(ids, pa.int64()), "inside": pa.array(inside), "n_tokens": pa.array(n), "ids_crc32": crc}
                )

    files = shard_files(spark, path).select("content")
    each = stored(files.mapInArrow(run, "first_key string, doc_id long, inside long, n_tokens long, ids_crc32 long"), "digests")
    totals = each.groupBy("first_key").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("first_key", (F.sum("total").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    return each.join(before, "first_key").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
