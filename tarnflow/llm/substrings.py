"""Removal of repeated byte strings, with suffix arrays kept as a logarithmic family of levels.

A string of `length` bytes is repeated when it also starts earlier. Suffixes are indexed where content says so: the
window of `gram` bytes with the least hash inside a string is its anchor, the same one in every copy. Neighbouring
strings share an anchor, and a suffix stands for all of them: it is held as bytes, those from the anchor on, then those
before the anchor read backwards. A first round counts anchors by hash and leaves out those that stand alone, which no
other suffix can match. A suffix array is a run of the others in byte order. Each batch of texts gets one; it is
merge-scanned against the levels that are there, equal suffixes being whole repeats, and levels of like size merge.
Suffixes that meet another only in part, by common bytes before and behind the anchor that add up to a string, are
taken apart into their strings. Whatever is removed was compared byte by byte; hashes only decide who meets whom.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import slices
from .common import shuffle_parts, text_or_empty

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE_BITS = np.uint64(24)
#: So many bytes can be numbered in PLACE_BITS; longer texts are indexed in overlapping pieces.
PLACES = 1 << 24
NO_DOC = -(1 << 63)
#: A gram with more suffixes than this in one task is common: they are not held but taken apart into strings at once.
COMMON = 4096


def suffix_type(length: int, gram: int) -> np.dtype:
    """Of a suffix: its bytes (behind the anchor, then before it backwards, both padded; how many of each), where its
    first string starts, and how many further strings, one byte on each, it stands for."""
    return np.dtype([("key", f"S{2 * length - gram + 2}"), ("doc", "<i8"), ("tie", "<i4"), ("lo", "<i8"), ("span", "u1")])


def string_type(length: int) -> np.dtype:
    """Of a single string: its bytes and where it starts."""
    return np.dtype([("key", f"S{length}"), ("doc", "<i8"), ("tie", "<i4"), ("lo", "<i8"), ("span", "u1")])


#: An anchor: the hash of its gram, and the strings that have it: where the first starts, how many follow, how far on it stands.
ANCHOR = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tie", "<i4"), ("lo", "<i8"), ("span", "u1"), ("off", "u1")])


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads the sums' weak low bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(keys: np.ndarray) -> np.ndarray:
    """Keys as a matrix of bytes."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), keys.dtype.itemsize)


def anchors(texts: list[bytes], docs: np.ndarray, ties: np.ndarray, length: int, gram: int, most: int = PLACES) -> np.ndarray:
    """The anchors of all strings of some texts.

    Texts of over `most` bytes (at most PLACES) together are taken one by one, and a longer one in pieces that overlap by length - 1 bytes.
    """
    if sum(map(len, texts)) <= most:
        return anchors_at_once(texts, docs, ties, length, gram)
    out = [np.empty(0, ANCHOR)]
    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, most - length + 1):
            rows = anchors_at_once([text[at : at + most]], docs[k : k + 1], ties[k : k + 1], length, gram)
            rows["lo"] += at
            out.append(rows)
    return np.concatenate(out)


def anchors_at_once(texts: list[bytes], docs: np.ndarray, ties: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchors of texts that have PLACES bytes at most together."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(n)
    total = int(n.sum())
    if total < length:
        return np.empty(0, ANCHOR)
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = 1 << max(16, total.bit_length())
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(int(BASE), size)[:total], out=sums[1:])
    grams, width = total - gram + 1, length - gram + 1
    h = mixed((sums[gram:] - sums[:grams]) * powers(int(INVERSE), size)[:grams])
    del sums
    low = (h >> PLACE_BITS << PLACE_BITS) | np.arange(grams, dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    anchor = (low & np.uint64(PLACES - 1)).astype(np.int64)
    del low
    doc = np.repeat(np.arange(len(texts)), n)[: len(anchor)]
    strings = np.flatnonzero(np.arange(len(anchor)) + length <= end[doc])
    if not len(strings):
        return np.empty(0, ANCHOR)
    anchor, doc = anchor[strings], doc[strings]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    lo, hi = strings[new], strings[np.append(new[1:], len(strings)) - 1]
    anchor, doc = anchor[new], doc[new]
    out = np.empty(len(new), ANCHOR)
    out["key"], out["doc"], out["tie"] = h[anchor], docs[doc], ties[doc]
    out["lo"], out["span"], out["off"] = lo - (end - n)[doc], hi - lo, anchor - lo
    return out


def suffixes(texts: list[bytes], docs: np.ndarray, ties: np.ndarray, places: list[np.ndarray], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes of some anchors of each text, a hash of each one's gram). places has an anchor's lo, off and span in one number."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in places])
    where = np.concatenate([np.empty(0, np.int64), *places])
    lo, off, span = where >> 16, where >> 8 & 255, where & 255
    before, joined = length - gram, b"".join(texts)
    anchor = (np.cumsum(n) - n)[doc] + lo + off
    padded = np.concatenate([np.zeros(before, np.uint8), np.frombuffer(joined, np.uint8), np.zeros(length, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, before + length)[anchor]
    key = np.empty((len(where), before + length + 2), np.uint8)
    key[:, -2], key[:, -1] = off, span + length - off
    key[:, :length] = around[:, before:]
    key[:, length:-2] = around[:, :before][:, ::-1]
    key[:, :length][np.arange(length) >= key[:, -1:]] = 0
    key[:, length:-2][np.arange(before) >= key[:, -2:-1]] = 0
    out = np.empty(len(where), suffix_type(length, gram))
    out["key"] = key.view(f"S{key.shape[1]}")[:, 0]
    out["doc"], out["tie"], out["lo"], out["span"] = docs[doc], ties[doc], lo, span
    digest = xxhash.xxh3_64_intdigest
    return out, np.fromiter((digest(joined[i : i + gram]) for i in anchor.tolist()), np.uint64, len(where))


def apart(rows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The single strings that suffixes stand for."""
    before, keys = length - gram, bytes_of(rows["key"])
    around = np.concatenate([keys[:, length:-2][:, ::-1], keys[:, :length]], axis=1).reshape(-1)
    n = rows["span"].astype(np.int64) + 1
    which = np.repeat(np.arange(len(rows)), n)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(which), string_type(length))
    if len(which):
        at = which * (before + length) + before - keys[which, -2] + turn
        out["key"] = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(around, length)[at]).view(f"S{length}")[:, 0]
    out["doc"], out["tie"], out["lo"] = rows["doc"][which], rows["tie"][which], rows["lo"][which] + turn
    return out


ZIP = zstandard.ZstdCompressor(1)
UNZIP = zstandard.ZstdDecompressor()


def packed(rows: np.ndarray) -> bytes:
    return ZIP.compress(b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names))


def unpacked(raw: bytes, kind: np.dtype) -> np.ndarray:
    raw = UNZIP.decompress(raw)
    n = len(raw) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for name in kind.names:
        out[name] = np.frombuffer(raw, kind[name], n, at)
        at += n * kind[name].itemsize
    return out


def settled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest of the rows with one key, in key order; the others)."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    same = rows["key"][1:] == rows["key"][:-1]
    if not same.any():
        return rows, rows[:0]
    group = np.cumsum(np.append(True, ~same))
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    part = rows[tied]
    rows[tied] = part[np.lexsort((part["lo"], part["tie"], part["doc"], group[tied]))]
    again = np.append(False, same)
    return rows[~again], rows[again]


class Family:
    """Suffix arrays in levels, each more than twice as long as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> list[np.ndarray]:
        """Takes a batch; gives the rows that turn out to repeat an earlier one."""
        run, lost = settled(batch)
        repeats = [lost]
        for i, level in enumerate(self.levels):
            if not len(run):
                break
            at = np.minimum(np.searchsorted(level["key"], run["key"]), len(level) - 1)
            hit = np.flatnonzero(level["key"][at] == run["key"])
            if len(hit):
                there, new = level[at[hit]], run[hit]
                first = earlier(new, there)
                level[at[hit[first]]] = new[first]
                repeats += [there[first], new[~first]]
                run = np.delete(run, hit)
        while self.levels and len(self.levels[-1]) <= 2 * len(run):
            both = np.concatenate([self.levels.pop(), run])
            run = both[np.argsort(both["key"], kind="stable")]
        if len(run):
            self.levels.append(run)
        return repeats

    def taken(self) -> np.ndarray | None:
        """All rows as one suffix array; the family is empty then."""
        rows = np.concatenate(self.levels) if self.levels else None
        self.levels = []
        return rows if rows is None else rows[np.argsort(rows["key"], kind="stable")]


def earlier(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a start before those of b."""
    same_doc = a["doc"] == b["doc"]
    same_tie = same_doc & (a["tie"] == b["tie"])
    return (a["doc"] < b["doc"]) | same_doc & (a["tie"] < b["tie"]) | same_tie & (a["lo"] < b["lo"])


def common_bytes(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with the row before or behind it, whichever is more."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = np.empty((len(rows) - 1, rows.shape[1] + 1), bool)
    differ[:, -1] = True
    np.not_equal(rows[1:], rows[:-1], out=differ[:, :-1])
    n = differ.argmax(1)
    return np.maximum(np.append(n, 0), np.append(0, n))


def met_in_part(rows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which suffixes of a suffix array may share a string with another: the most common bytes behind the anchor, seen
    beside them in byte order, and the most before it, seen beside them in the order of those, add up to a string."""
    keys = bytes_of(rows["key"])
    behind = common_bytes(keys[:, :length])
    some = np.flatnonzero(behind >= gram)
    way_back = np.ascontiguousarray(np.concatenate([keys[some][:, :gram], keys[some][:, length:-2]], axis=1))
    order = np.argsort(way_back.view(f"S{way_back.shape[1]}")[:, 0], kind="stable") if len(some) else some
    before = np.empty(len(some), np.int64)
    before[order] = common_bytes(way_back[order]) - gram
    out = np.zeros(len(rows), bool)
    out[some] = np.maximum(before, 0) + behind[some] >= length
    return out


def crowded(rows: np.ndarray, gram: int, most: int) -> np.ndarray:
    """The grams that more than `most` rows of a suffix array begin with."""
    head = np.ascontiguousarray(bytes_of(rows["key"])[:, :gram])
    same = (head[1:] == head[:-1]).all(1)
    start = np.flatnonzero(np.append(True, ~same)) if len(rows) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(rows)))
    return head[start[n > most]].view(f"S{gram}")[:, 0]


class Bucket:
    """What one task knows of the suffixes whose anchors it owns."""

    def __init__(self, length: int, gram: int, common: int):
        self.length, self.gram, self.most = length, gram, common
        self.family = Family()
        self.common = np.empty(0, f"S{gram}")

    def heads(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(bytes_of(rows["key"])[:, : self.gram]).view(f"S{self.gram}")[:, 0]

    def add(self, batch: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(repeats, single strings to be compared further)."""
        out = []
        if len(self.common):
            is_common = np.isin(self.heads(batch), self.common)
            out.append(apart(batch[is_common], self.length, self.gram))
            batch = batch[~is_common]
        repeats = self.family.add(batch)
        if self.family.levels:
            # Only a level that was just made can have become crowded; a gram that is spread over levels is found at their merge.
            found = crowded(self.family.levels[-1], self.gram, self.most)
            if len(found):
                self.common = np.concatenate([self.common, found])
                for i, level in enumerate(self.family.levels):
                    is_common = np.isin(self.heads(level), found)
                    out.append(apart(level[is_common], self.length, self.gram))
                    self.family.levels[i] = level[~is_common]
                self.family.levels = [x for x in self.family.levels if len(x)]
        return repeats, out

    def rest(self, at_once: int = 4096) -> Iterator[np.ndarray]:
        """Repeats among the single strings of suffixes that others meet in part; these share a gram, so they are all here."""
        rows = self.family.taken()
        if rows is None:
            return
        some = rows[met_in_part(rows, self.length, self.gram)]
        head = self.heads(some)
        start = np.flatnonzero(np.append(True, head[1:] != head[:-1])) if len(some) else np.empty(0, np.int64)
        turn = (np.append(start[1:], len(some)) - 1) // at_once  # whole grams, about at_once suffixes a time
        cuts = start[np.flatnonzero(np.append(False, turn[1:] != turn[:-1]))] if len(start) else start
        for part in np.split(some, cuts):
            yield settled(apart(part, self.length, self.gram))[1]


#: A place in a document: of an anchor, or of a repeat.
PLACE = np.dtype([("doc", "<i8"), ("tie", "<i4"), ("at", "<i8")])
SENT = "bucket int, rows binary, places binary"
NAMES = ["bucket", "rows", "places"]


def sent(rows: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle, a packed run for each bucket; places go into a column of their own."""
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    start = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    columns = [pa.array([packed(x) for x in np.split(rows, start[1:])], pa.binary()), pa.nulls(len(start), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(to[start].astype(np.int32)), *(columns[::-1] if rows.dtype == PLACE else columns)], NAMES)


def placed(rows: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Places for the shuffle, to the bucket of their document."""
    if len(rows):
        out = np.empty(len(rows), PLACE)
        out["doc"], out["tie"], out["at"] = rows["doc"], rows["tie"], at
        yield sent(out, (mixed(rows["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))


def runs(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The packed runs of a batch."""
    return (raw.as_py() for raw in batch.column(1) if raw.is_valid)


def known(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The places of a batch, which only pass through."""
    return batch.filter(batch.column(2).is_valid())


def met(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors that do not stand alone: lo, off and span in one number."""
    yield from placed(rows, rows["lo"] << 16 | rows["off"].astype(np.int64) << 8 | rows["span"], buckets)


class Told:
    """Repeats on their way to the buckets of their documents, many at a time: the places of their first strings and, in
    the last byte, how many more follow."""

    def __init__(self, buckets: int, at_once: int = 500_000):
        self.buckets, self.at_once = buckets, at_once
        self.rows: list[np.ndarray] = []
        self.n = 0

    def add(self, *repeats: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in repeats:
            if len(x):
                out = np.empty(len(x), PLACE)
                out["doc"], out["tie"], out["at"] = x["doc"], x["tie"], x["lo"] << 8 | x["span"]
                self.rows.append(out)
                self.n += len(x)
        if self.n >= self.at_once:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            rows = np.concatenate(self.rows)
            self.rows, self.n = [], 0
            yield from placed(rows, rows["at"], self.buckets)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, places) for each document of a bucket."""
    rows = [np.empty(0, PLACE), *[unpacked(raw.as_py(), PLACE) for b in batches for raw in b.column(2)]]
    rows = np.concatenate(rows)
    rows = rows[np.lexsort((rows["tie"], rows["doc"]))]
    start = np.flatnonzero(np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]))) if len(rows) else np.empty(0, np.int64)
    end = np.append(start[1:], len(rows))
    for at in range(0, len(start), 1000):
        i, j = start[at : at + 1000], end[at : at + 1000]
        lists = pa.ListArray.from_arrays(pa.array(np.append(i, j[-1]) - i[0], pa.int32()), pa.array(rows["at"][i[0] : j[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc"][i]), pa.array(rows["tie"][i]), lists], ["doc", "tie", "places"])


def to_buckets(strings: list[np.ndarray], buckets: int, told: Told) -> Iterator[pa.RecordBatch]:
    """Single strings for the shuffle; of those that are equal here only the earliest goes on."""
    if any(map(len, strings)):
        kept, lost = settled(np.concatenate(strings))
        yield from told.add(lost)
        digest = xxhash.xxh3_64_intdigest
        yield sent(kept, np.fromiter((digest(k) % buckets for k in kept["key"].tolist()), np.int64, len(kept)))


def alone(rows: np.ndarray) -> np.ndarray:
    """Which anchors have a hash of their own."""
    _, back, n = np.unique(rows["key"], return_inverse=True, return_counts=True)
    return n[back] == 1


def without_repeats(
    docs: DataFrame, length: int = 100, gram: int = 40, slice_bytes: int = 3_000_000, bucket_bytes: int = 64_000_000, common: int = COMMON
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text binary) for every row.

    Each text is its UTF-8 bytes; null is empty. A byte is removed when a string of `length` bytes that covers it also
    starts earlier: in a smaller doc_id, or before it in the same document. Strings never cross documents and are judged
    on the input. Texts shorter than `length` lose nothing. A null doc_id comes before all others. Rows that repeat
    doc_id and text are one document, and each gets its result; different texts under one doc_id are ordered by their
    MD5.

    Texts are read in slices of about slice_bytes (a longer text is one slice, indexed in pieces of that size). A task
    owns the anchors of one bucket, about bucket_bytes of them or of their suffixes, and is handed them a packed run at
    a time. What is equal within a slice is sent once, so copies of one text are not gathered anywhere. Suffixes of a
    gram that more than `common` of them share in a bucket go on as single strings, dealt by their own hashes, so that
    a very frequent line with different surroundings fills no task's memory.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", text_or_empty().alias("text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), "text"
    )
    size = int(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    key = ["doc"]
    if source.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        keyed = source.withColumn("tie", F.lit(0))
    else:
        key = ["doc", "tie"]
        keyed = source.withColumn("tie", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.md5("text"))) - 1)
    kind = suffix_type(length, gram)
    most = min(max(slice_bytes, 2 * length), PLACES)
    buckets = max(shuffle_parts(spark), -(-size * 2 * kind.itemsize // ((length - gram) * bucket_bytes)))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", slice_bytes):
                texts = part.column(2).cast(pa.binary()).to_pylist()
                rows = anchors(texts, part.column(0).to_numpy(), part.column(1).to_numpy(), length, gram, most)
                if len(rows):
                    rows = rows[np.argsort(rows["key"], kind="stable")]
                    first = np.append(True, rows["key"][1:] != rows["key"][:-1])
                    yield from met(rows[~(first & np.append(first[1:], True))], buckets)
                    yield sent(rows[first], (rows["key"][first] % np.uint64(buckets)).astype(np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.empty(0, ANCHOR)]
        for b in batches:
            yield known(b)
            rows += [unpacked(raw, ANCHOR) for raw in runs(b)]
        rows = np.concatenate(rows)
        yield from met(rows[~alone(rows)], buckets)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told(buckets)
        for b in batches:
            for part in slices(b, "text", slice_bytes):
                ids, ties, texts = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).cast(pa.binary()).to_pylist()
                places = [np.unique(x.values.to_numpy()) for x in part.column(3)]
                rows, h = suffixes(texts, ids, ties, places, length, gram)
                for at in range(0, len(rows), 100_000):
                    some, to = rows[at : at + 100_000], h[at : at + 100_000] % np.uint64(buckets)
                    order = np.argsort(some["key"], kind="stable")
                    same = some["key"][order][1:] == some["key"][order][:-1]
                    kept, lost = settled(some[order])
                    yield from told.add(lost)
                    yield sent(kept, to[order][np.append(True, ~same)].astype(np.int64))
        yield from told.rest()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, told, strings = Bucket(length, gram, common), Told(buckets), []
        for b in batches:
            yield known(b)
            for raw in runs(b):
                repeats, more = bucket.add(unpacked(raw, kind))
                yield from told.add(*repeats)
                strings += more
                if sum(map(len, strings)) >= 200_000:
                    yield from to_buckets(strings, buckets, told)
                    strings = []
        yield from to_buckets(strings, buckets, told)
        for x in bucket.rest():
            yield from told.add(x)
        yield from told.rest()

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, told = Family(), Told(buckets)
        for b in batches:
            yield known(b)
            for raw in runs(b):
                yield from told.add(*family.add(unpacked(raw, string_type(length))))
        yield from told.rest()

    def dealt(rows: DataFrame) -> DataFrame:
        """Packed runs go to their bucket's task; places go along, to that of their document."""
        return rows.repartitionById(buckets, F.col("bucket"))

    def listed(rows: DataFrame) -> DataFrame:
        return dealt(rows).mapInArrow(gathered, "doc long, tie int, places array<long>").select(*key, "places")

    # One plan without stored tables in between: the texts are shuffled once, and both joins read that exchange
    # (each takes all its columns, or there would be two exchanges).
    at_home = keyed.repartition(shuffle_parts(spark), *key)
    shared = listed(dealt(keyed.select("doc", "tie", "text").mapInArrow(anchored, SENT)).mapInArrow(counted, SENT))
    suffix_runs = at_home.join(shared, key).select("doc", "tie", "text", "places", "doc_id").mapInArrow(indexed, SENT)
    found = listed(dealt(dealt(suffix_runs).mapInArrow(compared, SENT)).mapInArrow(single, SENT))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        for b in batches:
            for part in slices(b, "text", slice_bytes):
                out = [kept(t.as_py().encode(), None if s.values is None else s.values.to_numpy(), length) for t, s in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    return at_home.join(found, key, "left").select("doc_id", "text", "places", "doc", "tie").mapInArrow(cut, schema)


def kept(text: bytes, marks: np.ndarray | None, length: int) -> tuple[int, int, int, str, bytes]:
    if marks is None or not len(marks):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), text
    x = np.asarray(marks, np.int64)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, x >> 8, 1)
    np.add.at(change, (x >> 8) + (x & 255) + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest
