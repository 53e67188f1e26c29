"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import slices
from .common import leaving_none, stored, text_or_empty

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def token_ids(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of `width` ids, from running sums."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * powers(BASE, len(ids)), dtype=np.uint64)])
    return (sums[width:] - sums[:n]) * powers(INVERSE, n)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def unmarked(free: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of which every token is free."""
    sums = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(sums[width:] == sums[: len(sums) - width])


def greedy_tiles(test: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in test, start in doc, length): the longest match of unmarked tokens is marked, again and again.

    Matches have `least` tokens or more and never overlap in either sequence. Ties go to the smallest start in test, then
    in doc. The search length starts at the longest that can match and halves while no match is found; every round
    hashes the unmarked windows of that length by running Karp-Rabin and verifies matches token by token.
    """
    tiles: list[tuple[int, int, int]] = []
    free_t, free_d = np.ones(len(test), bool), np.ones(len(doc), bool)
    length = min(len(test), len(doc))
    while length >= least and length > 0:
        best = 0
        found: list[tuple[int, int, int]] = []
        ht, hd = window_hashes(test, length), window_hashes(doc, length)
        open_t, open_d = unmarked(free_t, length), unmarked(free_d, length)
        common = np.isin(hd[open_d], ht[open_t])
        at: dict[int, list[int]] = {}
        for j in open_d[common]:
            at.setdefault(int(hd[j]), []).append(int(j))
        for i in open_t:
            for j in at.get(int(ht[i]), ()):
                k = 0
                while i + k < len(test) and j + k < len(doc) and free_t[i + k] and free_d[j + k] and test[i + k] == doc[j + k]:
                    k += 1
                if k >= length:
                    found.append((-k, int(i), j))
                    best = max(best, k)
        if best > length:  # a longer match exists: look for that length first
            found = [f for f in found if -f[0] == best]
        for k, i, j in sorted(found):
            k = -k
            if free_t[i : i + k].all() and free_d[j : j + k].all():
                free_t[i : i + k] = free_d[j : j + k] = False
                tiles.append((i, j, k))
        if not found:
            length = length // 2 if length // 2 > least else (least if length > least else 0)
    return tiles


def narrowed(doc: np.ndarray, seeds: np.ndarray, seed: int, reach: int) -> np.ndarray:
    """The tokens of doc within `reach` of a seed window; a sentinel stands between kept stretches so none joins across."""
    hit = np.flatnonzero(np.isin(window_hashes(doc, seed), seeds))
    if not len(hit):
        return np.empty(0, np.uint64)
    keep = np.zeros(len(doc) + 1, np.int64)
    np.add.at(keep, np.maximum(hit - reach, 0), 1)
    np.add.at(keep, np.minimum(hit + seed + reach, len(doc)), -1)
    inside = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
    cuts = np.flatnonzero(np.diff(inside) > 1) + 1
    return np.concatenate([np.append(x, np.uint64(0)) for x in np.split(doc[inside], cuts)])


class Index:
    """Benchmark rows by seed: the hash of every window of `seed` words, or the whole of a shorter text. Rows are numbered in the given order."""

    def __init__(self, texts: list[str | None], seed: int):
        self.seed = seed
        self.items = {i: ids for i, t in enumerate(texts) if len(ids := token_ids(words(t)))}
        pairs: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, t in self.items.items():
            width = min(seed, len(t))
            pairs.setdefault(width, []).append((window_hashes(t, width), i))
        self.by_width = {}
        for width, rows in pairs.items():
            h = np.concatenate([x for x, _ in rows])
            owner = np.concatenate([np.full(len(x), i, np.int64) for x, i in rows])
            order = np.argsort(h, kind="stable")
            self.by_width[width] = (h[order], owner[order])

    def candidates(self, doc: np.ndarray) -> dict[int, int]:
        """item -> seed width, for items that share a seed with doc."""
        out: dict[int, int] = {}
        for width, (h, owner) in self.by_width.items():
            mine = window_hashes(doc, width)
            first = np.minimum(np.searchsorted(h, mine), len(h) - 1)
            for x in np.unique(mine[h[first] == mine]):
                out.update(dict.fromkeys(owner[np.searchsorted(h, x) : np.searchsorted(h, x, "right")].tolist(), width))
        return out


def matches(doc: np.ndarray, index: Index, coverage: float) -> list[tuple[int, int, int, int]]:
    """(item, covered tokens, tokens, tiles) for items of which tiles cover enough."""
    out = []
    for item, width in sorted(index.candidates(doc).items()):
        test = index.items[item]
        if len(test) > index.seed:  # tiles start from a seed and reach no further than the item is long
            near = narrowed(doc, np.unique(window_hashes(test, width)), width, len(test))
        else:
            near = doc
        tiles = greedy_tiles(test, near, width)
        covered = sum(k for _, _, k in tiles)
        if covered >= coverage * len(test):
            out.append((item, covered, len(test), len(tiles)))
    return out


COLUMNS = {"doc_id": pa.int64(), "item_id": pa.int64(), "covered": pa.int64(), "n_tokens": pa.int64(), "n_tiles": pa.int64(), "coverage": pa.float64(), "th": pa.int64()}


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, seed: int, block_chars: int) -> DataFrame:
    """The rows of contaminated() with th, the hash of the document's text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = int(items.agg(F.sum(F.length("text"))).first()[0] or 0)
    blocks = max(1, -(-total * 2 // block_chars)) if total > block_chars else 1
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), F.col("text").cast("string").alias("text"))

    def scan(k: int) -> tuple[DataFrame, Broadcast]:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted({(r.item_id is not None, r.item_id or 0, r.text) for r in part.collect()})
        sent = spark.sparkContext.broadcast([(i if known else None, t) for known, i, t in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = [i for i, _ in sent.value]
            index = Index([t for _, t in sent.value], seed)
            vocabulary = sorted({w for _, t in sent.value for w in words(t)})
            known = {w: i + 1 for i, w in enumerate(vocabulary)}
            hashes = np.append(np.ones(1, np.uint64), token_ids(vocabulary))  # the first stands for any word that no item has
            for b in batches:
                for part in slices(b, "text", 2_000_000):
                    found = []
                    for doc_id, th, text in zip(*(c.to_pylist() for c in part.columns)):
                        ws = words(text)
                        tokens = hashes[np.fromiter(map(known.get, ws, repeat(0)), np.int64, len(ws))]
                        found += [(doc_id, ids[m[0]], *m[1:], m[1] / m[2], th) for m in matches(tokens, index, coverage)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), COLUMNS.values())], list(COLUMNS))

        return source.mapInArrow(leaving_none(run), "doc_id long, item_id long, covered long, n_tokens long, n_tiles long, coverage double, th long"), sent

    if blocks == 1:
        return scan(0)[0]
    out = None
    for k in range(blocks):  # one block at a time is collected and sent; its findings are written before the next
        found, sent = scan(k)
        found = stored(found, "leaks")
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, seed: int = 5, block_chars: int = 32_000_000) -> DataFrame:
    """(doc_id, item_id, covered, n_tokens, n_tiles, coverage) for each document that holds a benchmark item.

    Words are runs of \\w, lower-cased. A document and an item meet when they share a seed of `seed` words in a row (an
    item of fewer words is one seed). Their greedy tiles then cover a share of the item's words, wherever in the document
    the pieces stand and in whatever order; `coverage` or more is a leak. Null or wordless texts on either side match
    nothing. Repeated documents give one result row each. Every benchmark row counts: without an item_id it is reported
    under null, several texts under one item_id are looked for each, and a row that is repeated whole counts once.

    The benchmark is a stated query set: it is cut into blocks of at most `block_chars` characters, whatever its size,
    and only one block at a time is held by the driver and the workers; the documents are scanned whole for each block. A
    benchmark of ordinary size is one block. Documents are never shuffled.
    """
    return leaks(docs, benchmark, coverage, seed, block_chars).drop("th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, seed: int = 5, block_chars: int = 32_000_000) -> DataFrame:
    """The rows of docs that hold no benchmark item; all columns.

    Rows are told apart by doc_id and text: of several texts under one doc_id only those that leak go, and a leaking row
    without a doc_id goes too. Null and empty texts stay; repeated rows share their fate.
    """
    bad = leaks(docs, benchmark, coverage, seed, block_chars).select(F.col("doc_id").alias("_bad"), F.col("th").alias("_th")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["_th"])
    return docs.join(bad, same, "left_anti")
