"""SimHash near-duplicates, with pivot distance tables as the filter before exact comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import slices
from .common import leaving_none, stored
from .components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
#: Shingles whose bits are counted at once: bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of word shingles, unsigned; 0 for null and for texts without words."""
    words = WORD.findall((text or "").translate(UPPER_TO_LOWER))
    if not words:
        return 0
    shingles = list(map(" ".join, zip(*(words[i:] for i in range(width))))) or [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles)))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", 2_000_000):
                fp = np.fromiter((fingerprint(t, width) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(leaving_none(run), "doc_id long, fp long")


def pivots(count: int = 24) -> list[int]:
    """Reference fingerprints, signed, from a fixed rule: the hashes of 0, 1, 2 ..."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), 7)).astype(np.int64)) for i in range(count)]


#: Five runs of bits: two fingerprints that differ in at most three bits agree on at least two of the runs.
RUNS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def linked_within(fp: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among fp. table: a row of pivot distances for each fingerprint.

    Rows are sorted by the first pivot's distance, so a row only meets those within `most` of it. A pair whose largest
    coordinate difference exceeds `most` cannot be a link (triangle inequality) and is discarded; survivors are verified
    by the distance itself.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + most, side="right")
    root = np.arange(len(fp))
    left, right = [], []
    for i in range(len(fp) - 1):
        j = np.arange(i + 1, ends[i])
        j = j[root[j] != root[i]]  # a pair that is connected already adds nothing to a forest
        for p in range(1, table.shape[1]):
            if not len(j):
                break
            j = j[np.abs(table[j, p] - table[i, p]) <= most]
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= most] if len(j) else j
        for k in j:
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                left.append(i)
                right.append(k)
    return order[np.array(left, int)], order[np.array(right, int)]


def pivot_links(nodes: DataFrame, most: int, block: int = 2048) -> DataFrame:
    """(a, b): a spanning forest of the links, of at most `most` bits, among nodes (fp, rep) that share two of the five runs of bits.

    At most three bits that differ leave two runs equal, so these links are all there; of wider ones only some are.
    """
    distances = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("short") for p in pivots()])
    pairs = [(i, j) for i in range(len(RUNS)) for j in range(i)]

    def bits(i: int, j: int) -> F.Column:
        mask = sum(((1 << n) - 1) << at for at, n in (RUNS[i], RUNS[j]))
        return F.col("fp").bitwiseAND(F.lit(int(np.uint64(mask).astype(np.int64))))

    keys = F.explode(F.array(*[F.struct(F.lit(n).cast("byte").alias("which"), bits(i, j).alias("bits")) for n, (i, j) in enumerate(pairs)]))
    placed = nodes.where("rep IS NOT NULL").select("fp", "rep", keys.alias("k")).select("k.*", "fp", "rep")
    crowded = placed.groupBy("which", "bits").agg(F.count("*").alias("n")).where("n > 1")
    met = placed.join(crowded, ["which", "bits"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        met.withColumn("mine", mine)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("which", "bits", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp", "rep", distances.alias("d"))
    )
    groups = dealt.groupBy("which", "bits", "lo", "hi").agg(F.collect_list(F.struct("fp", "rep", "d")).alias("members"))
    cols = groups.select(F.col("members.fp").alias("fp"), F.col("members.rep").alias("rep"), F.flatten("members.d").alias("d"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, z = [], []
            for fp, rep, d in zip(b["fp"], b["rep"], b["d"]):
                i, j = linked_within(np.asarray(fp).view(np.uint64), np.asarray(d).reshape(len(fp), -1).astype(np.int16), most)
                a.append(np.asarray(rep)[i])
                z.append(np.asarray(rep)[j])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(z)} if a else {"a": [], "b": []})

    return cols.mapInPandas(leaving_none(link), "a long, b long")


def near_groups(docs: DataFrame, most: int = 3, width: int = 3, block: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Documents link when their fingerprints differ in at most `most` (3 or fewer) bits; component_id is the smallest
    doc_id that can be reached. Null and wordless texts have the fingerprint zero and link like any other. Rows with a
    null doc_id get a component but never name one. Repeated rows stay repeated.

    Copies are collapsed before anything is compared: one row for each distinct fingerprint, with its pivot distances.
    Each goes to ten buckets (two of five runs of bits equal, which any link shares at least once), and buckets of one
    go no further. A bucket of more than `block` fingerprints is dealt over pairs of blocks, so no task holds more than
    two blocks, none is capped, and each returns a spanning forest of its links, not the pairs.
    """
    if most > 3:
        raise ValueError("runs of bits are laid out for at most three differing bits")
    each = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    links = pivot_links(nodes, most, block)
    found = components(links)
    named = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return each.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group; rows without a doc_id stay."""
    groups = near_groups(docs)
    lost = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti")
