"""Importance resampling towards a target distribution, by hashed word runs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .numbering import numbered

#: ASCII as words see it: letters in lower case, digits, and spaces for all else. Bytes above are parts of letters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text that are cut into words at once: bounds memory for very long texts.
CHUNK = 1 << 20


def features(text: bytes, longest: int, buckets: int) -> Iterator[np.ndarray]:
    """The buckets of all runs of 1 to `longest` consecutive words, in parts of about a megabyte of text."""
    text = text.translate(WORD_BYTES)
    at, tail = 0, []
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        words = tail + text[at:end].split()
        hashes = list(map(crc32, words))
        for size in range(1, longest + 1):
            if size > 1:  # a run's hash goes on from that of the run without its last word
                hashes = list(map(crc32, words[size - 1 :], map(crc32, repeat(b" "), hashes)))
            new = hashes[max(0, len(tail) - size + 1) :]  # runs that end behind the words of the part before
            if new:
                yield np.fromiter(new, np.int64, len(new)) % buckets
        tail = words[len(words) - longest + 1 :] if longest > 1 else []
        at = end


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket is met in the column text: a vector for each partition, summed up a tree of executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for some in features(text.as_py() or b"", longest, buckets):
                    total += np.bincount(some, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = texts.select(F.col("text").cast("binary")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=3)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log of how much likelier it is in the target, in thousandths, floored; counts are smoothed by one."""
    n = len(raw)
    s, t = float(raw.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel draw in thousandths, floored, from the hash of seed and doc_id (null: as an empty text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs.

    Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII; features all runs of 1 to
    `longest` words, counted with repeats, hashed into `buckets`. A text's weight is the sum of its features' gains, its
    score adds a hashed Gumbel draw, and the highest floor(percent * N / 100) scores of the N texts with `least_words`
    words or more are drawn without replacement: they get rank 1, 2, 3 ..., ties to the smaller doc_id (null ids first).

    Null and empty texts have no features, weight 0 and are never drawn. Without documents the result is empty; an empty
    target leaves smoothed counts of one. Repeated rows are scored and ranked each. Other columns are ignored.

    Two passes read the texts and shuffle nothing: the first counts buckets, the second looks each feature's gain up. The
    vectors of counts have `buckets` entries whatever the corpus. Only ids and scores are sorted, over ranges.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value.astype(np.float64)
        for b in batches:
            counts, words, weights = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            held, held_rows, size = [], [], 0

            def settled() -> None:
                if held:
                    rows = np.repeat(np.array(held_rows), [len(x) for x in held])
                    counts[:] += np.bincount(rows, minlength=b.num_rows)
                    weights[:] += np.bincount(rows, gain[np.concatenate(held)], b.num_rows).astype(np.int64)
                    held.clear()
                    held_rows.clear()

            for i, text in enumerate(b.column(1)):
                for k, some in enumerate(features(text.as_py() or b"", longest, buckets)):
                    words[i] += len(some) if k % longest == 0 else 0
                    held.append(some)
                    held_rows.append(i)
                    size += len(some)
                    if size > CHUNK:
                        settled()
                        size = 0
            settled()
            score = weights + np.array([noise(d, seed) for d in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (counts, weights, score, words >= least_words))], ["doc_id", "n_features", "weight", "score", "able"])

    scored = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_features long, weight long, score long, able boolean"), "scores")
    able = scored.where("able").drop("able")
    drawn = percent * able.count() // 100
    ranks = numbered(able.withColumn("_all", F.lit(0)), "_all", [F.desc("score"), F.asc_nulls_first("doc_id")]).drop("_all")
    rank = F.col("number") + 1
    chosen = ranks.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return chosen.unionByName(scored.where("NOT able").drop("able").withColumn("rank", F.lit(None).cast("long")))


#: An unsigned CRC-32 in SQL: the table follows from its polynomial, and a fold over bytes looks it up.
CRC = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(blob: str) -> str:
    """The CRC-32 of a blob, for a query that has crc_table in its FROM."""
    octets = f"list_transform(range(octet_length({blob})), lambda j: ('0x' || substr(hex({blob}), CAST(2 * j + 1 AS INTEGER), 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE_SQL = rf"""
WITH {CRC},
 found AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
 each AS (SELECT doc_id, unnest(w) AS f FROM found),
 hashed AS (SELECT f, {crc_sql("encode(f)")} % 10000 AS bucket FROM (SELECT f FROM each UNION SELECT f FROM wanted), crc_table),
 raw AS (SELECT bucket, count(*) AS n FROM each JOIN hashed USING (f) GROUP BY 1),
 target AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (f) GROUP BY 1),
 gain AS (SELECT h.bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT sum(n) FROM raw)::DOUBLE + 10000) / ((coalesce(r.n, 0)::DOUBLE + 1) * ((SELECT sum(n) FROM target)::DOUBLE + 10000))))::BIGINT AS g
  FROM (SELECT DISTINCT bucket FROM hashed) h LEFT JOIN raw r USING (bucket) LEFT JOIN target t USING (bucket)),
 summed AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM each JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY 1),
 scored AS (SELECT found.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || found.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM found LEFT JOIN summed USING (doc_id)),
 ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
