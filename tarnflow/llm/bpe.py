"""Byte-level BPE: encoding and decoding as DuckDB queries inside each partition."""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Columns, Pieces, gathered, listed, slices
from .common import KEPT, lean, leaving_none

#: Each step joins the token positions of all unfinished words with the merge table and contracts every word's leftmost
#: pair of least rank. A word without a mergeable pair comes out once more with done set, which ends it.
ENCODE = """
WITH RECURSIVE s(done, w, toks) AS (
  SELECT false, w, toks FROM words
  UNION ALL
  (WITH p AS (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS i FROM s WHERE NOT done),
   least AS (SELECT w, min(m.id::BIGINT * 65536 + i) AS x FROM p JOIN merges m ON m.l = p.l AND m.r = p.r GROUP BY w)
   SELECT x IS NULL, s.w, CASE WHEN x IS NULL THEN toks ELSE toks[:x % 65536 - 1] || [(x // 65536)::INTEGER] || toks[x % 65536 + 2:] END
   FROM s LEFT JOIN least USING (w) WHERE NOT s.done))
SELECT w, array_to_string(toks, ' ') AS ids FROM s WHERE done ORDER BY w
"""
#: The same for long words, as rows (token, next token, its position) so that a step costs no copy of the word. It merges
#: all pairs of the least rank, left to right, where that gives the same result: merges.alone marks tokens that can join a neighbour at a lower rank than their own, and those are merged
#: one at a time. Of a run of one repeated token every other pair is taken (its tokens are equally long).
ENCODE_LONG = """
WITH RECURSIVE r(done, w, pos, np, tok, nx) AS (
  SELECT false, w, pos, pos + 1, tok, nx FROM word_tokens
  UNION ALL
  (WITH j AS MATERIALIZED (
     SELECT r.w, r.pos, r.np, r.tok, r.nx, m.id, m.alone FROM r LEFT JOIN merges m ON m.l = r.tok AND m.r = r.nx WHERE NOT r.done),
   least AS (SELECT w, min(id) AS id FROM j WHERE id IS NOT NULL GROUP BY w),
   met AS (
     SELECT j.w, j.pos, j.np, j.id, j.alone, j.tok = j.nx AS twin, j.np - j.pos AS width, min(j.pos) OVER (PARTITION BY j.w) AS first_pos,
            CASE WHEN lag(j.np) OVER in_word IS DISTINCT FROM j.pos THEN j.pos END AS run_start
     FROM j JOIN least USING (w, id) WINDOW in_word AS (PARTITION BY j.w ORDER BY j.pos)),
   run AS (SELECT *, max(run_start) OVER (PARTITION BY w ORDER BY pos) AS start_pos FROM met),
   d AS MATERIALIZED (
     SELECT run.w, run.pos AS p, run.np AS q, run.id, j.nx AS q_nx, j.np AS q_np FROM run JOIN j ON j.w = run.w AND j.pos = run.np
     WHERE CASE WHEN run.alone THEN run.pos = run.first_pos WHEN run.twin THEN ((run.pos - run.start_pos) // run.width) % 2 = 0 ELSE true END),
   k AS (
     SELECT j.w, j.pos, coalesce(d.q_np, j.np) AS np, coalesce(d.id, j.tok) AS tok, least.w IS NULL AS done
     FROM j LEFT JOIN d ON d.w = j.w AND d.p = j.pos LEFT JOIN d gone ON gone.w = j.w AND gone.q = j.pos LEFT JOIN least ON least.w = j.w
     WHERE gone.w IS NULL)
   SELECT done, w, pos, np, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) FROM k))
SELECT w, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids FROM r WHERE done GROUP BY w ORDER BY w
"""
#: Words of more bytes than this are long.
SHORT = 64
#: Bytes are carried as the code points 0 to 255, since a token need not be whole UTF-8. One thread keeps the rows' order.
DECODE = """
SELECT d, string_agg(chars, '') AS chars
FROM (SELECT t.d, v.chars FROM coded t JOIN vocabulary v ON v.id = t.tok ORDER BY t.pos) GROUP BY d
"""


class Coder:
    """A rank file loaded into an in-memory DuckDB; a worker process keeps one and a bounded memory of words."""

    def __init__(self, path: str, pattern: str, kept: int = 9_000_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        splits = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, made = (pa.array(x, pa.int32()) for x in zip(*splits))
        early = {part for left, right, rank in splits for part in (left, right) if rank < part}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": tempfile.mkdtemp(prefix="duckdb-")})
        for name, columns in (
            ("merges", {"l": l, "r": r, "id": made, "alone": pa.array(np.isin(made, list(early)))}),
            ("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in ranks])}),
        ):
            self.db.register("loaded", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
        self.db.unregister("loaded")
        self.known = Columns(kept, pa.string(), pa.binary())

    def encode_words(self, words: pa.Array, step: int = 16_000) -> pa.Array:
        """The ids of words, joined by spaces. Whole tokens are looked up, as the rank file's library does."""
        out = pa.array([None if rank is None else str(rank) for rank in map(self.ranks.get, listed(words.cast(pa.binary())))], pa.string())
        sizes = pc.binary_length(words).to_numpy()
        todo = np.flatnonzero(pc.is_null(out).to_numpy(zero_copy_only=False))
        todo = todo[np.argsort(sizes[todo], kind="stable")]
        many = int(np.searchsorted(sizes[todo], SHORT, "right"))
        made = [out]
        for part in [todo[at : min(at + step, many)] for at in range(0, many, step)] + [todo[i : i + 1] for i in range(many, len(todo))]:
            n = sizes[part]
            tok = self.byte_ids[np.frombuffer(words.take(pa.array(part)).buffers()[2], np.uint8, n.sum())]
            if n[-1] > SHORT:
                zeros = np.zeros(len(tok), np.int32)
                following = np.append(tok[1:], -1).astype(np.int32)
                self.db.register("word_tokens", pa.table({"w": zeros, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok, "nx": following}))
                got = self.db.sql(ENCODE_LONG)
            else:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                toks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tok))
                self.db.register("words", pa.table({"w": pa.array(np.arange(len(part), dtype=np.int32)), "toks": toks}))
                got = self.db.sql(ENCODE)
            made += got.to_arrow_table()["ids"].cast(pa.string()).chunks
        at = np.arange(len(words))
        at[todo] = len(words) + np.arange(len(todo))
        return pa.concat_arrays(made).take(pa.array(at))

    def both_ways(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The ids of words, and what the ids decode to."""
        ids = self.encode_words(words)
        return ids, self.decode(ids)

    def encode(self, texts: pa.Array) -> Coded:
        """The ids of each text, by its distinct words, and their bytes, decoded."""
        words = Pieces(texts, self.pattern.findall)
        return Coded(words, *self.known.all_of(words.distinct, self.both_ways))

    def decode(self, coded: pa.Array) -> pa.Array:
        """The bytes of each list of ids, by an ordered aggregation; ids are given as decimal text, null as none."""
        n, tok = numbered(coded)
        d = np.repeat(np.arange(len(coded), dtype=np.int32), n)
        self.db.register("coded", pa.table({"d": pa.array(d), "pos": pa.array(np.arange(len(tok), dtype=np.int32)), "tok": pa.array(tok)}))
        got = self.db.sql(DECODE).to_arrow_table()
        out = [b""] * len(coded)
        for d, chars in zip(listed(got["d"]), listed(got["chars"])):
            out[d] = chars.encode("latin-1")
        return pa.array(out, pa.binary())


def numbered(coded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids in decimal, joined by spaces, null as none: how many each has, and all ids."""
    some = pc.greater(pc.fill_null(pc.binary_length(coded), 0), 0)
    lists = pc.split_pattern(coded.filter(some), " ")
    n = np.zeros(len(coded), np.int64)
    n[some.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
    return n, lists.flatten().cast(pa.int32()).to_numpy()


class Coded:
    """Texts as ids: words, and for each distinct one its ids in decimal with what they decode to."""

    def __init__(self, words: Pieces, ids: pa.Array, decoded: pa.Array):
        self.words, self.ids, self.bytes = words, ids, decoded

    def decimal(self) -> pa.Array:
        """Each text's ids joined by one space."""
        return self.words.joined(self.ids, pa.string(), " ")

    def n_tokens(self) -> pa.Array:
        return pa.array(self.words.summed(pc.count_substring(self.ids, " ").to_numpy().astype(np.int64) + 1))

    def numbers(self) -> np.ndarray:
        """The ids of all texts, one after the other."""
        n, tok = numbered(self.ids)
        return gathered(tok, n, self.words.codes)

    def decoded(self) -> pa.Array:
        """The bytes of each text's ids."""
        return self.words.joined(self.bytes, pa.binary(), b"")


@lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


KEPT.append(coder.cache_clear)

#: Bytes of text that a worker encodes, or of ids that it decodes, at a time. What it needs besides is many times that.
AT_ONCE = 1_000_000


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def batch(**columns: list | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids string, n_tokens): decimal ids joined by one space, for every row. Null is the empty text, of no ids.

    Repeated rows stay repeated, and a null doc_id stays null. path is the rank file, found on every worker. Each slice is
    cut into pieces, of which the distinct ones that were not seen lately go through one recursive DuckDB query. Nothing
    is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            for part in slices(b, "text", AT_ONCE):
                got = c.encode(part.column(1))
                yield batch(doc_id=part.column(0), ids=got.decimal(), n_tokens=got.n_tokens())

    return with_text(docs).mapInArrow(run, "doc_id long, ids string, n_tokens long")


def decoded(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) of rows (doc_id, ids); null ids are none. Repeated rows stay repeated, and a null doc_id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            for part in slices(b, "ids", AT_ONCE):
                yield batch(doc_id=part.column(0), bytes=c.decode(part.column(1)))

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())


def round_trip(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, with ids also (ids array): encodes, then decodes the ids, in one pass."""

    def rows(c: Coder, part: pa.RecordBatch) -> pa.RecordBatch:
        got = c.encode(part.column(1))
        n = got.n_tokens()
        columns = {"doc_id": part.column(0), "n_tokens": n, "ids_sha256": digests(got.decimal()), "decoded_sha256": digests(got.decoded())}
        if ids:
            offsets = np.concatenate([[0], np.cumsum(n.to_numpy())]).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(got.numbers()))
        return batch(**columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            for part in slices(b, "text", AT_ONCE):
                yield rows(c, part)
                lean(forget=False)  # else what slices leave free piles up

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return with_text(docs).mapInArrow(leaving_none(run, forget=False), schema)
