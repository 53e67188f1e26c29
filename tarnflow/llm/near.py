"""Near copies by word shingles: every pair whose similarity reaches a bound, by SimHash pivots, prefixes of rare shingles and exact comparison.

SimHash fingerprints of the shingles are linked by pivot tables first, and an exact comparison confirms what they find.
They cannot find all: a pair with similarity 0.8 differs in ten bits or so, often in more, and at such a radius unrelated
texts meet too. The rest is found by prefixes. Of two texts with Jaccard similarity 0.8 or more, however, each holds four fifths of its
shingles in common with the other, so in any one order of all shingles their first fifths (and one more) share a shingle.
The order puts frequent shingles last; it decides how many pairs are compared, never which ones are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import listed, slices
from .common import leaving_none, shuffle_parts, stored, text_or_empty
from .components import components
from .simhash import majority, pivot_links  # noqa: F401  majority gives one text what Shingles.fingerprints gives each
from .substrings import runs, sent, unpacked

#: Counters of shingles by the low bits of their hash, for the order only.
BINS = 1 << 16
SLICE = 2_000_000
#: Bits in which fingerprints may differ: most pairs of similarity 0.8 differ in no more.
RADIUS = 12
#: Bits of a set's sketch.
SKETCH = 1024


class Shingles:
    """The distinct shingles of several texts, each text's as a sorted run of 64-bit hashes.

    Words are those of op3's contract; a shorter text is one shingle, one without words none. Each distinct word is hashed once.
    """

    def __init__(self, texts: pa.Array, width: int = 5):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
        words = parts.flatten()
        whole = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)))
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False).astype(bool)  # white space at an end leaves an empty word
        at = np.append(0, np.cumsum(real))[whole]
        coded = words.dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, listed(coded.dictionary)), np.uint64, len(coded.dictionary))
        ids = hashes[coded.indices.to_numpy()[real]]
        n = np.diff(at)
        made = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        start = np.append(0, np.cumsum(made))
        first = np.repeat(at[:-1] - start[:-1], made) + np.arange(start[-1])  # where each shingle's words begin
        h = np.empty(start[-1], np.uint64)
        long = np.repeat(np.minimum(n, width), made)
        for w in range(1, width + 1):
            some = np.flatnonzero(long == w)
            if len(some):
                h[some] = mixed(ids, first[some], w)
        for i, j in zip(start[:-1].tolist(), start[1:].tolist()):
            h[i:j].sort()
        fresh = np.append(True, h[1:] != h[:-1])[: len(h)]
        fresh[start[:-1][made > 0]] = True
        self.values, self.start = h[fresh], np.append(0, np.cumsum(fresh))[start]

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.start[i] : self.start[i + 1]]

    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    def keys(self) -> list[int]:
        return [key_of(self[i]) for i in range(len(self))]

    def counts(self) -> np.ndarray:
        """How many shingles each of BINS has."""
        return np.bincount((self.values & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)

    def fingerprints(self) -> np.ndarray:
        """Each text's SimHash: the bits that are set in over half of its shingles.

        Eight shifts bring every bit to the foot of a byte; up to 255 such words add up without carrying over.
        """
        out = np.zeros(len(self), np.uint64)
        n = self.sizes()
        some = np.flatnonzero(n)
        if not len(some):
            return out
        pieces = -(-n[some] // 255)
        head = np.cumsum(pieces) - pieces
        cuts = np.repeat(self.start[some] - 255 * head, pieces) + 255 * np.arange(pieces.sum())
        ones = np.empty((len(cuts), 8, 8), np.uint8)  # piece, byte, bit
        for bit in range(8):
            lanes = (self.values >> np.uint64(bit)) & np.uint64(0x0101010101010101)
            ones[:, :, bit] = np.add.reduceat(lanes, cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(ones.reshape(-1, 64), head, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * total > n[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
        return out

    def sketches(self) -> list[bytes]:
        """Each text's sketch()."""
        out = []
        for at in range(0, len(self), 1000):
            start = self.start[at : at + 1001]
            cell = np.repeat(np.arange(len(start) - 1) * SKETCH, np.diff(start)) + (self.values[start[0] : start[-1]] % np.uint64(SKETCH)).astype(np.int64)
            odd = np.bincount(cell, minlength=(len(start) - 1) * SKETCH) & 1
            out += map(bytes, np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH), axis=1))
        return out


def mixed(ids: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Hashes of the runs of w words that begin at these places."""
    h = np.full(len(first), w, np.uint64)
    for i in range(w):
        h = (h ^ ids[first + i]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return Shingles(pa.array([text]), width)[0]


def key_of(s: np.ndarray) -> int:
    """A text's key: the hash of its set of shingles, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """For each residue of the hashes modulo SKETCH, whether an odd number of them has it.

    A shingle that only one of two sets holds turns one bit, so sketches differ in at most as many bits as the sets do.
    """
    return np.packbits(np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def prefix(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The shingles, rarest first, of which every set with similarity 0.8 or more shares one in its own prefix. order: the place of each bin."""
    n = len(s)
    return s[np.argsort(order[s & np.uint64(BINS - 1)], kind="stable")[: n - -(-4 * n // 5) + 1]] if n else s


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have Jaccard similarity 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def may_reach(n, at, m, to):
    """Whether sets of n and m shingles whose first common one stands at these places can be similar enough; for columns and arrays."""
    left = n - at <= m - to
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & ((left & (9 * (n - at) >= 4 * (n + m))) | (~left & (9 * (m - to) >= 4 * (n + m))))


#: A shingle in a text's prefix: the text's key, how many shingles it has and where in their order this one stands.
POST = np.dtype([("shingle", "<u8"), ("key", "<i8"), ("size", "<i4"), ("at", "<i4")])


class Shared:
    """Posts whose shingle another key has too. Holds one post for each shingle, however many keys share it."""

    def __init__(self):
        self.held, self.shared = np.empty(0, POST), np.empty(0, bool)

    def add(self, new: np.ndarray) -> np.ndarray:
        """Takes posts and gives those, of these and of the held ones, that turn out to be shared and were not given yet."""
        if not len(new):
            return new
        rows = np.concatenate([self.held, new])
        fresh = np.append(~self.shared, np.ones(len(new), bool))  # not given yet
        order = np.lexsort((np.append(np.zeros(len(self.held), bool), np.ones(len(new), bool)), rows["key"], rows["shingle"]))
        rows, fresh = rows[order], fresh[order]
        first = np.append(True, rows["shingle"][1:] != rows["shingle"][:-1])
        again = ~first & np.append(False, rows["key"][1:] == rows["key"][:-1])  # the same post once more
        rows, fresh, first = rows[~again], fresh[~again], first[~again]
        start = np.flatnonzero(first)
        n = np.diff(np.append(start, len(rows)))
        shared = (n > 1) | ~np.logical_and.reduceat(fresh, start)
        out = rows[fresh & np.repeat(shared, n)]
        self.held, self.shared = rows[start], shared
        return out


def slices_of(batch: pa.RecordBatch, column: int, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists in a column hold about `most` members, one row at least."""
    held = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from slices(b, "text", SLICE)


#: Groups of at most so many members meet together, all their pairs at once; larger ones go member by member.
SMALL = 512
#: Pairs whose sketches are held at a time.
AT_ONCE = 50_000


def pairs_of_groups(n: np.ndarray, split: np.ndarray, own: np.ndarray, key: np.ndarray, label: np.ndarray, size: np.ndarray, at: np.ndarray, bits: np.ndarray, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, more) for groups of n members each, one after the other: the pairs of pairs_between, and for each group
    whether the forest has left out pairs that may be similar. split: whether a group is of two blocks."""
    group = np.repeat(np.arange(len(n)), n)
    more, left, right = np.zeros(len(n), bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    start = np.cumsum(n) - n
    for g in np.flatnonzero(n > SMALL).tolist():
        one = slice(start[g], start[g] + n[g])
        a, b = pairs_between((0, int(split[g])), own[one], key[one], label[one], size[one], at[one], bits[one], forest)
        left.append(a)
        right.append(b)
        more[g] = forest and len(a) > 0
    rest = np.flatnonzero(n[group] <= SMALL)
    rest = rest[np.lexsort((size[rest], group[rest]))]
    group, own, key, label, size, at = group[rest], own[rest], key[rest], label[rest], size[rest].astype(np.int64), at[rest].astype(np.int64)
    sorted_by = group << 32 | size
    many = np.searchsorted(sorted_by, group << 32 | 5 * size // 4, side="right") - np.arange(1, len(rest) + 1)
    ends = np.cumsum(many)
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def part(i: int) -> tuple[int, int]:
        x = (int(group[i]), int(label[i]))
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    lo = 0
    while lo < len(rest):
        done = ends[lo] - many[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[lo:hi] - many[lo:hi] - done, many[lo:hi])
        lo = hi
        may = (label[i] != label[j]) & ((own[i] != own[j]) | ~split[group[i]]) & may_reach(size[i], at[i], size[j], at[j])
        i, j = i[may], j[may]
        apart = np.bitwise_count(bits[rest[i]] ^ bits[rest[j]]).sum(1, dtype=np.int64)
        near = 9 * apart <= size[i] + size[j]
        i, j, apart = i[near], j[near], apart[near]
        if forest and len(i):
            order = np.lexsort((apart, i))
            i, j = i[order], j[order]
            taken = np.zeros(len(i), bool)
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                if (p := part(x)) != (q := part(y)):
                    root[q], taken[k] = p, True
            more[group[i[~taken]]] = True
            i, j = i[taken], j[taken]
        left.append(np.minimum(key[i], key[j]))
        right.append(np.maximum(key[i], key[j]))
    return np.concatenate(left), np.concatenate(right), more


def pairs_between(shape: tuple[int, int], own: np.ndarray, key: np.ndarray, label: np.ndarray, size: np.ndarray, at: np.ndarray, bits: np.ndarray, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks' members (of one block, where both are the same) that are not connected yet and may be similar.

    bits: a row of sketch words for each. Sets of n and m shingles with similarity 0.8 or more differ in at most
    (n + m) / 9 of them, so a pair whose sketches differ in more bits is none. With forest, each member is paired only with
    the closest one, by sketch, of each part that earlier pairs have not joined to its own: as many pairs as members at most.
    """
    order = np.argsort(size, kind="stable")
    own, key, label, size, at, bits = own[order], key[order], label[order], size[order], at[order], bits[order]
    ends = np.searchsorted(size, 5 * size // 4, side="right")
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    part = np.unique(label, return_inverse=True)[1].reshape(-1)
    for i in range(len(key)):
        j = np.arange(i + 1, ends[i])
        j = j[(part[j] != part[i]) & may_reach(size[i], at[i], size[j], at[j])]
        if shape[0] != shape[1]:
            j = j[own[j] != own[i]]
        if len(j):
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            near = 9 * apart <= size[i].astype(np.int64) + size[j]
            j, apart = j[near], apart[near]
        if len(j) and forest:
            j = j[np.argsort(apart, kind="stable")]
            j = j[np.sort(np.unique(part[j], return_index=True)[1])]
            part[np.isin(part, part[j])] = part[i]
        if len(j):
            left.append(np.minimum(key[i], key[j]))
            right.append(np.maximum(key[i], key[j]))
    return np.concatenate(left), np.concatenate(right)


def near_keys(docs: DataFrame, width: int = 5, block: int = 2048, bucket_bytes: int = 64_000_000) -> tuple[DataFrame, DataFrame]:
    """((doc_id, th, key) for every row, (node, component) for every key that is linked to another).

    th is the text's hash, key that of its set of shingles; keys link when their sets have Jaccard similarity 0.8 or more.

    Fingerprints are linked by their pivot distances; the forest of those links and keys of equal fingerprints are compared
    first. It is not complete at this radius, so pairs that share a shingle of their prefixes are candidates too. Prefixes are sent packed, by shingle, to tasks that give
    back only what several keys share. Then each key is compared with the least key under the same shingle, if they are
    not connected, which takes as many comparisons as a group has members. Under each shingle that still holds unconnected keys,
    these meet by their sketches, dealt over pairs of blocks, where a bound that no similar pair breaks leaves out most
    pairs. Of the others, first a forest is compared by texts, which connects what is alike, and then, under the shingles
    where the forest left any out, all that are still unconnected. Nothing is capped.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        names = ["doc_id", "th", "key", "fp", "bits", "bin", "n"]
        for part in in_slices(batches):
            sets = Shingles(part.column(2), width)
            counts += sets.counts()
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets.keys(), pa.int64()), pa.array(sets.fingerprints().view(np.int64)), pa.array(sets.sketches(), pa.binary()), none, none], names)
        seen = np.flatnonzero(counts)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(seen), pa.binary()), pa.array(seen), pa.array(counts[seen])], names)

    passed = stored(source.mapInArrow(leaving_none(first), "doc_id long, th long, key long, fp long, bits binary, bin long, n long"), "keys")
    each = passed.where("bin IS NULL").select("doc_id", "th", "key")
    counts = np.zeros(BINS, np.int64)
    for r in passed.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r.bin] = r.n
    buckets = max(shuffle_parts(spark), -(-int(counts.sum()) * POST.itemsize // (4 * bucket_bytes)))
    order = np.empty(BINS, np.uint16)
    order[np.argsort(counts, kind="stable")] = np.arange(BINS)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            sets = Shingles(part.column(0), width)
            ahead = [prefix(sets[i], order) for i in range(len(sets))]
            n = [len(x) for x in ahead]
            posts = np.empty(sum(n), POST)
            posts["shingle"] = np.concatenate([np.empty(0, np.uint64), *ahead])
            posts["key"], posts["size"] = np.repeat(np.array(sets.keys(), np.int64), n), np.repeat(sets.sizes(), n)
            posts["at"] = np.concatenate([np.empty(0, np.int64), *map(np.arange, n)])
            if len(posts):
                posts = posts[np.argsort(posts["shingle"], kind="stable")]
                yield sent(posts, (posts["shingle"] % np.uint64(buckets)).astype(np.int64))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, some = Shared(), []

        def given(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows["shingle"].view(np.int64)), *[pa.array(rows[c]) for c in ("key", "size", "at")]], ["shingle", "key", "size", "at"])

        for b in batches:
            for raw in runs(b):
                some.append(unpacked(raw, POST))
                if sum(map(len, some)) >= 1_000_000:
                    yield given(shared.add(np.concatenate(some)))
                    some = []
        yield given(shared.add(np.concatenate([np.empty(0, POST), *some])))

    dealt_posts = source.select("text").mapInArrow(leaving_none(second), "bucket int, rows binary, places binary").repartitionById(buckets, F.col("bucket"))
    posts = stored(dealt_posts.mapInArrow(leaving_none(share), "shingle long, key long, size int, at int"), "prefixes")
    heads = posts.groupBy("shingle").agg(F.min(F.struct("key", "size", "at")).alias("head"))
    met = posts.join(heads, "shingle")
    fits = may_reach(F.col("head.size"), F.col("head.at"), F.col("size"), F.col("at"))
    heads_and_others = met.where(F.col("key") > F.col("head.key")).where(fits).select(F.col("head.key").alias("a"), F.col("key").alias("b")).distinct()

    def pivoted() -> DataFrame:
        """(a, b): what SimHash and its pivot tables link."""
        prints = passed.where("bin IS NULL").select("key", "fp").distinct()
        nodes = stored(prints.groupBy("fp").agg(F.min("key").alias("rep")), "nodes")
        same = prints.join(nodes, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
        linked = pivot_links(nodes, RADIUS, block).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return stored(same.union(linked).distinct(), "pairs")

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs that no links connect."""
        one, other = label.toDF("a", "_a"), label.toDF("b", "_b")
        return pairs.join(one, "a", "left").join(other, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")

    def fetched(pairs: DataFrame) -> DataFrame:
        """(key, text) of all keys of some pairs."""
        asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        wanted = stored(each.join(asked, "key").groupBy("key").agg(F.min("th").alias("th")), "wanted")  # its size says whether texts must move

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in in_slices(batches):
                yield part.filter(pc.equal(part.column(0), pa.array(Shingles(part.column(1), width).keys(), pa.int64())))

        return source.join(wanted, "th").select("key", "text").mapInArrow(leaving_none(run), "key long, text string").dropDuplicates(["key"])

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 50):
                    some = b.slice(at, 50)
                    left, right, x, y = (c.to_pylist() for c in some.columns)
                    texts = dict(zip(left, x)) | dict(zip(right, y))  # a key names one set
                    sets = Shingles(pa.array(list(texts.values()), pa.string()), width)
                    at_ = {k: i for i, k in enumerate(texts)}
                    mask = [similar(sets[at_[i]], sets[at_[j]]) for i, j in zip(left, right)]
                    yield some.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

        texts = stored(fetched(pairs), "texts")
        one, other = texts.select(F.col("key").alias("a"), F.col("text").alias("x")), texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
        return stored(pairs.join(other, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(leaving_none(run), "a long, b long"), "links")

    def meeting(posts: DataFrame, label: DataFrame, forest: bool) -> DataFrame:
        """(a, b, more): pairs that meet under a shingle whose keys are in several components; and, as more, the shingles
        under which the forest has left out pairs that may be similar."""
        named = posts.join(label, posts["key"] == label["node"], "left").select("shingle", "key", "size", "at", F.coalesce("component", "key").alias("label"))
        open_ = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high")
        unsettled = stored(named.join(open_.select("shingle", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "shingle"), "unsettled")
        sketches = passed.where("bin IS NULL").select("key", "bits").join(unsettled.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        dealt = (
            unsettled.join(sketches, "key")
            .withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("shingle", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "label", "size", "at", "bits")
        )
        groups = dealt.groupBy("shingle", "lo", "hi").agg(F.collect_list(F.struct("own", "key", "label", "size", "at", "bits")).alias("m"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices_of(b, 3):
                    shingle, lo, hi = (part.column(k).to_numpy() for k in range(3))
                    own, key, label, size, at, bits = part.column(3).flatten().flatten()
                    words = np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(bits), -1)
                    n = pc.list_value_length(part.column(3)).to_numpy().astype(np.int64)
                    left, right, more = pairs_of_groups(n, lo != hi, *(c.to_numpy() for c in (own, key, label, size, at)), words, forest)
                    columns = [pa.array(left), pa.array(right), pa.nulls(len(left), pa.int64())], [*[pa.nulls(int(more.sum()), pa.int64())] * 2, pa.array(shingle[more])]
                    yield from (pa.RecordBatch.from_arrays(c, ["a", "b", "more"]) for c in columns)

        return groups.select("shingle", "lo", "hi", "m").mapInArrow(leaving_none(meet), "a long, b long, more long")

    def new(met: DataFrame) -> DataFrame:
        """The pairs that were not compared yet."""
        return stored(met.where("a IS NOT NULL").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")

    tried = pivoted()
    links = verified(tried)
    stars = stored(apart(heads_and_others, components(links)).join(tried, ["a", "b"], "left_anti"), "stars")
    tried, links = tried.union(stars), links.union(verified(stars))
    met = stored(meeting(posts, components(links), True), "met")
    pairs = new(met)
    tried, links = tried.union(pairs), links.union(verified(pairs))
    # A shingle under which the forest took all that may be similar is done: later, fewer of its pairs are unconnected.
    left = stored(met.where("more IS NOT NULL").select(F.col("more").alias("shingle")).distinct(), "open")
    pairs = new(meeting(posts.join(left, "shingle", "left_semi"), components(links), False))
    links = links.union(verified(pairs))
    return each, components(links)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group; rows without a doc_id stay.

    Texts whose sets of five-word shingles have Jaccard similarity 0.8 or more are linked, and a group is all that links
    connect. Texts without words have the same, empty set.
    """
    each, found = near_keys(docs)
    rows = each.join(found, each["key"] == found["node"], "left").select("doc_id", "th", F.coalesce("component", "key").alias("label"))
    least = rows.groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    lost = rows.join(least, "label").where("doc_id <> least").select(F.col("doc_id").alias("_lost"), F.col("th").alias("_th")).distinct()
    return docs.join(lost, (docs["doc_id"] == lost["_lost"]) & (F.xxhash64(text_or_empty()) == lost["_th"]), "left_anti")
