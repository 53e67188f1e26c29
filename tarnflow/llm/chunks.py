"""Cutting texts where byte-level BPE always cuts, so that each distinct piece of a slice is encoded once."""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of spaces or other white space decides together with what follows it; only a lone space between two characters
#: that are not white space is a certain cut, and it goes with what follows.
LONE = re.compile(r"(?<=\S) (?=\S)")
# White space besides the space.
OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts in which some space is not a certain cut.
UNSURE = f"^ | $| [ {OTHER_SPACE}]|[{OTHER_SPACE}] "


def parted(texts: pa.Array) -> pa.ListArray:
    """Texts without their lone spaces, in parts; " ".join gives a text."""
    unsure = pc.match_substring_regex(texts, UNSURE).to_numpy(zero_copy_only=False).astype(bool)
    lists = pc.split_pattern(texts.filter(pa.array(~unsure)), " ").cast(pa.list_(pa.string()))
    if not unsure.any():
        return lists
    other = pa.array([LONE.split(t) for t in texts.filter(pa.array(unsure)).to_pylist()], pa.list_(pa.string()))
    order = np.argsort(np.concatenate([np.flatnonzero(~unsure), np.flatnonzero(unsure)]), kind="stable")
    return pa.concat_arrays([lists, other]).take(pa.array(order))


def listed(values: pa.Array) -> list:
    """The values as Python objects; faster than one scalar after the other."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Pieces:
    """Texts as numbers of distinct pieces; a text's pieces joined give the text.

    Texts are cut before each lone space, and then, where a piece is more than letters behind its space, by `split`; of
    letters with punctuation behind them, both are a piece. The distinct pieces are a list, with `split` an Arrow array.
    """

    def __init__(self, texts: pa.Array, split: Callable[[str], list[str]] | None = None):
        parts = parted(texts.cast(pa.string()))
        coded = parts.flatten().dictionary_encode()
        self.offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
        codes = coded.indices.to_numpy().astype(np.int64)
        first = self.offsets[:-1]
        heads, back = np.unique(codes[first], return_inverse=True)
        codes[first] = len(coded.dictionary) + back
        if split is None:
            words = listed(coded.dictionary)
            self.distinct, self.codes = [" " + w for w in words] + [words[i] for i in heads.tolist()], codes  # some only stand at the beginning of a text
        else:
            made, n, self.distinct = cut(coded.dictionary, heads, split)
            self.codes = gathered(made, n, codes)
            self.offsets = np.concatenate([[0], np.cumsum(n[codes])])[self.offsets]
        self.counts = np.bincount(self.codes, minlength=len(self.distinct))

    def joined(self, values: list | pa.Array, kind: pa.DataType, between: str | bytes) -> pa.Array:
        """For each text, the values of its pieces joined."""
        taken = (values if isinstance(values, pa.Array) else pa.array(values, kind)).take(pa.array(self.codes))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), taken), between)

    def summed(self, numbers: np.ndarray) -> np.ndarray:
        """For each text, the sum of its pieces' numbers."""
        return np.diff(np.concatenate([[0], np.cumsum(numbers[self.codes])])[self.offsets])


def cut(words: pa.Array, heads: np.ndarray, split: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words behind a space, then the words numbered heads alone, each in pieces: all pieces' numbers, how many each has, the distinct pieces."""
    at = pa.array(heads)
    stems = pc.ascii_rtrim(words, characters=string.punctuation)
    plain = pc.utf8_is_alpha(stems)
    tails = pc.subtract(pc.binary_length(words), pc.binary_length(stems))
    spaced, stems_spaced = (pc.binary_join_element_wise(" ", x, "") for x in (words, stems))
    whole, stems, plain, tails = (pa.concat_arrays([x, y.take(at)]) for x, y in ((spaced, words), (stems_spaced, stems), (plain, plain), (tails, tails)))
    plain, tails = plain.to_numpy(zero_copy_only=False).astype(bool), tails.to_numpy()
    tailed = plain & (tails > 0)
    ends = [w[-k:] for w, k in zip(listed(whole.filter(pa.array(tailed))), tails[tailed].tolist())]
    other = [split(w) for w in listed(whole.filter(pa.array(~plain)))]
    n = 1 + tailed
    n[~plain] = np.fromiter(map(len, other), np.int64, len(other))
    coded = pa.concat_arrays([stems.filter(pa.array(plain)), pa.array(ends, pa.string()), pa.array(itertools.chain.from_iterable(other), pa.string())]).dictionary_encode()
    start = np.cumsum(n) - n
    in_turn = np.concatenate([start[plain], start[tailed] + 1, np.flatnonzero(np.repeat(~plain, n))])
    numbers = np.empty(len(coded), np.int64)
    numbers[in_turn] = coded.indices.to_numpy()
    return numbers, n, coded.dictionary


def gathered(values: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """values in runs of n, the runs that codes name one after the other."""
    start, m = np.cumsum(n) - n, n[codes]
    at = np.repeat(start[codes] - (np.cumsum(m) - m), m)
    return values[at + np.arange(len(at))]


class Memory(dict):
    """Values of pieces that are met more than once in a slice; when `kept` are held, those not asked for since the last time are dropped."""

    def __init__(self, kept: int):
        super().__init__()
        self.kept = kept
        self.older: dict = {}

    def all_of(self, pieces: Pieces, make: Callable[[list[str]], list]) -> list:
        """The values of the distinct pieces; those that are not held are made together."""
        keys = pieces.distinct
        out = list(map(self.get, keys))
        absent = [i for i, x in enumerate(out) if x is None]
        held = self.older.get
        for i in absent:
            out[i] = held(keys[i])
        new = [i for i in absent if out[i] is None]
        for i, x in zip(new, make([keys[i] for i in new]) if new else []):
            out[i] = x
        often = pieces.counts > 1
        worth = [i for i in absent if often[i]]
        if len(self) + len(worth) > self.kept:
            self.older = dict(self)
            self.clear()
        self.update((keys[i], out[i]) for i in worth)
        return out


class Columns:
    """Values of pieces as Arrow columns, for at most `kept` bytes of pieces, counting EACH more for each piece.

    Unlike Memory it holds pieces that a slice has once, too. When more are held, those longest not asked for are dropped,
    down to three quarters. No piece may take a hundredth.
    """

    EACH = 20

    def __init__(self, kept: int, *kinds: pa.DataType):
        self.kept, self.columns = kept, [pa.array([], kind) for kind in (pa.string(), *kinds)]
        self.turn, self.asked = 0, np.zeros(0, np.int64)

    def all_of(self, keys: pa.Array, make: Callable[[pa.Array], Sequence[pa.Array]]) -> list[pa.Array]:
        """The values of distinct pieces, a column each; those that are not held are made together."""
        self.turn += 1
        met = pc.index_in(self.columns[0], value_set=keys)
        rows = np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False))
        at = np.full(len(keys), -1)
        at[met.drop_null().to_numpy()] = rows
        self.asked[rows] = self.turn
        new = np.flatnonzero(at < 0)
        if not len(new):
            return [x.take(pa.array(at)) for x in self.columns[1:]]
        at[new] = len(self.asked) + np.arange(len(new))
        more = keys.take(pa.array(new))
        self.columns = [pa.concat_arrays(x) for x in zip(self.columns, (more, *make(more)))]
        self.asked = np.append(self.asked, np.full(len(new), self.turn))
        out = [x.take(pa.array(at)) for x in self.columns[1:]]
        sizes = pc.binary_length(self.columns[0]).to_numpy().astype(np.int64) + self.EACH
        left = sizes < self.kept // 100
        if sizes[left].sum() > self.kept:
            latest = np.argsort(-self.asked, kind="stable")
            left[latest] &= np.cumsum(np.where(left, sizes, 0)[latest]) <= self.kept * 3 // 4
        if not left.all():
            self.columns, self.asked = [x.filter(pa.array(left)) for x in self.columns], self.asked[left]
        return out


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about `most` bytes in a column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)
