"""Places of pattern matches in texts, with SQL functions only, in time that grows with the text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<s:int,e:int,m:string,g:string>>"
#: Arrays are built by steps over blocks of so many elements: appending one by one copies what is there.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a lambda takes from outside is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none(kind: str) -> Column:
    return F.array().cast(kind)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each int of an array, what combine makes of it and all before it."""

    def steps(some: Column, start: Column) -> Column:
        return F.aggregate(some, F.array(start), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def of(v: Column) -> Column:
        def block(i: Column) -> Column:
            return F.slice(v, i * BLOCK + 1, F.lit(BLOCK))

        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda i: F.aggregate(block(i), F.lit(zero), combine))
        made = let(steps(sums, F.lit(zero)), lambda starts: F.flatten(F.transform(blocks, lambda i: F.slice(steps(block(i), F.get(starts, i)), F.lit(2), F.lit(BLOCK)))))
        return F.when(F.size(v) > 0, made).otherwise(none("array<int>"))

    return let(values, of)


def matches(text: Column, pattern: str, group: int = 0, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as (s, e, m, g): code point places, the match, and one of its groups.

    Splitting by a pattern and extracting it walk the same matches, so the running sum of the lengths of both in turn
    gives the places. gate is a cheap condition without which there is no match.
    """

    def placed_(whole: Column) -> Column:
        def at(n: Column) -> Column:
            between = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), F.lit(1), F.size(n))
            ends = running(F.zip_with(between, n, lambda gap, k: gap + k), lambda a, b: a + b, 0)
            places = F.zip_with(ends, n, lambda e, k: F.struct((e - k).alias("s"), e.alias("e")))
            inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
            texts = F.zip_with(whole, inner, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
            return F.zip_with(places, texts, lambda p, x: F.struct(p["s"].alias("s"), p["e"].alias("e"), x["m"].alias("m"), x["g"].alias("g")))

        return F.when(F.size(whole) > 0, let(F.transform(whole, F.char_length), at)).otherwise(none(FOUND))

    all_ = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed_)
    return all_ if gate is None else F.when(gate, all_).otherwise(none(FOUND))


def placed(found: Column, kind: str, rank: int) -> Column:
    """found as sortable (s, rank, e, kind)."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def joined(*parts: Column) -> Column:
    """kind:start:end of all parts by start, then rank, then end; comma-joined."""
    ordered = F.array_sort(F.concat(*parts))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def apart(found: Column, *others: Column) -> Column:
    """Those of found that overlap none of the others, by one walk over all in the order of their starts."""
    far = 2**31 - 1
    both = [F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["g"].alias("g"), F.lit(True).alias("own")))]
    both += [F.transform(o, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m"), F.lit("").alias("g"), F.lit(False).alias("own"))) for o in others]

    def walk(a: Column) -> Column:
        # The furthest end of others that start no later, and the nearest start of others that start no earlier.
        ends = running(F.transform(a, lambda x: F.when(x["own"], 0).otherwise(x["e"])), lambda a, b: F.greatest(a, b), 0)
        starts = F.reverse(running(F.reverse(F.transform(a, lambda x: F.when(x["own"], far).otherwise(x["s"]))), lambda a, b: F.least(a, b), far))
        pairs = F.zip_with(a, F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x, o: F.struct(x.alias("x"), o.alias("o")))
        free = F.filter(pairs, lambda p: p["x"]["own"] & (p["o"]["e"] <= p["x"]["s"]) & (p["o"]["s"] >= p["x"]["e"]))
        return F.transform(free, lambda p: F.struct(p["x"]["s"].alias("s"), p["x"]["e"].alias("e"), p["x"]["m"].alias("m"), p["x"]["g"].alias("g")))

    all_ = let(F.array_sort(reduce(lambda x, y: F.concat(x, y), both)), walk)
    return F.when(F.size(found) > 0, all_).otherwise(none(FOUND))
