"""Recursions of any length, linear or over finite states: maps composed over blocks, so that one series runs in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps in a block. A block's path is built by appending, which copies what is there.
BLOCK = 128


def _unbroken(block: int) -> Column:
    """The steps of a block up to the first that is missing."""
    return F.filter("_m", lambda m, i: m["t"] == F.col("_block") * block + i)


def affine_path(maps: DataFrame, by: list[str], n: int, block: int = BLOCK) -> DataFrame:
    """(by, t, x) with x(t) = a(t) x(t - 1) + b(t), from maps (by, t, a, b) with t from 0 to n - 1; x(-1) is 0.

    Each block of steps is composed into one map; the maps of the blocks, `block` times fewer, are run the same way, and
    give every block the state that it starts from. A step without a map, and all after it, give no rows.
    """
    blocked = maps.groupBy(*by, F.floor(F.col("t") / block).cast("int").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("t", "a", "b"))).alias("_m")).withColumn("_m", _unbroken(block))
    if n > block:
        one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

        def composed(acc: Column, m: Column) -> Column:
            return F.struct((m["a"] * acc["a"]).alias("a"), (m["a"] * acc["b"] + m["b"]).alias("b"))

        whole = blocked.where(F.size("_m") == block).select(*by, F.col("_block").alias("t"), F.aggregate("_m", one, composed).alias("_w")).select(*by, "t", "_w.a", "_w.b")
        ends = affine_path(whole, by, -(-n // block), block)
        starts = ends.select(*by, (F.col("t") + 1).alias("_block"), F.col("x").alias("_x"))
        blocked = blocked.join(starts, [*by, "_block"], "left").where("_block = 0 OR _x IS NOT NULL")
    else:
        blocked = blocked.withColumn("_x", F.lit(None).cast("double"))
    first = F.array(F.coalesce("_x", F.lit(0.0)))
    path = F.aggregate("_m", first, lambda xs, m: F.concat(xs, F.array(m["a"] * F.element_at(xs, -1) + m["b"])))
    return blocked.select(*by, F.posexplode(F.arrays_zip(F.col("_m.t").alias("t"), F.slice(path, F.lit(2), F.size("_m")).alias("x"))).alias("_i", "_p")).select(*by, "_p.t", "_p.x")


def state_path(maps: DataFrame, by: list[str], n: int, block: int = BLOCK) -> DataFrame:
    """(by, t, s) with s(t) = m(t)[s(t - 1)], from maps (by, t, m) with t from 0 to n - 1; m lists the state that follows
    each of k states, and s(-1) is 0.

    Maps over states compose as affine ones do: a block's map lists where each state leads, and the blocks' maps are run
    the same way. A step without a map, and all after it, give no rows.
    """
    blocked = maps.groupBy(*by, F.floor(F.col("t") / block).cast("int").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("t", "m"))).alias("_m")).withColumn("_m", _unbroken(block))
    if n > block:
        rest = F.slice("_m", F.lit(2), F.size("_m"))
        whole = F.aggregate(rest, F.get("_m", F.lit(0))["m"], lambda at, m: F.transform(at, lambda s: F.get(m["m"], s)))
        ends = state_path(blocked.where(F.size("_m") == block).select(*by, F.col("_block").alias("t"), whole.alias("m")), by, -(-n // block), block)
        starts = ends.select(*by, (F.col("t") + 1).alias("_block"), F.col("s").alias("_s"))
        blocked = blocked.join(starts, [*by, "_block"], "left").where("_block = 0 OR _s IS NOT NULL")
    else:
        blocked = blocked.withColumn("_s", F.lit(None).cast("int"))
    path = F.aggregate("_m", F.array(F.coalesce("_s", F.lit(0))), lambda xs, m: F.concat(xs, F.array(F.get(m["m"], F.element_at(xs, -1)))))
    return blocked.select(*by, F.posexplode(F.arrays_zip(F.col("_m.t").alias("t"), F.slice(path, F.lit(2), F.size("_m")).alias("s"))).alias("_i", "_p")).select(*by, "_p.t", "_p.s")
