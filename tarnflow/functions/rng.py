"""Counter-based randomness: a draw depends on its keys alone, never on partitions or on order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *keys: Column | str) -> Column:
    """Uniform on (0, 1): the first 32 bits of the MD5 of seed, stream and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def normal(seed: int, stream: str, *keys: Column | str) -> Column:
    """Standard normal, by Box and Muller from two uniform streams."""
    u, v = uniform(seed, stream + "u", *keys), uniform(seed, stream + "v", *keys)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)
