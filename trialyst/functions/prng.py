"""Counter-based randomness that does not depend on partitioning or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def draw(seed, *keys) -> Column:
    """A whole number in [0, 2^32) fixed by the seed and the key columns."""
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_below(seed, n, *keys) -> Column:
    """A whole number in [0, n)."""
    return F.pmod(draw(seed, *keys), F.lit(n) if isinstance(n, int) else n)


def pick(options: list[str], seed, *keys) -> Column:
    """One of a fixed list of strings, chosen by hash."""
    table = F.array(*[F.lit(o) for o in options])
    return F.element_at(table, (draw_below(seed, len(options), *keys) + 1).cast("int"))
