"""Seeded choices: the same in every run, partitioning and engine.

Every draw is 32 bits of the md5 of a key; there is no ``rand``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*key: Column | str) -> Column:
    """A bigint in [0, 2**32) from the parts of a key, joined by ':'."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def below(n: Column | int, *key: Column | str) -> Column:
    return draw(*key) % n


def uniform(low: float, high: float, *key: Column | str) -> Column:
    return F.lit(float(low)) + (float(high) - float(low)) * (draw(*key) / float(1 << 32))


def one_of(values: list, *key: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (below(len(values), *key) + 1).cast("int"))
