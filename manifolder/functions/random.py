"""Random numbers as functions of a seed and whole numbers: the same whatever the partitions, and in any engine.

Only whole-number arithmetic below 2 ** 63 is used, so SQL can follow it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647


def mixed(seed: int, *keys: Column) -> Column:
    """A whole number from 0 to ``PRIME`` - 1: each key is added to a multiple, and twice squared, modulo the prime."""
    x = F.lit(seed % PRIME).cast("long")
    for key in keys:
        x = (x * 48_271 + F.pmod(key.cast("long"), F.lit(PRIME))) % PRIME
        x = (x * x + 12_345) % PRIME
        x = (x * x + 54_321) % PRIME
    return x


def uniform(seed: int, *keys: Column) -> Column:
    """Between 0 and 1, neither included."""
    return (mixed(seed, *keys) + 0.5) / PRIME


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal, from two uniform numbers."""
    return F.sqrt(F.log(uniform(2 * seed, *keys)) * -2) * F.cos(uniform(2 * seed + 1, *keys) * (2 * math.pi))
