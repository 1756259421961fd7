"""Random numbers that depend on keys only, not on partitions, tasks or row order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) from 52 hash bits of the seed and the keys.

    String arguments are literals.
    """
    parts = [F.lit(str(seed))] + [
        F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys
    ]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number by the Box-Muller transform."""
    u1 = 1.0 - uniform(seed, *keys, "a")
    u2 = uniform(seed, *keys, "b")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer on uint64 values (constants are fixed by that generator)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform_array(seed: int, salt: int, ids: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] for integer ids."""
    base = mix64(np.array([seed], np.int64).view(np.uint64)) ^ mix64(
        np.array([salt], np.int64).view(np.uint64) + np.uint64(1)
    )
    bits = mix64(ids.astype(np.int64).view(np.uint64) ^ mix64(base))
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) / float(2**53)
