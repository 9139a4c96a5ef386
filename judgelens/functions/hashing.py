"""Seeded hashes used for grouping, sampling and resampling.

``xxhash64`` is the default for split assignment. The portable variants give
the same value in any SQL engine, so results can be checked outside Spark.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelens.constants import SEED
from judgelens.functions.text import as_column

KeyHash = Callable[[Column, int], Column]

# A 32-bit integer mixer (shift, multiply) and its stream offsets.
MASK_32 = 0xFFFFFFFF
MIX_FACTORS = (0x7FEB352D, 0x21F0AAAD)
MIX_SHIFTS = (16, 15, 15)
STREAM_STEP = 0x61C88647


def xxhash_key(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def sha_key(key: Column, seed: int = SEED) -> Column:
    """First 32 bits of SHA-256 over ``seed:key`` as a bigint."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column | str, modulus: int, seed: int = SEED, key_hash: KeyHash = xxhash_key) -> Column:
    """Non-negative bucket number of a key."""
    return F.pmod(key_hash(as_column(key), seed), F.lit(modulus))


def mix32(value: str) -> str:
    """SQL text that scrambles a bigint in [0, 2**32) into another one."""
    first, second, third = MIX_SHIFTS
    a, b = MIX_FACTORS
    step = f"((({value}) ^ shiftright({value}, {first})) * {a}L & {MASK_32}L)"
    step = f"(({step} ^ shiftright({step}, {second})) * {b}L & {MASK_32}L)"
    return f"({step} ^ shiftright({step}, {third}))"


def mix32_array(values: np.ndarray) -> np.ndarray:
    """The same scramble for a NumPy array of unsigned 64-bit integers."""
    first, second, third = (np.uint64(shift) for shift in MIX_SHIFTS)
    a, b = (np.uint64(factor) for factor in MIX_FACTORS)
    mask = np.uint64(MASK_32)
    values = ((values ^ (values >> first)) * a) & mask
    values = ((values ^ (values >> second)) * b) & mask
    return values ^ (values >> third)
