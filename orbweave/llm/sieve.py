"""A bit set of 64-bit fingerprints that every task can hold: what is not in it cannot be in the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

BITS_EACH = 16                    # bits per fingerprint; one in 17 strangers passes
LOWEST, HIGHEST = 17, 30          # exponents of the smallest and the largest set: 16 KB, 128 MB


def sieve(prints: DataFrame, column: str = "fp") -> np.ndarray:
    """Bits of the fingerprints of ``prints`` as bytes, a power of two of them.

    Built by Spark in segments of 32,768 bits; the driver gets the finished set, which ends at 128 MB.  A fuller set lets
    more strangers pass, never fewer members, so callers lose speed beyond that and no result.
    """
    count = prints.count()
    exponent = min(max((BITS_EACH * count).bit_length(), LOWEST), HIGHEST)
    place = F.col(column).bitwiseAND(F.lit((1 << exponent) - 1))
    parts = prints.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(
        F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (exponent - 3), "u1")
    for part, bits in zip(parts["part"].to_pylist(), parts["bits"]):
        out[part * 4096:(part + 1) * 4096] = np.frombuffer(bits.as_buffer(), "u1")
    return out


def held(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which of the fingerprints (64-bit unsigned) may be in the set."""
    place = prints & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1")) & 1 > 0


def mix(z: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the public splitmix finaliser)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Powers:
    """Powers of an odd 64-bit base and of its inverse, kept as long as the longest block so far."""

    def __init__(self, base: int):
        self._base = base | 1
        self._inverse = pow(self._base, -1, 1 << 64)
        self._up = self._down = np.ones(1, "u8")

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self._up):
            size = max(n, 1 << 16)
            self._up, self._down = (np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(size - 1, b, "u8")]), dtype="u8")
                                    for b in (self._base, self._inverse))
        return self._up[:n], self._down[:n]


class Prefix:
    """Prefix polynomial of a sequence of 64-bit numbers: the hash of any stretch by two look-ups."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self._down = powers.upto(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, "u8")
        np.cumsum(values * up[:-1], dtype="u8", out=self._sum[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self._sum[stop] - self._sum[start]) * self._down[start]

    def each(self, size: int, start: int, stop: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` numbers that begin from ``start`` to before ``stop``."""
        return (self._sum[start + size:stop + size] - self._sum[start:stop]) * self._down[start:stop]


#: Random numbers for the 256 byte values and two odd bases, from a fixed seed.
_RNG = np.random.default_rng(20240607)
BYTES = _RNG.integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD1B54A32D192ED03)
