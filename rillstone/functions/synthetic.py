"""Reproducible test data: vector components and payloads from plain integer recurrences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multiplier and increment of a 32-bit linear congruential generator, and splitmix64's step and multipliers.
LCG = (1_664_525, 1_013_904_223)
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_MASK = (1 << 64) - 1


def component(row: Column, column: Column) -> Column:
    """A float in [0, 1) with four decimals; rows and columns must keep the sum under 2**63."""
    mixed = row * F.lit(LCG[0]) + column * F.lit(LCG[1]) + F.lit(LCG[1])
    return ((mixed % 10_000).cast("float") / F.lit(10_000)).cast("float")


def vector(row: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda c: component(row, c))


def compressible(index: int, size: int) -> bytes:
    line = f'{{"sensor":"temperature","site":"rome","status":"ok","record":{index:08}}}\n'.encode()
    return (line * (size // len(line) + 1))[:size]


def incompressible(index: int, size: int) -> bytes:
    step, first, second = SPLITMIX
    state, out = (index + step) & _MASK, bytearray()
    while len(out) < size:
        state = (state + step) & _MASK
        state = (state ^ state >> 30) * first & _MASK
        state = (state ^ state >> 27) * second & _MASK
        state ^= state >> 31
        out += state.to_bytes(8, "little")
    return bytes(out[:size])
