"""Bloom filters as binary columns: bit b is bit ``b & 7`` of byte ``b >> 3``."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from arclog.functions import text as t

# Fixed values of the archive format.
TEXT_BITS = 8192
FIELD_BITS = 4096


def positions(token: Column, bits: int) -> Column:
    """The three bits of a token, in one pass over its bytes."""
    state = F.struct(F.lit(5381).cast("long").alias("a"), F.lit(2166136261).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
    cut = lambda x: x.bitwiseAND(F.lit(t.MASK))

    def step(h: Column, x: Column) -> Column:
        return F.struct(cut(h["a"] * 33 + x).alias("a"), cut(h["b"].bitwiseXOR(x) * 16777619).alias("b"), cut(x + h["c"] * 65599).alias("c"))

    return F.aggregate(t.byte_values(token), state, step, lambda h: F.array(h["a"] % bits, h["b"] % bits, h["c"] % bits))


def build(position: Column, bits: int) -> Column:
    """Aggregate: the filter with all given bits set; up to 32,768 bits."""
    return F.substring(F.bitmap_construct_agg(position), 1, bits // 8)


def bitmap(values: Iterable[bytes], bits: int) -> bytes:
    """The filter of some values, hashed side by side for each length."""
    by_length: dict[int, list[bytes]] = {}
    for value in values:
        by_length.setdefault(len(value), []).append(value)
    marks = np.zeros(bits, np.uint8)
    mask = np.uint64(t.MASK)
    for length, group in by_length.items():
        columns = np.frombuffer(b"".join(group), np.uint8).reshape(len(group), length).T.astype(np.uint64)
        a, b, c = (np.full(len(group), x, np.uint64) for x in (5381, 2166136261, 0))
        for x in columns:
            a, b, c = (a * 33 + x) & mask, ((b ^ x) * 16777619) & mask, (x + c * 65599) & mask
        for h in (a, b, c):
            marks[(h % bits).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def _has_bit(bloom: Column, bit: int) -> Column:
    byte = F.conv(F.hex(F.substring(bloom, (bit >> 3) + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(F.lit(1 << (bit & 7))) != 0


def has_all(bloom: Column, values: list[str], bits: int) -> Column:
    """Whether a filter may hold all of some constants: a conjunction of constant bit tests."""
    wanted = sorted({h % bits for v in values for h in t.py_hashes(v.encode())})
    return reduce(lambda a, b: a & b, [_has_bit(bloom, bit) for bit in wanted], F.lit(True))
