"""Variable-byte integers: cost expressions, and packing whole batches with numpy.

A value is written seven bits at a time, low bits first; the high bit of a byte says that more follow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 9


def vbyte_length(value: Column) -> Column:
    """Bytes of a non-negative value."""
    out = F.lit(MAX_BYTES)
    for n in range(MAX_BYTES - 1, 0, -1):
        out = F.when(value < F.lit(1 << (7 * n)), F.lit(n)).otherwise(out)
    return out.cast("long")


def vbyte_hex(value: Column) -> Column:
    """Lower-case hexadecimal digits of the encoded value; built-in expressions only."""
    parts = []
    for i in range(MAX_BYTES):
        low = F.shiftright(value, 7 * i).bitwiseAND(F.lit(127))
        more = F.shiftright(value, 7 * (i + 1)) > 0
        byte = F.lpad(F.lower(F.hex(F.when(more, low + 128).otherwise(low).cast("long"))), 2, "0")
        parts.append(byte if i == 0 else F.when(F.shiftright(value, 7 * i) > 0, byte).otherwise(F.lit("")))
    return F.concat(*parts)


def single_bytes(node: Column) -> Column:
    """Cost of a command that names one node."""
    return vbyte_length(node * 2)


def path_bytes(bottom: Column, steps: Column) -> Column:
    """Cost of a command that names a node and ``steps`` ancestors."""
    return vbyte_length(bottom * 2 + 1) + vbyte_length(steps)


def command_bytes(bottom: Column, steps: Column, is_path: Column) -> Column:
    return F.when(is_path, path_bytes(bottom, steps)).otherwise(single_bytes(bottom))


def pack_command(bottom: Column, is_path: Column) -> Column:
    return F.shiftleft(bottom, 1).bitwiseOR(is_path.cast("long"))


def command_node(value: Column) -> Column:
    return F.shiftright(value, 1)


def command_is_path(value: Column) -> Column:
    return value.bitwiseAND(F.lit(1)) == 1


def lengths(values: np.ndarray) -> np.ndarray:
    """Bytes of each value."""
    out = np.ones(len(values), dtype=np.int64)
    for n in range(1, MAX_BYTES):
        out += values >= (1 << (7 * n))
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values' bytes in a row, and the number of bytes of each."""
    values = np.asarray(values, dtype=np.int64)
    size = lengths(values)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    raw = (np.repeat(values, size) >> (7 * place)) & 127
    raw |= np.where(place < np.repeat(size, size) - 1, 128, 0)
    return raw.astype(np.uint8), size


def decode(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and the index of the byte behind each."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(ends[-1]) - np.repeat(starts, ends - starts)
    return np.add.reduceat((raw[: ends[-1]].astype(np.int64) & 127) << (7 * place), starts), ends
