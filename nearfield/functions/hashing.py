"""FNV-1a with 64 bits, on columns and on numpy arrays.

Results are bigint with the bits of the unsigned value. The prime is 2**40 + 435, so products are put together from
halves and never overflow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
OFFSET = 14695981039346656037
PRIME = 1099511628211

_LOW = 0xFFFFFFFF


def _times_prime(h: Column) -> Column:
    low = h.bitwiseAND(F.lit(_LOW)) * 435
    high = F.shiftrightunsigned(h, 32) * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFF)), 8)
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def fnv1a64(octets: Column) -> Column:
    """Hash of an array of byte values."""
    return F.aggregate(octets, F.lit(OFFSET - (1 << 64)).cast("long"), lambda h, b: _times_prime(h.bitwiseXOR(b.cast("long"))))


def fnv1a64_long(value: Column) -> Column:
    """Hash of the eight little-endian bytes of a bigint."""
    v = value.cast("long")
    return fnv1a64(F.array(*[F.shiftrightunsigned(v, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]))


def fnv1a64_string(value: Column) -> Column:
    """Hash of the UTF-8 bytes of a string."""
    octets = F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit(".."), F.lit(0))
    return fnv1a64(F.transform(octets, lambda x: F.conv(x, 16, 10).cast("long")))


def vnode_key(shard: Column, vnode: Column) -> Column:
    return F.shiftleft(shard.cast("long"), 32) + vnode.cast("long")


def unsigned_text(h: Column) -> Column:
    """Decimal digits of the unsigned value."""
    return F.conv(F.hex(h), 16, 10)


def fnv_long_array(values: np.ndarray) -> np.ndarray:
    v, h = values.astype(np.uint64), np.full(len(values), OFFSET, np.uint64)
    for i in range(8):
        h = (h ^ ((v >> np.uint64(8 * i)) & np.uint64(255))) * np.uint64(PRIME)
    return h


def fnv_text(value: str) -> int:
    h = OFFSET
    for b in value.encode():
        h = (h ^ b) * PRIME % (1 << 64)
    return h
