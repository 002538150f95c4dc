"""Fixed-width bit packing of token ids.

A block is a 24-byte header (magic, bits per id, number of ids) and the ids at ``bits`` each, little-endian, without gaps.
Id k starts at bit k * bits, so any range is read from its own bytes alone.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"HXBITS01"
_HEADER = struct.Struct("<8sQQ")


def bits_for(largest: int) -> int:
    """Bits that hold 0 .. ``largest``."""
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill ``bits`` bytes; each of those bytes is an OR of shifted id columns, for all groups of eight at once."""
    n = len(ids)
    if not 1 <= bits <= 32:
        raise ValueError("1 to 32 bits")
    if n and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id needs more than {bits} bits")
    head = _HEADER.pack(MAGIC, bits, n)
    if bits in (8, 16, 32):
        return head + ids.astype(f"<u{bits // 8}").tobytes()
    eights = np.zeros((-(-n // 8), 8), np.uint64)
    eights.ravel()[:n] = ids
    out = np.zeros((len(eights), bits), np.uint8)
    for b in range(bits):
        for i in range(8 * b // bits, min(7, (8 * b + 7) // bits) + 1):
            shift = 8 * b - i * bits
            part = eights[:, i] >> np.uint64(shift) if shift >= 0 else eights[:, i] << np.uint64(-shift)
            out[:, b] |= (part & np.uint64(255)).astype(np.uint8)
    return head + out.tobytes()[: -(-n * bits // 8)]


def unpack(block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start .. stop of a block as uint32."""
    magic, bits, n = _HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a packed block")
    start, stop, _ = slice(start, stop).indices(n)
    if stop <= start:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        wide = bits // 8
        return np.frombuffer(block, f"<u{wide}", stop - start, _HEADER.size + start * wide).astype(np.uint32)
    at = np.arange(start, stop, dtype=np.int64) * bits
    low = int(at[0]) >> 3
    raw = np.frombuffer(block, np.uint8, offset=_HEADER.size + low)[: (int(at[-1]) + bits + 7 >> 3) - low]
    raw = np.concatenate([raw, np.zeros(5, np.uint8)]).astype(np.uint64)
    where = (at >> 3) - low
    value = raw[where]
    for k in range(1, 5):
        value |= raw[where + k] << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
