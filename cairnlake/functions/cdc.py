"""Content-defined chunk boundaries: FastCDC with normalised chunking (level 1), vectorised.

The rolling hash h = (h << 1) + gear[byte] starts anew `min` bytes into each chunk; a chunk ends before the byte at which h has no
bit of a mask in common: the harder mask before `avg` bytes, the easier one from there, `max` at the latest. As h forgets a byte
after 64 shifts, the hash at every offset is computed at once from its 64 last bytes; only the first 64 offsets after a restart see
fewer. Bytes are taken in pairs, so an odd last byte never ends a chunk. The gear value of byte b is the first 8 bytes of the MD5 of 64 bytes b.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np

from ..schema import ChunkParams

U64 = np.uint64
#: The mask with k effective bits stands at position k; those below 5 are unused.
MASKS = [
    0, 0, 0, 0, 0,
    0x0000000001804110, 0x0000000001803110, 0x0000000018035100, 0x0000001800035300, 0x0000019000353000,
    0x0000590003530000, 0x0000D90003530000, 0x0000D90103530000, 0x0000D90303530000, 0x0000D90313530000,
    0x0000D90F03530000, 0x0000D90303537000, 0x0000D90703537000, 0x0000D90707537000, 0x0000D91707537000,
    0x0000D91747537000, 0x0000D91767537000, 0x0000D93767537000, 0x0000D93777537000, 0x0000D93777577000,
    0x0000DB3777577000,
]


@functools.cache
def gear() -> np.ndarray:
    return np.array([int.from_bytes(hashlib.md5(bytes([b]) * 64, usedforsecurity=False).digest()[:8], "big") for b in range(256)], U64)


def masks(params: ChunkParams) -> tuple[int, int]:
    """(before avg, from avg on)."""
    bits = round(math.log2(params.avg))
    if not 5 <= bits - 1 <= bits + 1 < len(MASKS):
        raise ValueError(f"average chunk size {params.avg} is out of range")
    return MASKS[bits + 1], MASKS[bits - 1]


def _hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, started with the first."""
    h = gear()[data]
    for k in range(6):
        step = 1 << k
        if len(h) <= step:
            break
        h = np.concatenate([h[:step], h[step:] + (h[:-step] << U64(step))])
    return h


def cuts(data: bytes, params: ChunkParams) -> list[int]:
    """End offsets of the chunks of data."""
    n, buf = len(data), np.frombuffer(data, np.uint8)
    hard, easy = (U64(m) for m in masks(params))
    h = _hashes(buf) if n > params.min else np.zeros(0, U64)
    at_hard, at_easy = np.flatnonzero(h & hard == 0), np.flatnonzero(h & easy == 0)

    def first(at: np.ndarray, mask: np.uint64, fresh: np.ndarray, begin: int, lo: int, hi: int) -> int | None:
        """The first end in [lo, hi): within 64 bytes of begin by the fresh hash, beyond by the common one."""
        near = np.flatnonzero(fresh[max(lo - begin, 0) : max(hi - begin, 0)] & mask == 0)
        if len(near):
            return lo + int(near[0])
        k = int(np.searchsorted(at, max(lo, begin + 64)))
        return int(at[k]) if k < len(at) and at[k] < hi else None

    out, start = [], 0
    while start < n:
        left = n - start
        if left <= params.min:
            out.append(n)
            break
        size = min(left, params.max)
        begin = start + params.min
        middle = start + min(params.avg, left) // 2 * 2
        last = start + size // 2 * 2
        fresh = _hashes(buf[begin : begin + 64])
        end = first(at_hard, hard, fresh, begin, begin, middle)
        if end is None:
            end = first(at_easy, easy, fresh, begin, max(begin, middle), last)
        start = start + size if end is None else end
        out.append(start)
    return out
