"""Hashes and comparisons of byte spans, eight bytes at a time for all spans at once.

A span's hash chains its 8-byte lanes and its length through a mixing function that is not linear in the
bytes, so texts built to cancel out in a polynomial do not collide. Hashes of two seeds are independent.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Spans of more bytes are hashed one by one.
LONG = 512

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of ``x`` spread over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, view: np.ndarray | None = None
) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; ``view`` saves making the :func:`lanes` of ``data``."""
    view, length = lanes(data) if view is None else view, end - start
    out = mixed(length.astype(np.uint64) * _ODD + np.uint64(seed))
    at = np.flatnonzero((length > 0) & (length <= LONG))
    place, left = start[at], length[at]
    while len(at):
        lane = view[place] & _MASKS[np.minimum(left, 8)]
        out[at] = mixed((out[at] ^ lane) * _ODD + np.uint64(seed))
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(length > LONG).tolist():
        digest = blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def equal_spans(
    data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, length: np.ndarray
) -> np.ndarray:
    """Whether spans of ``length`` bytes hold the same bytes in ``data`` and in ``other``."""
    left_view, right_view = lanes(data), lanes(other)
    out = np.ones(len(start), bool)
    at, a, b, left = np.arange(len(start)), start, other_start, length
    while len(at):
        mask = _MASKS[np.minimum(left, 8)]
        same = (left_view[a] & mask) == (right_view[b] & mask)
        out[at[~same]] = False
        more = same & (left > 8)
        at, a, b, left = at[more], a[more] + 8, b[more] + 8, left[more] - 8
    return out


def first_bytes(view: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` bytes, at most 8, of each place of :func:`lanes`."""
    return view & _MASKS[size]


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end, one range after the other."""
    length = end - start
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(int(length.sum()))
