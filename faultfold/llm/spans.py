"""Hashes of words and of runs of words, built on :mod:`faultfold.functions.spans`."""

from __future__ import annotations

import numpy as np

from faultfold.functions.spans import equal_spans, mixed, ranges, span_hashes

__all__ = ["equal_spans", "mixed", "ranges", "span_hashes", "window_hashes"]

_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values of ``hashes``, which are themselves mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= _ODD
        out += hashes[k : n + k]
    return mixed(out)
