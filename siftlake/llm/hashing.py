"""Vectorised polynomial hashes of all windows of many texts at once (NumPy, modulo 2**64)."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all bits; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _BASE
    return h ^ (h >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() hashes any window."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power("up", len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the windows [start, end); equal windows hash alike wherever they stand."""
    return mix((sums[end] - sums[start]) * _power("down", len(sums))[start])


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined texts, and the offsets where each text begins (and the last ends)."""
    joined = "".join(texts)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), at


def chunks(ids: list, texts: list, limit: int = 1 << 21):
    """(ids, texts) in pieces of about `limit` characters; null texts are left out."""
    some_ids, some, size = [], [], 0
    for i, t in zip(ids, texts):
        if t is None:
            continue
        some_ids.append(i)
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some_ids, some
            some_ids, some, size = [], [], 0
    if some:
        yield some_ids, some
