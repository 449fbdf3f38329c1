"""Word shingles of whole texts as 64-bit hashes, by numpy over Arrow batches.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A text's shingles are its distinct
runs of ``width`` words; a text with fewer words has the whole run as its one shingle; one without words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_STEP, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)[_LOWER]
_BASE = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n - 1 modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, BLOCK + 4096), np.uint64(base)))))
    return _powers[base][:n]


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of each word. Worked in blocks that end at white space, so memory follows the words."""
    hashes, begins, lo = [], [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + BLOCK)
        while hi < len(raw) and not _SPACE[raw[hi]]:
            gap = np.flatnonzero(_SPACE[raw[hi : hi + BLOCK]])
            hi = hi + int(gap[0]) if len(gap) else min(len(raw), hi + BLOCK)
        block = raw[lo:hi]
        edge = np.diff(np.concatenate(([True], _SPACE[block], [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            up, down = _power(_BASE, len(block)), _power(pow(_BASE, -1, 1 << 64), len(block))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[block] * up)))
            hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP))
            begins.append(start + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles, ascending by both."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    h, at = words(raw)
    own = np.searchsorted(starts, at, "right") - 1
    count = np.bincount(own, minlength=len(texts))
    turns = mix(np.arange(1, width + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    n = max(0, len(h) - width + 1)
    s = sum((h[k : k + n] * turns[k] for k in range(1, width)), h[:n] * turns[0])
    fits = own[:n] == own[width - 1 :][:n]
    doc, s = [own[:n][fits]], [mix(s[fits])]
    first = np.concatenate(([0], np.cumsum(count)))
    for d in np.flatnonzero((count > 0) & (count < width)):
        part = h[first[d] : first[d + 1]]
        with np.errstate(over="ignore"):
            s.append(mix(np.array([sum((x * t for x, t in zip(part, turns, strict=False)), np.uint64(len(part)) * _STEP)], np.uint64)))
        doc.append(np.array([d]))
    doc, s = np.concatenate(doc), np.concatenate(s)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return doc[new], s[new]


_draws: dict[int, np.ndarray] = {}


def draws(bins: int) -> np.ndarray:
    """Row b: all bins in the order in which an empty bin b draws them, a random permutation for each b."""
    if bins not in _draws:
        at = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
        _draws[bins] = np.argsort(mix(mix(at + np.uint64(1)) * _STEP), axis=1)
    return _draws[bins]


def one_permutation(doc: np.ndarray, s: np.ndarray, n_docs: int, bins: int) -> np.ndarray:
    """Signatures (n_docs x bins, uint32) by one permutation, with optimal densification.

    The hash's leading bits are the bin, the smallest hash of a bin gives its value. An empty bin draws bins, in an
    order of its own that is the same for all texts, until one has a value: so it takes any of a text's full bins
    alike, independent of the other empty bins, however few are full. Texts without shingles keep zeros.
    """
    shift = np.uint64(64 - (bins.bit_length() - 1))
    place = (s >> shift).astype(np.int64)
    key = doc * bins + place
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    out, full = np.zeros(n_docs * bins, np.uint32), np.zeros(n_docs * bins, bool)
    out[key[head]] = (mix(s[head] + _STEP) >> np.uint64(32)).astype(np.uint32)
    full[key[head]] = True
    out, full = out.reshape(n_docs, bins), full.reshape(n_docs, bins)
    d, b = np.nonzero(~full & full.any(axis=1)[:, None])
    order = draws(bins)
    for attempt in range(bins):
        if not len(d):
            break
        draw = order[b, attempt]
        hit = full[d, draw]
        out[d[hit], b[hit]] = out[d[hit], draw[hit]]
        d, b = d[~hit], b[~hit]
    return out


def batches_of(texts: list[str], most: int) -> Iterator[tuple[int, list[bytes]]]:
    from .common import text_chunks

    raw = [t.encode() for t in texts]
    for lo, hi in text_chunks([len(t) for t in raw], most):
        yield lo, raw[lo:hi]
