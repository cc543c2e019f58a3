"""Vectorized word and shingle hashes over UTF-8 buffers.

A word is a run of bytes none of which is a separator.  Every word gets a
64-bit hash from a prefix sum of byte values times powers of an odd base, so a
batch of texts costs a handful of numpy passes whatever its word count.
"""

from __future__ import annotations

import numpy as np

#: Separators of plain words: ASCII white space, [\t-\r ].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of bare words: all of ASCII but letters and digits.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = [not chr(i).isalnum() for i in range(128)]

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.uint64(pow(base, m, 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers[0][:n], _powers[1][:n]


def _hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[buf] * power[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _pieces(text: bytes, separator: np.ndarray):
    """Slices of at most _CHUNK bytes, cut at separators wherever one is in reach."""
    at, buf = 0, np.frombuffer(text, np.uint8)
    while len(buf) - at > _CHUNK:
        gaps = np.flatnonzero(separator[buf[at : at + _CHUNK]])
        if not len(gaps):
            gaps = np.flatnonzero(separator[buf[at:]])[:1]
            if not len(gaps):
                break
        yield buf[at : at + gaps[-1] + 1]
        at += int(gaps[-1]) + 1
    yield buf[at:]


def word_hashes(texts: list[str], separator: np.ndarray = SPACE, lower: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets): words of texts[i] are hashes[offsets[i]:offsets[i + 1]].

    With prefixes, a row of hashes for each word: its own and those of its first
    so many bytes, marked by length (of the whole word where it is shorter).
    """
    values = _VALUES
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    counts = np.zeros(len(texts) + 1, np.int64)
    found: list[np.ndarray] = []
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owners, size
        if size:
            buf = np.concatenate(held)
            edge = np.cumsum([len(x) for x in held])
            word = ~separator[buf]
            before = np.empty(len(buf), bool)
            before[0] = False
            before[1:] = word[:-1]
            before[edge[:-1][edge[:-1] < len(buf)]] = False
            after = np.empty(len(buf), bool)
            after[-1] = False
            after[:-1] = word[1:]
            after[edge[edge > 0] - 1] = False
            starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
            own = _hash_runs(buf, starts, ends, values)
            if prefixes:
                cut = [_hash_runs(buf, starts, np.minimum(ends, starts + n), values) ^ np.uint64(n) for n in prefixes]
                own = np.stack([own, *cut], axis=1)
            found.append(own)
            per = np.bincount(np.searchsorted(edge, starts, side="right"), minlength=len(held))
            np.add.at(counts, np.asarray(owners) + 1, per[: len(held)])
        held, owners, size = [], [], 0

    for i, t in enumerate(texts):
        for piece in _pieces(t.encode("utf-8", "surrogatepass"), separator):
            if not len(piece):
                continue
            if size and size + len(piece) > _CHUNK:
                flush()
            held.append(piece)
            owners.append(i)
            size += len(piece)
    flush()
    none = np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
    return (np.concatenate(found) if found else none), np.cumsum(counts)


_STEPS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of k words; a text of
    fewer words (but at least one) has the one shingle of all of them."""
    words, offsets = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * _STEPS[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = (words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
