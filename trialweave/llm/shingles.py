"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes other than space and 09-0D; A-Z count as a-z. Equal words
have equal hashes; different ones collide with odds of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are hashed together until they have so many bytes; one longer text goes alone.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE[_SPACE] = 0
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, 256) - 1, _BASE))))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over the whole word (multiply and shift, in place)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts' bytes in runs of about CHUNK_BYTES, each with the index of its first text."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        b = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if run and size + len(b) > CHUNK_BYTES:
            yield first, run
            first, run, size = i, [], 0
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): text k has the words bounds[k]:bounds[k+1]."""
    b = np.frombuffer(b"\n".join(run).lower() + b"\n", np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    ends_of_texts = np.cumsum([len(x) + 1 for x in run])
    bounds = np.concatenate(([0], np.searchsorted(starts, ends_of_texts)))
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    reach = np.diff(np.concatenate((starts, [len(b)])))
    place = np.arange(starts[0], len(b)) - np.repeat(starts, reach)
    value = _BYTE[b[starts[0] :]] * _power(int((ends - starts).max()) + int(reach.max()))[place]
    return mix(np.add.reduceat(value, starts - starts[0])), bounds


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of x, ascending (by sorting: faster here than np.unique's hash table)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for the whole of a shorter text; none without words."""
    for _, run in chunks(texts):
        words, bounds = word_hashes(run)
        total = np.zeros(len(words), np.uint64)
        for k in range(width):
            total[: len(words) - k] += words[k:] * _PLACE[k]
        whole = mix(total.copy())
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            n = hi - lo
            if n >= width:
                yield distinct(whole[lo : hi - width + 1])
            elif n:
                parts = np.append(words[lo:hi] * _PLACE[:n], np.array([n], np.uint64) * _PLACE[15:])
                yield mix(np.add.reduce(parts, keepdims=True))
            else:
                yield np.empty(0, np.uint64)


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingle hashes; equal sets have equal digests."""
    x = mix(hashes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))
    d = mix(np.add.reduce(x, keepdims=True) + np.array([len(x)], np.uint64) * _BASE)
    return int(d.view(np.int64)[0])
