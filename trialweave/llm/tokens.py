"""Ids of whole texts, each distinct piece of text encoded once.

Vocabularies split a text before they merge anything, so the ids of a text are those of
its pieces in turn, if it is cut only where the split has a bound whatever stands around:

* between a Latin letter and ASCII punctuation other than an apostrophe;
* before a space between two characters that aren't white (byte-level vocabularies, where
  the space belongs to what follows), or before any space (those that drop white space).

Texts are cut with numpy, many at once; Arrow finds the distinct pieces, and a worker keeps
the ids of the pieces it has met.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a Python worker keeps, and bytes of text that are cut together.
MOST_PIECES, CHUNK_BYTES = 1_000_000, 4 << 20
#: Pieces that an encoder is given at a time.
LEARNED_TOGETHER = 8192

_LETTER, _POINT, _WHITE = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_POINT[ord("'")] = False
_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: Two-byte letters in UTF-8: U+00C0 to U+017F but for the signs U+00D7 and U+00F7, which end as two others do.
_LATIN, _LATIN_END = np.zeros(256, bool), np.zeros(256, bool)
_LATIN[0xC3:0xC6] = _LATIN_END[0x80:0xC0] = True
_LATIN_END[[0x97, 0xB7]] = False
#: How white characters beyond ASCII begin in UTF-8 (U+0085, U+00A0, U+1680, U+2000.., U+205F, U+3000).
_FAR_WHITE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def cuts(raw: bytes, spaced: bool) -> np.ndarray:
    """Where raw can be cut (but for its start and end). spaced: a space belongs to what follows."""
    b = np.frombuffer(raw, np.uint8)
    before, after = b[:-1], b[1:]
    letter = _LETTER[before]
    letter[1:] |= _LATIN[b[:-2]] & _LATIN_END[b[1:-1]]
    cut = letter & _POINT[after]
    if not spaced:
        return np.flatnonzero(cut | (after == 32) | (after == 10)) + 1
    unsure = _WHITE.copy()
    if any(x in raw for x in _FAR_WHITE):
        unsure[128:] = True
    sure = ~unsure[b]
    cut[:-1] |= (b[1:-1] == 32) & sure[:-2] & sure[2:]
    return np.flatnonzero(cut) + 1


def slices(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of about ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most, "right")))
        yield start, stop
        start = stop


def flat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] numbers), start[1], ..."""
    end = np.cumsum(length)
    n = int(end[-1]) if len(end) else 0
    kind = np.int32 if n < 2**31 and (not len(start) or start.max() < 2**30) else np.int64
    return np.repeat((start - end + length).astype(kind), length) + np.arange(n, dtype=kind)


def _bytes_of(values: pa.BinaryArray) -> list[bytes]:
    """values.to_pylist(), without a scalar for each value."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(at, at[1:])]


class PieceEncoder:
    """encode_many gives the ids of some pieces of text (UTF-8)."""

    def __init__(self, encode_many: Callable[[list[bytes]], Iterable[list[int]]], spaced: bool, lower: bool):
        self.encode_many, self.spaced, self.lower = encode_many, spaced, lower
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces."""
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0
        self.start = np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        for lo in range(0, len(pieces), LEARNED_TOGETHER):
            some = pieces[lo : lo + LEARNED_TOGETHER]
            got = list(self.encode_many(some))
            length = np.fromiter(map(len, got), np.int64, len(got))
            n, known = int(length.sum()), len(self.known)
            while self.used + n > len(self.flat):
                self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
            while known + len(some) + 1 > len(self.start):
                self.start = np.concatenate((self.start, np.empty_like(self.start)))
            self.flat[self.used : self.used + n] = np.fromiter(chain.from_iterable(got), "<u4", n)
            self.start[known + 1 : known + 1 + len(some)] = self.used + np.cumsum(length)
            self.used += n
            self.known.update(zip(some, range(known, known + len(some))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): text k has ids[bounds[k]:bounds[k+1]]. A null text counts as empty."""
        raws = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"".join(raws)
        text_ends = np.cumsum([len(r) for r in raws])
        if not raw:
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        if self.lower:
            raw = raw.lower()
        edge = np.zeros(len(raw) + 1, bool)
        edge[0] = True
        edge[cuts(raw, self.spaced)] = True
        edge[text_ends] = True
        offsets = np.flatnonzero(edge).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        distinct = _bytes_of(pieces.dictionary)
        if len(self.known) + len(distinct) > MOST_PIECES and len(self.known) > MOST_PIECES // 2:
            self.clear()
        new = [p for p in distinct if p not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        first, length = self.start[place], self.start[place + 1] - self.start[place]
        ends = np.concatenate(([0], np.cumsum(length)))
        return self.flat[flat_ranges(first, length)], np.concatenate(([0], ends[np.searchsorted(offsets, text_ends)]))


@lru_cache(maxsize=4)
def tokenizer(path: str, spaced: bool) -> PieceEncoder:
    """The encoder of a file of the tokenizers library; one for each worker and file, kept from task to task.

    spaced: a byte-level vocabulary; otherwise one that drops white space and case.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode_many(pieces):
        return [e.ids for e in library.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]

    return PieceEncoder(encode_many, spaced, not spaced)


def forget_tokenizers() -> None:
    """Gives up the encoders that this worker keeps, and their vocabularies."""
    tokenizer.cache_clear()
