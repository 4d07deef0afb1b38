"""Byte-level BPE as a monoid: texts are encoded in halves whose ids are joined.

The ids of a concatenation follow from the ids of its parts but for a window around the
seam. Two neighbouring tokens are *stable* if their bytes together encode to just these
two; a sequence of tokens is the encoding of its bytes if and only if all neighbours in
it are stable (every token of the ranks encodes to itself; ``TreeEncoder`` checks that).
So a join re-encodes a window of k tokens on each side of the seam, and is done when the
window's ends are stable with the tokens outside it; until then the window doubles.

A match of the pattern is split in halves down to ``LEAF`` bytes, which are merged by rank;
a text's matches are its branches above. Decoding concatenates up the same tree.

Defined cases: a null or empty text has no ids. Repeated rows are kept. A null doc_id is
kept. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PieceEncoder, flat_ranges, slices

#: Bytes of a leaf of the tree.
LEAF = 8
#: Entries that a worker keeps of its leaves and of its pairs.
MOST = 200_000
_NONE = 1 << 62


class TreeEncoder:
    """ranks: token bytes to id, 0 for the first merge. pattern: what splits a text (regex module syntax)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.leaves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        if odd := [i for b, i in ranks.items() if self.merged(b) != (i,)]:
            raise ValueError(f"tokens that don't encode to themselves: {odd[:5]}")

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a few bytes by merging the pair of lowest rank, leftmost first, as long as there is one."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        at = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while at:
            low = min(at)
            if low == _NONE:
                break
            i = at.index(low)
            parts[i] += parts.pop(i + 1)
            del at[i]
            if i < len(at):
                at[i] = rank(parts[i] + parts[i + 1], _NONE)
            if i:
                at[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
        return tuple(self.ranks[p] for p in parts)

    def stable(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MOST:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """Ids of the bytes of a followed by those of b."""
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        k = 1
        while True:
            left, right = a[:-k], b[k:]
            window = self.merged(self.decode(a[-k:] + b[:k]))
            if (not left or self.stable(left[-1], window[0])) and (not right or self.stable(window[-1], right[0])):
                return left + window + right
            k *= 2

    def tree(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= LEAF:
            ids = self.leaves.get(piece)
            if ids is None:
                if len(self.leaves) > MOST:
                    self.leaves.clear()
                ids = self.leaves[piece] = self.merged(piece)
            return ids
        mid = len(piece) // 2
        return self.join(self.tree(piece[:mid]), self.tree(piece[mid:]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_piece(self, text: str) -> list[int]:
        """Ids of a text, match by match of the pattern."""
        ids: list[int] = []
        for match in self.find(text):
            piece = match.encode()
            whole = self.ranks.get(piece)
            ids += self.tree(piece) if whole is None else (whole,)
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def tree_encoder(path: str, pattern: str) -> TreeEncoder:
    return TreeEncoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def piece_encoder(path: str, pattern: str) -> PieceEncoder:
    """One for each worker, kept from task to task."""
    tree = tree_encoder(path, pattern)
    return PieceEncoder(lambda pieces: [tree.encode_piece(p.decode()) for p in pieces], True, False)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes after one another, and where each begins."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        tokens[i] = b
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens])))


def decoded(ids: np.ndarray, bounds: np.ndarray, path: str) -> tuple[bytes, np.ndarray]:
    """(bytes of all ids, bounds of each text's bytes): the concatenation of the tokens of each node of the tree."""
    flat, start = _token_bytes(path)
    length = start[ids + 1] - start[ids]
    ends = np.concatenate(([0], np.cumsum(length)))
    return flat[flat_ranges(start[ids], length)].tobytes(), ends[bounds]


def _encode(path, pattern):
    def run(batches):
        encoder = piece_encoder(path, pattern)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(texts):
                ids, bounds = encoder.encode(texts[lo:hi].to_pylist())
                back, back_bounds = decoded(ids.astype(np.int64), bounds, path)
                raw, back = memoryview(ids.tobytes()), memoryview(back)
                digest = lambda m, at: [hashlib.sha256(m[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi], pa.int64()), pa.array(np.diff(bounds)), pa.array(digest(raw, 4 * bounds)), pa.array(digest(back, back_bounds))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text); path: a file of ranks on each executor."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path, pattern):
    def run(batches):
        encoder = piece_encoder(path, pattern)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(texts):
                ids, bounds = encoder.encode(texts[lo:hi].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi], pa.int64()), lists], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ids(path, pattern), "doc_id long, ids array<int>")


def _texts(path, pattern):
    def run(batches):
        encoder = tree_encoder(path, pattern)
        for batch in batches:
            texts = [encoder.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows with ids; bytes that aren't UTF-8 become U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(path, pattern), "doc_id long, text string")
