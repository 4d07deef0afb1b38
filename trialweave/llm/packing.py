"""Best-fit packing of tokenised documents into sequences, by swap-based local search.

Documents become pieces: those longer than a sequence are cut, with the short piece first.
Short pieces are dealt over shards. A shard places them best-fit, longest first, and then
improves the bins that aren't full: starting at the emptiest it moves a piece to another
bin, exchanges one piece for a shorter one there, or two for one, always so that the sum of
squared fills grows, until a bin is empty or nothing helps. The pieces of bins that stay
underfull are dealt anew to a next level, over as many shards as they fill, while levels fill
bins; when one fills few (short pieces are scarce, say), its underfull bins are sequences as
they are. No shard of any level holds more than about ``SHARD_PIECES``. Full pieces are
sequences by themselves.

Defined cases: a null or empty text is its end id alone. Repeated rows are packed each for
itself. A null doc_id is kept. Other columns of the input are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, released, written
from .tokens import forget_tokenizers, slices, tokenizer

#: Short pieces of a shard, about.
SHARD_PIECES = 16_384
#: Sequence ids that a shard has: more than the pieces that hashing deals to one.
SHARD_IDS = 1 << 20
#: What a task that keeps nothing (keep=False) cuts at a time, in bytes of text, and the pieces of text that it remembers meanwhile.
SMALL_CHUNK, FEW_PIECES = 1 << 19, 100_000
#: A level whose full bins hold a smaller share of its pieces is the last one.
LEAST_FILLED = 0.125

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path, size, end, keep):
    tail = np.array([end], "<u4").tobytes()

    @released
    def run(batches):
        encoder = tokenizer(path, True)
        release()  # what reading the vocabulary took
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(texts) if keep else slices(texts, SMALL_CHUNK):
                if not keep and len(encoder.known) > FEW_PIECES:
                    encoder.clear()
                ids, bounds = encoder.encode(texts[lo:hi].to_pylist())
                raw, rows = memoryview(ids.tobytes()), []
                for doc, a, b in zip(docs[lo:hi], bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = b - a + 1
                    at, stop, k = 0, n % size or size, 0
                    while at < n:
                        crc = zlib.crc32(raw[4 * (a + at) : 4 * min(a + stop, b)])
                        if stop == n:
                            crc = zlib.crc32(tail, crc)
                        rows.append((doc, k, at, stop - at, crc))
                        at, stop, k = stop, stop + size, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            del docs, texts, batch
            if not keep:
                release()
        if not keep:
            del encoder
            forget_tokenizers()

    return run


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 2, keep: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32.

    keep: workers remember pieces of text from one task to the next, which is faster; without, a task's memory ends with it,
    the vocabulary's too, and it cuts less text at a time and remembers fewer pieces.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path, size, end, keep), _PIECE)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of indexes, longest first, each to the bin that it leaves the least room in."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            bins[k].append(i)
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, k = size, len(bins)
            bins.append([i])
        if r > n:
            room[r - n].append(k)
            open_rooms |= 1 << (r - n)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins with fewer or as many members lists, no worse by the sum of squared fills.

    Each step takes 2*d*(A-B)+2*d*d > 0 more squared fill from moving d tokens from a bin
    with fill B to one with fill A >= B, so the search ends.
    """
    bins = [list(b) for b in bins]
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    at = np.concatenate([np.full(len(b), k) for k, b in enumerate(bins)]) if bins else np.empty(0, int)
    item = np.concatenate([np.array(b, int) for b in bins]) if bins else np.empty(0, int)
    slot = {i: s for s, i in enumerate(item.tolist())}
    size_of = lengths[item]

    def put(i, k):
        bins[k].append(i)
        at[slot[i]] = k

    def step(b: int) -> bool:
        usable = (fill >= fill[b]) & (fill < size)
        usable[b] = False
        if not usable.any():
            return False
        room = size - fill
        mine = sorted(bins[b], key=lambda i: -lengths[i])
        for i in mine:  # a move, to where it leaves the least room
            to = np.flatnonzero(usable & (room >= lengths[i]))
            if len(to):
                k = to[np.argmin(room[to])]
                bins[b].remove(i)
                put(i, k)
                fill[b] -= lengths[i]
                fill[k] += lengths[i]
                return True
        open_items = usable[at]
        for give in [(i,) for i in mine] + [(mine[x], mine[y]) for x in range(len(mine)) for y in range(x + 1, len(mine))]:
            more = sum(int(lengths[i]) for i in give) - size_of
            fits = np.flatnonzero(open_items & (more > 0) & (more <= room[at]))
            if len(fits):
                s = fits[np.argmin(room[at[fits]] - more[fits])]
                k, j, d = at[s], int(item[s]), int(more[s])
                bins[k].remove(j)
                for i in give:
                    bins[b].remove(i)
                    put(i, k)
                put(j, b)
                fill[b] -= d
                fill[k] += d
                return True
        return False

    moved = True
    while moved:
        moved = False
        for b in np.argsort(fill, kind="stable").tolist():
            while bins[b] and step(b):
                moved = True
    return [b for b in bins if b]


def _pack(size, last, first_shard):
    """first_shard: the shards of the levels before, so that no two levels share sequence ids."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins = best_fit(lengths, size)
        fill = np.array([lengths[b].sum() for b in bins])
        under = [b for b, f in zip(bins, fill) if f < size]
        bins = [b for b, f in zip(bins, fill) if f == size] + local_search(under, lengths, size)
        order = np.concatenate([np.array(b) for b in bins])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = pdf.iloc[order].reset_index(drop=True)
        n = out["length"].to_numpy()
        end = np.cumsum(n)
        first = np.concatenate(([True], number[1:] != number[:-1]))
        out["offset"] = end - n - np.repeat((end - n)[first], np.bincount(number))
        out["sequence_id"] = ((first_shard + int(key[0])) * SHARD_IDS + number) * 2 + 1
        full = np.bincount(number, n) == size
        out["done"] = last | full[number]
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "done"]]

    return run


def packed(parts: DataFrame, size: int = 1024, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """parts (as of pieces()) with sequence_id and offset: each sequence holds at most ``size`` tokens without a gap."""
    parts = written(parts, "pieces")
    full = parts.where(F.col("length") == size).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    rest = parts.where(F.col("length") < size)
    left = rest.count()
    first_shard, levels = 0, [full]
    schema = f"{_PIECE}, sequence_id long, offset long, done boolean"
    while left:
        shards = -(-left // shard_pieces)
        # By a hash of the row's place: neither short partitions nor repeated pieces pile up in one shard.
        shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
        done = written(rest.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack(size, shards == 1, first_shard), schema), "packed")
        open_pieces = done.where("not done")
        more = open_pieces.count()
        if left - more < LEAST_FILLED * left:
            levels.append(done.drop("done"))
            break
        levels.append(done.where("done").drop("done"))
        rest, left, first_shard = open_pieces.select(*parts.columns), more, first_shard + shards
    return reduce(DataFrame.unionByName, levels)
