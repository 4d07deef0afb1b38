"""Token ids as binary blocks, compressed by Re-Pair.

The ids of all documents, in ascending order of doc_id, are stored in blocks. Within a
block, frequent pairs of neighbouring ids are replaced by nonterminals, round after round,
until no pair is frequent or 16-bit symbols run out. A pair never spans two documents, so
any document can be decoded alone: a block stores its rules, the length each rule expands
to, and for each document its number of symbols and of ids. By the lengths, any span of a
document's ids is found and decoded without expanding the symbols before it.

The file format is a table of blocks that Spark writes (Parquet):

=============  ===========================================================
run, block     place in the order: runs of documents, blocks within a run
doc_ids        array<bigint>, ascending, nulls first
n_tokens       number of ids of each document, 32-bit little-endian
n_symbols      number of symbols of each document, 32-bit
symbols        16-bit symbols; those from ``base`` on are rules
rules          pairs of 16-bit symbols, in order; a rule uses earlier ones
expansions     length in ids of each rule, 32-bit
base, tokens   first nonterminal; ids in the block
=============  ===========================================================

Defined cases: a null or empty text is its end id alone. Rows of one doc_id follow each
other in order of their texts' first 32 characters, then of the texts' hashes; null doc_ids
come first. No id or text, however often it occurs, is bound to one run. Other columns of
the input are not read.
An empty table gives a table without blocks.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, tables_folder
from .tokens import slices, tokenizer

#: Ids in a block, about; a longer document is a block by itself.
BLOCK_TOKENS = 1 << 18
#: A pair that occurs so often is replaced (a rule takes 8 bytes and saves 2 each time); so many pairs a round at most.
FREQUENT, A_ROUND = 5, 2048
#: Runs of neighbouring documents for each shuffle partition.
RUNS = 2

BLOCKS = "run int, block int, doc_ids array<bigint>, n_tokens binary, n_symbols binary, symbols binary, rules binary, expansions binary, base int, tokens long"


def compress(ids: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, whether each ends a document, rules as an (n, 2) array) for ids below base; last marks documents' ends."""
    seq, last, rules = ids.astype(np.uint32), last.copy(), []
    top = base
    cell = np.zeros(1 << 18, np.int32)
    while top < 65536 and len(seq) > 1:
        key = (seq[:-1] << np.uint32(16)) | seq[1:]
        inner = ~last[:-1]
        pairs = np.sort(key[inner])
        if not len(pairs):
            break
        start = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        count = np.diff(np.append(start, len(pairs)))
        often = np.flatnonzero(count >= FREQUENT)
        most = min(A_ROUND, 65536 - top)
        if len(often) > most:
            often = often[np.argpartition(-count[often], most - 1)[:most]]
        if not len(often):
            break
        # Chosen pairs by a small table of cells: of two in one cell, the more frequent one is replaced in this round.
        often = often[np.argsort(count[often], kind="stable")]
        chosen = pairs[start[often]]
        home = lambda k: (k * np.uint32(2654435769)) >> np.uint32(14)
        cell[:] = -1
        cell[home(chosen)] = np.arange(len(chosen))
        at = cell[home(key)]
        match = inner & (at >= 0)
        match[match] = chosen[at[match]] == key[match]
        # Of overlapping matches, every other one from the left.
        where = np.flatnonzero(match)
        fresh = np.concatenate(([True], np.diff(where) > 1))
        run = np.flatnonzero(fresh)
        offset = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
        where = where[offset % 2 == 0]
        used, rule = np.unique(at[where], return_inverse=True)
        rules.append(np.stack((chosen[used] >> np.uint32(16), chosen[used] & np.uint32(0xFFFF)), 1))
        seq[where] = top + rule
        last[where] = last[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last = seq[keep], last[keep]
        top += len(used)
    return seq.astype(np.uint16), last, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = symbols.astype(np.int32)
    while True:
        whole = seq >= base
        if not whole.any():
            return seq.astype("<u4")
        at = np.cumsum(1 + whole) - 1 - whole
        pair = rules[seq[whole] - base]
        seq = np.repeat(seq, 1 + whole)
        seq[at[whole]], seq[at[whole] + 1] = pair[:, 0], pair[:, 1]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """The number of ids of each rule."""
    n = np.zeros(len(rules), np.int64)
    while len(n) and not n.all():
        parts = np.where(rules < base, 1, n[np.maximum(rules.astype(np.int64) - base, 0)])
        n = np.where(parts.all(1), parts.sum(1), 0)
    return n


def decode_document(block, k: int) -> np.ndarray:
    """The ids of document k of a block (a row of the format), without decoding the others."""
    counts = np.frombuffer(block["n_symbols"], "<u4")
    lo = int(counts[:k].sum())
    symbols = np.frombuffer(block["symbols"], "<u2")[lo : lo + int(counts[k])]
    return expand(symbols, np.frombuffer(block["rules"], "<u2").reshape(-1, 2), block["base"])


def decode_span(block, k: int, start: int, stop: int) -> np.ndarray:
    """The ids start:stop of document k of a block; only symbols that reach into the span are expanded."""
    counts = np.frombuffer(block["n_symbols"], "<u4")
    lo = int(counts[:k].sum())
    symbols = np.frombuffer(block["symbols"], "<u2")[lo : lo + int(counts[k])]
    length = np.append(np.ones(block["base"], np.int64), np.frombuffer(block["expansions"], "<u4"))[symbols]
    ends = np.cumsum(length)
    start, stop = max(0, start), min(stop, int(ends[-1]))
    if start >= stop:
        return np.empty(0, "<u4")
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    skipped = int(ends[first] - length[first])
    return expand(symbols[first : last + 1], np.frombuffer(block["rules"], "<u2").reshape(-1, 2), block["base"])[start - skipped : stop - skipped]


def _spans(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_span(row, row["k"], row["start"], row["stop"])
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), pa.array([row["start"]], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])


def read_spans(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<bigint>) of spans (doc_id, start, stop: places among a document's ids, cut to what there is)."""
    at = blocks.select("run", "block", F.posexplode("doc_ids").alias("k", "doc_id"))
    wanted = spans.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).join(at, "doc_id")
    held = wanted.join(blocks.select("run", "block", "n_symbols", "symbols", "rules", "expansions", "base"), ["run", "block"])
    return held.mapInArrow(_spans, "doc_id long, start long, ids array<bigint>")


def _block(run, number, docs, held, base):
    ids = np.concatenate(held)
    n = np.array([len(h) + 1 for h in held[::2]], "<u4")
    last = np.zeros(len(ids), bool)
    last[np.cumsum(n, dtype=np.int64) - 1] = True
    symbols, ends, rules = compress(ids, last, base)
    n_symbols = np.diff(np.concatenate(([-1], np.flatnonzero(ends)))).astype("<u4")
    return (run, number, docs, n.tobytes(), n_symbols.tobytes(), symbols.astype("<u2").tobytes(), rules.astype("<u2").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), base, len(ids))


_ARROW = pa.schema([("run", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.binary()), ("n_symbols", pa.binary()), ("symbols", pa.binary()), ("rules", pa.binary()), ("expansions", pa.binary()), ("base", pa.int32()), ("tokens", pa.int64())])


def _encode(path, end, base):
    tail = np.array([end], "<u4")

    def run(batches):
        encoder, at = tokenizer(path, False), TaskContext.get().partitionId()
        number, docs, held, size = 0, [], [], 0

        def out():
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, _block(at, number, docs, held, base)))], _ARROW)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(texts):
                got, bounds = encoder.encode(texts[lo:hi].to_pylist())
                for doc, a, b in zip(ids[lo:hi], bounds[:-1].tolist(), bounds[1:].tolist()):
                    if held and size + b - a > BLOCK_TOKENS:
                        yield out()
                        number, docs, held, size = number + 1, [], [], 0
                    docs.append(doc)
                    held += (got[a:b], tail)
                    size += b - a + 1
        if held:
            yield out()

    return run


def blocks_of(docs: DataFrame, path: str, end: int = 2, base: int = 49_408) -> DataFrame:
    """The blocks of all documents (doc_id, text); path: a file of the tokenizers library with ids below base.

    A run is a partition by ranges of (doc_id, start of the text, its hash, a number of the row), so equal rows may part.
    Runs are numbered as they are computed: write the blocks once and read those.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = (F.asc_nulls_first("doc_id"), F.asc_nulls_first("head"), "hash", "row")
    dealt = docs.repartitionByRange(RUNS * shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(_encode(path, end, base), BLOCKS)


def write_blocks(docs: DataFrame, folder: str, path: str, end: int = 2, base: int = 49_408) -> None:
    blocks_of(docs, path, end, base).write.parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = expand(np.frombuffer(row["symbols"], "<u2"), np.frombuffer(row["rules"], "<u2").reshape(-1, 2), row["base"])
            n = np.frombuffer(row["n_tokens"], "<u4").astype(np.int64)
            ends = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([row[c]] * len(n), pa.int32()) for c in ("run", "block")] + [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["run", "block", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from blocks; start counts the ids of all before it."""
    sums = blocks.groupBy("run").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run: a few for each partition
    runs = sums.select("run", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("run_start"))
    within = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("run", "block", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("block_start")).join(runs, "run")
    docs = blocks.select("run", "block", "doc_ids", "n_tokens", "symbols", "rules", "base").mapInArrow(_decode, "run int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["run", "block"]).select("doc_id", (F.col("run_start") + F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end: int = 2, base: int = 49_408, folder: str | None = None) -> DataFrame:
    """Writes the blocks of docs to folder (one of its own in the shared folder by default) and reads the documents back."""
    spark = docs.sparkSession
    folder = folder or f"{tables_folder(spark)}/blocks-{uuid.uuid4().hex}"
    write_blocks(docs, folder, path, end, base)
    return read_documents(read_blocks(spark, folder))
