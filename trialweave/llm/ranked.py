"""Ranked lexical search over a length-stratified index.

A document's length counts in its score only through its normaliser m, a whole number, so
documents of equal m make a *stratum*, in which a term's part of a score depends on its
frequency tf alone. The index keeps strata in blocks of documents: each block has the postings
of a term ordered by tf, so that an impact is computed once for each (term, tf), and the
largest tf of each term, which bounds what any of its documents can score.

A search visits blocks in order of these bounds: first, for each item, the ``FIRST`` blocks with
the largest; the scores found there are a threshold, and of the others only those blocks are
scored whose bound reaches it. Nothing that could be among the results is passed over, so
they are exact. Items are searched in groups whose terms are bounded (``ITEM_TERMS``); an
index has the postings of the terms that are asked for, which are what a search reads.

A stratum, which may hold a third of all documents, is dealt over as many blocks as it takes;
blocks are built and searched in numpy, each by itself.

Scores: with N documents that have terms, L terms in all, n in a document and df documents
that hold a term, its weight w is floor(1000 ln((2N+2)/(2df+1))), m = 25 + (75 n N) div L, and
a document scores the sum of w ((10^9 tf) div (1000 tf + 8m)) over the item's terms with repeats.

Defined cases: a null or empty text has no terms; an item without terms, or whose terms no
document has, gets no rows; rows without a doc_id count in the statistics and aren't
returned; repeated rows are ranked each (of equal ones the order doesn't show). Equal item_ids
are ranked each by itself. Other columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, shuffle_partitions, written
from .shingles import chunks
from .tokens import flat_ranges

#: (item, term) rows and items that are searched together; blocks that an item visits first; documents of a block at least and at most.
ITEM_TERMS, ITEMS, FIRST, LEAST_DOCS, MOST_DOCS = 1 << 18, 1 << 14, 4, 256, 1 << 14
#: Strata of several blocks whose numbers of blocks are broadcast (16 bytes each); more are joined.
HELD_STRATA = 1 << 16
#: Postings that a task scores at a time.
TOGETHER = 1 << 21
SCALE = 1_000_000_000

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(run: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """(all terms, bounds): text k has the terms bounds[k]:bounds[k+1]. Only A-Z count as a-z."""
    b = np.frombuffer(b"\n".join(run).lower() + b"\n", np.uint8)
    inside = _TERM[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    terms = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])])
    return terms, np.concatenate(([0], np.searchsorted(starts, np.cumsum([len(x) + 1 for x in run]))))


def item_terms(items: DataFrame) -> DataFrame:
    """item (a row's number), item_id, term and count of the terms of each row of items (item_id, text), written."""

    def run(batches):
        for batch in batches:
            rows, ids = batch.column("item").to_numpy(), batch.column("item_id")
            for first, texts in chunks(batch.column("text").to_pylist()):
                terms, bounds = terms_of(texts)
                for k in range(len(texts)):
                    counted = terms.slice(bounds[k], bounds[k + 1] - bounds[k]).value_counts()
                    n = len(counted)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rows[first + k])), pa.array([ids[first + k].as_py()] * n, pa.int64()), counted.field("values"), counted.field("counts")], ["item", "item_id", "term", "count"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return written(rows.mapInArrow(run, "item long, item_id long, term binary, count long"), "item-terms")


@dataclass(frozen=True)
class Queries:
    """Items that are searched together: item i has the terms ``terms[start[i]:start[i+1]]``, numbers in the vocabulary, each ``counts`` times."""

    ids: list
    start: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    weights: np.ndarray

    def bounds(self, m: int, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What no document of a block scores more than, for each item."""
        part = np.zeros(len(self.weights), np.int64)
        part[terms] = self.weights[terms] * (SCALE * most // (1000 * most + 8 * m))
        return np.add.reduceat(self.counts * part[self.terms], self.start[:-1])


def _forward(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the text), terms and tfs (those of the vocabulary, packed), written."""
    held, size = pa.array(vocabulary, pa.binary()), max(1, len(vocabulary))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in chunks(batch.column("text").to_pylist()):
                terms, bounds = terms_of(texts)
                at = pc.fill_null(pc.index_in(terms, value_set=held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                key = np.repeat(np.arange(len(texts)), np.diff(bounds))[at >= 0] * size + at[at >= 0]
                key, tf = np.unique(key, return_counts=True)
                cut = np.searchsorted(key, np.arange(len(texts) + 1) * size)
                term, tf = (key % size).astype("<i4"), tf.astype("<i4")
                packed = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:])] for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(np.diff(bounds)), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(released(run), "doc_id long, n long, terms binary, tfs binary"), "terms-of-documents")


def _document_counts(forward: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is: a task sends a count for each term that it has."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for r in forward.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


_BLOCK = "m long, shard long, docs binary, terms binary, most binary, group_term binary, group_tf binary, group_end binary, postings binary"


def _built(table: pa.Table) -> pa.Table:
    """The block of a shard of a stratum: postings by term, then by tf, then by document."""
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    terms, tfs = ([np.frombuffer(x, "<i4") for x in table[c].to_pylist()] for c in ("terms", "tfs"))
    doc = np.repeat(np.arange(len(order), dtype="<i4"), [len(x) for x in terms])
    term, tf = np.concatenate(terms), np.concatenate(tfs)
    order = np.lexsort((doc, -tf, term))
    doc, term, tf = doc[order], term[order], tf[order]
    last = np.append((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), True)
    end = np.flatnonzero(last) + 1
    group_term, group_tf = term[end - 1], tf[end - 1]
    first = np.concatenate(([True], group_term[1:] != group_term[:-1]))
    packed = (table["doc_id"].to_numpy(), group_term[first], group_tf[first], group_term, group_tf, end.astype("<i4"), doc)
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    return pa.Table.from_arrays([table["m"][:1], table["shard"][:1], *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names)


@dataclass(frozen=True)
class Index:
    """blocks: a table of _BLOCK; n_documents and n_terms: N and L; vocabulary: the terms it has, by number; counts: their df."""

    blocks: DataFrame
    n_documents: int
    n_terms: int
    vocabulary: list[bytes]
    counts: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_documents + 2) / (2 * d + 1))) for d in self.counts.tolist()], np.int64)


def index(docs: DataFrame, vocabulary: list[bytes]) -> Index | None:
    """The index of docs (doc_id, text) for the terms of vocabulary; None if no document has terms."""
    forward = _forward(docs, vocabulary)
    n, total = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return None
    counts = _document_counts(forward, len(vocabulary))
    named = forward.where("doc_id is not null and length(terms) > 0").withColumn("m", F.expr(f"25 + (75L * n * {n}L) div {total}L"))
    # A stratum goes to as many blocks as keep each at a share of a task's documents.
    most = min(MOST_DOCS, max(LEAST_DOCS, n // (8 * shuffle_partitions(docs.sparkSession))))
    large = named.groupBy("m").agg(F.ceil(F.count("*") / most).alias("shards")).where("shards > 1")
    large = F.broadcast(large) if large.count() <= HELD_STRATA else large
    shard = F.pmod(F.xxhash64("place"), F.coalesce("shards", F.lit(1)))
    dealt = named.withColumn("place", F.monotonically_increasing_id()).join(large, "m", "left").withColumn("shard", shard)
    # Dealt by both: a join's partitioning by m alone would do for the grouping, and keep a large stratum together.
    blocks = dealt.select("m", "shard", "doc_id", "terms", "tfs").repartition("m", "shard").groupBy("m", "shard").applyInArrow(_built, _BLOCK)
    return Index(written(blocks, "strata"), n, total, vocabulary, counts)


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each item, equal ones by document."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return item[rank < k], score[rank < k], doc[rank < k]


def _numbers(row: dict, name: str, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _scored(row: dict, q: Queries, chosen: np.ndarray, least: np.ndarray, k: int):
    """(item, score, doc) of the k best documents of a block for each of the chosen items, scores below ``least`` (by item) left out."""
    docs, terms, of, tf, end, postings = _numbers(row, "docs", "<i8"), *(_numbers(row, c) for c in ("terms", "group_term", "group_tf", "group_end", "postings"))
    impact = q.weights[of] * (SCALE * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * row["m"]))
    value = np.repeat(impact, np.diff(end, prepend=0)).astype(float)  # whole numbers below 2^53, and so are their sums
    edges = np.concatenate((np.concatenate(([0], end))[np.searchsorted(of, terms)], [len(postings)])).astype(np.int64)
    pair = flat_ranges(q.start[chosen], q.start[chosen + 1] - q.start[chosen])
    item = np.repeat(np.arange(len(chosen)), q.start[chosen + 1] - q.start[chosen])
    at = np.minimum(np.searchsorted(terms, q.terms[pair]), len(terms) - 1)
    there = terms[at] == q.terms[pair]
    item, at, count = item[there], at[there], q.counts[pair[there]].astype(float)
    length = edges[at + 1] - edges[at]
    work = np.cumsum(np.bincount(item, weights=length + 1.0, minlength=len(chosen))) + np.arange(len(chosen)) * len(docs)
    lo = 0
    while lo < len(chosen):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + TOGETHER, "right")))
        mine = slice(*np.searchsorted(item, [lo, hi]))
        places = flat_ranges(edges[at[mine]], length[mine])
        key = np.repeat((item[mine] - lo) * len(docs), length[mine]) + postings[places]
        score = np.bincount(key, weights=np.repeat(count[mine], length[mine]) * value[places], minlength=(hi - lo) * len(docs)).astype(np.int64)
        good = np.flatnonzero(score.reshape(hi - lo, -1) >= np.maximum(least[chosen[lo:hi]], 1)[:, None])
        yield _best(chosen[lo + good // len(docs)], score[good], docs[good % len(docs)], k)
        lo = hi


def _found(batch_of) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in batch_of], ["item", "score", "doc_id"])


_FOUND = "item long, score long, doc_id long"


def _first_visits(blocks: DataFrame, q: Queries) -> DataFrame:
    """m, shard and items: the blocks with the largest bounds of each item. Reads what bounds blocks, no postings."""

    def run(batches):
        held = (np.empty(0, np.int64),) * 3
        keys: list[tuple[int, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                bound = q.bounds(row["m"], _numbers(row, "terms"), _numbers(row, "most").astype(np.int64))
                at = np.flatnonzero(bound > 0)
                held = _best(*(np.concatenate(x) for x in zip(held, (at, bound[at], np.full(len(at), len(keys))))), FIRST)
                keys.append((row["m"], row["shard"]))
        m, shard = (np.array(x, np.int64) for x in zip(*keys)) if keys else (np.empty(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(m[held[2]]), pa.array(shard[held[2]])], ["item", "bound", "m", "shard"])

    bounds = blocks.select("m", "shard", "terms", "most").mapInArrow(run, "item long, bound long, m long, shard long")
    ranked = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "m", "shard"))).where(F.col("nth") <= FIRST)
    return ranked.groupBy("m", "shard").agg(F.collect_list("item").alias("items"))


def _thresholds(blocks: DataFrame, q: Queries, k: int) -> np.ndarray:
    """For each item the k-th best score in the blocks that it visits first; 0 if they have fewer documents that score."""
    none = np.zeros(len(q.ids), np.int64)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for some in _scored(row, q, np.array(sorted(row["items"])), none, k):
                    yield _found(some)

    found = blocks.join(_first_visits(blocks, q), ["m", "shard"]).mapInArrow(run, _FOUND)
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("nth") == k)
    out = none.copy()
    for r in ranked.toLocalIterator():
        out[r["item"]] = r["score"]
    return out


def _searched(blocks: DataFrame, q: Queries, k: int) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    reached = _thresholds(blocks, q, k)

    def run(batches):
        held, least = (np.empty(0, np.int64),) * 3, reached.copy()
        for batch in batches:
            for row in batch.to_pylist():
                bound = q.bounds(row["m"], _numbers(row, "terms"), _numbers(row, "most").astype(np.int64))
                for some in _scored(row, q, np.flatnonzero(bound >= np.maximum(least, 1)), least, k):
                    held = _best(*(np.concatenate(x) for x in zip(held, some)), k)
                    full = held[0][k - 1 :][held[0][k - 1 :] == held[0][: max(0, len(held[0]) - k + 1)]]
                    least[full] = np.maximum(least[full], held[1][np.searchsorted(held[0], full) + k - 1])
        yield _found(held)

    ids = blocks.sparkSession.createDataFrame(list(enumerate(q.ids)), "item long, item_id long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = blocks.mapInArrow(released(run), _FOUND).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: for each row of items (item_id, text) the k documents of docs (doc_id, text) that score most.

    Equal scores are ranked by ascending doc_id; documents that score 0 aren't returned.
    """
    spark = docs.sparkSession
    asked = item_terms(items)
    rows, n = asked.agg(F.count("*"), F.count_distinct("item")).first()
    groups = max(-(-rows // ITEM_TERMS), -(-n // ITEMS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).orderBy("item", "term").collect()
        if not some:
            continue
        vocabulary = sorted({bytes(r["term"]) for r in some})
        number = {t: i for i, t in enumerate(vocabulary)}
        found = index(docs, vocabulary)
        if found is None:
            break
        items_of = np.array([r["item"] for r in some])
        first = np.concatenate(([0], np.flatnonzero(items_of[1:] != items_of[:-1]) + 1))
        q = Queries([some[i]["item_id"] for i in first], np.append(first, len(some)), np.array([number[bytes(r["term"])] for r in some]), np.array([r["count"] for r in some], np.int64), found.weights())
        out = out.union(_searched(found.blocks, q, k))
    return out


_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{_AZ}', '{_AZ.lower()}'), '{_WORDS}')) AS term FROM (SELECT *, row_number() OVER () AS r FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), sums),
m AS (SELECT r, 25 + (75 * n * docs) // total AS m FROM lengths, sums),
q AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, '{_AZ}', '{_AZ.lower()}'), '{_WORDS}')) AS term FROM (SELECT *, row_number() OVER () AS i FROM benchmark)) GROUP BY ALL),
scored AS (SELECT i, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10"""
