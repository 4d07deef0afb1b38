"""Hashed maximum-entropy language model: n-gram and skip features, class-factored softmax.

A text's tokens are its words (A-Z in lower case) and one end. The ``WORDS`` most frequent
tokens of the training documents are events of their own; all others fall into ``BANDS`` by
frequency and share their band's probability by their counts. With h the tokens before,

    P(token | h) = P(class | h) * P(token | class, h)          for a frequent token
    P(token | h) = P(band | h) * (c + 1) / Z of the band       for another one

Both softmaxes start from the smoothed counts (so that the untrained model is exactly the
unigram base) and add weights of three features, each hashed into a table: the token before
(any token, rare ones too), the last frequent word before that one (a skip), and the two
together (an n-gram). The tables' rows grow with the number of distinct tokens, up to
``MOST_ROWS``. Classes are balanced halvings of the words by what precedes them.

Counts are of all training documents: every task sums its own, buckets sum tasks, and the
table of all tokens stays distributed; buckets are as many as the texts have room for. Texts
look up the ``HEAD`` most frequent tokens in place (bounded: 12 bytes each); other tokens go
to their bucket and come back as a sum. Training is by rounds: each task makes gradient
updates over its own examples from the same weights, the updates of a round are averaged,
slice by slice, and form the next weights. Every position of all training documents is an
example of one round, that which its text's hash says.

Defined cases: a null or empty text is its end alone. Without training documents all counts
are 0. Rows with a null doc_id are training rows (the crc32 of '' is 0). Repeated rows count
and are scored each for itself. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_buckets, written
from .shingles import chunks, mix, word_hashes

#: Classes of frequent words and words in each; bands of other tokens, the last of those beyond the head.
CLASSES, PER_CLASS = 63, 65
WORDS, BANDS = CLASSES * PER_CLASS, 8
#: Tokens whose counts go to all executors.
HEAD = 1 << 18
#: Rows of the tables that features are hashed into, for classes: one for so many distinct tokens, within these bounds
#: (at most 3 * 65,536 rows of 71 numbers, 56 MB); and for words within a class.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 512, 8192, 65_536
WORD_ROWS = 256
ROUNDS, BATCH, RATE = 3, 4096, 0.15
#: Training positions that a task takes at least, where that leaves two tasks for each core.
TASK_TOKENS = 8_000_000
#: Columns of the count of what precedes a word, from which classes are made.
CONTEXTS = 64
#: Slices that updates are summed in, and tasks whose slices meet in one group: of more tasks, sums are summed again.
SLICES, FAN = 32, 64

_END = np.uint64(0x0E4D_0E4D_0E4D_0E4D)
_TAIL = WORDS + BANDS - 1  # the event of tokens beyond the head
_START = WORDS + BANDS  # what stands before a text
_OTHERS = 8192  # codes of histories from here on are of tokens that aren't frequent


def tokens_of(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens of a run of texts, bounds of each text's); each text ends with the end token."""
    words, bounds = word_hashes(run)
    n = np.diff(bounds)
    out = np.full(len(words) + len(run), _END, np.uint64)
    text = np.repeat(np.arange(len(run)), n)
    out[np.arange(len(words)) + text] = words
    return out, bounds + np.arange(len(run) + 1)


def _blobs(rows, schema):
    columns = zip(*rows) if rows else [()] * len(schema.names)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names)


_COUNTS = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _bucket(h, buckets):
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _count(buckets):
    def run(batches):
        held, size = [], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            return _blobs([(k, h[a:b].tobytes(), n[a:b].astype("<u4").tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a], _COUNTS)

        for batch in batches:
            for _, texts in chunks(batch.column(0).to_pylist()):
                held.append(tokens_of(texts)[0])
                size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _joined(table, name, dtype):
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), dtype)


def _sum_counts(table: pa.Table) -> pa.Table:
    h, n = _joined(table, "hashes", np.uint64), _joined(table, "counts", "<u4").astype(np.int64)
    by = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
    h, n = h[by][first], np.add.reduceat(n[by], first)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "hashes": pa.array([h.tobytes()]), "counts": pa.array([n.tobytes()]), "total": pa.array([int(n.sum())], pa.int64()), "distinct": pa.array([len(h)], pa.int64())})


def _head(most):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, n = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int64)
                top = np.lexsort((h, -n))[:most]
                yield _blobs([(0, h[top].tobytes(), n[top].tobytes())], _COUNTS)

    return run


class Model:
    """What scoring needs; its size is bounded by HEAD and the tables' shapes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        by = np.argsort(hashes)
        self.hashes, self.counts = hashes[by], counts[by]
        self.total, self.distinct = total, distinct
        order = np.lexsort((self.hashes, -self.counts))
        words, rest = order[:WORDS], order[WORDS:]
        self.rank = np.full(len(hashes), _TAIL, np.int32)
        self.rank[words] = np.arange(len(words))
        self.word_counts = np.zeros(WORDS, np.int64)
        self.word_counts[: len(words)] = self.counts[words]
        # Bands of about equal mass: counts, and one more for each token (and, in the last, for the unseen).
        mass = np.cumsum(self.counts[rest] + 1)
        band = np.minimum((mass - 1) * (BANDS - 1) // max(1, int(mass[-1]) if len(mass) else 1), BANDS - 2)
        self.rank[rest] = WORDS + band
        self.band_mass = np.bincount(band, self.counts[rest] + 1, BANDS)
        self.band_mass[-1] = total - int(self.counts.sum()) + distinct - len(hashes) + 1
        self.place = np.arange(WORDS, dtype=np.int32)
        rows = LEAST_ROWS
        while rows < MOST_ROWS and rows * TOKENS_A_ROW < distinct:
            rows *= 2
        self.rows = rows
        self.shapes = {"class": (3, rows, BANDS + CLASSES), "word": (2, WORD_ROWS, CLASSES, PER_CLASS)}
        self.tables = {k: np.zeros(s, np.float32) for k, s in self.shapes.items()}
        self._biases()

    def _biases(self):
        mass = np.zeros(WORDS)
        mass[self.place] = np.where(self.word_counts > 0, self.word_counts + 1.0, 1e-12)
        mass = mass.reshape(CLASSES, PER_CLASS)
        self.word_bias = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
        every = np.append(np.maximum(self.band_mass, 1e-12), mass.sum(1))
        self.class_bias = np.log(every / every.sum()).astype(np.float32)

    def classify(self, contexts: np.ndarray) -> None:
        """Places of words: halves by the main direction of their contexts, down to classes of equal size."""
        x = contexts + 0.5 * contexts.sum(0) / max(1.0, contexts.sum())
        x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1e-9))
        order: list[np.ndarray] = []

        def halve(at, classes):
            if classes == 1:
                order.append(at)
                return
            y = x[at] - x[at].mean(0)
            main = np.linalg.eigh(y.T @ y)[1][:, -1]
            by = at[np.argsort(y @ (main * np.sign(main[np.argmax(np.abs(main))])), kind="stable")]
            left = classes // 2
            halve(by[: left * PER_CLASS], left)
            halve(by[left * PER_CLASS :], classes - left)

        halve(np.arange(WORDS), CLASSES)
        self.place[np.concatenate(order)] = np.arange(WORDS)
        self._biases()

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(event, count or -1 where the token isn't among the head) of token hashes."""
        if not len(self.hashes):
            return np.full(len(h), _TAIL, np.int32), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.rank[at], _TAIL), np.where(hit, self.counts[at], -1)


def histories(h: np.ndarray, rank: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token 16-bit codes of (the token before, the last frequent word before that): ranks, hashes of other tokens, or the text's start."""
    n = len(rank)
    i = np.arange(n)
    first = np.repeat(bounds[:-1], np.diff(bounds))
    code = np.where(rank < WORDS, rank, _OTHERS + ((h >> np.uint64(40)) % np.uint64(65_536 - _OTHERS)).astype(np.int64))
    before = np.where(i > first, code[np.maximum(i - 1, 0)], _START)
    word = np.maximum.accumulate(np.where(rank < WORDS, i, -1))
    at = np.where(i - 2 >= 0, word[np.maximum(i - 2, 0)], -1)
    skip = np.where(at >= first, rank[np.maximum(at, 0)], _START)
    return before.astype(np.int32), skip.astype(np.int32)


def rows_of(before: np.ndarray, skip: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables' rows of each history: (3, n) for classes, whose tables have ``rows`` rows, and (2, n) for words."""
    a, b = before.astype(np.uint64), skip.astype(np.uint64)
    mixed = ((a * np.uint64(65_537) + b) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    # Frequent words have the first half of the least table to themselves.
    own = np.where(before < _OTHERS, before, LEAST_ROWS // 2 + 1024 + before % (rows - LEAST_ROWS // 2 - 1024))
    return np.stack((own, skip, (mixed % np.uint64(rows)).astype(np.int64))).astype(np.int64), np.stack((a % np.uint64(WORD_ROWS), b % np.uint64(WORD_ROWS))).astype(np.int64)


def _log_softmax(x):
    x -= x.max(1, keepdims=True)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


def log_probabilities(model: Model, rank, before, skip) -> np.ndarray:
    """Natural log of P(class | h) * P(word | class, h) of each event; for bands of P(band | h)."""
    out = np.empty(len(rank), np.float64)
    for lo in range(0, len(rank), BATCH):
        s = slice(lo, lo + BATCH)
        class_rows, word_rows = rows_of(before[s], skip[s], model.rows)
        x = model.class_bias + model.tables["class"][0][class_rows[0]]
        for k in (1, 2):
            x += model.tables["class"][k][class_rows[k]]
        frequent = np.flatnonzero(rank[s] < WORDS)
        place = model.place[rank[s][frequent]]
        cls = rank[s] - WORDS
        cls[frequent] = place // PER_CLASS + BANDS
        got = _log_softmax(x)[np.arange(len(x)), cls].astype(np.float64)
        c = cls[frequent] - BANDS
        y = model.word_bias[c]
        for k in (0, 1):
            y += model.tables["word"][k][word_rows[k][frequent], c]
        got[frequent] += _log_softmax(y)[np.arange(len(c)), place % PER_CLASS]
        out[s] = got
    return out


_EXAMPLES = pa.schema([("part", pa.int32()), ("rank", pa.binary()), ("before", pa.binary()), ("skip", pa.binary())])


def _examples(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            rows = []
            for _, texts in chunks(batch.column(0).to_pylist()):
                h, bounds = tokens_of(texts)
                rank, _ = model.look_up(h)
                before, skip = histories(h, rank, bounds)
                part = np.repeat(mix(np.add.reduceat(h, bounds[:-1])) % np.uint64(ROUNDS), np.diff(bounds))
                for k in range(ROUNDS):
                    rows.append((k, *(x[part == k].astype("<u2").tobytes() for x in (rank, before, skip))))
            yield _blobs(rows, _EXAMPLES)

    return run


def _read_examples(row):
    return (np.frombuffer(row[k], "<u2").astype(np.int32) for k in ("rank", "before", "skip"))


def _contexts(batches):
    total = np.zeros((WORDS, CONTEXTS), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            rank, _, skip = _read_examples(row)
            ok = (rank < WORDS) & (skip < CONTEXTS)
            total += np.bincount(rank[ok] * CONTEXTS + skip[ok], minlength=total.size).reshape(total.shape)
    if total.any():
        yield from _slices_of(total.ravel(), "<f4")


def _sum_slices(table: pa.Table) -> pa.Table:
    """Of one slice: the sum of what tasks send, in half precision (changes of weights) or single (counts)."""
    kind = table.column("kind")[0].as_py()
    total = 0.0
    for x in table.column("data"):
        total = total + np.frombuffer(x.as_buffer(), kind).astype(np.float64)
    return pa.table([pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("slice", "part")] + [pa.array(["<f4"]), pa.array([total.astype("<f4").tobytes()])], names=["slice", "part", "kind", "data"])


def _slices_of(data: np.ndarray, kind: str):
    task = TaskContext.get().partitionId()
    for k, part in enumerate(np.array_split(data, SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([kind]), pa.array([part.astype(kind).tobytes()])], names=["slice", "part", "kind", "data"])


_SLICE = "slice int, part int, kind string, data binary"


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct number of key first stands, each place's number among them)."""
    by = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
    of = np.empty(len(key), np.int64)
    of[by] = np.cumsum(new) - 1
    return by[new], of


def _add_rows(table, rows, grad):
    """Adds to rows of a table the summed gradient of each row, scaled by how much the row has moved (AdaGrad by row)."""
    by = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], rows[by][1:] != rows[by][:-1])))
    n = np.diff(np.append(first, len(rows)))
    total = grad[by[first]]
    many = n > 1
    if many.any():
        ends = np.cumsum(n[many])
        total[many] = np.add.reduceat(grad[by[np.repeat(many, n)]], ends - n[many], axis=0)
    at = rows[by][first]
    weights, seen = table
    moved = seen[at] + np.einsum("rk,rk->r", total, total)
    seen[at] = moved
    total *= (RATE * np.sqrt(total.shape[1]) / 4 / np.sqrt(moved + 1.0)).astype(np.float32)[:, None]
    weights[at] += total


def updates(model: Model, examples) -> dict[str, np.ndarray]:
    """The model's tables after a gradient update for each batch of examples (tuples of rank, before, skip)."""
    tables = {k: v.copy() for k, v in model.tables.items()}
    flat = {"class": tables["class"].reshape(3, model.rows, -1), "word": tables["word"].reshape(2, WORD_ROWS * CLASSES, -1)}
    seen = {k: np.zeros(v.shape[:2], np.float32) for k, v in flat.items()}

    def gradient(x, of, right):
        """Of distinct contexts with scores x: the sum over their examples (numbered by ``of``) of 1 at the right column less the softmax."""
        size = x.shape[1]
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x *= (-np.bincount(of, minlength=len(x)) / x.sum(1)).astype(np.float32)[:, None]
        at, n = np.unique(of * size + right, return_counts=True)
        x.ravel()[at] += n
        return x

    for rank, before, skip in (tuple(x[lo : lo + BATCH] for x in e) for e in examples for lo in range(0, len(e[0]), BATCH)):
        one, of = _distinct(before.astype(np.int64) << 16 | skip)
        class_rows, word_rows = rows_of(before[one], skip[one], model.rows)
        x = model.class_bias + flat["class"][0][class_rows[0]] + flat["class"][1][class_rows[1]] + flat["class"][2][class_rows[2]]
        frequent = np.flatnonzero(rank < WORDS)
        place = model.place[rank[frequent]]
        cls = rank.astype(np.int64) - WORDS
        cls[frequent] = place // PER_CLASS + BANDS
        grad = gradient(x, of, cls)
        for k in range(3):
            _add_rows((flat["class"][k], seen["class"][k]), class_rows[k], grad)
        if len(frequent):
            c = cls[frequent] - BANDS
            rows = word_rows[:, of[frequent]] * CLASSES + c
            one, of = _distinct(rows[0] * (WORD_ROWS * CLASSES) + rows[1])
            rows, c = rows[:, one], c[one]
            grad = gradient(model.word_bias[c] + flat["word"][0][rows[0]] + flat["word"][1][rows[1]], of, place % PER_CLASS)
            for k in range(2):
                _add_rows((flat["word"][k], seen["word"][k]), rows[k], grad)
    return tables


def _joined_examples(batches):
    """The partition's examples, those of several texts together, a few batches' worth at a time."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(tuple(_read_examples(row)))
            size += len(held[-1][0])
            if size >= 16 * BATCH:
                yield tuple(np.concatenate([h[k] for h in held]) for k in range(3))
                held, size = [], 0
    if size:
        yield tuple(np.concatenate([h[k] for h in held]) for k in range(3))


def _updates(sent):
    def run(batches):
        model = sent.value
        tables = updates(model, _joined_examples(batches))
        changed = {k: (tables[k] - model.tables[k]).reshape(-1, s[-1]) for k, s in model.shapes.items()}
        if not any(d.any() for d in changed.values()):
            return
        # The change, and by row whether there was one: rows that few tasks met aren't averaged away.
        yield from _slices_of(np.concatenate([np.concatenate((d, np.any(d, 1, keepdims=True)), 1).ravel() for d in changed.values()]), "<f2")

    return run


def train(docs: DataFrame, buckets: int) -> tuple[Model, DataFrame]:
    """A model of the texts of docs (the training rows), and the table of all tokens' counts by bucket."""
    spark = docs.sparkSession
    texts = docs.select("text")
    schema = "bucket int, hashes binary, counts binary"
    vocabulary = written(texts.mapInArrow(_count(buckets), schema).groupBy("bucket").applyInArrow(_sum_counts, schema + ", total long, distinct long"), "counts")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    head = vocabulary.select("hashes", "counts").mapInArrow(_head(max(1, HEAD // buckets)), schema).select("hashes", "counts").collect()
    model = Model(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["hashes"], np.uint64) for r in head)]), np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in head)]), total, distinct)
    if not total:
        return model, vocabulary
    examples = written(texts.mapInArrow(_examples(spark.sparkContext.broadcast(model)), "part int, rank binary, before binary, skip binary"), "examples")
    # Tasks that each send a table: no more of them than keep all cores busy or have their share of positions.
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // TASK_TOKENS)
    examples = examples.coalesce(tasks)

    def gathered(rows, size):
        left = tasks
        while left:
            rows = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("slice", "part").applyInArrow(_sum_slices, _SLICE)
            left = 0 if left <= FAN else -(-left // FAN)
        got = rows.collect()
        parts = {r["slice"]: np.frombuffer(r["data"], "<f4") for r in got}
        return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(size, np.float32)

    contexts = gathered(examples.select("rank", "before", "skip").mapInArrow(_contexts, _SLICE), WORDS * CONTEXTS)
    model.classify(contexts.reshape(WORDS, CONTEXTS).astype(np.float64))
    for part in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        rows = examples.where(F.col("part") == part).select("rank", "before", "skip").mapInArrow(_updates(sent), _SLICE)
        data = gathered(rows, sum(int(np.prod(s[:-1])) * (s[-1] + 1) for s in model.shapes.values()))
        at = 0
        for k, shape in model.shapes.items():
            width = shape[-1] + 1
            part_of = data[at : at + int(np.prod(shape[:-1])) * width].reshape(-1, width)
            at += part_of.size
            model.tables[k] = model.tables[k] + (part_of[:, :-1] / np.maximum(part_of[:, -1:], 1)).reshape(shape)
        sent.unpersist()
    return model, vocabulary


_SCORED = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("model", pa.float64()), ("hashes", pa.binary()), ("rows", pa.binary())])


def _score(sent, buckets):
    """A row for each text, and rows of the tokens to look up elsewhere (with a bucket)."""

    def run(batches):
        model = sent.value
        row = TaskContext.get().partitionId() << 40
        band = np.log10(np.maximum(model.band_mass, 1e-12))
        held, size = [], 0

        def look_ups():
            h, rows = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(h, kind="stable")
            h, rows = h[by], rows[by]
            cut = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            return _blobs([(k, *[None] * 7, h[a:b].tobytes(), rows[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a], _SCORED)

        for batch in batches:
            ids, held_out = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for first, texts in chunks(batch.column(0).to_pylist()):
                h, bounds = tokens_of(texts)
                rank, count = model.look_up(h)
                logp = log_probabilities(model, rank, *histories(h, rank, bounds)) / np.log(10)
                known = count >= 0
                log = np.log10(np.maximum(count, 0) + 1.0)
                logp += np.where(rank >= WORDS, log - band[np.maximum(rank - WORDS, 0)], 0)
                text = np.repeat(np.arange(len(texts)), np.diff(bounds))
                sums = [np.bincount(text, w, len(texts)) for w in (known, log, logp)]
                for k in range(len(texts)):
                    out.append((None, row + k, ids[first + k], held_out[first + k], int(bounds[k + 1] - bounds[k]), int(sums[0][k]), float(sums[1][k]), float(sums[2][k]), None, None))
                held.append((h[~known], row + text[~known]))
                size += len(held[-1][0])
                row += len(texts)
                if size > 2_000_000:
                    yield look_ups()
                    held, size = [], 0
            yield _blobs(out, _SCORED)
        if size:
            yield look_ups()

    return run


def _looked_up(_, left: pa.Table, right: pa.Table) -> pa.Table:
    h, rows = _joined(left, "hashes", np.uint64), _joined(left, "rows", np.int64)
    known, counts = _joined(right, "hashes", np.uint64), _joined(right, "counts", np.int64)
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    hit = known[at] == h if len(known) else np.zeros(len(h), bool)
    rows, log = rows[hit], np.log10(counts[at[hit]] + 1.0) if len(known) else np.empty(0)
    distinct, of = np.unique(rows, return_inverse=True)
    return pa.table({"row": distinct, "known": np.bincount(of, minlength=len(distinct)).astype(np.int64), "log": np.bincount(of, log, len(distinct)).astype(np.float64)})


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all rows of docs (doc_id, text) by a model of those where held_out is false.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10 by smoothed counts)
    and score (log10 by the model).
    """
    spark = docs.sparkSession
    docs = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
    buckets = text_buckets(docs)
    model, vocabulary = train(docs.where("not held_out"), buckets)
    sent = spark.sparkContext.broadcast(model)
    schema = "bucket int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double, hashes binary, rows binary"
    both = written(docs.mapInArrow(_score(sent, buckets), schema), "scores")
    elsewhere = both.where("bucket is not null").select("bucket", "hashes", "rows").groupBy("bucket").cogroup(vocabulary.select("bucket", "hashes", "counts").groupBy("bucket")).applyInArrow(lambda k, a, b: _looked_up(k, a, b), "row long, known long, log double")
    more = elsewhere.groupBy("row").agg(F.sum("known").alias("known"), F.sum("log").alias("log"))
    per_token = float(np.log10(model.total + model.distinct + 1))
    log = F.coalesce("log", F.lit(0.0))
    return (
        both.where("bucket is null")
        .join(more, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(int(model.total)).cast("long").alias("train_tokens"),
            (F.col("logs") + log - F.col("n_tokens") * per_token).alias("base_score"),
            (F.col("model") + log).alias("score"),
        )
    )
