"""N-gram Jaccard join by prefix lists with skipping on set relations.

Every text is the set of its distinct word shingles. Two texts link when their Jaccard
similarity reaches the threshold; the join returns each document's class of linked texts.

1. *Frequencies.* All shingles of all documents are counted by 32-bit cell. What comes
   back is bounded: a bitmap of the cells that occur twice, and the heaviest cells.
2. *Index.* Shingles are ordered rare first. If two sets link, they share a shingle in
   their first ``n - ceil(t*n) + 1`` places, so only those places are listed, and none
   whose cell occurs once.
3. *Index-level skipping.* Lists are in order of position, in blocks of ``SKIP`` entries
   that know their largest position, what is left behind it, and their sizes. Pairs of blocks
   that leave too little room for the overlap that is needed are skipped as a whole, pairs of
   entries in the others one by one, and then those that meet too seldom within their prefixes.
   A list with more than ``LIST_PAIRS`` entries emits no pairs but one edge an entry.
4. *Answer-level skipping.* Sets that may link (a cluster) come together. There, a set's
   overlaps with all others are derived from those of a similar set that has been
   answered: minus the lists of what it lacks, plus those of what it adds.

Groups of equal sets count as one set. A cluster beyond ``SHARE_HASHES`` is dealt over shares.
First each of its sets is compared with a few leaders; those that links connect with most
others are one class, within which nothing is left to compare. What lies outside it comes
once to each share, in blocks. So a cluster of near copies, however large, is read twice;
only one whose sets don't link costs more, as many times as its outside has ``BLOCK_HASHES``.
No step drops a pair that links; orders and filters only save work.

Hashes go from where a text lies to the task that answers its cluster in one shuffle: all
executors are sent a half digest and the task of each candidate. A text whose half digest
is another's is sent too, and left there. Candidates beyond ``MOST_ROUTED`` are joined by
shuffle with their clusters first, filtered by a bitmap of their digests.

Defined cases: null and empty texts, and those without words, have no shingles and link
with nothing. Fewer words than the width make one shingle. Repeated rows are kept: each
gets its row. A null doc_id takes part but never names a component. Other columns of the
input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_to_few, released, released_group, shuffle_partitions, text_buckets, written
from .graph import components
from .shingles import digest, mix, shingle_sets

#: Bits of the map of cells that occur at least twice (sent to all executors: 8 MB).
SEEN_BITS = 26
#: A cell in so many sets is heavy and comes last in the order; so many heavy cells are sent at most (8 bytes each).
HEAVY, MOST_HEAVY = 64, 1 << 20
#: A list of more sets gives one edge for each set instead of pairs.
LIST_PAIRS = 64
#: Entries of a list that are skipped together.
SKIP = 8
#: Candidates of which all executors get the task that answers them (8 bytes each: 32 MB).
MOST_ROUTED = 1 << 22
#: Words of 64 bits in the map of candidate digests, where these are more (8 MB).
MAP_WORDS = 1 << 20
#: Shingle hashes of a share of a large cluster, and of a block of what is compared with all shares.
SHARE_HASHES, BLOCK_HASHES = 100_000, 2_000_000
#: Sets of a large cluster that all others are compared with first.
LEADERS = 4


def _need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-n * num // den)


class _Distinct:
    """Documents of a task whose set has not been met in it yet: equal copies count once."""

    def __init__(self):
        self.met: set[int] = set()

    def new(self, d: int) -> bool:
        if d in self.met:
            return False
        if len(self.met) < 4_000_000:
            self.met.add(d)
        return True


def _texts(batch):
    return batch.column(0).to_pylist()


def _gaps(cells: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as the first one and the gaps that follow, of 16 bits where they fit."""
    gaps = np.diff(cells)
    small = not len(gaps) or gaps.max() < 65536
    return bytes([int(small)]) + cells[:1].tobytes() + gaps.astype(np.uint16 if small else np.uint32).tobytes()


def _from_gaps(blob: bytes) -> np.ndarray:
    first = np.frombuffer(blob[1:5], np.uint32)
    gaps = np.frombuffer(blob[5:], np.uint16 if blob[0] else np.uint32)
    return np.cumsum(np.concatenate((first, gaps.astype(np.uint32))), dtype=np.uint32)


def _count_cells(buckets, width):
    @released
    def run(batches):
        seen, held, size = _Distinct(), [], 0

        def out():
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = (cells.astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            once = counts == 1
            blobs = [(k, _gaps(cells[a:b][once[a:b]]), _gaps(cells[a:b][~once[a:b]]), counts[a:b][~once[a:b]].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blobs), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "once", "cells", "counts"])

        for batch in batches:
            for s in shingle_sets(_texts(batch), width):
                if len(s) and seen.new(digest(s)):
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    size += len(s)
                    if size > 3_000_000:
                        yield out()
                        held, size = [], 0
        if size:
            yield out()

    return run


def _joined(table, name, dtype):
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), dtype)


def _sum_cells(buckets):
    @released_group
    def run(table: pa.Table) -> pa.Table:
        k = table.column("bucket")[0].as_py()
        once, cells = (np.concatenate([_from_gaps(x.as_py()) for x in table.column(n)]) for n in ("once", "cells"))
        counts = _joined(table, "counts", np.uint32)
        every = np.concatenate((once, cells))
        weight = np.concatenate((np.ones(len(once), np.uint32), counts))
        order = np.argsort(every, kind="stable")
        every, weight = every[order], weight[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        cells, counts = every[first], np.add.reduceat(weight.astype(np.int64), first)
        shift = 32 - SEEN_BITS
        lo = -(-(k << 32) // buckets) >> shift >> 3
        hi = ((((k + 1) << 32) - 1) // buckets >> shift >> 3) + 1
        bits = np.zeros((hi - lo) * 8, bool)
        bits[(cells[counts > 1].astype(np.int64) >> shift) - lo * 8] = True
        heavy = np.flatnonzero(counts >= HEAVY)
        heavy = np.sort(heavy[np.argsort(-counts[heavy], kind="stable")[: max(1, MOST_HEAVY // buckets)]])
        return pa.table({"byte": pa.array([lo], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "cells": pa.array([cells[heavy].tobytes()], pa.binary()), "counts": pa.array([counts[heavy].astype(np.uint32).tobytes()], pa.binary())})

    return run


def _order(texts: DataFrame, width: int, buckets: int):
    """(bitmap of cells that occur twice, heavy cells, their counts); sizes bounded by SEEN_BITS and MOST_HEAVY."""
    sums = texts.mapInArrow(_count_cells(buckets, width), "bucket int, once binary, cells binary, counts binary").groupBy("bucket").applyInArrow(_sum_cells(buckets), "byte long, bits binary, cells binary, counts binary")
    seen, cells, counts = np.zeros(1 << (SEEN_BITS - 3), np.uint8), [], []
    for row in sums.orderBy("byte").collect():
        part = np.frombuffer(row["bits"], np.uint8)
        seen[row["byte"] : row["byte"] + len(part)] |= part[: len(seen) - row["byte"]]
        cells.append(np.frombuffer(row["cells"], np.uint32))
        counts.append(np.frombuffer(row["counts"], np.uint32))
    cells, counts = (np.concatenate([np.empty(0, np.uint32), *x]) for x in (cells, counts))
    order = np.argsort(cells, kind="stable")
    return seen, cells[order], counts[order]


def _prefix(s, order, num, den):
    """The listed shingles of a set and their places in the order."""
    seen, heavy, counts = order
    n = len(s)
    cell = (s >> np.uint64(32)).astype(np.uint32)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, cell), len(heavy) - 1)
        hit = heavy[at] == cell
        if hit.any():
            by = np.lexsort((s, np.where(hit, counts[at], 0)))
            s, cell = s[by], cell[by]
    p = n - int(_need(np.int64(n), num, den)) + 1
    bit = cell[:p].astype(np.int64) >> (32 - SEEN_BITS)
    place = np.flatnonzero((seen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
    return s[place], place


def _list_entries(buckets, width, num, den, sent):
    @released
    def run(batches):
        order, seen, held, size = sent.value, _Distinct(), [], 0

        def out():
            tok = np.concatenate([h[0] for h in held])
            reps = [len(h[0]) for h in held]
            dig = np.repeat(np.array([h[2] for h in held], np.int64), reps)
            n = np.repeat(np.array([h[3] for h in held], np.uint32), reps)
            place = np.minimum(np.concatenate([h[1] for h in held]), 65535).astype(np.uint16)
            by = np.argsort(tok, kind="stable")
            bucket = ((tok[by] >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            low = ((tok >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = [(k, *(x[by[a:b]].tobytes() for x in (low, dig, n, place))) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows))], names=["bucket", "token", "digest", "n", "place"])

        for batch in batches:
            for s in shingle_sets(_texts(batch), width):
                if len(s) and seen.new(d := digest(s)):
                    tok, place = _prefix(s, order, num, den)
                    if len(tok):
                        held.append((tok, place, d, len(s)))
                        size += len(tok)
                        if size > 1_000_000:
                            yield out()
                            held, size = [], 0
        if size:
            yield out()

    return run


_PAIR_BLOBS = "task int, a binary, b binary, na binary, nb binary, met binary, star binary"
_PAIR_TYPES = {"a": np.int64, "b": np.int64, "na": np.uint32, "nb": np.uint32, "met": np.uint32, "star": np.uint8}


def _skipped(group, size, place, num, den):
    """Pairs (i, j) of entries of one group that may link, for entries in order of group and place.

    The room for an overlap is what lies before both entries' places and what is left behind them.
    Blocks are skipped by the most room and the least sizes that their entries have.
    """
    if not len(group):
        return
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    first = np.flatnonzero(rank % SKIP == 0)
    last = np.append(first[1:], len(group))
    of, most, left = group[first], np.maximum.reduceat(place, first), np.maximum.reduceat(size - place, first)
    least, largest = np.minimum.reduceat(size, first), np.maximum.reduceat(size, first)
    each = np.arange(SKIP)
    for step in range(LIST_PAIRS // SKIP + 1):
        i = np.flatnonzero(of[: len(of) - step] == of[step:])
        if not len(i):
            return
        j = i + step
        room = np.minimum(most[i], most[j]) + np.minimum(left[i], left[j])
        fits = (largest[i] * den >= least[j] * num) & (largest[j] * den >= least[i] * num)
        ok = fits & ((room * (num + den) >= num * (least[i] + least[j])) | (np.maximum(most[i], most[j]) == 65535))
        for lo in range(0, int(ok.sum()), 50_000):
            a, b = (x[ok][lo : lo + 50_000] for x in (i, j))
            x, y = first[a][:, None, None] + each[:, None], first[b][:, None, None] + each
            inside = (x < last[a][:, None, None]) & (y < last[b][:, None, None]) & (x < y)
            x, y = (np.broadcast_to(v, inside.shape)[inside] for v in (x, y))
            m, n, p, q = size[x], size[y], place[x], place[y]
            room = np.minimum(p, q) + np.minimum(m - p, n - q)
            pair = (np.minimum(m, n) * den >= np.maximum(m, n) * num) & ((room * (num + den) >= num * (m + n)) | (np.maximum(p, q) == 65535))
            yield x[pair], y[pair]


def _scan_lists(num, den, tasks):
    @released_group
    def run(table: pa.Table) -> pa.Table:
        tok, dig, n, place = (_joined(table, c, t) for c, t in (("token", np.uint32), ("digest", np.int64), ("n", np.uint32), ("place", np.uint16)))
        by = np.lexsort((place, dig, n, tok))
        # copies of a set from several tasks; a set's entries at two places are two shingles
        keep = np.concatenate(([True], (tok[by][1:] != tok[by][:-1]) | (dig[by][1:] != dig[by][:-1]) | (place[by][1:] != place[by][:-1])))
        by = by[keep]
        tok, dig, n, place = tok[by], dig[by], n[by].astype(np.int64), place[by].astype(np.int64)
        # A list of one size run: sizes that leave a gap too wide for any link start a new one.
        new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (n[:-1] * den < n[1:] * num)))
        first = np.flatnonzero(new)
        length = np.diff(np.concatenate((first, [len(tok)])))
        group = np.repeat(np.arange(len(first)), length)
        long = length > LIST_PAIRS
        member = long[group] & ~new
        lead = first[group[member]]
        got = [(dig[lead], dig[member], n[lead], n[member], np.ones(len(lead), np.int32))]
        light = np.flatnonzero((length > 1)[group] & ~long[group])
        light = light[np.lexsort((n[light], place[light], group[light]))]
        d, size = dig[light], n[light]
        for i, j in _skipped(group[light], size, place[light], num, den):
            got.append((d[i], d[j], size[i], size[j], np.zeros(len(i), np.int32)))
        a, b, na, nb, star = (np.concatenate(x) for x in zip(*got))
        flip = a > b
        a, b, na, nb = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, nb, na), np.where(flip, na, nb)
        by = np.lexsort((star, b, a))
        a, b, na, nb, star = (x[by] for x in (a, b, na, nb, star))
        start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, int)
        met = np.diff(np.concatenate((start, [len(a)])))
        most = np.maximum.reduceat(star, start) if len(start) else star[:0]
        columns = [x.astype(t) for x, t in zip((a[start], b[start], na[start], nb[start], met, most), _PAIR_TYPES.values())]
        task = mix(columns[0].astype(np.uint64) ^ (columns[1].astype(np.uint64) << np.uint64(1))) % np.uint64(tasks)
        by = np.argsort(task, kind="stable")  # within a task's pairs, still by a and b
        cut = np.searchsorted(task[by], np.arange(tasks + 1))
        rows = [(k, *(x[by[lo:hi]].tobytes() for x in columns)) for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
        return pa.table([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows) if rows else [()] * 7)], names=["task", *_PAIR_TYPES])

    return run


def _meet(num, den):
    """Pairs that meet often enough within their prefixes, or in a long list."""

    @released_group
    def run(table: pa.Table) -> pa.Table:
        a, b, na, nb, met, star = (_joined(table, c, t).astype(np.int64) for c, t in _PAIR_TYPES.items())
        by = np.lexsort((b, a))
        start = np.flatnonzero(np.concatenate(([True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]))))
        met, star = np.add.reduceat(met[by], start), np.maximum.reduceat(star[by], start)
        a, b, na, nb = (x[by][start] for x in (a, b, na, nb))
        # Beyond its prefix a set has ceil(t*n)-1 shingles: the rest of the overlap must lie within the prefixes.
        beyond = np.maximum(_need(na, num, den), _need(nb, num, den)) - 1
        keep = (star == 1) | ((met + beyond) * (num + den) >= num * (na + nb))
        return pa.table([x[keep] for x in (a, b, na, nb)], names=["a", "b", "na", "nb"])

    return run


def _ship(width, sent):
    @released
    def run(batches):
        words, seen = sent.value, _Distinct()
        for batch in batches:
            got = []
            for s in shingle_sets(_texts(batch), width):
                if len(s):
                    d = digest(s)
                    u = d & 0xFFFFFFFFFFFFFFFF
                    if (int(words[(u >> 6) % MAP_WORDS]) >> (u & 63)) & 1 and seen.new(d):
                        got.append((d, s.tobytes()))
            if got:
                d, s = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.binary())], names=["digest", "hashes"])

    return run


def _ship_to_tasks(width, sent):
    """Sets with the tasks of the candidates that have the same upper half of a digest."""

    @released
    def run(batches):
        routes, seen = sent.value, _Distinct()
        for batch in batches:
            got = []
            for s in shingle_sets(_texts(batch), width):
                if len(s):
                    d = digest(s)
                    half = d & ~0xFFFFFFFF
                    lo, hi = np.searchsorted(routes, np.array([half, half + 0x80000000], np.int64))
                    if hi > lo and seen.new(d):
                        got += [(int(k), d, s.tobytes()) for k in np.unique(routes[lo:hi] & 0x7FFFFFFF)]
            if got:
                k, d, s = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.binary())], names=["task", "digest", "hashes"])

    return run


def _within(sets: list[np.ndarray], num: int, den: int, asked: np.ndarray | None = None) -> np.ndarray:
    """For sets in ascending order of size, the label (an index) of each one's class of links; with asked, of links that one of these sets has."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(m)
    owner = np.repeat(np.arange(m), size)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.split(ids, np.cumsum(size)[:-1])
    own = [x[count[x] > 1] for x in own]  # what one set has alone overlaps with nothing
    lists, start = owner[np.argsort(ids, kind="stable")], np.concatenate(([0], np.cumsum(count)))

    def lists_of(x):
        length = count[x]
        at = np.repeat(start[x] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        return np.bincount(lists[at], minlength=m)

    overlap, like = None, -1
    for i in range(m) if asked is None else np.flatnonzero(asked).tolist():
        if overlap is not None and len(own[i]) + len(own[like]) - 2 * overlap[i] < len(own[i]) // 2:
            overlap = overlap + lists_of(np.setdiff1d(own[i], own[like], True)) - lists_of(np.setdiff1d(own[like], own[i], True))
        else:
            overlap = lists_of(own[i])
        like = i
        lo, hi = np.searchsorted(size[:i] * den, size[i] * num), i if asked is None else m
        o = overlap[lo:hi]
        links = lo + np.flatnonzero(den * o >= num * (size[i] + size[lo:hi] - o))
        if len(links):
            old = np.unique(label[np.append(links, i)])
            if len(old) > 1:
                label[np.isin(label, old).nonzero()[0]] = old[0]
    return label


def _follow(num, den):
    """Links of a share's sets with the leaders among its rows."""

    @released_group
    def run(table: pa.Table) -> pa.Table:
        dig, lead, blobs = table.column("digest").to_numpy(), table.column("asked").to_numpy(), table.column("hashes")
        sets = [np.frombuffer(blobs[k].as_buffer(), np.uint64) for k in range(len(dig))]
        mine = np.flatnonzero(~lead)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(mine):
            every, size = np.concatenate([sets[k] for k in mine]), np.array([len(sets[k]) for k in mine])
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            for k in np.flatnonzero(lead):
                s = sets[k]
                met = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
                both = np.add.reduceat(met.astype(np.int64), start)
                linked = mine[(den * both >= num * (len(s) + size - both)) & (dig[mine] != dig[k])]
                a.append(np.full(len(linked), dig[k]))
                b.append(dig[linked])
        return pa.table([np.concatenate(a), np.concatenate(b)], names=["a", "b"])

    return run


def _answer(num, den):
    @released_group
    def run(table: pa.Table) -> pa.Table:
        cluster, dig, asked = (table.column(c).to_numpy() for c in ("cluster", "digest", "asked"))
        blobs = table.column("hashes")
        size = pc.binary_length(blobs).to_numpy()
        by = np.lexsort((~asked, dig, size, cluster))
        by = by[np.concatenate(([True], (cluster[by][1:] != cluster[by][:-1]) | (dig[by][1:] != dig[by][:-1])))]
        c = cluster[by]
        cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1], [True])))
        a, b = [], []
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi - lo > 1:
                at = by[lo:hi]
                label = _within([np.frombuffer(blobs[int(k)].as_buffer(), np.uint64) for k in at], num, den, None if asked[at].all() else asked[at])
                linked = label != np.arange(len(at))
                a.append(dig[at[linked]])
                b.append(dig[at[label[linked]]])
        none = [np.empty(0, np.int64)]
        return pa.table([np.concatenate(none + a), np.concatenate(none + b)], names=["a", "b"])

    return run


def _answer_task(num, den):
    """The same for a task's sets (digest, hashes) and its candidates (digest, cluster); sets that are no candidates are left."""
    answer = _answer(num, den)

    def run(sets: pa.Table, member: pa.Table) -> pa.Table:
        dig, known = (t.column("digest").to_numpy() for t in (sets, member))
        by = np.argsort(known)
        at = by[np.minimum(np.searchsorted(known[by], dig), len(known) - 1)] if len(known) else np.zeros(len(dig), int)
        mine = known[at] == dig if len(known) else np.zeros(len(dig), bool)
        if not mine.any():
            return pa.table([np.empty(0, np.int64)] * 2, names=["a", "b"])
        table = pa.table([dig[mine], sets.column("hashes").filter(pa.array(mine)), member.column("cluster").to_numpy()[at[mine]], np.ones(mine.sum(), bool)], names=["digest", "hashes", "cluster", "asked"])
        return answer(table)

    return run


def _info(width):
    @released
    def run(batches):
        for batch in batches:
            rows = [(len(s), digest(s) if len(s) else None) for s in shingle_sets(_texts(batch), width)]
            n, d = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=[*batch.schema.names[1:], "n_shingles", "digest"])

    return run


def _links_of_large(sets: DataFrame, member: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what links connect in clusters beyond a share.

    sets: cluster, digest, n, hashes, hashes_of_cluster; member: the same without hashes.
    """
    from_0 = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    schema, names = "a long, b long", ["cluster", "digest", "hashes", "asked"]
    shares = F.ceil(F.col("hashes_of_cluster") / SHARE_HASHES)
    chosen = [F.min(F.struct(F.xxhash64("digest", F.lit(k)), "digest"))["digest"] for k in range(LEADERS)]
    leaders = member.groupBy("cluster").agg(F.array_distinct(F.array(*chosen)).alias("d")).select("cluster", F.explode("d").alias("digest"))
    ahead = sets.join(leaders, ["cluster", "digest"], "left_semi").withColumn("asked", F.lit(True)).select(*names, from_0(shares).alias("share"))
    every = sets.withColumn("asked", F.lit(False)).select(*names, F.pmod(F.xxhash64("digest"), shares).alias("share"))
    first = written(ahead.union(every).groupBy("cluster", "share").applyInArrow(_follow(num, den), schema), "links")
    # The largest class of each cluster is done; the sets outside it are compared with all.
    classes = member.join(components(first).toDF("digest", "root"), "digest", "left")
    sizes = classes.where("root is not null").groupBy("cluster", "root").agg(F.count("*").alias("sets"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("sets", "root"))["root"].alias("main"))
    classes = joined_to_few(classes, main, "cluster", "digest", "left").withColumn("asked", ~F.coalesce(F.col("root") == F.col("main"), F.lit(False)))
    outside = classes.where("asked").groupBy("cluster").agg(F.sum("n").alias("outside"))
    # So many shares that what is outside, sent to each, is no more than the cluster, and that none is beyond a block.
    by_block = F.ceil(F.col("hashes_of_cluster") / BLOCK_HASHES)
    deal = outside.join(member.select("cluster", "hashes_of_cluster").distinct(), "cluster").select(
        "cluster", F.greatest(by_block, F.least(shares, F.ceil(F.col("hashes_of_cluster") / F.col("outside")))).alias("shares"), F.ceil(F.col("outside") / BLOCK_HASHES).alias("blocks")
    )
    rows = joined_to_few(sets.join(classes.select("digest", "asked"), "digest"), deal, "cluster", "digest")
    share, block = F.pmod(F.xxhash64("digest"), F.col("shares")), F.pmod(F.xxhash64("digest", F.lit(1)), F.col("blocks"))
    all_of = rows.withColumn("asked", F.lit(False)).select(*names, share.alias("share"), from_0(F.col("blocks")).alias("block"))
    some = rows.where("asked").select(*names, from_0(F.col("shares")).alias("share"), block.alias("block"))
    return all_of.union(some).groupBy("cluster", "share", "block").applyInArrow(_answer(num, den), schema).union(first)


def set_classes(texts: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """(digest, root) of the sets of texts (column text) that link with another one; sets of a class have one root."""
    spark = texts.sparkSession
    buckets = 2 * text_buckets(texts)
    order = spark.sparkContext.broadcast(_order(texts, width, buckets))
    lists = texts.mapInArrow(_list_entries(buckets, width, num, den, order), "bucket int, token binary, digest binary, n binary, place binary")
    pairs = lists.groupBy("bucket").applyInArrow(_scan_lists(num, den, buckets), _PAIR_BLOBS).groupBy("task").applyInArrow(_meet(num, den), "a long, b long, na long, nb long")
    pairs = written(pairs, "pairs")
    sizes = pairs.select("a", "na").union(pairs.select("b", "nb")).toDF("digest", "n").distinct()
    member = components(pairs).toDF("digest", "cluster").join(sizes, "digest")
    whole = member.groupBy("cluster").agg(F.sum("n").alias("hashes_of_cluster"))
    member = written(joined_to_few(member, whole, "cluster", "digest"), "members")
    large = F.col("hashes_of_cluster") > 2 * SHARE_HASHES
    candidates, total, beyond = member.agg(F.count("*"), F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)), F.count_if(large)).first()
    tasks = int(max(1, total // SHARE_HASHES, min(shuffle_partitions(spark), total // 50_000)))
    task = F.when(large, tasks).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(tasks))).cast("int").alias("task")
    if candidates <= MOST_ROUTED:
        routes = member.select(F.col("digest").bitwiseAND(F.lit(~0xFFFFFFFF)).bitwiseOR(task.cast("long")).alias("route")).toArrow()
        routes = spark.sparkContext.broadcast(np.sort(routes.column("route").to_numpy()))
        shipped = texts.mapInArrow(_ship_to_tasks(width, routes), "task int, digest long, hashes binary")
    else:
        word = F.pmod(F.shiftrightunsigned("digest", 6), F.lit(MAP_WORDS))
        words = np.zeros(MAP_WORDS, np.uint64)
        got = member.groupBy(word.alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(digest & 63 as int)))").alias("bits")).toArrow()
        words[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        shipped = texts.mapInArrow(_ship(width, spark.sparkContext.broadcast(words)), "digest long, hashes binary")
        shipped = shipped.join(member.select("digest", task), "digest").select("task", "digest", "hashes")
    if beyond:
        shipped = written(shipped, "candidates")
    small = member.where(~large).select(task, "digest", "cluster").groupBy("task")
    links = shipped.where(F.col("task") < tasks).groupBy("task").cogroup(small).applyInArrow(_answer_task(num, den), "a long, b long")
    if beyond:
        sets = written(shipped.where(F.col("task") == tasks).drop("task").join(member.where(large), "digest"), "large")
        links = links.union(_links_of_large(sets, member.where(large), num, den))
    # Written first: in one stage with the forests of components() each task would need two Python workers.
    return components(written(links, "links")).toDF("digest", "root")


def representatives(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5) -> DataFrame:
    """The numbers ``row`` of one row of each class of linked texts, and of all texts without words.

    docs: row long (unique), doc_id and text. Of a class it is the row with the smallest doc_id (one
    that is null comes last), then the smallest digest of its set, then the smallest number.
    """
    docs = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), "row")
    info = written(docs.mapInArrow(_info(width), "doc_id long, row long, n_shingles long, digest long"), "sets")
    classes = set_classes(docs.select("text"), num, den, width)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest", "row")
    of_sets = info.where("digest is not null").groupBy("digest").agg(F.min(first).alias("first")).join(classes, "digest", "left")
    best = of_sets.groupBy(F.coalesce("root", "digest").alias("root")).agg(F.min("first").alias("first"))
    return best.select("first.row").union(info.where("digest is null").select("row"))


def linked_classes(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id long, text string).

    Sets A and B link when ``den * |A and B| >= num * |A or B|``; component_id is the
    smallest doc_id reachable by links, the row's own included.
    """
    docs = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    classes = set_classes(docs.select("text"), num, den, width)
    info = written(docs.mapInArrow(_info(width), "doc_id long, n_shingles long, digest long"), "sets")
    least = info.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least")).join(classes, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id")).join(least.select("digest", "root"), "root").select("digest", "component_id")
    return info.join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
