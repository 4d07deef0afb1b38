"""Repair of conversations: the cheapest edits that make the turns of each one alternate.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Walking along
its rows, an automaton has four states: nothing yet, after ``s``, after ``u``, after ``a``; each
allows one role but ``s``. Edits keep a row (0), change its role to the allowed one (1), delete
it (2; blank and duplicate rows must go) or insert the allowed role with an empty text (5); a
truncated row that isn't deleted costs 5 more. Of the edits of least cost those whose initials
are ASCII-least are emitted.

The costs of what is still to come are a vector over the four states, computed from the last
row to the first. Only every sqrt(n)-th vector is kept; walking forward, the vectors of one
block are computed again from the one at its end, and at each row the ASCII-least of the tight
edits is taken. So a conversation of n rows takes O(sqrt n) memory beside a byte for each row.

How rows get there: equal rows (turn, role and text) are counted before they are shuffled, a
text that a conversation has at several turns is joined to its first turn, rows are sorted by
ranges of (conversation, turn, ...), which splits a conversation of any length, and each run of
a conversation's rows becomes a block of one byte a row. Only these bytes, and the edits, which
are one value of the result, come together for a conversation; its texts stream past the edits
in order, sorted by Spark, and are never held.

Defined cases: a null role or text is one space, a null turn comes before all others, and null
conv_ids are one conversation. Rows of one turn are taken by role, then by the sha-256 of the
text. Other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a conversation in one block of bytes at most.
BLOCK_ROWS = 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; the role that each allows, and the state after it.
_START, _S, _U, _A = range(4)
ALLOWED, AFTER = ("user", "user", "assistant", "user"), (_U, _U, _A, _U)
_KINDS = "sua"
OK, BLANK, DUPLICATE, CUT = range(4)
_INF = 1 << 60

_WHITE = r"[\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows of conversations after the damage that crc32(conv_id:turn) % 20 says, with ``gone``: whether a row is dropped."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _codes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, code and copies of the distinct rows of each conversation, in the order of partitions and rows; gone rows have no copies.

    code: the role's initial (0 to 2 for s, u and a, else 3) and four times the first fault.
    """
    last = F.right(F.regexp_replace("text", f"{_WHITE}+$", ""), F.lit(1))
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(OK)
    keys = ["conv_id", "turn", "role", "digest"]
    rows = rows.withColumns({"digest": F.when(~F.col("gone"), _digest(F.col("text"))), "role": F.when(~F.col("gone"), F.col("role")), "turn": F.when(~F.col("gone"), F.col("turn")), "fault": fault})
    distinct = rows.groupBy(*keys).agg(F.count_if(~F.col("gone")).alias("copies"), F.max("fault").alias("fault"))
    # Texts that a conversation has at several turns, by their first; most texts aren't among them.
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = distinct.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    again = again.select(*(F.col(c).alias(f"r_{c}") for c in ("conv_id", "role", "digest")), "first")
    same = F.col("conv_id").eqNullSafe(F.col("r_conv_id")) & (F.col("role") == F.col("r_role")) & (F.col("digest") == F.col("r_digest"))
    marked = distinct.join(again, same, "left").withColumn("later", F.coalesce(place > F.col("first"), F.lit(False)))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when((F.col("fault") != BLANK) & F.col("later"), DUPLICATE).otherwise(F.col("fault"))
    order = [F.col(c).asc_nulls_first() for c in keys]
    return marked.select(*keys, (kind + 4 * fault).cast("int").alias("code"), "copies").repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "code", "copies")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of codes of consecutive rows of one conversation; turns: how many distinct ones, the first and the last."""
    place = TaskContext.get().partitionId() << 33
    for batch in batches:
        if not len(batch):
            continue
        conv, turn = batch.column("conv_id"), batch.column("turn")
        known = conv.is_valid().to_numpy(zero_copy_only=False)
        value = conv.fill_null(0).to_numpy()
        edge = np.flatnonzero((value[1:] != value[:-1]) | (known[1:] != known[:-1])) + 1
        codes, copies = batch.column("code").to_numpy(), batch.column("copies").to_numpy()
        out = []
        for lo, hi in zip([0, *edge], [*edge, len(batch)]):
            ends = np.cumsum(copies[lo:hi])
            for start in range(0, max(1, int(ends[-1])), BLOCK_ROWS):  # copies are rows too, and may be any number
                at = np.arange(start, min(int(ends[-1]), start + BLOCK_ROWS))
                row = np.searchsorted(ends, at, "right")
                mine = codes[lo:hi][row]
                mine = np.where((at > ends[row] - copies[lo:hi][row]) & (mine >> 2 != BLANK), (mine & 3) | DUPLICATE << 2, mine)
                turns = turn.slice(lo, hi - lo).take(pa.array(np.unique(row))).drop_null().to_numpy()
                count = len(np.unique(turns))
                out.append((conv[lo].as_py(), place, mine.astype(np.uint8).tobytes(), count, int(turns[0]) if count else None, int(turns[-1]) if count else None))
                place += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (conv.type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["conv_id", "place", "codes", "turns", "low", "high"])


def _step(code: int, after: list[int]) -> list[int]:
    """The costs from before a row, by those from after it."""
    kind, fault = code & 3, code >> 2
    got = [DELETE + x for x in after]
    if fault in (OK, CUT):
        more = TRUNCATED if fault == CUT else 0
        for s in range(4):
            got[s] = min(got[s], more + after[AFTER[s]] + (KEEP if kind < 3 and _KINDS[kind] == ALLOWED[s][0] else REROLE))
        if kind == 0:
            got[_START] = min(got[_START], more + after[_S])
    return _inserted(got)


def _inserted(costs: list[int]) -> list[int]:
    """costs, with rows inserted before: two that return to a state gain nothing."""
    u, a = min(costs[_U], INSERT + costs[_A]), min(costs[_A], INSERT + costs[_U])
    return [min(costs[_START], INSERT + u), min(costs[_S], INSERT + u), u, a]


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, edits' initials) of rows by their codes: least cost, then ASCII-least."""
    n = len(codes)
    every = max(1, math.isqrt(n))
    vector = _inserted([0, _INF, _INF, 0])
    kept = {n: vector}
    for i in range(n - 1, -1, -1):
        vector = _step(codes[i], vector)
        if i % every == 0:
            kept[i] = vector
    cost, state, done, edits = vector[_START], _START, [], []
    for lo in range(0, n, every):
        done.append("".join(edits))
        edits.clear()
        hi = min(n, lo + every)
        block = [kept[hi]]
        for i in range(hi - 1, lo - 1, -1):
            block.append(_step(codes[i], block[-1]))
        block.reverse()
        for i in range(lo, hi):
            here, after, kind, fault = block[i - lo], block[i - lo + 1], codes[i] & 3, codes[i] >> 2
            more = TRUNCATED if fault == CUT else 0
            while True:
                if here[state] == DELETE + after[state]:
                    edits.append("D")
                    break
                to = AFTER[state]
                if here[state] == INSERT + here[to]:
                    edits.append("I")
                    state = to
                    continue
                if kind == 0 and state == _START and here[state] == more + after[_S]:
                    edits.append("K")
                    state = _S
                elif kind < 3 and _KINDS[kind] == ALLOWED[state][0] and here[state] == more + after[to]:
                    edits.append("K")
                    state = to
                else:
                    edits.append("R")
                    state = to
                break
    while state not in (_START, _A):
        edits.append("I")
        state = AFTER[state]
    return cost, "".join(done) + "".join(edits)


_LEGAL = np.zeros(16, bool)
_LEGAL[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True  # su, ua, au
_SUMS = "gaps: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string"


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and sums of each conversation from its blocks, which follow one another."""

    def of(conv, blocks):
        codes = b"".join(b["codes"] for b in blocks)
        x = np.frombuffer(codes, np.uint8)
        kind, fault = x & 3, np.bincount(x >> 2, minlength=4).tolist()
        known = [b for b in blocks if b["turns"]]
        distinct = sum(b["turns"] for b in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        cost, audit = cheapest(codes)
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        return conv, gaps, fault[BLANK], fault[DUPLICATE], fault[CUT], int((~_LEGAL[kind[:-1] * 4 + kind[1:]]).sum()), cost, audit

    names = ["conv_id", *(c.split(":")[0] for c in _SUMS.split(", "))]
    held, kind = [], None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for b in batch.to_pylist():
            if held and held[0]["conv_id"] != b["conv_id"]:
                out.append(of(held[0]["conv_id"], held))
                held = []
            held.append(b)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (kind, *[pa.int64()] * 6, pa.string()))], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(of(held[0]["conv_id"], held), (kind, *[pa.int64()] * 6, pa.string()))], names)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of rows (as of damaged())."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = _codes(rows).mapInArrow(_runs, f"conv_id {kind}, place long, codes binary, turns long, low long, high long")
    order = [F.col("conv_id").asc_nulls_first(), F.col("place")]
    return blocks.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_audited, f"conv_id {kind}, {_SUMS.replace(':', '')}")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each conversation along its rows; a conversation begins with the row that has its sums."""
    conv, audit, at, left, place, state = None, "", 0, 0, 0, _START
    for batch in batches:
        out = []

        def emit(edit, role, text):
            nonlocal place
            out.append((conv, place, edit, role, text, None))
            place += 1

        def insert():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                emit("I", ALLOWED[state], "")
                at, state = at + 1, AFTER[state]

        for r in batch.to_pylist():
            if r["sums"] is not None:
                conv, audit, at, place, state = r["conv_id"], r["sums"]["audit"], 0, 0, _START
                left = len(audit) - audit.count("I")  # rows to come
                out.append((conv, -1, None, None, None, r["sums"]))
                continue
            insert()
            edit, role = audit[at], r["role"]
            at, left = at + 1, left - 1
            if edit == "R":
                role, state = ALLOWED[state], AFTER[state]
            elif edit == "K":
                state = _S if role[0] == "s" else AFTER[state]
            emit(edit, role, r["text"])
            if not left:
                insert()
        kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), batch.schema.field("sums").type)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["conv_id", "place", "edit", "role", "text", "sums"])


def edited(rows: DataFrame) -> DataFrame:
    """All edits in order: conv_id, place, edit (K, R, D, I), role and text after it; before a conversation's first (place -1) its sums."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = audits(rows).select("conv_id", F.struct(*(c.split(":")[0] for c in _SUMS.split(", "))).alias("sums"))
    texts = rows.where("not gone").select("conv_id", F.lit(1).alias("after"), "turn", "role", "text")
    both = texts.unionByName(heads.withColumn("after", F.lit(0)), allowMissingColumns=True).withColumn("digest", _digest(F.col("text")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("after"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "sums")
    return dealt.mapInArrow(_replayed, f"conv_id {kind}, place long, edit string, role string, text string, sums struct<{_SUMS}>")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the repaired conversations of rows (as of damaged())."""
    return edited(rows).where("edit <> 'D'").select("conv_id", "place", "role", "text")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's sums with the sha-256 of its repaired rows, as they stream past."""
    conv, sums, hashed, any_row = None, None, None, False
    names = [c.split(":")[0] for c in _SUMS.split(", ")]

    def packed(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (kind, *[pa.int64()] * 6, pa.string(), pa.string()))], ["conv_id", *names, "repaired_sha256"])

    kind = None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for r in batch.to_pylist():
            if r["sums"] is not None:
                if sums is not None:
                    out.append((conv, *(sums[c] for c in names), hashed.hexdigest()))
                conv, sums, hashed, any_row = r["conv_id"], r["sums"], hashlib.sha256(), False
            elif r["edit"] != "D":
                hashed.update(("\n" * any_row + f"{r['role']}:{r['text']}").encode("utf-8", "surrogatepass"))
                any_row = True
        if out:
            yield packed(out, kind)
    if sums is not None:
        yield packed([(conv, *(sums[c] for c in names), hashed.hexdigest())], kind)


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation of edited(): its sums and the sha-256 of the repaired ``role:text``, newline-joined. Keeps the order of edits."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    return edits.mapInArrow(_summed, f"conv_id {kind}, {_SUMS.replace(':', '')}, repaired_sha256 string")
