"""op13: repairs against all edits of small conversations, checkpoints against one pass, and Spark against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from trialweave.llm import repair

WELL = re.compile("(s?(ua)+)?")


def by_trying(codes, most_inserts=4):
    """The least (cost, edits) over all sequences of edits with few inserts."""
    best = None
    for row_edits in itertools.product("DKR", repeat=len(codes)):
        for slots in itertools.product(range(most_inserts), repeat=len(codes) + 1):
            if sum(slots) > most_inserts:
                continue
            cost, edits, options = 5 * sum(slots), "", [""]
            for i in range(len(codes) + 1):
                edits += "I" * slots[i]
                options = [o + "".join(x) for o in options for x in itertools.product("ua", repeat=slots[i])]
                if i == len(codes):
                    break
                kind, fault, e = codes[i] & 3, codes[i] >> 2, row_edits[i]
                edits += e
                if e == "D":
                    cost += 2
                    continue
                if fault in (1, 2):
                    options = []
                cost += (5 if fault == 3 else 0) + (e == "R")
                options = [o + x for o in options for x in ("ua" if e == "R" else "sua?"[kind])]
            if any(WELL.fullmatch(o) for o in options) and (best is None or (cost, edits) < best):
                best = (cost, edits)
    return best


def test_cheapest_edits_of_all_small_conversations():
    rng = random.Random(3)
    for n in range(4):
        for _ in range(60 if n else 1):
            codes = bytes(rng.randrange(4) + 4 * rng.choice([0, 0, 1, 2, 3]) for _ in range(n))
            assert repair.cheapest(codes) == by_trying(codes)


def test_checkpoints_give_what_one_pass_gives(monkeypatch):
    codes = bytes(random.Random(1).randrange(16) for _ in range(3001))
    want = repair.cheapest(codes)
    monkeypatch.setattr(repair.math, "isqrt", lambda n: n)
    assert repair.cheapest(codes) == want


def plain(rows):
    """All columns, by the definitions, the edits by repair.cheapest()."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        spaced = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        convs[conv] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (1 + (kind == 3))
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, codes = set(), []
        for _, role, text in held:
            core = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0
            codes.append(("sua".find(role[:1]) if role[:1] else 3) % 4 + 4 * fault)
            seen.add((role, text))
        cost, audit = repair.cheapest(bytes(codes))
        out, left, last = [], iter(held), ""
        for e in audit:
            allowed = "assistant" if last == "u" else "user"
            role, text = (allowed, "") if e == "I" else next(left)[1:]
            if e != "D":
                role = allowed if e == "R" else role
                out.append(f"{role}:{text}")
                last = role[0]
        turns = [t for t, _, _ in held if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        faults = collections.Counter(c >> 2 for c in codes)
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults[1], faults[2], faults[3], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(c, rng.choice([None, i, i, i, i + 3]), rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(["Hi.", "no end", "x!", " ", "", None, "a.b", "é?\n", "Hi. "])) for c in [None, *range(200)] for i in range(rng.randint(1, 7))]
    out += [(1000, i, rng.choice(["user", "assistant"]), f"w{rng.randint(0, 30)}.") for i in range(1500)] + [(1001, 5, "user", "same.")] * 700  # one long, one row very often
    return out + [(2000 + i, t, "user", "Hi.") for i in range(300) for t in (0,)]  # some have nothing left


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, sums int, audit string").repartition(5)


def test_equals_the_definitions(spark, rows, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 100)
    got = repair.digests(repair.edited(repair.damaged(table(spark, rows)))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = repair.digests(repair.edited(repair.damaged(df))).collect()
    assert sorted(map(tuple, got)) == sorted(plain([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]))


def test_repaired_rows_alternate(spark, rows):
    seen = collections.defaultdict(str)
    for r in repair.repaired(repair.damaged(table(spark, rows))).orderBy("conv_id", "place").collect():
        seen[r["conv_id"]] += r["role"][0]
    assert all(WELL.fullmatch(s) for s in seen.values())


def test_empty_table(spark, rows):
    assert repair.digests(repair.edited(repair.damaged(table(spark, rows[:1]).limit(0)))).collect() == []
