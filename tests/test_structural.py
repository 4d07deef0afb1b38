"""JSON compared inside the row, against the plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trialweave.operators import scorers, structural

ODD = ['{"a": NaN}', '[NaN, {"a": 1}]', '{"a": 1, "a": 2}', '{"x": {"a": 1, "a": 2}, "y": [1]}', '"\\ud800"', "12345678901234567890.5", "[" * 5000 + "]" * 5000, "1E400", "-Infinity"]
PLAIN = [None, "", " ", "no", "1 2", "1]", "[1,]", "[01]", '{"a": 1} junk', '{"a": 1} and {"b": 2}', '} {"a": 1', "x [1, 2] y", 'a [1] {"a": 1} [2]', "null", "true", "-0", ' {"a": [1, {}]} ', '"{}"', '```json\n{"a": 1.0}\n```', '<think>{"a": 2}</think>{"a": 1}', '"a\tb"', "[1.5e3, 15e2, 1500]", '{"": {"": []}}', '{"a.b": 1, "it\'s": [null]}']


def _value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice(["a", "b", "c.d", "é", ""]): _value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth and kind < 0.6:
        return [_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 0, 1, 1.0, 0.1, 2.5, -3, "x", "1", "", "null"])


def _changed(rng, v):
    if isinstance(v, dict) and v and rng.random() < 0.9:
        return {k: _changed(rng, x) for k, x in v.items() if rng.random() < 0.9} | ({"more": 1} if rng.random() < 0.2 else {})
    if isinstance(v, list) and v and rng.random() < 0.9:
        return [_changed(rng, x) for x in v] + ([1] if rng.random() < 0.1 else [])
    return v if rng.random() < 0.8 else _value(rng, 1)


@pytest.fixture(scope="module")
def pairs(spark):
    rng, rows = random.Random(3), []
    for _ in range(1500):
        want = _value(rng, 4)
        rows.append((json.dumps(want), json.dumps(_changed(rng, want), ensure_ascii=rng.random() < 0.5)))
    targets = ["1", "null", '{"a": 1}', "[1, 2]", '{"": {"": []}}', "{}", "[]", '{"a": [1, {}]}', '{"a.b": 1, "it\'s": [null, 2]}', '{"a": {"a": 2}}']
    rows += [(t, r) for t in targets + ODD[:-3] for r in PLAIN + ODD]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, target string, reply string").repartition(4).persist()


@pytest.mark.parametrize("way", [scorers.json_match, scorers.json_match_variant])
@pytest.mark.parametrize("mode,partial", [("subset", True), ("exact", True), ("exact", False)])
def test_equals_the_plain_recursion(pairs, way, mode, partial):
    from trialweave.functions import text as T

    got = pairs.select("target", "reply", T.strip_code_fence(T.strip_thinking("reply")).alias("said"), way(F.col("reply"), F.col("target"), mode, partial).alias("s")).collect()
    for r in got:
        want = scorers.json_text_result(r["said"] or "", r["target"], mode, partial)
        assert r["s"]["passed"] == want[1] and r["s"]["value"] == pytest.approx(want[0]), (r, want)


def test_python_sees_odd_texts_alone(pairs):
    """Plain replies and targets get their verdict in the JVM; what it leaves is odd for it."""
    fast = structural.verdict(structural.reply(F.col("reply")), structural.target(F.col("target")), F.lit(False), F.lit(True))
    left = pairs.where(fast.isNull()).collect()
    good = lambda t: t not in ODD and t not in ("[1,]", '{"a": 1} and {"b": 2}', '"a\tb"', "[01]", "x [1, 2] y")
    assert not [r for r in left if good(r["target"]) and good(r["reply"]) and r["i"] < 1500]
    assert len({r["reply"] for r in left if r["target"] == "[1, 2]"}) <= len(ODD) + 6


@pytest.mark.parametrize("way", [scorers.json_match, scorers.json_match_variant])
def test_literal_targets_and_no_targets(spark, way):
    df = spark.createDataFrame([('{"a": [1, 2, {"b": "x"}]}',), (None,)], "r string").coalesce(1)
    target = {"a": [1, 3, {"b": "x", "c": {}}]}
    rows = df.select(way(F.col("r"), target).alias("s"), way(F.col("r"), F.lit(None).cast("string")).alias("none"), way(F.col("r"), F.lit("{")).alias("bad")).collect()
    assert [tuple(r["s"]) for r in rows] == [(0.5, False), (0.0, False)]
    assert all(tuple(r[c]) == (None, None) for r in rows for c in ("none", "bad"))
    with pytest.raises(scorers.ScoringError, match="no JSON"):
        way(F.col("r"), "{")
