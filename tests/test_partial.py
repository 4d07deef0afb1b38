"""States of outcomes: parts merge into the whole, batches count once, sketches keep their error."""

import random

import pytest
from pyspark.sql import functions as F

from trialweave.operators import outcomes, partial
from trialweave.sources import runs


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(4)
    rows = [
        (rng.choice("ab"), f"t{rng.randrange(3)}", f"c{rng.randrange(5)}", i, rng.choice(["ok", "ok", "ok", "error"]), rng.choice([None, rng.random()]), rng.choice([None, True, False]), rng.random() < 0.2, rng.randrange(4), rng.lognormvariate(3, 2), 5, 7, rng.random(), [f"g{rng.randrange(3)}"])
        for i in range(3000)
    ] + [("errors", "t0", "c0", 9999, "error", None, None, False, 1, 1.0, 1, 1, 0.0, ["x"])]
    return spark.createDataFrame(rows, "model_id string, task_id string, case_id string, sample_index long, status string, score double, passed boolean, cached boolean, attempts long, latency_ms double, input_tokens long, output_tokens long, cost_usd double, tags array<string>").repartition(4)


def board(df):
    skip = ("latency_p50_ms", "latency_p95_ms", "rank_error")
    return {r["model_id"]: {c: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for c, v in r.asDict().items() if c not in skip} for r in df.collect()}


@pytest.mark.parametrize("errors", ["zero", "exclude"])
def test_state_equals_the_whole_after_appends(spark, records, tmp_path, errors):
    state = partial.OutcomeState(spark, str(tmp_path / "state"))
    parts = [records.where(F.col("sample_index") % 5 == i) for i in range(5)]
    for i, part in enumerate(parts[:3]):
        state.add(part, i)
    state.add(parts[1], 1)  # tried again
    state.compact()
    for i, part in enumerate(parts[3:], 3):
        state.add(part, i)
    got, want = board(state.leaderboard(errors)), board(outcomes.leaderboard(records, errors))
    assert {m: {c: v for c, v in r.items() if c in got[m]} for m, r in want.items()} == got
    cases = {tuple(r[c] for c in partial.CASE): r for r in partial.outcomes_of(state.cases(), errors).collect()}
    for r in outcomes.collapse_cases(records, errors).collect():
        own = cases.pop(tuple(r[c] for c in partial.CASE))
        assert own["score"] == pytest.approx(r["score"]) and own["passed"] == pytest.approx(r["passed"]) and (own["samples"], own["errors"], own["tags"]) == (r["samples"], r["errors"], r["tags"])
    assert not cases


def test_a_stream_of_files_adds_each_batch_once(spark, tmp_path):
    line = lambda i: (f"r{i % 2}", "m", "t", f"c{i % 3}", i, "ok", 0.25 * (i % 4), i % 2 == 0, float(i))
    state = partial.OutcomeState(spark, str(tmp_path / "state"))
    for lo in (0, 40):
        rows = spark.createDataFrame([line(i) for i in range(lo, lo + 40)], "run_id string, model_id string, task_id string, case_id string, sample_index long, status string, score double, passed boolean, latency_ms double")
        runs.append_records(rows.coalesce(1), str(tmp_path / "files"))
        stream = spark.readStream.schema(runs.RECORD).json(str(tmp_path / "files")).fillna(runs.DEFAULTS)
        stream.writeStream.foreachBatch(state.add).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    r = state.leaderboard().first()
    assert (r["trials"], r["cases"], r["score"]) == (80, 3, pytest.approx(0.375, abs=0.02))
    assert (r["latency_p50_ms"], r["rank_error"]) == (pytest.approx(39.5, abs=0.6), 0.0)


def test_merged_sketches_keep_their_error(spark):
    rows = spark.range(200_000).select(F.lit("m").alias("model_id"), (F.col("id") % 7).alias("part"), F.lit("ok").alias("status"), F.lit(False).alias("cached"), F.exp(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 1000).alias("latency_ms"), *(F.lit(1).alias(c) for c in ("cost_usd", "input_tokens", "output_tokens", "attempts")))
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    states = partial.merge_models(partial.model_state(rows, "part", "model_id"))
    r = partial.latencies(states, shares).first()
    assert r["measured"] == 200_000 and len(r["latency"]) < 20_000
    for i, share in enumerate(shares):
        below = rows.where(F.col("latency_ms") <= r[f"p{i}"]).count() / 200_000
        assert abs(below - share) < 2 * r["rank_error"] + 1e-4
