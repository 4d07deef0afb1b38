"""Live sums with retractions against the last records of the table."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trialweave.operators import outcomes
from trialweave.streaming import latest

RECORD = "run_id string, model_id string, task_id string, case_id string, sample_index long, timestamp string, status string, score double, passed boolean, cost_usd double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    latest.configure(spark)
    yield
    spark.conf.set(key, before)


def test_out_of_order_batches_give_the_last_records(spark, rocks, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(60):  # every trial has some attempts, errors first or last, at times of their own
        for a in range(rng.randint(1, 3)):
            ok = rng.random() < 0.6
            rows.append(("r", rng.choice("m") + str(i % 2), "t", f"c{i}", 0, f"2024-01-01T00:{i:02d}:{a:02d}Z", "ok" if ok else "error", rng.choice([None, 0.5, 1.0]) if ok else None, rng.random() < 0.5 if ok else None, 0.25))
    rng.shuffle(rows)
    third = len(rows) // 3 + 1
    for b in range(3):
        spark.createDataFrame(rows[b * third : (b + 1) * third], RECORD).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = latest.changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    out.awaitTermination()
    changed = spark.read.parquet(str(tmp_path / "out"))
    assert changed.where("sign < 0").count() > 0
    got = {r["model_id"]: tuple(r)[2:] for r in latest.standing(changed).collect()}
    kept, ok = outcomes.latest(spark.createDataFrame(rows, RECORD), "timestamp"), F.col("status") == "ok"
    want = kept.groupBy("model_id").agg(F.count("*"), F.count_if(~ok), F.sum(F.coalesce("score", F.lit(0.0))), F.count_if(F.col("passed")), F.sum("cost_usd"))
    assert got == {r["model_id"]: pytest.approx(tuple(r)[1:]) for r in want.collect()}


def test_a_timer_tells_the_pace_when_nothing_arrives(spark, rocks, tmp_path):
    rows = [("r", "m", "t", f"c{i}", 0, 1, "ok" if i else "error", 1.0, True, 0.5) for i in range(4)]
    spark.createDataFrame(rows, latest.CHANGE).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(latest.CHANGE).json(str(tmp_path / "in"))
    told = []
    query = latest.paced(stream, total=10, every_ms=500).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda df, _: told.extend(df.collect())).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while len(told) < 3 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert len(told) >= 3 and all((r["done"], r["errors"], r["cost_usd"]) == (4, 1, 2.0) for r in told)
    last = told[-1]
    assert last["at_ms"] > told[0]["at_ms"] and last["eta_s"] == pytest.approx(6 / last["rate_per_s"])
