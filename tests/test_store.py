"""The store of runs as a data source against Spark's own JSON reader."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from trialweave.sources import runs, store


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(2)
    for run in ("r1", "r2", "s1"):
        (tmp_path / run).mkdir()
        lines = []
        for i in range(300):
            row = {"run_id": run, "model_id": rng.choice("ab"), "task_id": "t", "case_id": f"é{i}", "sample_index": i, "score": rng.choice([None, 1, 0.5]), "more": [1]}
            row |= rng.choice([{}, {"tags": ["x"], "cached": True, "latency_ms": 3}, {"components": [{"name": "n", "type": "exact", "value": 1.0, "passed": True, "weight": 2.0, "required": False, "detail": {"a": [1, "b"]}}]}])
            lines.append(json.dumps(row, ensure_ascii=False))
        lines += ["", "[1]", '{"x": 1}', '{"run_id": "torn', '{"run_id": 3}', '{"run_id": "' + run + '", "sample_index": "many"}']
        (tmp_path / run / "records.jsonl").write_text("\n".join(lines), encoding="utf-8")
        (tmp_path / run / "manifest.json").write_text("{}")
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_reads_what_the_json_reader_reads(spark, folder, monkeypatch):
    store.register(spark)
    want = runs.read_records(spark, f"{folder}/*/records.jsonl")
    assert len(want.collect()) == 903 and same(spark.read.format("runs").load(folder), want)


def test_lines_belong_to_one_piece_each():
    text = b"first\n\nthird line\nlast"
    for width in range(1, len(text) + 2):
        for chunk in (1, 3, 100):
            got = [line for at in range(0, len(text), width) for line in store.lines_of(io.BytesIO(text), at, min(len(text), at + width), chunk)]
            assert got == text.split(b"\n"), width


def test_filters_choose_directories(spark, folder, monkeypatch):
    store.register(spark)
    df = spark.read.format("runs").load(folder)
    pieces = lambda d: d.rdd.getNumPartitions()
    assert pieces(df) == 3 and pieces(df.where("run_id = 'r2'")) == 1 and pieces(df.where("run_id like 'r%'")) == 2 and pieces(df.where("run_id in ('r1', 's1') and score > 0.7")) == 2 and pieces(df.where("run_id > 'r1'")) == 2
    assert df.where("run_id = 'r2' and score > 0.7").count() == len(runs.read_records(spark, f"{folder}/r2/records.jsonl").where("run_id = 'r2' and score > 0.7").collect())
    assert df.where("run_id = 'none'").count() == 0
    assert store.allowed("r1", []) and not store.allowed("r1", [store.In(("run_id",), ("x",))])


def test_writes_once_and_replaces_runs(spark, folder, tmp_path):
    store.register(spark)
    rows, to = spark.read.format("runs").load(folder), str(tmp_path / "copy")
    rows.repartition(4).write.format("runs").mode("append").save(to)
    assert same(spark.read.format("runs").load(to), rows)
    rows.where("run_id = 's1'").limit(5).write.format("runs").mode("append").save(to)
    assert spark.read.format("runs").load(to).where("run_id = 's1'").count() == 305
    rows.where("run_id = 's1'").limit(7).write.format("runs").mode("overwrite").save(to)
    got = {r["run_id"]: r["count"] for r in spark.read.format("runs").load(to).groupBy("run_id").count().collect()}
    assert got == {"r1": 300, "r2": 300, "s1": 7, "3": 3}


def test_a_failed_write_leaves_no_record(spark, folder, tmp_path):
    store.register(spark)
    rows, to = spark.read.format("runs").load(folder), str(tmp_path / "failed")
    bad = rows.withColumn("run_id", F.when((F.col("run_id") == "s1") & (F.col("sample_index") == 250), "a/b").otherwise(F.col("run_id")))
    with pytest.raises(Exception, match="name a run"):
        bad.coalesce(1).write.format("runs").mode("append").save(to)
    assert spark.read.format("runs").load(to).count() == 0
