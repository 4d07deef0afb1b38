"""Replicates of very many clusters, and how often a comparison reads its input."""

import math
from statistics import fmean, pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import bootstrap, compare


def tree(sizes):
    """Blocks' paths in a tree over sizes (as many as a power of two)."""
    depth = int(math.log2(len(sizes)))
    below = lambda d, prefix: sum(sizes[prefix << (depth - d) : (prefix + 1) << (depth - d)])
    return [[(d, b >> (depth - d), below(d, b >> (depth - d)), below(d + 1, (b >> (depth - d)) << 1)) for d in range(depth)] for b in range(len(sizes))]


def test_blocks_share_out_all_draws():
    sizes, resamples = [40, 1, 7, 100, 3, 60, 50, 9], 400
    k, rng = sum(sizes), np.random.default_rng(0)
    values = [rng.normal(3, 1, s) for s in sizes]
    drawn = [bootstrap.block_sums(v, np.ones(len(v), np.int64), path, b, k, resamples, 5) for b, (v, path) in enumerate(zip(values, tree(sizes)))]
    assert (sum(n for _, n in drawn) == k).all()  # every replicate draws as many clusters as there are
    counts = np.array([n for _, n in drawn])
    for size, got in zip(sizes, counts):  # each block its binomial share
        assert abs(got.mean() - size) < 5 * math.sqrt(size * (1 - size / k) / resamples) + 1e-9
        assert got.std() == pytest.approx(math.sqrt(size * (1 - size / k)), rel=0.2, abs=0.1)
    means = sum(t for t, _ in drawn) / k
    every = np.concatenate(values)
    assert means.std() == pytest.approx(every.std() / math.sqrt(k), rel=0.15) and abs(means.mean() - every.mean()) < 5 * every.std() / math.sqrt(k * resamples)


def test_slices_of_draws_change_nothing_but_the_stream(monkeypatch):
    v, n = np.arange(50.0), np.arange(1, 51)
    monkeypatch.setattr(bootstrap, "TOGETHER", 60)
    totals, cases = bootstrap.block_sums(v, n, [], 0, 50, 300, 1)
    assert len(totals) == 300 and totals.mean() == pytest.approx(50 * v.mean(), rel=0.05) and cases.mean() == pytest.approx(50 * n.mean(), rel=0.05)


def test_a_hundred_thousand_clusters(spark):
    k, resamples = 100_000, 300
    obs = spark.range(2 * k).select((F.col("id") % k).cast("string").alias("cluster"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("value"), F.when(F.col("id") % 3 == 0, None).otherwise("m").alias("model_id"))
    sums = bootstrap.clusters(obs, "model_id")
    reps = bootstrap.replicates(sums, resamples, 3, "model_id")
    plan = reps._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    means = {}
    for r in reps.collect():
        means.setdefault(r["model_id"], []).append(r["mean"])
    assert {m: len(x) for m, x in means.items()} == {"m": resamples, None: resamples}
    for m, got in means.items():
        rows = sums.where(F.col("model_id").eqNullSafe(m)).agg(F.count("*").alias("k"), F.sum("total").alias("t"), F.sum("n").alias("n"))
        rows = rows.collect()[0]
        point = rows["t"] / rows["n"]
        spread = sums.where(F.col("model_id").eqNullSafe(m)).agg(F.sum(F.pow(F.col("total") - F.col("n") * point, 2))).first()[0]
        se = math.sqrt(spread) / rows["n"]  # of a ratio, by linearisation
        assert pstdev(got) == pytest.approx(se, rel=0.15) and abs(fmean(got) - point) < 5 * se / math.sqrt(resamples)
    one = bootstrap.intervals(sums.where("model_id = 'm'"), resamples, 3).first()
    assert one["method"] == "bca" and one["low"] < one["point"] < one["high"] and one["n_clusters"] > 90_000


def scans(df):
    """(scans beside what is kept, distinct kept tables and the scans that each was made by)."""
    leaves, own, kept = df._jdf.queryExecution().withCachedData().collectLeaves(), 0, {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("InMemoryRelation"):
            inner = leaf.cacheBuilder().cachedPlan().toString()
            kept[leaf.cacheBuilder().toString()[:80] + str(hash(inner))] = inner.split("== Initial Plan ==")[0].count("FileScan parquet")
        else:
            own += 1
    return own, kept


def test_a_comparison_reads_each_side_once(spark, tmp_path):
    rows = [(f"t{i % 9}/c{i}", f"t{i % 9}", float((i * 7) % 10) / 10) for i in range(200)]
    sides = []
    for name, keep in (("a", 190), ("b", 180)):
        spark.createDataFrame(rows[-keep:] if name == "a" else rows[:keep], "unit string, cluster string, value double").write.parquet(str(tmp_path / name))
        sides.append(spark.read.parquet(str(tmp_path / name)))
    diff = compare.paired_diff(*sides, resamples=50)
    own, kept = scans(diff)
    assert own == 0 and list(kept.values()) == [2]
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    r = diff.first()
    assert (r["n_paired"], r["only_in_a"], r["only_in_b"], r["delta"], r["ties"]) == (170, 20, 10, 0.0, 170)


def test_null_values_and_units(spark):
    a = spark.createDataFrame([("u1", "c", 1.0), ("u2", "c", None), ("u3", "d", 0.5), (None, "d", 1.0)], "unit string, cluster string, value double")
    b = spark.createDataFrame([("u1", "c", 0.0), ("u2", "c", 1.0), ("u3", "d", 0.5), (None, "d", 1.0)], "unit string, cluster string, value double")
    r = compare.paired_diff(a, b, resamples=20).first()
    assert (r["n_paired"], r["wins"] + r["losses"] + r["ties"], r["only_in_a"], r["only_in_b"]) == (2, 2, 1, 2)
    assert (r["mean_a"], r["mean_b"], r["delta"]) == (0.75, 0.25, 0.5)


def test_warnings_compare_parameters_of_any_type_and_read_once(spark):
    records = spark.createDataFrame([("t", "c", "ok"), ("t", "d", "error")], "task_id string, case_id string, status string")
    suite, tasks = ("f1", "zero"), [("t1", "x"), ("t2", "y"), ("t3", "z")]

    def found(params, params_b, kind, version=("1", ""), sides=(("r1", "m"), ("r2", "m")), other=("f2", "")):
        rows = [("r1", suite, version[0], tasks, [("m", "gpt", params)]), ("r2", other, version[1], [("t1", "x"), ("t2", "Y"), ("t4", "w")], [("m", "gpt", params_b)])]
        manifests = spark.createDataFrame(rows, f"run_id string, suite struct<fingerprint: string, errors: string>, version string, tasks array<struct<id: string, fingerprint: string>>, models array<struct<id: string, model: string, params: {kind}>>")
        df = compare.warnings(records, records, manifests, *sides)
        assert len(df.columns) == 3 and df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 3
        return {(r["side"], r["warning"]): r["detail"] for r in df.collect()}

    always = {("a", "many errors"): "50%", ("b", "many errors"): "50%", ("both", "other contents"): "f1 / f2", ("both", "changed tasks"): "t2 changed, t3 removed, t4 added"}
    assert found({"a": 1, "b": 2}, {"b": 2, "a": 1}, "map<string,int>") == always
    assert found('{"a": 1, "b": 2}', '{"b":2,"a":1}', "string") == always
    assert found('{"a": 1}', '{"a": 2}', "string", ("1", "2"), other=("f2", "exclude")) == always | {("both", "other parameters of one model"): '{"a":1} / {"a":2}', ("both", "other versions"): "1 / 2", ("both", "other error policies"): "zero / exclude"}
    assert found((1,), (2,), "struct<t: int>") == always | {("both", "other parameters of one model"): '{"t":1} / {"t":2}'}
    assert found("", "", "string", sides=(("r1", "m"), ("r1", "m"))) == {("a", "many errors"): "50%", ("b", "many errors"): "50%", ("both", "one side twice"): "r1:m"}
    assert found("", "", "string", sides=(("r1", "m"), ("none", "m"))) == {("a", "many errors"): "50%", ("b", "many errors"): "50%"}
