"""Comparisons, comparisons' inputs and specs: against plain loops, with duplicates, lone units and one cluster."""

import json
import math
import random
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from trialweave.functions import mock, templates
from trialweave.functions import text as T
from trialweave.functions import values as V
from trialweave.operators import bootstrap, compare, judge, outcomes, scorers, stacks
from trialweave.plans import specs, trials
from trialweave.sources import runs
from trialweave.streaming import live


def drawn(k, seed, rep, j):
    import hashlib

    return math.floor(int(hashlib.sha256(f"{seed}:{rep}:{j}".encode()).hexdigest()[:12], 16) / 2**48 * k)


def loop(values, resamples, seed, level=0.95):
    """(means, bca or percentile interval) of {cluster: [values]} by plain loops over the hashed draws."""
    clusters = [values[c] for c in sorted(values)]
    k = len(clusters)
    means = []
    for rep in range(resamples):
        picked = [clusters[drawn(k, seed, rep, j)] for j in range(k)]
        means.append(math.fsum(map(math.fsum, picked)) / sum(map(len, picked)))
    means.sort()
    every = [v for c in clusters for v in c]
    without = [(math.fsum(every) - math.fsum(c)) / (len(every) - len(c)) for c in clusters]
    # Equal but for rounding isn't below.
    lo, hi = bootstrap.bca_quantiles([round(m, 12) for m in means], round(fmean(every), 12), without, level) or ((1 - level) / 2, (1 + level) / 2)
    return means, (bootstrap.quantile(means, lo), bootstrap.quantile(means, hi))


def test_intervals_of_hashed_draws(spark):
    rng = random.Random(3)
    values = {f"t{c}": [min(1.0, max(0.0, rng.gauss(0.7, 0.2))) ** 3 for _ in range(rng.randint(1, 9))] for c in range(9)}
    obs = spark.createDataFrame([("m", c, v) for c, vs in values.items() for v in vs] + [("lone", "t", 0.5)], "model_id string, cluster string, value double")
    sums = bootstrap.clusters(obs, "model_id")
    means, (low, high) = loop(values, 300, 7)
    got = sorted(r["mean"] for r in bootstrap.replicates(sums.where("model_id = 'm'"), 300, 7, "model_id").collect())
    assert got == pytest.approx(means, rel=1e-12)
    rows = {r["model_id"]: r for r in bootstrap.intervals(sums, 300, 7).collect()}
    assert (rows["m"]["low"], rows["m"]["high"], rows["m"]["std_error"], rows["m"]["method"]) == (pytest.approx(low, rel=1e-9), pytest.approx(high, rel=1e-9), pytest.approx(pstdev(means), rel=1e-9), "bca")
    assert (rows["lone"]["low"], rows["lone"]["method"]) == (0.5, "degenerate")
    same = bootstrap.clusters(spark.createDataFrame([("m", f"t{i}", 1.0) for i in range(10)], "model_id string, cluster string, value double"), "model_id")
    one = bootstrap.intervals(same, 50).first()
    assert (one["method"], one["point"], one["low"], one["high"]) == ("percentile", 1.0, 1.0, 1.0)


def observed(spark, rows):
    return spark.createDataFrame(rows, "unit string, cluster string, value double, ordinal long")


def test_last_of_a_unit_counts_once(spark):
    a = observed(spark, [("u1", "c1", 0.0, 1), ("u1", "c1", 1.0, 2), ("u2", "c2", 1.0, 1), ("only", "c2", 0.0, 1)])
    b = observed(spark, [("u1", "c1", 0.0, 3), ("u1", "c1", 1.0, 1), ("u2", "c2", 0.5, 1)])
    assert sorted((r["unit"], r["value_a"], r["value_b"]) for r in compare.paired(a, b).collect()) == [("u1", 1.0, 0.0), ("u2", 1.0, 0.5)]
    r = compare.paired_diff(a, b, 60).first()
    assert (r["n_paired"], r["n_clusters"], r["mean_a"], r["mean_b"], r["delta"], r["wins"], r["only_in_a"], r["only_in_b"]) == (2, 2, 1.0, 0.25, 0.75, 2, 1, 0)
    assert len(r["notes"]) == 1 and r["verdict"] == "improvement" and compare.regression_gate(compare.paired_diff(b, a, 60)).first()["fails"]


def test_differences_by_loop(spark):
    rng = random.Random(8)
    pairs = [(f"t{i % 7}", rng.random(), rng.random() * 0.8) for i in range(60)]
    a = observed(spark, [(f"u{i}", c, x, i) for i, (c, x, _) in enumerate(pairs)])
    b = observed(spark, [(f"u{i}", c, y, i) for i, (c, _, y) in enumerate(pairs)])
    group = lambda f: {c: [f(x, y) for d, x, y in pairs if d == c] for c in {c for c, _, _ in pairs}}
    means, (low, high) = loop(group(lambda x, y: x - y), 200, 5)
    r = compare.paired_diff(a, b, 200, 5).first()
    assert (r["low"], r["high"], r["std_error"]) == (pytest.approx(low), pytest.approx(high), pytest.approx(pstdev(means)))
    clusters = [[group(f)[c] for c in sorted(group(f))] for f in (lambda x, y: x, lambda x, y: y)]
    apart = []
    for rep in range(200):
        side = []
        for seed, cs in zip((6, 7), clusters):
            picked = [cs[drawn(7, seed, rep, j)] for j in range(7)]
            side.append(math.fsum(map(math.fsum, picked)) / sum(map(len, picked)))
        apart.append(side[0] - side[1])
    apart.sort()
    assert (r["unpaired_low"], r["unpaired_high"]) == (pytest.approx(bootstrap.quantile(apart, 0.025)), pytest.approx(bootstrap.quantile(apart, 0.975)))


def test_nothing_shared_and_one_cluster(spark):
    a, b = observed(spark, [("x", "c", 1.0, 0), ("y", "c", 0.0, 0)]), observed(spark, [("z", "c", 0.25, 0)])
    r = compare.paired_diff(a, b, 20).first()
    assert (r["n_paired"], r["mean_a"], r["mean_b"], r["delta"], r["method"], r["unpaired_method"], r["verdict"]) == (0, 0.5, 0.25, 0.0, "empty", "empty", "inconclusive") and len(r["notes"]) == 2
    r = compare.paired_diff(a, a, 20).first()
    assert (r["n_paired"], r["method"], r["unpaired_method"], r["low"], r["verdict"], r["mde"]) == (2, "degenerate", "degenerate", 0.0, "inconclusive", 0.0)
    one = observed(spark, [(f"u{i}", f"t{i}", 1.0, 0) for i in range(10)])
    two = observed(spark, [(f"u{i}", f"t{i}", float(i < 2), 0) for i in range(10)])
    r = compare.paired_diff(one, two, 50, binary=True).first()
    assert (r["only_a"], r["only_b"], r["p_value"]) == (8, 0, pytest.approx(2 / 2**8))


def test_runs_and_their_models(spark):
    rows = [("r1", m, "t", f"c{i}", 0, "ok", 0.5, True) for m in ("a", "b") for i in range(3)] + [("r2", "a", "t", "c0", 0, "error", None, None)]
    records = spark.createDataFrame(rows, "run_id string, model_id string, task_id string, case_id string, sample_index long, status string, score double, passed boolean")
    assert runs.model_in_run(records, "r2") == "a" and runs.model_in_run(records, "r1", "b") == "b"
    for run, model in (("r1", None), ("r1", "z"), ("none", None)):
        with pytest.raises(runs.RunNotFound):
            runs.model_in_run(records, run, model)
    listed = runs.list_runs(records, spark.createDataFrame([("r0", "1")], "run_id string, version string")).collect()
    assert [(r["run_id"], r["records"], r["best_score"]) for r in listed] == [("r2", 1, 0.0), ("r1", 6, 0.5), ("r0", 0, None)]


SUITE = """
name: demo
models: [{id: a, provider: mock, model: m, params: {temperature: 0}}, {id: b, provider: mock, model: m}]
tasks: [tasks, "more/*.yaml", tasks/one.yaml]
params: {max_tokens: 5}
repeats: 2
"""
TASK = "id: {id}\nprompt: 'What is {{{{ q }}}}?'\nscoring: [{{type: {kind}, target: '{{{{ a }}}}'}}]\ncases: [{{vars: {{q: 1, a: 1}}}}, {{vars: {{q: 2, a: 2}}}}]\n"


def test_suites(spark, tmp_path):
    (tmp_path / "tasks" / "deep").mkdir(parents=True)
    (tmp_path / "more").mkdir()
    (tmp_path / "suite.yaml").write_text(SUITE)
    (tmp_path / "tasks" / "one.yaml").write_text(TASK.format(id="one", kind="numeric"))
    (tmp_path / "tasks" / "deep" / "two.yml").write_text(TASK.format(id="two", kind="exact"))
    (tmp_path / "more" / "three.yaml").write_text(TASK.format(id="three", kind="contains"))
    suite, tasks, cases = specs.load_suite(spark, tmp_path / "suite.yaml")
    assert [r["task_id"] for r in tasks.orderBy("ordinal").collect()] == ["two", "one", "three"] and cases.count() == 6 and suite["errors"] == "zero"
    manifest = runs.build_manifest(suite, tasks, cases, "run-1", "0", {"git": "x"})
    assert manifest["totals"] == {"models": 2, "tasks": 3, "cases": 6, "planned_trials": 24} and manifest["git"] == "x" and json.loads(manifest["models"][0]["params"]) == {"max_tokens": 5, "temperature": 0}
    assert manifest["suite"]["fingerprint"] == runs.build_manifest(suite, tasks, cases, "run-2", "0")["suite"]["fingerprint"]
    runs.write_manifest(manifest, tmp_path / "runs" / "run-1")
    runs.write_manifest({}, tmp_path / "runs" / "run-2")
    (tmp_path / "runs" / "run-2" / "manifest.json").write_text("{torn")
    read = runs.read_manifests(spark, f"{tmp_path}/runs/*/manifest.json")
    assert [(r["run_id"], len(r["tasks"])) for r in read.where("run_id is not null").collect()] == [("run-1", 3)]
    assert runs.read_manifests(spark, f"{tmp_path}/none/*.json").count() == 0 and runs.read_document(tmp_path / "runs/run-2/manifest.json") == {} and runs.read_document(tmp_path / "gone") == {}
    assert runs.read_document(tmp_path / "runs/run-1/manifest.json")["run_id"] == "run-1"
    for change, said in ((("tasks: [tasks", "tasks: [nowhere"), "no file"), (("id: b", "id: a"), "twice"), (("repeats: 2", "repeats: 0"), "repeats"), (("repeats: 2", "errors: maybe"), "errors"), (("name: demo", "nmae: demo"), "unknown key"), (("models: [", "models: []\nlimits: [") , "models")):
        (tmp_path / "bad.yaml").write_text(SUITE.replace(*change))
        with pytest.raises(specs.SpecError, match=said):
            specs.load_suite(spark, tmp_path / "bad.yaml")
    (tmp_path / "more" / "three.yaml").write_text(TASK.format(id="three", kind="llm_judge"))
    with pytest.raises(specs.SpecError, match="three"):
        specs.load_suite(spark, tmp_path / "suite.yaml")


def test_filters_that_match_nothing(spark):
    rows = spark.createDataFrame([("ab",), ("cd",)], "task_id string")
    assert trials.filter_suite(rows, "task_id", ["a*"]).count() == 1
    with pytest.raises(trials.NothingMatched, match="ab, cd"):
        trials.filter_suite(rows, "task_id", ["x*"])


def test_advice_about_the_judge(spark):
    tasks = spark.createDataFrame([("t", 5), ("u", 1)], "task_id string, cases long")
    models = spark.createDataFrame([("m", "mock", False)], "model_id string, provider string, priced boolean")
    assert {r["advice"] for r in trials.advisories(tasks, models, judge_samples=1).collect()} == {"few cases", "asked once: its noise can't be seen"}
    assert {r["advice"] for r in trials.advisories(tasks, models, judge_samples=3).collect()} == {"few cases"}


def test_templates_keep_types(spark):
    df = spark.createDataFrame([("x", [2, 1], {"b": 1, "a": [1.5]}, "{{")], "s string, l array<int>, m struct<b: int, a: array<double>>, t string")
    kinds = {"l": "array<int>"}
    values = {c: F.col(c) for c in df.columns}
    made = templates.render_deep({"deep": ["{{ l }}", {"x": "{{ s | upper }}!"}], "plain": "no tag", "n": 3, "json": "{{ m | json }}", "pretty": "{{ m | json_pretty }}", "len": "{{ l | len }} {{ s | len }}"}, values, kinds)
    assert made["plain"] == "no tag" and made["n"] == 3
    r = df.select(made["deep"][0].alias("l"), made["deep"][1]["x"].alias("x"), made["json"].alias("json"), made["pretty"].alias("pretty"), made["len"].alias("len")).first()
    assert (r["l"], r["x"], r["json"], r["len"]) == ([2, 1], "X!", '{"a": [1.5], "b": 1}', "2 1") and r["pretty"] == json.dumps({"b": 1, "a": [1.5]}, indent=2, sort_keys=True)
    with pytest.raises(templates.TemplateError):
        templates.render_value("{{ gone }}", values)


def test_text_of_values(spark):
    r = spark.range(1).select(
        V.as_text(F.lit(3.0), "double").alias("a"), V.as_text(F.lit(2.5), "double").alias("b"), V.as_text(F.lit(True), "boolean").alias("c"), V.interval_cell(F.lit(0.1), F.lit(0.3), F.lit("bca")).alias("d"), V.interval_cell(F.lit(0.1), F.lit(0.3), F.lit("degenerate")).alias("e"),
        V.money(F.lit(0.00123)).alias("f"), V.duration_text(F.lit(3725.0)).alias("g"), V.percent(F.lit(0.12345)).alias("h"),
    ).first()
    assert tuple(r) == ("3", "2.5", "true", "±10.0", "n/a", "$0.0012", "1h02m", "12.3%")
    assert V.rounded(spark.createDataFrame([(1.23456789, 0.98765)], "x double, hit_rate double"), hit_rate=2).first() == (1.234568, 0.99)


def test_markdown_to_the_end(spark):
    import re

    texts = ["***42***", "_" * 9 + "x" + "_" * 9, "**a _b *c* d_ e**", "plain", "", None, "*" * 40, "**a** " * 300 + "__x__"]

    def loops(t):
        while t is not None:
            less = re.sub(r"(?s)(\*{1,3}|_{1,3})(.+?)\1", r"\2", t)
            if less == t:
                break
            t = less
        return t

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.strip_markdown(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [loops(t) for t in texts]


def test_unicode_space_in_fences_and_thoughts(spark):
    df = spark.createDataFrame([(" ```py \nx\n``` ", "<think>a</think> y")], "f string, t string")
    assert tuple(df.select(T.strip_code_fence(F.col("f")), T.strip_thinking(F.col("t"))).first()) == ("x", "y")


def test_regex_groups_and_options(spark):
    x = F.col("t")
    df = spark.createDataFrame([("found ID-42 here",)], "t string")
    one = lambda s: tuple(df.select(s.alias("s")).first()["s"])
    assert one(scorers.regex(x, r"ID-(?P<n>\d+)", group="n", target="42")) == (1.0, True)
    assert one(scorers.regex(x, r"ID-(\d+)", group=1, target="43")) == (0.0, False)
    assert one(scorers.regex(x, r"ID-(\d+)", target="43", expect=False)) == (0.0, False)
    assert one(scorers.regex(x, "no", target="43", expect=False)) == (1.0, True)
    for bad in ({"group": "m"}, {"group": 2}, {"pattern": "("}):
        with pytest.raises(scorers.ScoringError):
            scorers.regex(x, **{"pattern": "ID", **bad})
    with pytest.raises(scorers.ScoringError, match="tolerence"):
        scorers.build("numeric", x, target=1, tolerence=2)
    with pytest.raises(scorers.ScoringError, match=r"t/c scoring\[1\]: .*nope"):
        scorers.stack([{"type": "numeric", "target": 1}, {"type": "nope"}], x, {}, "t/c")


def test_stacks_by_case(spark):
    answers = spark.createDataFrame([("t", "c1", "it is 7"), ("t", "c2", "**Bern.**"), ("t", "none", "x")], "task_id string, case_id string, response_text string")
    cases = spark.createDataFrame([("t", "c1", '{"a": 7}', None), ("t", "c2", '{"all": ["Bern", "Berne"]}', '[{"type": "exact", "any_of": "{{ all }}"}]')], "task_id string, case_id string, vars string, case_scoring string")
    tasks = spark.createDataFrame([("t", '[{"type": "numeric", "target": "{{ a }}", "weight": 2}, {"type": "contains", "target": "no", "required": false}]')], "task_id string, task_scoring string")
    got = {r["case_id"]: r for r in stacks.score_cases(answers, cases, tasks).select("*", scorers.verdict_of(F.col("components")).alias("v")).collect()}
    assert [(c["type"], c["value"], c["weight"]) for c in got["c1"]["components"]] == [("numeric", 1.0, 2.0), ("contains", 0.0, 1.0)] and got["c1"]["v"] == (pytest.approx(2 / 3), True)
    assert got["c2"]["v"] == (1.0, True) and got["none"]["components"] is None and got["none"]["v"] is None


def test_replies_are_read_as_a_whole(spark):
    good = '{"scores": {"accuracy": 9, "brevity": -2}, "reason": "why"}'
    forms = [good, f"```json\n{good}\n```", f"Well: {good}!", '{"scores": {"accuracy": 1}}', '{"scores": {"accuracy": true, "brevity": 1}}', '{"x": 1}', "none", None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(forms)] + [(2, 0, "none")], "trial int, sample_index int, reply string")
    rubric = [("accuracy", 2.0), ("brevity", 1.0)]
    got = judge.read_replies(df.where("trial = 1"), rubric).orderBy("sample_index").collect()
    assert [r["poll"] is not None for r in got] == [True] * 3 + [False] * 5 and [s["score"] for s in got[1]["poll"]["scores"]] == [4.0, 0.0]
    assert [r["parse_error"] for r in got[3:]] == ["no criterion brevity", "no number for accuracy", "no object scores", "no JSON", "no JSON"]
    rows = {r["trial"]: r for r in judge.judgements(df, rubric, "trial").collect()}
    assert (rows[1]["status"], rows[1]["samples"], rows[1]["samples_requested"], rows[1]["rationale"]) == ("ok", 3, 8, "why") and rows[1]["score"] == pytest.approx(8 / 12)
    assert rows[2]["status"] == "error" and rows[2]["score"] is None and "no JSON" in rows[2]["error"]


def test_percentiles_by_ranks(spark):
    rng = random.Random(2)
    rows = [("a", rng.lognormvariate(3, 2)) for _ in range(500)] + [("b", 5.0)] * 40 + [("c", -1.5), ("c", 2.5)] + [("d", None)]
    df = spark.createDataFrame(rows, "model_id string, x double").repartition(3)
    got = {r["model_id"]: (r["p0"], r["p1"]) for r in outcomes.ranked_percentiles(df, "x", [0.5, 0.95], "model_id").collect()}
    want = {r["model_id"]: tuple(r["p"]) for r in df.groupBy("model_id").agg(F.percentile("x", [0.5, 0.95]).alias("p")).where("p is not null").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_progress_of_nothing(spark):
    none = spark.createDataFrame([], "status string, cached boolean, cost_usd double")
    assert tuple(live.progress(none, 10, 0.0, F.lit(5.0)).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_wrong_answers_and_failures(spark):
    df = spark.createDataFrame([(t, s) for t in ("7", "2.5", "", "one two three", "Bern") for s in (0.0, 0.6)], "t string, s double")
    got = [tuple(r) for r in df.select("t", "s", mock.wrong_answer(F.col("t"), F.col("s"))).collect()]
    assert got == [("7", 0.0, "8"), ("7", 0.6, "5"), ("2.5", 0.0, "3.5"), ("2.5", 0.6, "0.5"), ("", 0.0, "unknown"), ("", 0.6, "unknown"), ("one two three", 0.0, "one two"), ("one two three", 0.6, "not enough information"), ("Bern", 0.0, "none of the above"), ("Bern", 0.6, "not enough information")]
    requests = spark.createDataFrame([("what", "m", i, "candidate", None) for i in range(200)], "prompt string, model string, sample_index int, role string, expected string")
    rows = mock.answers(requests, error_rate=0.3).collect()
    assert 30 <= sum(r["failed"] for r in rows) <= 90 and all((r["response_text"] is None) == r["failed"] for r in rows) and {r["response_text"] for r in rows} == {None, "[mock:m] what"}
