"""Operators on small tables with results known by hand or by a plain loop."""

import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from trialweave.functions import templates
from trialweave.functions import text as T
from trialweave.functions import values as V
from trialweave.operators import bootstrap, compare, judge, outcomes, scorers
from trialweave.plans import specs, trials
from trialweave.sources import cache, runs
from trialweave.streaming import live


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text", ["  42  ", "**42**", "***42***", "The answer is 42.", "Answer: 42", '"42"', "<think>let me see</think>42", "```\n42\n```", "```text\n42\n```"])
def test_default_chain_finds_the_answer(spark, text):
    assert one(spark, text, T.normalize) == "42"


@pytest.mark.parametrize(("name", "text", "want"), [
    ("strip", "\u00a0 a b \n", "a b"), ("collapse_whitespace", " a \n\t b ", "a b"), ("strip_punctuation", "(-5).", "5"), ("strip_articles", "The cat and a dog", "cat and dog"),
    ("strip_code_fence", "  x ``` y", "  x ``` y"), ("strip_thinking", "<Think>a\nb</think> c", "c"), ("strip_markdown", "**a _b_**", "a b"), ("strip_quotes", "“hi”", "hi"), ("strip_quotes", '"', '"'),
    ("strip_answer_prefix", "The final answer: 7", "7"), ("strip_trailing_period", "a..", "a."), ("first_line", "\n \n a \nb", "a"), ("last_line", "a\n b \n\n", "b"), ("last_line", "", ""),
    ("extract_boxed", r"so \boxed{ 17 } or \boxed{18}", "18"), ("extract_last_number", "12 x 4 = 1,248", "1248"), ("extract_first_number", "none", "none"),
    ("extract_choice", "Maybe A. Actually the answer is C.", "C"), ("extract_choice", "I'd say (D)", "D"), ("extract_choice", "B", "B"), ("normalize_unicode", "ﬁ①", "fi1"),
])
def test_normalizer(spark, name, text, want):
    assert one(spark, text, T.NORMALIZERS[name]) == want


def test_markdown_and_unicode_over_documents(spark, sf_dir):
    def unwrapped(x):
        while (y := re.sub(r"(\*{1,3}|_{1,3})(.+?)\1", r"\2", x, flags=re.DOTALL)) != x:
            x = y
        return x

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", T.strip_markdown(F.col("text")).alias("m"), T.normalize_unicode(F.col("text")).alias("u")).collect()
    assert all(r["m"] == unwrapped(r["text"]) and r["u"] == unicodedata.normalize("NFKC", r["text"]) for r in rows)


def test_white_space_is_that_of_regular_expressions(spark):
    around = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    rows = around.select(F.concat("c", F.lit("\n"), "c", F.lit("x"), "c", F.lit("y"), "c", F.lit("\n"), "c").alias("x"), F.concat("c", "c").alias("z"))
    edge = r"(?U)^[\s\"'`(\[{<.,;:!?*_-]+|[\s\"'`)\]}>.,;:!?*_-]+$"
    for c in ("x", "z"):
        odd = rows.where((T.strip(F.col(c)) != F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) | (T.strip_punctuation(F.col(c)) != F.regexp_replace(c, edge, "")))
        assert rows.count() == 0xFFFF - 2048 and odd.count() == 0


def test_a_chain_computes_each_step_once(spark):
    """Steps read their text several times; written into each other, the plan of the default chain doubles with every step."""
    plan = spark.range(1).select(T.normalize(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("<(think|") == 1


def test_unicode_in_slices():
    import pyarrow as pa

    texts = ["ﬁ①" * 9, None, "plain", "", "e\u0301", "x" * 50, "１"]
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    for size in (1, 8, 1 << 20):
        assert T._nfkc(pa.array(texts), size).to_pylist() == want
        assert T._nfkc(pa.array(texts).slice(2, 4), size).to_pylist() == want[2:6]
    assert T._nfkc(pa.array([], "string")).to_pylist() == []


def test_unknown_normalizer():
    with pytest.raises(ValueError, match="unknown normalizer"):
        T.normalize(None, ["nope"])


@pytest.mark.parametrize(("score", "text", "value", "passed"), [
    (lambda x: scorers.exact_match(x, "  Paris  "), "**Paris.**", 1.0, True),
    (lambda x: scorers.exact_match(x, "Bern", ["Berne"]), "Berne", 1.0, True),
    (lambda x: scorers.exact_match(x, "paris"), "Paris", 0.0, False),
    (lambda x: scorers.contains(x, all_of=["alpha", "beta", "gamma"]), "alpha and beta", 2 / 3, False),
    (lambda x: scorers.not_contains(x, any_of=["sorry"]), "here you go", 1.0, True),
    (lambda x: scorers.not_contains(x, any_of=["sorry"]), "sorry, I cannot", 0.0, False),
    (lambda x: scorers.not_contains(x, all_of=["a", "z"]), "a", 0.5, True),
    (lambda x: scorers.numeric(x, 42), "12 x 4 = 48, minus 6, so 42", 1.0, True),
    (lambda x: scorers.numeric(x, 1234), "1,234", 1.0, True),
    (lambda x: scorers.numeric(x, 17), r"\boxed{17}", 1.0, True),
    (lambda x: scorers.numeric(x, 100, tolerance=0.1), "100.5", 0.0, False),
    (lambda x: scorers.numeric(x, 1000, rel_tolerance=0.01), "1005", 1.0, True),
    (lambda x: scorers.numeric(x, 42, extract="strict"), "either 12 or 42", 0.0, False),
    (lambda x: scorers.numeric(x, 42), "no number", 0.0, False),
    (lambda x: scorers.regex(x, r"ID-(\d+)", group=1, target="42"), "found ID-42 here", 1.0, True),
    (lambda x: scorers.regex(x, "id", ["i"], expect=False), "ID", 0.0, False),
    (lambda x: scorers.choice(x, "c"), "The answer is (C).", 1.0, True),
    (lambda x: scorers.json_match(x, {"a": 1}), 'Sure! {"a": 1.0} Hope', 1.0, True),
    (lambda x: scorers.json_match(x, {"a": 1}, mode="exact"), '{"a": 1, "b": 2}', 0.0, False),
    (lambda x: scorers.json_match(x, {"a": 1, "b": [1, 2]}), '{"a": 1, "b": [1, 3]}', 2 / 3, False),
    (lambda x: scorers.json_match(x, {"a": 1}), "no", 0.0, False),
])
def test_scorer(spark, score, text, value, passed):
    got = one(spark, text, score)
    assert (got["value"], got["passed"]) == (pytest.approx(value), passed)


def test_scorer_registry(spark):
    assert one(spark, "a", lambda x: scorers.build(" Exact ", x, target="a"))["passed"]
    with pytest.raises(scorers.ScoringError):
        scorers.build("nope", F.col("x"))
    with pytest.raises(scorers.ScoringError):
        scorers.exact_match(None)


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", 1.0, True, 3.0, True), ("a", 0.0, False, 1.0, False), ("b", 1.0, True, 0.0, True), ("b", 0.0, False, 0.0, True)], "k string, value double, passed boolean, weight double, required boolean")
    got = {r["k"]: (r["score"], r["passed"]) for r in scorers.verdicts(rows, ["k"], 0.6).collect()}
    assert got == {"a": (0.75, True), "b": (0.5, False)}


def _records(spark, rows):
    return spark.createDataFrame(rows, "model_id string, task_id string, case_id string, status string, score double, passed boolean, tags array<string>")


def test_collapse_policies(spark):
    rows = _records(spark, [("m", "t", "c1", "error", None, None, ["x"]), ("m", "t", "c2", "ok", 1.0, True, ["y"]), ("m", "t", "c2", "ok", 0.0, False, ["x"]), ("m", "t", "c3", "ok", None, None, None)])
    zero = {r["case_id"]: r for r in outcomes.collapse_cases(rows).collect()}
    assert (zero["c1"]["score"], zero["c2"]["score"], zero["c2"]["passed"], zero["c2"]["samples"]) == (0.0, 0.5, 0.5, 2)
    assert zero["c2"]["tags"] == ["x", "y"]
    assert {r["case_id"] for r in outcomes.collapse_cases(rows, "exclude").collect()} == {"c2", "c3"}
    assert outcomes.collapse_cases(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        outcomes.collapse_cases(rows, "drop")


def test_bootstrap_exact_is_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(f"t{t:02d}/c{c}", f"t{t:02d}", float(rng.random() < 0.7)) for t in range(12) for c in range(rng.randint(1, 6))]
    obs = spark.createDataFrame([("m", *r, r[0]) for r in rows], "model_id string, unit string, cluster string, value double, ordinal string")
    got = bootstrap.exact_bootstrap(obs, 300, 5, method="percentile").first()
    clusters = {}
    for _, c, v in sorted(rows):
        clusters.setdefault(c, []).append(v)
    values, draws = list(clusters.values()), random.Random(5)
    means = []
    for _ in range(300):
        some = [values[draws.randrange(len(values))] for _ in values]
        means.append(sum(map(sum, some)) / sum(map(len, some)))
    means.sort()
    assert got["low"] == pytest.approx(bootstrap.quantile(means, 0.025)) and got["high"] == pytest.approx(bootstrap.quantile(means, 0.975))
    bca = bootstrap.exact_bootstrap(obs, 300, 5).first()
    assert bca["method"] == "bca" and bca["low"] < bca["point"] < bca["high"]


def test_bootstrap_degenerate_and_se(spark):
    obs = spark.createDataFrame([("one", "u", "c", 1.0, "u")] + [("ones", f"u{i}", f"c{i}", 1.0, f"u{i:02d}") for i in range(10)], "model_id string, unit string, cluster string, value double, ordinal string")
    got = {r["model_id"]: r for r in bootstrap.exact_bootstrap(obs, 50).collect()}
    assert got["one"]["method"] == "degenerate" and got["ones"]["method"] == "percentile" and got["ones"]["low"] == 1.0
    grid = {r["model_id"]: r for r in bootstrap.percentile_intervals(bootstrap.clusters(obs, "model_id"), 50).collect()}
    assert grid["one"]["method"] == "degenerate" and grid["ones"]["high"] == 1.0


def test_grid_covers_the_mean(spark):
    """Of 60 data sets with a known mean, the 95 % interval of nearly all holds it: one job for all."""
    rng = random.Random(1)
    obs = spark.createDataFrame([(f"d{d}", f"{t}/{c}", f"t{t}", float(rng.random() < 0.7)) for d in range(60) for t in range(15) for c in range(4)], "model_id string, unit string, cluster string, value double")
    got = bootstrap.percentile_intervals(bootstrap.clusters(obs, "model_id"), 200).collect()
    assert sum(r["low"] <= 0.7 <= r["high"] for r in got) >= 52


def test_normal_and_power(spark):
    assert bootstrap.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6) and bootstrap.normal_cdf(0) == 0.5
    with pytest.raises(ValueError):
        bootstrap.normal_ppf(1.0)
    row = spark.range(1).select(bootstrap.required_cases(F.lit(0.5), F.lit(0.1)).alias("a"), bootstrap.required_cases(F.lit(0.5), F.lit(0.05)).alias("b"), bootstrap.required_cases(F.lit(0.0), F.lit(0.1)).alias("c")).first()
    assert row["b"] == pytest.approx(4 * row["a"], rel=0.05) and row["c"] == 0


@pytest.mark.parametrize(("a", "b"), [(0, 0), (5, 5), (1, 5), (8, 0), (300, 350), (900, 1100)])
def test_mcnemar(spark, a, b):
    got = spark.range(1).select(compare.mcnemar(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("p")).first()["p"]
    n = a + b
    if n <= 1000:
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n)
    else:
        want = min(1.0, math.erfc(max(0, abs(a - b) - 1) / math.sqrt(n) / math.sqrt(2)))
    assert got == pytest.approx(want, abs=1e-6)


def test_pairs_and_sides(spark):
    side = lambda names, v: spark.createDataFrame([(n, "t", v) for n in names], "unit string, cluster string, value double")
    a, b = side(["c0", "c1", "c2", "c3", "c4", "c5"], 1.0), side(["c0", "c1", "c2", "c3", "only-b"], 0.0)
    assert compare.sign_counts(compare.paired(a, b)).first()["wins"] == 4
    assert {(r["unit"], r["side"]) for r in compare.only_in(a, b).collect()} == {("c4", "a"), ("c5", "a"), ("only-b", "b")}


def test_judge(spark):
    polls = spark.createDataFrame([("t", "accuracy", s, 2.0, 4, i, f"r{i}") for i, s in enumerate([0.0, 4.0, 9.0])] + [("t", "brevity", -2.0, 1.0, 4, 0, "r"), ("t", "brevity", None, 1.0, 4, 1, "r")], "trial string, criterion string, score double, weight double, scale int, sample_index int, rationale string")
    by = judge.criteria(polls, "trial")
    assert {r["criterion"]: (r["median"], r["spread"]) for r in by.collect()} == {"accuracy": (4.0, 4.0), "brevity": (0.0, 0.0)}
    got = judge.scores(by, "trial").first()
    assert (got["score"], got["passed"], got["disagreement"]) == (pytest.approx(8 / 12), True, 1.0)
    assert judge.first_rationale(polls, "trial").first()["rationale"] in ("r", "r0")


def test_poll_replies(spark):
    replies = ['{"scores": {"a": 3}, "rationale": "x"}', '{"scores": {"a": true}}', '{"scores": {"a": "4"}}', "nonsense", None]
    polls = spark.createDataFrame([(r, "a") for r in replies], "reply string, criterion string")
    assert [r["score"] for r in judge.poll_scores(polls).collect()] == [3.0, None, None, None, None]


def test_templates(spark):
    df = spark.createDataFrame([("x ", 3.7)], "a string, n double")
    assert df.select(templates.render("{{ a | strip | upper }}-{{n|int}} \\{{", {"a": F.col("a"), "n": F.col("n")})).first()[0] == "X-3 {{"
    assert templates.variables("{{ b }} {{ a | json }} {{ b }}") == ["b", "a"]
    for bad in ("{{ }}", "{{ nope }}", "{{ a | nope }}"):
        with pytest.raises(templates.TemplateError):
            templates.render(bad, {"a": F.col("a")})


def test_values(spark):
    got = spark.range(1).select(V.duration_seconds(F.lit("1.5h")).alias("d"), V.duration_seconds(F.lit("soon")).alias("n"), V.retry_after_seconds(F.lit("500ms")).alias("r"), V.retry_after_seconds(F.lit("Wed, 21 Oct")).alias("h"), V.token_estimate(F.lit("")).alias("t0"), V.token_estimate(F.lit("äöüßa")).alias("t")).first()
    assert tuple(got) == (5400.0, None, 0.5, None, 0, 2)
    assert runs.parse_selector("run-1:candidate") == ("run-1", "candidate") and runs.parse_selector("C:\\runs\\run-1") == ("C:\\runs\\run-1", None)


def test_plans(spark):
    models = spark.createDataFrame([("a",), ("b",)], "model_id string")
    cases = spark.createDataFrame([("t1", "c1", 0, ["x"], []), ("t1", "c2", 1, ["x"], ["y"]), ("t2", "c1", 0, ["z"], [])], "task_id string, case_id string, ordinal int, task_tags array<string>, case_tags array<string>")
    plan = trials.expand(models, cases, 3)
    assert plan.count() == 18
    done = plan.where("model_id = 'a'").select(*trials.KEY).withColumn("status", F.when(F.col("sample_index") == 0, "ok").otherwise("error"))
    assert trials.remaining(plan, done).count() == 15
    assert trials.with_tags(cases, ["y"]).count() == 2 and trials.match_globs(cases, "task_id", ["t[!2]"]).count() == 2 and trials.first_cases(cases, 1).count() == 2


def test_cache_upsert_and_versions(spark):
    row = lambda key, at, payload, hits, v=1: (key, v, "p", "m", "r", payload, at, hits)
    old = spark.createDataFrame([row("a", 1.0, "x", 5), row("b", 2.0, "y", 0, 0)], cache.SCHEMA)
    got = {r["key"]: (r["payload"], r["hits"]) for r in cache.upsert(old, spark.createDataFrame([row("a", 3.0, "z", 0)], cache.SCHEMA)).collect()}
    assert got == {"a": ("z", 5), "b": ("y", 0)}
    assert [r["key"] for r in cache.valid(old, 10.0, 9.0).collect()] == ["a"] and cache.valid(old, 10.0, 8.9).count() == 0
    assert cache.run_stats(cache.look_up(spark.createDataFrame([("a",), ("q",)], "cache_key string"), cache.empty(spark))).first()["hits"] == 0


def test_run_directories(spark, tmp_path):
    folder = tmp_path / "runs" / "r1"
    folder.mkdir(parents=True)
    lines = [json.dumps({"run_id": "r1", "model_id": "m", "task_id": "t", "case_id": "c", "sample_index": 0, "score": 1.0, "new_field": 1}), "", "[1, 2]", '{"run_id": "r1", "model_']
    (folder / "records.jsonl").write_text("\n".join(lines))
    rows = runs.read_records(spark, str(folder / "records.jsonl"))
    assert [(r["status"], r["attempts"], r["tags"]) for r in rows.collect()] == [("ok", 1, [])]
    runs.append_records(rows.withColumn("run_id", F.lit("r2")), str(tmp_path / "out"))
    both = runs.read_records(spark, str(tmp_path / "out")).unionByName(rows)
    assert runs.resolve(both, "latest") == "r2" and runs.resolve(both, "r1") == "r1"
    with pytest.raises(runs.RunNotFound):
        runs.resolve(both, "r")


def test_specs(spark, tmp_path):
    good = "id: t\nprompt: What is {{ q }}?\ncases:\n- vars: {q: 1}\n- id: two\n  vars: {q: 2}\n"
    (tmp_path / "a.yaml").write_text(good)
    tasks, cases = specs.load_tasks(spark, str(tmp_path / "a.yaml"))
    assert tasks.first()["messages"][0]["content"] == "What is {{ q }}?" and [r["case_id"] for r in cases.orderBy("ordinal").collect()] == ["case-000", "two"]
    for bad in ("", good + "colour: red\n", good.replace("q: 2", "z: 2"), good.replace("two", "case-000"), good.replace("What is {{ q }}?", "{messages: [{role: assistant, content: x}]}")):
        (tmp_path / "b.yaml").write_text(bad)
        with pytest.raises(specs.SpecError):
            specs.load_tasks(spark, str(tmp_path / "b.yaml"))


def test_live_view_counts_a_trial_once(spark, tmp_path):
    rows = [("2026-01-01 10:00:00", "m", "t", "c", 0, "ok", 1.0), ("2026-01-01 10:01:00", "m", "t", "c", 0, "ok", 1.0), ("2026-01-01 10:02:00", "m", "t", "c", 1, "error", None), ("2026-01-01 13:00:00", "m", "t", "d", 0, "ok", 0.5)]
    df = spark.createDataFrame(rows, "ts string, model_id string, task_id string, case_id string, sample_index long, status string, score double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.windowed_leaderboard(stream).writeStream.format("memory").queryName("live_view").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r)[1:] for r in spark.table("live_view").collect()]
    assert got == [("m", 2, 1, 1.0)]
    assert live.windowed_leaderboard(df).count() == 2


def test_sizes_of_a_plan_are_those_of_its_product(spark):
    """Counted before the product: repeated rows are trials of their own, ids that are null no cases."""
    models = spark.createDataFrame([("a",), ("b",), ("b",)], "model_id string")
    cases = spark.createDataFrame([("t", "1"), ("t", "1"), ("t", "2"), ("t", None), ("u", "1"), (None, "1")], "task_id string, case_id string")
    plan = trials.expand(models, cases, 3)
    want = plan.groupBy("model_id", "task_id").agg(F.count("*").alias("trials"), F.countDistinct("case_id").alias("cases"))
    got = trials.sizes(models, cases, 3)
    assert "sample_index" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for some in (cases, cases.limit(0)):
        plan = trials.expand(models, some, 3)
        want = plan.agg(F.countDistinct("model_id").alias("models"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("task_id", "case_id").alias("cases"), F.count("*").alias("trials"))
        assert trials.totals(models, some, 3).first() == want.first()
