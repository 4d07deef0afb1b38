"""Scorer lists as data against the same scorers built one by one."""

import json
import time

import pytest
from pyspark.sql import functions as F

from trialweave.operators import scorers, stacks

SPECS = [
    {"type": "exact", "target": "42"}, {"type": "exact_match", "any_of": ["Bern", 42, True, 1.5]}, {"type": "Match", "target": "berne", "any_of": ["x"], "case_sensitive": False},
    {"type": "exact", "target": "**Bern**", "normalize": []}, {"type": "exact", "target": "ﬁt", "normalize": ["lower", "normalize_unicode", "strip"]}, {"type": "exact", "target": 7.0},
    {"type": "exact", "target": "last", "normalize": ["last_line", "strip_trailing_period", "lower"]}, {"type": "exact", "target": "3", "normalize": ["extract_last_number"]},
    {"type": "contains", "target": "bern"}, {"type": "includes", "any_of": ["zz", "Answer"], "case_sensitive": True}, {"type": "contains", "all_of": ["is", "zz", "the"]},
    {"type": "contains", "any_of": ["is"], "all_of": ["the"], "normalize": ["strip_articles"]}, {"type": "not_contains", "target": "sorry"}, {"type": "not_contains", "all_of": ["is", "zz"]},
    {"type": "regex", "pattern": r"id-(\d+)", "flags": ["i"], "group": 1, "target": "7"}, {"type": "regex", "pattern": r"[(]?(?P<a>[a-z]+) (?P<n>\d+)", "group": "n", "target": "42"},
    {"type": "regex", "pattern": "sorry", "expect": False}, {"type": "regex", "pattern": "^x.y$", "flags": ["s", "M"]}, {"type": "regex", "pattern": r"\(x\)(\d)", "group": 1, "target": "3", "normalize": []},
    {"type": "numeric", "target": 42}, {"type": "number", "target": 41.5, "tolerance": 0.5, "extract": "all"}, {"type": "numeric", "target": 40, "rel_tolerance": 0.06, "extract": "first"},
    {"type": "numeric", "target": 3, "extract": "strict"}, {"type": "choice", "target": "b"}, {"type": "mcq", "target": "E", "options": ["D", "e"], "name": "letter", "weight": 0, "required": False},
    {"type": "json", "target": {"a": 1, "b": [1, {"c": None}]}}, {"type": "json_match", "target": '{"a": 1}', "mode": "exact", "partial_credit": False}, {"type": "json", "target": [1, 2]},
]
RESPONSES = ["42", "The answer is Bern.", "**Bern**", " \"42\" ", "ﬁt", "FIT", "one\nLast.\n", "a 3 b", "ID-7 and id-8", "(ab 42", "x\ny", "(x)3", "41 or 42.0", "I am sorry", "(B)", "e", '{"a": 1, "b": [1, {"c": null}]}', 'So: {"a": 1, "z": 2}!', "[1, 2]", "", None, "berne", "true", "1.5", "7", "\\boxed{42}", "<think>Bern</think> is the 42"]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([("t", f"c{i}", t, 1) for i, t in enumerate(RESPONSES)], "task_id string, case_id string, response_text string, components int").repartition(3)


def shape(components):
    return None if components is None else [(c["name"], c["type"], None if c["value"] is None else round(c["value"], 12), c["passed"], c["weight"], c["required"]) for c in components]


def test_equals_scorers_built_one_by_one(spark, answers):
    lists = {f"c{i}": SPECS[::3] if i % 2 else SPECS for i in range(len(RESPONSES))}
    cases = spark.createDataFrame([("t", c, "{}", json.dumps(s)) for c, s in lists.items()], "task_id string, case_id string, vars string, case_scoring string")
    none = spark.createDataFrame([], "task_id string, task_scoring string")
    got = {r["case_id"]: shape(r["components"]) for r in stacks.score_cases(answers, cases, none).collect()}
    for r in answers.select("case_id", scorers.stack(SPECS, F.col("response_text"), {}, "t").alias("c")).collect():
        assert got[r["case_id"]] == shape(r["c"] if lists[r["case_id"]] is SPECS else r["c"][::3]), r["case_id"]


def test_tags_are_filled_by_each_case(spark):
    variables = {"n": 7, "f": 1.5, "s": " Ab ", "l": ["x", "Y"], "o": {"b": 1, "a": [2]}, "t": True, "z": None, "q": 'say "hi"'}
    texts = ["{{ n }}|{{f}}|{{ s | strip | upper }}|{{ l | len }}|{{ s | len }}|{{ t }}|{{ z }}", "\\{{ n }} {{ n | int }}", "{{ o | json }}", "{{ l|json }} {{ s | json }} {{ s | strip | json }}", "{{ o | json_pretty }}", "{{ q }}"]
    want = ["7|1.5|AB|2|4|True|None", "{{ n }} 7", '{"a": [2], "b": 1}', '["x", "Y"] " Ab " "Ab"', json.dumps(variables["o"], indent=2, sort_keys=True), 'say "hi"']
    lists = [[{"type": "exact", "target": t, "normalize": []}] for t in texts] + [[{"type": "exact", "any_of": "{{ l }}"}], [{"type": "exact", "any_of": ["{{ s | trim }}", "no"]}], [{"type": "numeric", "target": "{{ n }}", "tolerance": "{{ f }}"}], [{"type": "json", "target": {"n": "{{ n }}", "q": "{{ q }}!", "o": ["{{ o }}"]}}], [{"type": "json", "target": "{{ l }}"}]]
    said = [*want, "Y", "Ab", "8.5", json.dumps({"n": 7, "q": 'say "hi"!', "o": [variables["o"]]}), '["x", "Y"]']
    cases = spark.createDataFrame([("t", str(i), json.dumps(variables), json.dumps(s)) for i, s in enumerate(lists)], "task_id string, case_id string, vars string, case_scoring string")
    rows = spark.createDataFrame([("t", str(i), s) for i, s in enumerate(said)], "task_id string, case_id string, response_text string")
    got = {r["case_id"]: r["components"][0]["passed"] for r in stacks.score_cases(rows, cases, spark.createDataFrame([], "task_id string, task_scoring string")).collect()}
    assert got == {str(i): True for i in range(len(lists))}


BAD = [
    ('{"type": "exact", "target": 1}', "a JSON list is needed"), ("[3]", "a mapping with a type"), ('[{"target": 1}]', "a mapping with a type"), ('[{"type": "nope"}]', "unknown scorer 'nope'"), ('[{"type": "numeric", "target": 1, "tolerence": 2}]', "unknown option 'tolerence'"),
    ('[{"type": "exact", "target": 1}, {"type": "exact"}]', r"scoring[1]: exact_match needs"), ('[{"type": "exact", "target": "{{ x }}"}]', "unknown variable 'x'"), ('[{"type": "exact", "target": "{{ a | nope }}"}]', "unknown filter 'nope'"),
    ('[{"type": "exact", "target": "{{ }}"}]', "empty tag"), ('[{"type": "exact", "target": 1, "normalize": ["nope"]}]', "unknown normalizer"), ('[{"type": "exact", "target": 1, "weight": -1}]', "weight is"), ('[{"type": "exact", "target": 1, "required": 1}]', "weight is"),
    ('[{"type": "regex", "pattern": "a", "flags": ["q"]}]', "unknown regex flag"), ('[{"type": "numeric", "target": 1, "extract": "some"}]', "extract is not"), ('[{"type": "json", "target": "1", "mode": "x"}]', "mode is not"), ("nothing", "a JSON list"),
]


def test_faults_are_told_with_their_place(spark):
    cases = spark.createDataFrame([("t", str(i), '{"a": 1}', s) for i, (s, _) in enumerate(BAD)] + [("t", "fine", None, '[{"type": "exact", "target": "\\\\\\\\{{ x }}"}]')], "task_id string, case_id string, vars string, case_scoring string")
    none = spark.createDataFrame([], "task_id string, task_scoring string")
    told = {r["case_id"]: r["fault"] for r in stacks.faults(cases, none).collect()}
    assert set(told) == {str(i) for i in range(len(BAD))}
    assert all(told[str(i)].startswith(f"t/{i} scoring") and message in told[str(i)] for i, (_, message) in enumerate(BAD)), told
    answers = cases.select("task_id", "case_id", F.lit("x").alias("response_text"))
    assert {r["case_id"] for r in stacks.score_cases(answers, cases, none, on_fault="null").where("components is not null").collect()} == {"fine"}
    with pytest.raises(Exception, match="unknown scorer 'nope'"):
        stacks.score_cases(answers, cases.where("case_id = '3'"), none).collect()


def test_a_registered_scorer_is_one_branch(spark, monkeypatch):
    def length(response, target, slack=0, units=("characters",)):
        return scorers.score(F.lit(1), (F.abs(F.length(response) - target.cast("int")) <= slack) & F.array_contains(units, "characters"))

    monkeypatch.setitem(scorers.SCORERS, "length", length)
    cases = spark.createDataFrame([("t", "a", "{}", '[{"type": "length", "target": 3}]'), ("t", "b", "{}", '[{"type": "length", "target": 3, "slack": 2, "units": ["characters"]}]'), ("t", "c", "{}", '[{"type": "length", "target": 9}]')], "task_id string, case_id string, vars string, case_scoring string")
    rows = cases.select("task_id", "case_id", F.when(F.col("case_id") == "b", "abcde").otherwise("abc").alias("response_text"))
    got = {r["case_id"]: r["components"][0]["passed"] for r in stacks.score_cases(rows, cases, spark.createDataFrame([], "task_id string, task_scoring string")).collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_ten_thousand_lists_have_the_plan_of_one(spark):
    def made(n):
        ids = spark.range(n).select(F.lit("t").alias("task_id"), F.col("id").cast("string").alias("case_id"))
        own = F.format_string('[{"type":"exact","target":"w%s"},{"type":"numeric","target":%s},{"type":"contains","all_of":["w","%s"]}]', "case_id", "case_id", "case_id")
        cases = ids.select("*", F.lit("{}").alias("vars"), own.alias("case_scoring"))
        rows = ids.select("*", F.concat(F.lit("w"), "case_id").alias("response_text"))
        return stacks.score_cases(rows, cases, spark.createDataFrame([], "task_id string, task_scoring string"))

    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    one, many = made(1), made(10_000)
    assert size(many) < 1.02 * size(one)  # names of lambda variables have more digits
    began = time.time()
    assert many.select(F.explode("components").alias("c")).where("c.passed").count() == 30_000
    assert time.time() - began < 60  # some seconds; a branch for each list took two seconds a list
