"""From specs as tables to the trials that remain to be run, and what they would cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern
from ..functions.values import cost_usd, token_estimate

KEY = ("model_id", "task_id", "case_id", "sample_index")


def expand(models: DataFrame, cases: DataFrame, repeats: int) -> DataFrame:
    """A trial for each model (model_id), case (task_id, case_id) and repeat.

    The plan is a product by definition; models are few by the spec (one row an endpoint).
    """
    samples = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("sample_index")
    return cases.crossJoin(models).select("*", samples)


def sizes(models: DataFrame, cases: DataFrame, repeats: int) -> DataFrame:
    """model_id, task_id, trials and cases (different ids) of expand(): what is counted are the cases, before the product.

    Each case is counted once for all models and repeats. Equal rows are trials of their own, as in the product.
    """
    rows = cases.groupBy("task_id", "case_id").agg(F.count("*").alias("n"))
    tasks = rows.groupBy("task_id").agg(F.sum("n").alias("n"), F.count("case_id").alias("cases"))
    asked = models.groupBy("model_id").agg(F.count("*").alias("times"))
    return tasks.crossJoin(asked).select("model_id", "task_id", (F.col("n") * F.col("times") * repeats).alias("trials"), "cases")


def match_globs(rows: DataFrame, column: str, globs: Sequence[str]) -> DataFrame:
    """Rows whose column matches any of the shell patterns; all rows without patterns."""
    if not globs:
        return rows
    return rows.where(F.col(column).rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)))


class NothingMatched(LookupError):
    """Patterns that match no row, and what there is."""


def filter_suite(rows: DataFrame, column: str, globs: Sequence[str]) -> DataFrame:
    """match_globs() that fails, with the values there are (twenty at most), if nothing matches."""
    found = match_globs(rows, column, globs)
    if globs and not found.limit(1).count():
        there = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(20).collect()]
        raise NothingMatched(f"no {column} matches {', '.join(globs)}; there are {', '.join(there)}")
    return found


def with_tags(cases: DataFrame, tags: Sequence[str]) -> DataFrame:
    """All cases of the tasks that have one of the tags, on the task or on any of its cases."""
    if not tags:
        return cases
    hit = cases.where(F.arrays_overlap(F.array_union("task_tags", "case_tags"), F.array(*map(F.lit, tags)))).select("task_id").distinct()
    return cases.join(hit, "task_id", "left_semi")


def first_cases(cases: DataFrame, limit: int, order: str = "ordinal") -> DataFrame:
    """The first ``limit`` cases of each task."""
    by = Window.partitionBy("task_id").orderBy(order)
    return cases.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= limit).drop("__n")


def default_case_ids(cases: DataFrame, order: str = "ordinal") -> DataFrame:
    """``case-000`` and so on, by position within the task, where there is no case_id."""
    n = F.row_number().over(Window.partitionBy("task_id").orderBy(order)) - 1
    return cases.withColumn("case_id", F.coalesce("case_id", F.format_string("case-%03d", n)))


def remaining(trials: DataFrame, records: DataFrame) -> DataFrame:
    """Trials without a record of status ok."""
    return trials.join(records.where("status = 'ok'").select(*KEY), list(KEY), "left_anti")


def scoring_of(cases: DataFrame, task_scorers: DataFrame) -> DataFrame:
    """Each case's scorers: its own (case_scoring) or its task's."""
    return cases.join(task_scorers, "task_id", "left").withColumn("scoring", F.coalesce("case_scoring", "task_scoring"))


def threshold_of(task: Column, suite: Column | float = 0.0) -> Column:
    """The score that a trial passes from: its task's, else the suite's."""
    return F.coalesce(task, suite if isinstance(suite, Column) else F.lit(suite))


# The names of the scorer that asks a judge.
JUDGES = ("llm_judge", "judge", "rubric")


def uses_judge(cases: DataFrame, task_scorers: DataFrame, types: Sequence[str] = JUDGES) -> DataFrame:
    """task_id and uses_judge: whether a scorer of any of its cases (their own, or the task's) is one of types. Scorers are JSON lists of mappings."""
    rows = scoring_of(cases, task_scorers)
    kinds = F.transform(F.from_json("scoring", "array<struct<type: string>>"), lambda s: F.lower(F.trim(s["type"])))
    return rows.groupBy("task_id").agg(F.bool_or(F.coalesce(F.arrays_overlap(kinds, F.array(*map(F.lit, types))), F.lit(False))).alias("uses_judge"))


def expected_answers(cases: DataFrame) -> DataFrame:
    """cases (scoring, vars: JSON) with ``expected``: target or reference of the first scorer that has one, rendered by the case's variables.

    A text with an unknown variable or a filter stays as it is; numbers are written as JSON writes them.
    """
    fields = F.transform(F.from_json("scoring", "array<string>"), lambda s: F.coalesce(F.get_json_object(s, "$.target"), F.get_json_object(s, "$.reference")))
    raw = F.get(F.filter(fields, lambda v: v.isNotNull()), 0)
    values = F.from_json("vars", "map<string,string>")
    tag = r"(?<!\\)\{\{\s*([^{}|]*?)\s*\}\}"
    names = F.array_distinct(F.regexp_extract_all(raw, F.lit(tag), 1))
    plain = F.size(F.regexp_extract_all(raw, F.lit(r"(?<!\\)\{\{"), 0)) == F.size(F.regexp_extract_all(raw, F.lit(tag), 0))
    known = F.forall(names, lambda n: F.map_contains_key(values, n))
    # Each part of the text between tags, and after each the value of its tag.
    texts, tags = F.split(raw, tag), F.regexp_extract_all(raw, F.lit(tag), 1)
    filled = F.array_join(F.transform(texts, lambda t, i: F.concat(t, F.coalesce(F.try_element_at(values, F.get(tags, i)), F.lit("")))), "")
    return cases.withColumn("expected", F.when(plain & known, F.replace(filled, F.lit("\\{{"), F.lit("{{"))).otherwise(raw))


def estimate(requests: DataFrame, cache: DataFrame, default_max_tokens: int = 512) -> DataFrame:
    """By model: trials, those cached, tokens in and out, and the cost of those not cached.

    requests: model_id, cache_key, prompt, max_tokens, input_per_mtok, output_per_mtok; cache: key.
    """
    cached = F.col("hit").isNotNull()
    tokens_in, tokens_out = token_estimate(F.col("prompt")), F.coalesce("max_tokens", F.lit(default_max_tokens)).cast("long")
    rows = requests.join(cache.select(F.col("key").alias("cache_key"), F.lit(1).alias("hit")).distinct(), "cache_key", "left")
    return rows.groupBy("model_id").agg(
        F.count("*").alias("trials"),
        F.count_if(cached).alias("cached_trials"),
        F.sum(tokens_in).alias("input_tokens"),
        F.sum(tokens_out).alias("max_output_tokens"),
        F.sum(cost_usd(tokens_in, tokens_out, F.col("input_per_mtok"), F.col("output_per_mtok"), cached)).alias("cost_usd"),
    )


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def advisories(tasks: DataFrame, models: DataFrame, few_cases: int = 3, judge_samples: int | None = None) -> DataFrame:
    """subject and advice: models without a price (but mocks), tasks with few cases, fewer than two tasks, a judge that is asked once.

    tasks: task_id and cases; models: model_id, provider and priced; judge_samples: None without a judge.
    """
    found = (
        models.where("provider <> 'mock' and not priced").select(F.col("model_id").alias("subject"), F.lit("no price").alias("advice"))
        .union(tasks.where(F.col("cases") < few_cases).select("task_id", F.lit("few cases")))
        .union(tasks.agg(F.count("*").alias("n")).where("n < 2").select(F.lit("suite"), F.lit("fewer than two tasks")))
    )
    once = tasks.agg(F.count("*").alias("n")).select(F.lit("judge"), F.lit("asked once: its noise can't be seen"))
    return found.union(once) if judge_samples == 1 else found


def totals(models: DataFrame, cases: DataFrame, repeats: int) -> DataFrame:
    """One row of models, tasks, cases and trials of expand(), counted before the product."""
    rows = cases.groupBy("task_id", "case_id").agg(F.count("*").alias("n"))
    tasks = rows.groupBy("task_id").agg(F.sum("n").alias("n"), F.count("case_id").alias("cases"))
    mine = tasks.agg(F.count("task_id").alias("tasks"), F.coalesce(F.sum(F.when(F.col("task_id").isNotNull(), F.col("cases"))), F.lit(0)).alias("cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    asked = models.agg(F.countDistinct("model_id").alias("models"), F.count("*").alias("times"))
    some = lambda c: F.when((F.col("n") > 0) & (F.col("times") > 0) & F.lit(repeats > 0), F.col(c)).otherwise(0)
    return mine.crossJoin(asked).select(some("models").alias("models"), some("tasks").alias("tasks"), some("cases").alias("cases"), (F.col("n") * F.col("times") * repeats).alias("trials"))
