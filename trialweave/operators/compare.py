"""Paired and unpaired comparison of two sides, and whether two runs can be compared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.values import side_label, unit_id
from ..sources.runs import model_in_run, parse_selector, resolve
from . import outcomes
from .bootstrap import LEVEL, RESAMPLES, SEED, clusters, intervals, mde, replicates, summed


def last_units(observations: DataFrame) -> DataFrame:
    """unit, cluster and value, one row a unit: the last by ``ordinal`` (with none, or at ties, the largest). A unit whose last value is null has none."""
    kept = F.struct("cluster", "value")
    order = F.struct("ordinal", kept) if "ordinal" in observations.columns else kept
    return observations.groupBy("unit").agg(F.max_by(kept, order).alias("one")).select("unit", "one.*").where("value is not null")


def _sides(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    right = last_units(b).select("unit", F.col("cluster").alias("cluster_b"), F.col("value").alias("value_b"), F.lit(True).alias("in_b"))
    left = last_units(a).select("unit", "cluster", F.col("value").alias("value_a"), F.lit(True).alias("in_a"))
    return left.join(right, "unit", how).withColumn("delta", F.col("value_a") - F.col("value_b"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """unit, cluster, cluster_b, value_a, value_b, delta = a - b of the units that both observation tables have, each once."""
    return _sides(a, b, "inner").select("unit", "cluster", "cluster_b", "value_a", "value_b", "delta")


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """unit and side of the units that one side has alone."""
    a, b = a.select("unit").distinct(), b.select("unit").distinct()
    return a.join(b, "unit", "left_anti").withColumn("side", F.lit("a")).union(b.join(a, "unit", "left_anti").withColumn("side", F.lit("b")))


def sign_counts(pairs: DataFrame) -> DataFrame:
    """Pairs, means, wins, losses and ties of a against b."""
    return pairs.agg(F.count("*").alias("n_paired"), F.avg("value_a").alias("mean_a"), F.avg("value_b").alias("mean_b"), F.avg("delta").alias("delta"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of discordant counts; beyond 1000 the normal approximation with continuity correction."""
    n, low = only_a + only_b, F.least(only_a, only_b)
    first = F.pow(F.lit(0.5), n.cast("double"))
    tail = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1).cast("long"))),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda acc, i: F.struct((acc["term"] * (n - i + 1) / i).alias("term"), F.when(i <= low, acc["sum"] + acc["term"] * (n - i + 1) / i).otherwise(acc["sum"]).alias("sum")),
        lambda acc: F.least(F.lit(1.0), acc["sum"] * 2),
    )
    z = F.greatest(F.lit(0.0), F.abs(only_a - only_b) - 1) / F.sqrt(n.cast("double"))
    # The upper tail of the normal distribution has no SQL function: an expansion that is good to 1e-7.
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    approx = F.least(F.lit(1.0), F.exp(-z * z / 2) / F.sqrt(F.lit(2) * F.pi()) * poly * 2)
    return F.when(n == 0, 1.0).when(n <= 1000, tail).otherwise(approx)


def discordant(pairs: DataFrame) -> DataFrame:
    """only_a, only_b and McNemar's p of pairs of binary values."""
    counts = pairs.agg(F.count_if((F.col("value_a") == 1) & (F.col("value_b") == 0)).alias("only_a"), F.count_if((F.col("value_a") == 0) & (F.col("value_b") == 1)).alias("only_b"))
    return counts.withColumn("p_value", mcnemar(F.col("only_a"), F.col("only_b")))


def paired_replicates(pairs: DataFrame, resamples: int, seed: int) -> DataFrame:
    """The mean difference of each replicate over clusters of pairs."""
    return replicates(clusters(pairs.select("cluster", F.col("delta").alias("value"))), resamples, seed)


def sides_of(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The observations of both sides of pairs: those of the units that they share."""
    return pairs.select("unit", "cluster", F.col("value_a").alias("value")), pairs.select("unit", F.col("cluster_b").alias("cluster"), F.col("value_b").alias("value"))


def _apart(left: DataFrame, right: DataFrame, resamples: int, seed: int) -> DataFrame:
    """The difference of independent replicates of two tables of sums; none if one has a single cluster."""
    a, b = (replicates(x.where("k > 1"), resamples, seed + i).withColumnRenamed("mean", c) for i, (x, c) in enumerate(((left, "a"), (right, "b"))))
    return a.join(b, "rep").select("rep", (F.col("a") - F.col("b")).alias("mean"))


def unpaired_replicates(pairs: DataFrame, resamples: int, seed: int) -> DataFrame:
    """The difference of independent replicates of both sides (seeds ``seed`` and ``seed`` + 1), over shared units; none if a side has one cluster."""
    return _apart(*map(clusters, sides_of(pairs)), resamples, seed)


def side_sums(a: DataFrame, b: DataFrame) -> DataFrame:
    """total, n and k of the clusters of differences (side ``d``) and of both sides' shared units (``a``, ``b``), with wins, losses and ties of ``d``; of all units of a side (``all a``, ``all b``) in one row each.

    One join of both tables and one aggregation, whose rows are clusters.
    """
    every, shared = _sides(a, b, "full_outer"), F.col("in_a") & F.col("in_b")
    row = lambda side, cluster, value: F.struct(F.lit(side).alias("side"), cluster.alias("cluster"), F.col(value).alias("value"))
    none = F.lit(None).cast(every.schema["cluster"].dataType)
    rows = F.array(
        F.when(shared, row("d", F.col("cluster"), "delta")), F.when(shared, row("a", F.col("cluster"), "value_a")), F.when(shared, row("b", F.col("cluster_b").cast(every.schema["cluster"].dataType), "value_b")),
        F.when(F.col("in_a"), row("all a", none, "value_a")), F.when(F.col("in_b"), row("all b", none, "value_b")),
    )
    d = F.col("side") == "d"
    counts = [F.count_if(d & c).alias(name) for name, c in (("wins", F.col("value") > 0), ("losses", F.col("value") < 0), ("ties", F.col("value") == 0))]
    long = every.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
    return summed(long.groupBy("side", "cluster").agg(F.sum("value").alias("total"), F.count("*").alias("n"), *counts), "side")


def paired_diff(a: DataFrame, b: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, level: float = LEVEL, binary: bool = False, method: str = "bca") -> DataFrame:
    """One row that compares a (the candidate) with b on the units that both have.

    n_paired, n_clusters; mean_a, mean_b, delta; low, high, std_error and method of the paired interval;
    unpaired_low, unpaired_high, unpaired_method (each side drawn by itself: what pairing is worth);
    wins, losses, ties; only_a, only_b and p_value (McNemar's) if binary; mde, significant, verdict;
    only_in_a, only_in_b (numbers of units) and notes. Without shared units: means of all of each side, method ``empty``.
    A unit with a null value counts as if that side hadn't it; a null unit as one that each side has alone.

    Both tables are read once: everything comes from the sums of clusters of side_sums(), which are kept.
    """
    tail = (1 - level) / 2
    sums = side_sums(a, b)
    total = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    mean = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c))) / F.sum(F.when(F.col("side") == side, F.col("n")))
    counts = sums.agg(
        total("d", "n").alias("n_paired"), mean("a", "total").alias("mean_a"), mean("b", "total").alias("mean_b"), *(total("d", c).alias(c) for c in ("wins", "losses", "ties")),
        (total("all a", "n") - total("d", "n")).alias("only_in_a"), (total("all b", "n") - total("d", "n")).alias("only_in_b"), mean("all a", "total").alias("all_a"), mean("all b", "total").alias("all_b"),
    )
    of = lambda side: sums.where(F.col("side") == side)
    both = intervals(of("d"), resamples, seed, level, [], method)
    apart = _apart(of("a"), of("b"), resamples, seed + 1).agg(F.percentile("mean", [tail, 1 - tail]).alias("q"))
    # Three tables of one row each.
    one = lambda df: F.broadcast(df.withColumn("__one", F.lit(1)))
    rows = one(counts).join(one(both), "__one", "left").join(one(apart), "__one", "left")
    none = F.col("n_paired") == 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    kind = F.coalesce("method", F.lit("empty"))
    low, high = zero(F.col("low")), zero(F.col("high"))
    decided = verdict(low, high, kind)
    gone = F.col("only_in_a") + F.col("only_in_b")
    notes = F.filter(
        F.array(
            F.when(gone > 0, F.format_string("%d cases are in one run alone and aren't compared", gone)),
            F.when(none, F.lit("no case is in both runs: there is nothing to compare")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select(
        "n_paired", F.coalesce("n_clusters", F.lit(0).cast("long")).alias("n_clusters"),
        F.when(none, zero(F.col("all_a"))).otherwise(F.col("mean_a")).alias("mean_a"), F.when(none, zero(F.col("all_b"))).otherwise(F.col("mean_b")).alias("mean_b"),
        zero(F.col("mean_a") - F.col("mean_b")).alias("delta"), low.alias("low"), high.alias("high"), zero(F.col("std_error")).alias("std_error"), kind.alias("method"),
        F.coalesce(F.col("q")[0], zero(F.col("delta"))).alias("unpaired_low"), F.coalesce(F.col("q")[1], zero(F.col("delta"))).alias("unpaired_high"),
        F.when(none, "empty").when(F.col("q").isNull(), "degenerate").otherwise("percentile").alias("unpaired_method"),
        "wins", "losses", "ties",
        *((F.col("wins").alias("only_a"), F.col("losses").alias("only_b"), F.when(~none, mcnemar(F.col("wins"), F.col("losses"))).alias("p_value")) if binary else (F.lit(0).cast("long").alias("only_a"), F.lit(0).cast("long").alias("only_b"), F.lit(None).cast("double").alias("p_value"))),
        mde(zero(F.col("std_error")), level).alias("mde"), decided.isin("improvement", "regression").alias("significant"), decided.alias("verdict"), "only_in_a", "only_in_b", notes.alias("notes"),
    )


def regression_gate(diff: DataFrame) -> DataFrame:
    """diff (as of paired_diff) with ``fails``: whether it is a significant regression."""
    return diff.withColumn("fails", F.col("significant") & (F.col("delta") < 0))


def verdict(low: Column, high: Column, method: Column) -> Column:
    return F.when(method.isin("degenerate", "empty"), "inconclusive").when(low > 0, "improvement").when(high < 0, "regression").otherwise("no significant difference")


def case_deltas(pairs: DataFrame, most: int = 15) -> DataFrame:
    """The units whose values differ most: a report of ``most`` rows."""
    return pairs.where("delta <> 0").orderBy(F.desc(F.abs("delta")), "unit").limit(most)


def changed_tasks(a: DataFrame, b: DataFrame) -> DataFrame:
    """task_id and change (added, removed, changed) between two tables of task_id and fingerprint."""
    both = a.select("task_id", F.col("fingerprint").alias("fa")).join(b.select("task_id", F.col("fingerprint").alias("fb")), "task_id", "full_outer")
    change = F.when(F.col("fb").isNull(), "removed").when(F.col("fa").isNull(), "added").when(F.col("fa") != F.col("fb"), "changed")
    return both.select("task_id", change.alias("change")).where("change is not null")


def error_policy(policies: DataFrame | GroupedData) -> DataFrame:
    """The policy that all sides which have one share, else zero. policies: column errors, perhaps grouped."""
    kinds = F.collect_set("errors")
    return policies.agg(F.when(F.size(kinds) == 1, kinds[0]).otherwise("zero").alias("errors"))


def model_entry(manifests: DataFrame, run_id: str, model_id: str) -> DataFrame:
    """id, model and params of a model in a run's manifest: the first entry of that id; no row without one."""
    entry = F.get(F.filter("models", lambda m: m["id"] == model_id), 0)
    return manifests.where(F.col("run_id") == run_id).select(entry.alias("m")).where("m is not null").select("m.*")


def warnings(a: DataFrame, b: DataFrame, manifests: DataFrame | None = None, side_a: tuple[str, str] | None = None, side_b: tuple[str, str] | None = None, most_errors: float = 0.05) -> DataFrame:
    """side, warning and detail: what makes a comparison of two tables of records less trustworthy than it looks.

    Of records: error rates beyond a share, no unit in common. Of manifests (run_id, suite struct<fingerprint, errors>,
    version, tasks array<struct<id, fingerprint>>, models array<struct<id, model, params>>; sides are (run_id, model_id)):
    other contents of the suite and the tasks that changed, at most eight; other error policies; other parameters of one
    model; one side twice; other versions. What a manifest doesn't say raises no warning.
    """
    keys = ["task_id", "case_id"]
    side = lambda df, of: df.select(*keys, (F.col("status") != "ok").alias("failed"), F.lit(of).alias("of_a"))
    cases = side(a, True).union(side(b, False)).groupBy(*keys).agg(
        F.count_if("of_a").alias("a"), F.count_if(~F.col("of_a")).alias("b"), F.count_if(F.col("of_a") & F.col("failed")).alias("fa"), F.count_if(~F.col("of_a") & F.col("failed")).alias("fb")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    row = cases.agg(*map(total, ("a", "b", "fa", "fb")), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"))
    told = lambda of, warning, detail, when: F.when(when, F.struct(F.lit(of).alias("side"), F.lit(warning).alias("warning"), detail.alias("detail")))
    rate = lambda x: F.col(f"f{x}") / F.nullif(F.col(x), F.lit(0))
    out = [told(x, "many errors", F.format_string("%.0f%%", rate(x) * 100), rate(x) > most_errors) for x in "ab"]
    out.append(told("both", "no unit in common", F.lit(""), F.col("shared") == 0))
    if manifests is not None:
        # Both manifests as one row; what only a run that is both sides would read twice is read once.
        named = F.struct(*(F.col(c) for c in manifests.columns))
        of = lambda run: F.first(F.when(F.col("run_id") == run, named), ignorenulls=True)
        pair = manifests.where(F.col("run_id").isin(side_a[0], side_b[0])).agg(of(side_a[0]).alias("x"), of(side_b[0]).alias("y"))
        model = lambda x, s: F.get(F.filter(f"{x}.models", lambda m: m["id"] == s[1]), 0)
        pair = pair.withColumns({"mx": model("x", side_a), "my": model("y", side_b)})
        pair = pair.withColumns({"px": params_text(pair, "mx.params"), "py": params_text(pair, "my.params")})
        row = row.withColumn("__one", F.lit(0)).join(F.broadcast(pair.withColumn("__one", F.lit(0))), "__one")
        said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
        differs = lambda c: said(f"x.{c}") & said(f"y.{c}") & (F.col(f"x.{c}") != F.col(f"y.{c}"))
        versus = lambda c: F.concat_ws(" / ", f"x.{c}", f"y.{c}")
        short = lambda x: F.left(f"{x}.suite.fingerprint", F.lit(12))
        prints = lambda x: F.map_from_entries(F.transform(f"{x}.tasks", lambda t: F.struct(t["id"], t["fingerprint"])))
        change = lambda k, va, vb: F.when(vb.isNull(), "removed").when(va.isNull(), "added").when(va != vb, "changed")
        tasks = F.map_filter(F.map_zip_with(prints("x"), prints("y"), change), lambda k, v: v.isNotNull())
        listed = F.slice(F.array_sort(F.transform(F.map_entries(tasks), lambda e: F.concat_ws(" ", e["key"], e["value"]))), 1, 8)
        out += [
            told("both", "other contents", F.concat_ws(" / ", short("x"), short("y")), differs("suite.fingerprint")),
            told("both", "changed tasks", F.array_join(listed, ", "), differs("suite.fingerprint") & (F.size(listed) > 0)),
            told("both", "other error policies", versus("suite.errors"), differs("suite.errors")),
            told("both", "other parameters of one model", F.concat_ws(" / ", "px", "py"), (F.col("mx.model") == F.col("my.model")) & ~F.col("px").eqNullSafe(F.col("py"))),
            told("both", "one side twice", F.lit(":".join(side_a)), F.col("mx").isNotNull() & F.lit(side_a == side_b)),
            told("both", "other versions", versus("version"), differs("version")),
        ]
    return row.select(F.explode(F.filter(F.array(*out), lambda w: w.isNotNull())).alias("w")).select("w.*")


def params_text(rows: DataFrame, name: str) -> Column:
    """Parameters (JSON text, a map or a struct) as JSON in one order of keys, so that equal ones are equal texts."""
    kind = rows.select(name).schema[0].dataType.simpleString()
    text = F.col(name) if kind == "string" else F.to_json(name)
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


@dataclass(frozen=True)
class DiffOfRuns:
    """What diff_runs() returns: ``result`` (one row, as of paired_diff, with the sides' labels), ``warnings`` and ``deltas`` (units that differ, largest first)."""

    result: DataFrame
    warnings: DataFrame
    deltas: DataFrame


def diff_runs(
    records: DataFrame, manifests: DataFrame, selector_a: str, selector_b: str, metric: str = "score", errors: str | None = None,
    cluster_by: str = "task", resamples: int = RESAMPLES, seed: int = SEED, level: float = LEVEL,
) -> DiffOfRuns:
    """Compares two sides of records, ``run`` or ``run:model``; a positive delta means that a is better.

    A run may be named as resolve() takes it; without a model it must have one. Unless errors says
    otherwise, the error policy is what the manifests agree on, else zero.
    """
    sides = []
    for selector in (selector_a, selector_b):
        run, model = parse_selector(selector)
        run = resolve(records, run)
        sides.append((run, model_in_run(records, run, model)))
    if errors is None:
        mine = manifests.where(F.col("run_id").isin([run for run, _ in sides])).select("suite.errors").where("errors is not null")
        errors = error_policy(mine).first()["errors"]
    rows = [records.where((F.col("run_id") == run) & (F.col("model_id") == model)) for run, model in sides]
    obs = [outcomes.observations(outcomes.collapse_cases(r, errors), metric, cluster_by) for r in rows]
    result = paired_diff(*obs, resamples, seed, level, binary=metric == "pass")
    labels = {f"side_{x}": side_label(F.lit(run), F.lit(model)) for x, (run, model) in zip("ab", sides)}
    deltas = paired(*obs).where("delta <> 0").select("unit", "value_a", "value_b", "delta").orderBy(F.desc(F.abs("delta")), "unit")
    return DiffOfRuns(result.withColumns(labels), warnings(*rows, manifests, *sides), deltas)


def observations_from_scores(scores: DataFrame) -> DataFrame:
    """unit, cluster and value of scores (task_id, scores map<case_id, number>)."""
    rows = scores.select("task_id", F.explode("scores").alias("case_id", "value"))
    return rows.select(unit_id(F.col("task_id"), F.col("case_id")).alias("unit"), F.col("task_id").alias("cluster"), F.col("value").cast("double").alias("value"))
