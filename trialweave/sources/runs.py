"""Run directories: ``<runs>/<run_id>/records.jsonl`` and ``manifest.json``, read and written by Spark."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import truncate
from ..functions.values import canonical_json

# The fields of a record, and what they are where a line lacks them.
COMPONENT = "name: string, type: string, value: double, passed: boolean, weight: double, required: boolean, detail: string"
RECORD = (
    "run_id string, model_id string, task_id string, case_id string, sample_index long, status string, response_text string, score double, passed boolean, "
    f"components array<struct<{COMPONENT}>>, error string, error_type string, input_tokens long, output_tokens long, cost_usd double, latency_ms double, "
    "cached boolean, attempts long, finish_reason string, cache_key string, reported_model string, tags array<string>, timestamp string"
)
DEFAULTS = {"status": "ok", "response_text": "", "input_tokens": 0, "output_tokens": 0, "cost_usd": 0.0, "latency_ms": 0.0, "cached": False, "attempts": 1, "cache_key": ""}


class RunNotFound(LookupError):
    """No run, or several, for a selector."""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines: blank, torn and foreign lines are left out, unknown fields dropped, missing ones filled."""
    rows = spark.read.schema(RECORD + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where(F.col("_corrupt").isNull() & F.col("run_id").isNotNull()).drop("_corrupt").fillna(DEFAULTS)
    return rows.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "components": F.coalesce("components", F.array().cast(rows.schema["components"].dataType))})


def append_records(records: DataFrame, path: str) -> None:
    """More lines, in files of their own: a lost task leaves no torn line."""
    records.write.mode("append").json(path)


#: What comparisons read of a manifest.
MANIFEST = (
    "run_id string, version string, suite struct<name: string, fingerprint: string, errors: string, repeats: long, seed: long>, "
    "tasks array<struct<id: string, fingerprint: string, cases: long>>, models array<struct<id: string, model: string, params: string>>"
)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of many runs (a glob); corrupt ones are left out, and a path without any gives no rows."""
    try:
        return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def read_document(path: str | Path) -> dict[str, Any]:
    """One manifest or summary as a mapping; an empty one if the file is missing or no JSON object."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def build_manifest(suite: Mapping[str, Any], tasks: DataFrame, cases: DataFrame, run_id: str, version: str, extra: Mapping[str, Any] = {}) -> dict[str, Any]:
    """What it takes to tell whether two runs can be compared: a run's manifest, of a suite and its tables (as of specs.load_suite).

    Models' parameters are the suite's, the first task's and their own, merged. extra: more entries (provenance, say), which win.
    """
    ordered = cases.groupBy("task_id").agg(F.count("*").alias("cases"), F.sort_array(F.collect_list(F.struct("ordinal", "case_id", "vars", "tags", "scoring"))).alias("all"))
    own = F.to_json(F.struct("task_id", "system", "messages", "params", "scoring", "pass_threshold", "all"), {"ignoreNullFields": "false"})
    rows = tasks.join(ordered, "task_id", "left").select("task_id", F.sha2(own, 256).alias("fingerprint"), F.coalesce("cases", F.lit(0)).alias("cases"), "tags", "scoring", "source", "params", "ordinal").orderBy("ordinal").collect()
    listed = [{"id": r["task_id"], "fingerprint": r["fingerprint"], "cases": r["cases"], "tags": r["tags"], "scorers": [s.get("name") or s["type"] for s in json.loads(r["scoring"])], "source": r["source"]} for r in rows]
    first = json.loads(rows[0]["params"]) if rows else {}
    models = [{"id": m["id"], "provider": m.get("provider"), "model": m.get("model"), "params": canonical_json({**suite.get("params", {}), **first, **m.get("params", {})}), "pricing": m.get("pricing") or {}} for m in suite["models"]]
    planned = sum(t["cases"] for t in listed) * len(models) * suite.get("repeats", 1)
    about = {k: suite.get(k) for k in ("name", "description", "source", "repeats", "seed", "errors", "pass_threshold", "params")}
    about["fingerprint"] = hashlib.sha256(canonical_json(sorted(t["fingerprint"] for t in listed)).encode()).hexdigest()
    return {
        "run_id": run_id, "created_at": datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z"), "version": version, "suite": about, "models": models, "judge": suite.get("judge"), "limits": suite.get("limits") or {}, "tasks": listed,
        "totals": {"models": len(models), "tasks": len(listed), "cases": sum(t["cases"] for t in listed), "planned_trials": planned}, **extra,
    }


def write_manifest(manifest: Mapping[str, Any], folder: str | Path) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "manifest.json").write_text(json.dumps(manifest, ensure_ascii=False, indent=2), encoding="utf-8")


def list_runs(records: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """run_id, records and best_score (the best model's mean over cases, errors as 0), newest (by name) first; runs with a manifest alone have 0 records."""
    trial = F.when(F.col("status") == "ok", F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    cases = records.groupBy("run_id", "model_id", "task_id", "case_id").agg(F.avg(trial).alias("score"), F.count("*").alias("records"))
    models = cases.groupBy("run_id", "model_id").agg(F.avg("score").alias("score"), F.sum("records").alias("records"))
    runs = models.groupBy("run_id").agg(F.sum("records").alias("records"), F.max("score").alias("best_score"))
    if manifests is not None:
        known = manifests.select("run_id").distinct()
        runs = runs.join(known, "run_id", "full_outer").withColumn("records", F.coalesce("records", F.lit(0).cast("long")))
    return runs.orderBy(F.desc("run_id"))


def error_records(trials: DataFrame, message: Column, kind: Column, attempts: Column) -> DataFrame:
    """Records of trials (run_id and the key; task_tags and case_tags if there are) that failed: the message is cut to 800 characters."""
    tags = F.array_union("task_tags", "case_tags") if {"task_tags", "case_tags"} <= set(trials.columns) else F.array().cast("array<string>")
    made = {"status": F.lit("error"), "error": truncate(message, 800), "error_type": kind, "attempts": attempts.cast("long"), "tags": F.array_sort(tags)}
    rows = trials.select("run_id", "model_id", "task_id", "case_id", "sample_index", *(c.alias(name) for name, c in made.items()))
    schema = StructType.fromDDL(RECORD)
    return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields))


def model_in_run(records: DataFrame, run_id: str, model_id: str | None = None) -> str:
    """The model of a run that is meant: the one named, or without a name the only one."""
    found = [r[0] for r in records.where(F.col("run_id") == run_id).select("model_id").distinct().orderBy("model_id").collect()]
    if not found:
        raise RunNotFound(f"run {run_id!r} has no records")
    if model_id is None and len(found) > 1:
        raise RunNotFound(f"run {run_id!r} has {len(found)} models ({', '.join(found)}): name one as {run_id}:model")
    if model_id is not None and model_id not in found:
        raise RunNotFound(f"run {run_id!r} has no model {model_id!r}; there are {', '.join(found)}")
    return model_id or found[0]


def resolve(runs: DataFrame, selector: str) -> str:
    """The run_id that a selector means: ``latest``, an exact id, or a prefix that only one has."""
    ids = runs.select("run_id").distinct()
    if selector in ("latest", "last"):
        found = [r[0] for r in ids.orderBy(F.desc("run_id")).limit(1).collect()]
    else:
        found = [r[0] for r in ids.where(F.col("run_id") == selector).limit(1).collect()] or [r[0] for r in ids.where(F.col("run_id").startswith(selector)).limit(2).collect()]
    if len(found) != 1:
        raise RunNotFound(f"{len(found) or 'no'} runs for {selector!r}")
    return found[0]


def parse_selector(text: str) -> tuple[str, str | None]:
    """(run, model) of ``run:model``; a path with a colon in front of a separator is a run alone."""
    run, colon, model = text.rpartition(":")
    return (run, model) if colon and run and model and not set(model) & {"/", "\\"} else (text, None)
