"""Live sums of a run in which a trial's last record counts: what a retry supersedes is taken back.

``changes`` keeps the last record of each trial as state and turns a stream of records, in any
order, into changes: a row of sign 1 for what counts now and one of sign -1 for what no longer
does. Their sums (``standing``) are those of the table's last records, batch by batch.

``paced`` keeps the sums of each run and says by a timer, also when nothing arrives, how fast
the run is and when it will end.

State needs the RocksDB provider (``configure``). It is as large as the trials of the run;
``forget`` drops what hasn't changed for a while, after which a trial that comes again counts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRIAL = ("run_id", "model_id", "task_id", "case_id", "sample_index")
CHANGE = "run_id string, model_id string, task_id string, case_id string, sample_index long, sign int, status string, score double, passed boolean, cost_usd double"
_HELD = "at string, status string, score double, passed boolean, cost_usd double"
_KEPT = ("status", "score", "passed", "cost_usd")


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LatestTrial(StatefulProcessor):
    """Of a trial's records the last by ``at`` (of equal ones an ok before an error); changes of what that is."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _HELD, self.forget_ms)

    @staticmethod
    def _rank(record: Any) -> tuple:
        return (record["at"] is not None, record["at"] or "", record["status"] == "ok", record["score"] or 0.0, record["passed"] or False, record["cost_usd"] or 0.0)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = dict(zip(("at", *_KEPT), self.held.get())) if self.held.exists() else None
        last = before
        for row in rows:
            if last is None or self._rank(row) > self._rank(last):
                last = {c: row[c] for c in ("at", *_KEPT)}
        if last is before:
            return
        self.held.update(tuple(last[c] for c in ("at", *_KEPT)))
        names = [c.split()[0] for c in CHANGE.split(", ")]
        for sign, record in ((-1, before), (1, last)):
            if record is not None:
                yield Row(**dict(zip(names, (*key, sign, *(record[c] for c in _KEPT)))))

    def close(self) -> None:
        pass


def changes(records: DataFrame, order: str = "timestamp", forget_ms: int | None = None) -> DataFrame:
    """Changes of a stream of records: the trial, sign, status, score, passed and cost_usd. order: a column that sorts as text."""
    cost = F.col("cost_usd").cast("double") if "cost_usd" in records.columns else F.lit(0.0)
    rows = records.select(*TRIAL, F.col(order).cast("string").alias("at"), "status", F.col("score").cast("double").alias("score"), F.col("passed").cast("boolean").alias("passed"), cost.alias("cost_usd"))
    return rows.groupBy(*TRIAL).transformWithState(LatestTrial(forget_ms), CHANGE, "Append", "ProcessingTime" if forget_ms else "None")


def standing(changed: DataFrame, *keys: str) -> DataFrame:
    """Sums of changes, a table of them or a stream in complete or update mode: trials, errors, score_sum, passed_sum and cost_usd."""
    sign, ok = F.col("sign"), F.col("status") == "ok"
    total = lambda c: F.sum(sign * c)
    return changed.groupBy(*(keys or ("run_id", "model_id"))).agg(
        F.sum("sign").alias("trials"), total(F.when(ok, 0).otherwise(1)).alias("errors"), total(F.when(ok, F.coalesce("score", F.lit(0.0))).otherwise(0.0)).alias("score_sum"),
        total(F.when(ok & F.coalesce("passed", F.lit(False)), 1).otherwise(0)).alias("passed_sum"), total(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"),
    )


PACE = "run_id string, done long, errors long, cost_usd double, rate_per_s double, eta_s double, at_ms long"


class Pace(StatefulProcessor):
    """A run's sums, told again every ``every_ms`` by a timer until all of its trials are done."""

    def __init__(self, total: int, every_ms: int):
        self.total, self.every_ms = total, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "done long, errors long, cost_usd double, began_ms long")

    def _told(self, key: Any, now: int) -> Row:
        done, errors, cost, began = self.sums.get()
        spent = (now - began) / 1000
        rate = done / spent if spent > 0 else 0.0
        return Row(run_id=key[0], done=done, errors=errors, cost_usd=cost, rate_per_s=rate, eta_s=max(0, self.total - done) / rate if rate > 0 else 0.0, at_ms=now)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now, fresh = timerValues.getCurrentProcessingTimeInMs(), not self.sums.exists()
        done, errors, cost, began = (0, 0, 0.0, now) if fresh else self.sums.get()
        for r in rows:
            done, errors, cost = done + r["sign"], errors + r["sign"] * (r["status"] != "ok"), cost + r["sign"] * (r["cost_usd"] or 0.0)
        self.sums.update((done, errors, cost, began))
        if fresh:
            self.handle.registerTimer(now + self.every_ms)
        yield self._told(key, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.sums.get()[0] < self.total:
            self.handle.registerTimer(now + self.every_ms)
        yield self._told(key, now)

    def close(self) -> None:
        pass


def paced(changed: DataFrame, total: int, every_ms: int = 10_000) -> DataFrame:
    """Of a stream of changes: done, errors, cost, rate and remaining time of each run, as they change and every so often. total: trials of a run."""
    return changed.select("run_id", "sign", "status", "cost_usd").groupBy("run_id").transformWithState(Pace(total, every_ms), PACE, "Update", "ProcessingTime")
