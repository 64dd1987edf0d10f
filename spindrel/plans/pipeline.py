"""Pipelines of steps over documents, as columns or as Python functions.

A table in flight has the columns doc, status (active, or paused), reason and
next_step beside its id. A step computes a new doc; rows that paused stay as
they are. Pipelines are immutable: two that grow from one base are independent.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fresh

ColumnStep = Callable[[Column], Column]


@dataclass(frozen=True)
class Step:
    """doc -> doc as columns; `pause` gives a reason where the row is to wait (null elsewhere). Where
    `apply` comes out null from a doc that isn't, the step failed: the doc stays and goes on."""

    name: str
    apply: ColumnStep
    pause: ColumnStep | None = None


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...] = ()

    def add(self, name: str, apply: ColumnStep, pause: ColumnStep | None = None) -> Pipeline:
        return replace(self, steps=(*self.steps, Step(name, apply, pause)))

    def start(self, df: DataFrame, doc: Column) -> DataFrame:
        return df.withColumns({"doc": doc, "status": F.lit("active"), "reason": F.lit(None).cast("string"), "next_step": F.lit(0)})

    def run(self, df: DataFrame) -> DataFrame:
        """All steps from each row's next_step on. A paused row keeps the last doc it completed and, as
        next_step, the step that paused it: resumed() takes it from there."""
        for number, step in enumerate(self.steps):
            df = self._advance(df, number, step)
        return df.withColumn("status", F.when(F.col("status") == "active", "done").otherwise(F.col("status")))

    def next(self, df: DataFrame) -> DataFrame:
        """One step: each row's own."""
        at = F.col("next_step")
        doc, status, reason, to = F.col("doc"), F.col("status"), F.col("reason"), at
        for number, step in enumerate(self.steps):
            mine = (at == number) & (F.col("status") == "active")
            why = step.pause(F.col("doc")) if step.pause else F.lit(None).cast("string")
            doc = F.when(mine & why.isNull(), F.coalesce(step.apply(F.col("doc")), F.col("doc"))).otherwise(doc)
            status = F.when(mine & why.isNotNull(), "paused").otherwise(status)
            reason = F.when(mine, why).otherwise(reason)
            to = F.when(mine & why.isNull(), number + 1).otherwise(to)
        out = df.withColumns({"doc": doc, "status": status, "reason": reason, "next_step": to})
        return out.withColumn("status", F.when((F.col("status") == "active") & (F.col("next_step") >= len(self.steps)), "done").otherwise(F.col("status")))

    def resumed(self, df: DataFrame) -> DataFrame:
        """Paused rows made active again at the step that paused them."""
        return df.withColumns({"status": F.when(F.col("status") == "paused", "active").otherwise(F.col("status")), "reason": F.lit(None).cast("string")})

    def events(self, df: DataFrame) -> DataFrame:
        """One row per step that ran: the columns of df but the four, and step, type (progress, pause, error), doc, reason, next_step."""
        keep = [c for c in df.columns if c not in ("doc", "status", "reason", "next_step")]
        names = set(df.columns)

        def new(wish: str) -> str:
            names.add(name := fresh(names, wish))
            return name

        # each step has columns of its own, so that no expression holds those of the steps before it
        doc, why, made, active = new("__doc"), new("__why"), new("__made"), new("__active")
        df = df.withColumns({doc: F.col("doc"), active: F.col("status") == "active"})
        seen = []
        for number, step in enumerate(self.steps):
            d = F.col(doc)
            df = df.withColumns({why: step.pause(d) if step.pause else F.lit(None).cast("string"), made: step.apply(d)})
            kind = F.when(F.col(why).isNotNull(), "pause").when(F.col(made).isNull() & d.isNotNull(), "error").otherwise("progress")
            runs = F.col(active) & (F.col("next_step") <= number)
            after = F.when(runs & F.col(why).isNull(), F.coalesce(made, d)).otherwise(d)
            event = F.struct(F.lit(number).alias("step"), F.lit(step.name).alias("name"), kind.alias("type"), after.alias("doc"), F.col(why).alias("reason"), F.when(F.col(why).isNull(), number + 1).otherwise(number).alias("next"))
            seen.append(new(f"__event{number}"))
            df = df.withColumns({seen[-1]: F.when(runs, event), doc: after, active: F.col(active) & ~(runs & F.col(why).isNotNull())})
        return df.select(*keep, F.explode(F.array_compact(F.array(*seen))).alias("e")).select(*keep, "e.step", "e.name", "e.type", "e.doc", "e.reason", F.col("e.next").alias("next_step"))

    def _advance(self, df: DataFrame, number: int, step: Step) -> DataFrame:
        why = step.pause(F.col("doc")) if step.pause else F.lit(None).cast("string")
        runs = (F.col("status") == "active") & (F.col("next_step") <= number)
        done = runs & why.isNull()
        return df.withColumns(
            {
                "doc": F.when(done, F.coalesce(step.apply(F.col("doc")), F.col("doc"))).otherwise(F.col("doc")),
                "status": F.when(runs & why.isNotNull(), "paused").otherwise(F.col("status")),
                "reason": F.when(runs, why).otherwise(F.col("reason")),
                "next_step": F.when(done, number + 1).otherwise(F.col("next_step")),
            }
        )


def pipe_steps(*steps: ColumnStep) -> ColumnStep:
    def piped(doc: Column) -> Column:
        for step in steps:
            doc = step(doc)
        return doc

    return piped


def _let(value: Column, then: ColumnStep) -> Column:
    """then(value), with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def with_sequence(*steps: ColumnStep, stop: ColumnStep | None = None) -> ColumnStep:
    """Steps one after another until `stop` holds, which is asked after each."""

    def after(step: ColumnStep) -> ColumnStep:
        return lambda s: F.struct(F.when(s["stopped"], s["doc"]).otherwise(step(s["doc"])).alias("doc"), s["stopped"].alias("stopped"))

    def asked(s: Column) -> Column:
        return F.struct(s["doc"].alias("doc"), (s["stopped"] | F.coalesce(stop(s["doc"]), F.lit(False))).alias("stopped"))

    def sequence(doc: Column) -> Column:
        state = F.struct(doc.alias("doc"), F.lit(False).alias("stopped"))
        for step in steps:
            state = _let(state, after(step))
            if stop is not None:
                state = _let(state, asked)
        return state["doc"]

    return sequence


def with_alternatives(*steps: ColumnStep, accept: ColumnStep | None = None, feed_forward: bool = True) -> ColumnStep:
    """The first result that is accepted, else the last (without `accept` nothing is). Each strategy gets
    the one before's result, or with feed_forward off the input."""
    if not steps:
        raise ValueError("no alternatives")

    def after(step: ColumnStep, doc: Column) -> ColumnStep:
        return lambda s: F.struct(F.when(s["accepted"], s["now"]).otherwise(step(s["now"] if feed_forward else doc)).alias("now"), s["accepted"].alias("accepted"))

    def asked(s: Column) -> Column:
        return F.struct(s["now"].alias("now"), (s["accepted"] | F.coalesce(accept(s["now"]), F.lit(False))).alias("accepted"))

    def alternatives(doc: Column) -> Column:
        state = F.struct(doc.alias("now"), F.lit(False).alias("accepted"))
        for step in steps:
            state = _let(state, after(step, doc))
            if accept is not None:
                state = _let(state, asked)
        return state["now"]

    return alternatives


def cached(df: DataFrame, key: Column, compute: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """compute() runs over distinct keys (a table with the column key) and gives key and `out`, joined
    back. A null key is a key. A column of df's named `out` is replaced; all others stay."""
    mine = fresh([*df.columns, out], "__key")
    keyed = df.drop(out).withColumn(mine, key)
    made = compute(keyed.select(F.col(mine).alias("key")).distinct()).select(F.col("key").alias(mine + "made"), F.col(out))
    return keyed.join(made, F.col(mine).eqNullSafe(F.col(mine + "made")), "left").drop(mine, mine + "made")


def tap(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """The same rows; metrics go to listeners under the name."""
    return df.observe(name, *metrics)


@dataclass(frozen=True)
class Outcome:
    """What a Python step came to: a value, or the reason of a pause with a payload."""

    value: object = None
    reason: str | None = None
    payload: object = None
    attempts: int = 1

    @property
    def done(self) -> bool:
        return self.reason is None


PyStep = Callable[[object], Outcome]


def _outcome(step: Callable, doc: object) -> Outcome:
    out = step(doc)
    return out if isinstance(out, Outcome) else Outcome(out)


def sequence_steps(*steps: Callable, stop: Callable[[object], bool] | None = None) -> PyStep:
    """Python steps one after another until `stop` holds; a pause is handed on at once."""

    def sequence(doc: object) -> Outcome:
        for step in steps:
            out = _outcome(step, doc)
            if not out.done:
                return out
            doc = out.value
            if stop is not None and stop(doc):
                break
        return Outcome(doc)

    return sequence


def alternative_steps(*steps: Callable, accept: Callable[[object], bool] | None = None) -> PyStep:
    """Python strategies, each given the one before's result, until one is accepted, else the last; a pause is handed on at once."""
    if not steps:
        raise ValueError("no alternatives")

    def alternatives(doc: object) -> Outcome:
        return sequence_steps(*steps, stop=accept)(doc)

    return alternatives


def with_error_handling(step: Callable) -> PyStep:
    def handled(doc: object) -> Outcome:
        try:
            return _outcome(step, doc)
        except Exception:
            return Outcome(reason="error", payload=doc)

    return handled


def with_retry(step: Callable, retries: int = 2, delay: float = 0.0) -> PyStep:
    """Error pauses are tried again, `retries` times at most; other pauses are handed on."""

    def retried(doc: object) -> Outcome:
        for attempt in range(1, retries + 2):
            out = _outcome(step, doc)
            if out.reason != "error":
                return replace(out, attempts=attempt)
            if delay and attempt <= retries:
                time.sleep(delay)
        return Outcome(reason="retryExceeded", payload=doc, attempts=retries + 1)

    return retried


def with_timeout(step: Callable, seconds: float) -> PyStep:
    """Waits so long and no longer; the work itself isn't cut off. 0 and less: no limit."""

    def timed(doc: object) -> Outcome:
        if seconds <= 0:
            return _outcome(step, doc)
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(_outcome, step, doc).result(seconds)
        except Late:
            return Outcome(reason="timeout", payload=doc)
        finally:
            pool.shutdown(wait=False)

    return timed


@dataclass
class with_cache:  # noqa: N801
    """Remembers what came out, by key; pauses aren't kept. One memory per task."""

    step: Callable
    key: Callable
    memory: dict = field(default_factory=dict)

    def __call__(self, doc: object) -> Outcome:
        k = self.key(doc)
        if k not in self.memory:
            out = _outcome(self.step, doc)
            if not out.done:
                return out
            self.memory[k] = out
        return self.memory[k]


def run_python(df: DataFrame, steps: list[Callable], id_col: str, doc_col: str) -> DataFrame:
    """id, doc, status, reason, step, attempts: Python steps over Arrow batches. A step that throws leaves the doc as it is."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, doc in zip(batch["id"], batch["doc"]):
                status, reason, at, attempts = "done", None, len(steps), 0
                for number, step in enumerate(steps):
                    try:
                        out = _outcome(step, doc)
                    except Exception:
                        continue
                    attempts += out.attempts
                    if not out.done:
                        status, reason, at = "paused", out.reason, number
                        break
                    doc = out.value
                rows.append((i, doc, status, reason, at, attempts))
            yield pd.DataFrame(rows, columns=["id", "doc", "status", "reason", "step", "attempts"])

    return df.select(F.col(id_col).alias("id"), F.col(doc_col).cast("string").alias("doc")).mapInPandas(run, f"id {kind}, doc string, status string, reason string, step int, attempts int").withColumnRenamed("id", id_col)
