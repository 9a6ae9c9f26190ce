"""Progress events: the state of each project as the last value of every field, in batch and as a stream; jobs with retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a project.
STATES = ("PENDING", "PROCESSING", "AUDITING", "SEGMENTING", "MAPPING", "TRAINING", "LIBRARIAN", "COMPLETED", "FAILED")

STATE = "status string, progress double, stage string"


def meaningful(events: DataFrame) -> DataFrame:
    """Empty statuses and stages change nothing; a progress of 0 counts."""
    text = lambda k: F.when(F.col(k) != "", F.col(k)).alias(k)
    return events.select("project", "seq", text("status"), "progress", text("stage"))


def latest(events: DataFrame) -> DataFrame:
    """(project, status, progress, stage): the last value given for each field."""
    last = lambda k: F.max_by(k, F.when(F.col(k).isNotNull(), F.col("seq"))).alias(k)
    return meaningful(events).groupBy("project").agg(last("status"), last("progress"), last("stage"))


def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One project's state after a micro-batch, for applyInPandasWithState."""
    held = list(state.get) if state.exists else [None, None, None]
    rows = pd.concat(list(frames)).sort_values("seq")
    for row in rows.itertuples():
        for k, value in enumerate((row.status, row.progress, row.stage)):
            if value is not None and value == value:
                held[k] = value
    state.update(tuple(held))
    yield pd.DataFrame({"project": [key[0]], "status": [held[0]], "progress": [held[1]], "stage": [held[2]]})


def stream(events: DataFrame) -> DataFrame:
    """The same as an update stream with one small state for each project."""
    return meaningful(events).groupBy("project").applyInPandasWithState(fold, f"project long, {STATE}", STATE, "update", "NoTimeout")


def follow(events: DataFrame, project: int, first: DataFrame) -> DataFrame:
    """A client's view: its project's state so far, then its project's events."""
    return first.filter(F.col("project") == project).unionByName(events.filter(F.col("project") == project))


def attempts(jobs: DataFrame, most: int = 3, base_ms: int = 1000) -> DataFrame:
    """One row for each attempt of a job up to its first success, with the wait before it: base * 2 ** (attempt - 2)."""
    tries = jobs.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.least(F.col("succeeds_at"), F.lit(most)))))
    wait = F.when(F.col("attempt") == 1, 0).otherwise((base_ms * F.pow(F.lit(2.0), F.col("attempt") - 2)).cast("long")).cast("long")
    return tries.withColumn("wait_ms", wait).withColumn("ok", F.col("attempt") == F.col("succeeds_at"))


def terminal(exit_code: Column) -> Column:
    return F.when(exit_code == 0, "COMPLETED").otherwise("FAILED")


def known_state(status: Column) -> Column:
    """Any state may follow any other; only the name is checked."""
    return status.isin(*STATES)


def notification(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("status") == "COMPLETED", "done").otherwise("update")
    return events.withColumn("kind", kind)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each record of an append-only table."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*")


def running(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"n": F.count(value).over(w), "mean": F.avg(value).over(w)})
