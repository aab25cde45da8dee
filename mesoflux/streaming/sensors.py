"""Structured Streaming over sensor feeds. Row-local gates are the batch column code; the rest is watermarked or keyed state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.quality import range_gate
from ..sources.publish import append_block


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A watermark needs TIMESTAMP; the session's zone must be UTC for the cast to keep the wall time."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_gate(df: DataFrame, limits: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    return range_gate(df, limits)


def stream_hourly(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), ts: str = "ts", freq: str = "1 hour", lateness: str = "2 hours", min_samples: int = 6) -> DataFrame:
    """Means of tumbling windows in append mode; later rows than ``lateness`` are dropped with the window's state."""
    out = [F.when(F.count(c) >= min_samples, F.avg(c)).alias(c) for c in values]
    grouped = event_time(df, ts).withWatermark(ts, lateness).groupBy(*keys, F.window(ts, freq))
    return grouped.agg(*out).select(*keys, F.col("window.start").alias(ts), *values)


def _runs(values: np.ndarray, micros: np.ndarray, last: float, at: int | None, run: int, step: int) -> np.ndarray:
    """Length of the run of equal values that each row ends, on a grid of ``step`` microseconds; a missing value ends a run and has 0.

    ``last``, ``at`` and ``run`` are what the rows before left.
    """
    before = np.concatenate(([last], values[:-1]))
    gap = np.diff(micros, prepend=micros[0] - step if at is None else at)
    goes_on = (values == before) & (gap == step)
    place = np.arange(len(values))
    start = np.maximum.accumulate(np.where(goes_on, -1, place))  # -1: a run that began before these rows
    length = np.where(start < 0, place + 1 + run, place - start + 1)
    return np.where(np.isnan(values), 0, length)


def stream_stuck(df: DataFrame, column: str, min_run: int, key: str, ts: str = "ts", step_seconds: float = 300.0, idle: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """(key, ts, value, run): rows at which the same value has stood for more than ``min_run`` samples on the exact grid.

    A station's state is its last value, stamp and run length. With ``idle`` (a length of event time, as "6 hours") a station whose last
    stamp the watermark, ``lateness`` behind the newest row, has passed by that much loses its state, so that stations which are gone
    cost nothing; a run that goes on after so long a gap could not be on the grid anyway. Rows of a batch are put in the order of their
    stamps, equal stamps by value; a row behind the state's stamp is not on the grid and begins a new run.
    """
    step, wait = round(step_seconds * 1e6), pd.Timedelta(idle).value // 1_000_000 if idle else None
    if wait is not None and wait * 1000 < step:
        raise ValueError("idle must not be shorter than the grid's step")

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at, run = state.get if state.exists else (float("nan"), None, 0)
        for rows in [pd.concat(list(frames), ignore_index=True).sort_values([ts, column], kind="stable")]:  # all that a batch has of the key
            values = rows[column].to_numpy("float64", na_value=np.nan)
            micros = rows[ts].to_numpy("datetime64[us]").astype("int64")
            length = _runs(values, micros, last, at, run, step)
            long = length > min_run
            last, at, run = float(values[-1]), int(micros[-1]), int(length[-1])
            yield pd.DataFrame({key: k[0], ts: rows[ts].to_numpy()[long], "value": values[long], "run": length[long].astype("int32")})
        state.update((last, at, run))
        if wait is not None:
            state.setTimeoutTimestamp(max(at // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    kind = df.schema[key].dataType.simpleString()
    rows = event_time(df, ts).select(key, ts, F.col(column).cast("double").alias(column))
    if idle:
        rows = rows.withWatermark(ts, lateness)
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {ts} timestamp, value double, run int", "value double, at long, run int", "append", timeout)


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    return event_time(df, ts).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([*keys, ts])


def append_sink(path: str, keys: Sequence[str] | None = None, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows whose ``keys`` (a station and a stamp) the table lacks are appended, one a key, as a whole or not at all.

    A batch that the stream has committed before is left alone: the commit holds the number of the last batch of every stream, known by
    its checkpoint. Of the table only the span of the batch's stamps is read. Without keys see ``append_block``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_block(batch, path, keys, ts, batch=(stream, epoch) if stream else None)

    return write


def rolling_monitor(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), ts: str = "ts", span: str = "1 day", every: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Sliding means, minima and maxima of the last ``span``, every ``every``, in append mode.

    Two windows in a row: panes, as long as both lengths allow, take each sample once; closed panes then go to the windows that they lie
    in. So a sample changes one state, not ``span / every``, and the second state has rows by panes, however many samples there are.
    """
    pane = f"{math.gcd(pd.Timedelta(span).value, pd.Timedelta(every).value) // 1000} microseconds"
    parts = [f(c).alias(f"_{c}_{n}") for c in values for n, f in (("sum", F.sum), ("n", F.count), ("min", F.min), ("max", F.max))]
    panes = event_time(df, ts).withWatermark(ts, lateness).groupBy(*keys, F.window(ts, pane).alias("_pane")).agg(*parts)
    out = []
    for c in values:
        out += [F.try_divide(F.sum(f"_{c}_sum"), F.sum(f"_{c}_n")).alias(f"{c}_mean"), F.min(f"_{c}_min").alias(f"{c}_min"), F.max(f"_{c}_max").alias(f"{c}_max")]
    slid = panes.groupBy(*keys, F.window(F.window_time("_pane"), span, every).alias("_w")).agg(*out)
    return slid.select(*keys, F.col("_w.end").alias(ts), *[f"{c}_{n}" for c in values for n in ("mean", "min", "max")])
