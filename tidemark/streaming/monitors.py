"""Monitors whose state lives in the stream: smoothing, growth, alerts and carried values per source, and silence.

Each is the twin of a batch operator in ``operators.timeseries`` and gives the same rows, however the input is cut into
batches, as long as a source's rows arrive in time order. Rows of one batch are put in order first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "segment string, recent array<double>, times array<double>, fracs array<double>, streak int, latched boolean, carried double, carried_at double"
SHOWN = "smoothed double, growth_per_min double, streak int, alert boolean, latched boolean, carried double, age_s double"


class Monitor:
    """The state of one source and what a row does to it."""

    def __init__(self, n: int, window_s: float, area_from: float, growth_from: float, consecutive: int, held: tuple | None = None):
        self.n, self.window_s, self.area_from, self.growth_from, self.consecutive = n, window_s, area_from, growth_from, consecutive
        self.segment = None
        self.reset()
        if held is not None:
            self.segment, recent, times, fracs, self.streak, self.latched, self.carried, self.carried_at = held
            self.recent, self.times, self.fracs = list(recent), list(times), list(fracs)

    def reset(self) -> None:
        self.recent, self.times, self.fracs, self.streak, self.latched, self.carried, self.carried_at = [], [], [], 0, False, None, None

    def held(self) -> tuple:
        return self.segment, self.recent, self.times, self.fracs, self.streak, self.latched, self.carried, self.carried_at

    def row(self, t: float, frac, slow, segment) -> tuple:
        from statistics import median

        if segment != self.segment:  # another source, or regions drawn anew: nothing of before counts
            self.reset()
            self.segment = segment
        growth = None
        if frac is not None:
            self.recent = [*self.recent, frac][-self.n :]
            self.times, self.fracs = [*self.times, t], [*self.fracs, frac]
            while len(self.times) > 2 and self.times[0] < t - self.window_s:
                self.times, self.fracs = self.times[1:], self.fracs[1:]
            if len(self.times) > 1 and (t - self.times[0]) / 60 > 1e-6:
                growth = (frac - self.fracs[0]) / ((t - self.times[0]) / 60)
        hit = frac is not None and (frac >= self.area_from or (growth is not None and growth >= self.growth_from))
        self.streak = self.streak + 1 if hit else 0
        alert = self.streak >= self.consecutive
        self.latched = self.latched or alert
        if slow is not None:
            self.carried, self.carried_at = slow, t
        smoothed = median(self.recent) if self.recent else None
        return smoothed, growth, self.streak, alert, self.latched, self.carried, None if self.carried_at is None else t - self.carried_at


def monitored(stream: DataFrame, key: str, ts: str, frac: str, slow: str, segment: str, n: int = 30, window_s: float = 300.0, area_from: float = 0.3, growth_from: float = 0.1, consecutive: int = 3, forget_s: float | None = None) -> DataFrame:
    """Rows (key, ts, SHOWN): median of the last ``n`` measured shares, growth, alert, and the last value of the slower ``slow`` with its age.

    A row whose ``segment`` differs from the one before starts anew. A source's state is bounded by ``n`` and by the rows
    of ``window_s`` seconds; with ``forget_s`` it goes when a source has sent nothing for so long by the wall clock.
    """
    kind = dict(stream.dtypes)[key]

    def run(keys, batches: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        monitor = Monitor(n, window_s, area_from, growth_from, consecutive, state.get if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        clean = lambda v: None if pd.isna(v) else v
        out = [monitor.row(t, clean(f), clean(s), clean(g)) for t, f, s, g in zip(rows[ts], rows[frac], rows[slow], rows[segment], strict=True)]
        state.update(monitor.held())
        if forget_s:
            state.setTimeoutDuration(int(forget_s * 1000))
        names = [x.split()[0] for x in SHOWN.split(", ")]
        yield pd.DataFrame({key: keys[0], ts: rows[ts].to_numpy(), **{name: pd.Series([o[i] for o in out], dtype=object) for i, name in enumerate(names)}}).astype({"streak": "int32", "alert": bool, "latched": bool, **{c: "float64" for c in ("smoothed", "growth_per_min", "carried", "age_s")}})

    typed = stream.withColumn(segment, F.col(segment).cast("string"))
    return typed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} double, {SHOWN}", STATE, "append", "ProcessingTimeTimeout" if forget_s else "NoTimeout")


def silent(stream: DataFrame, key: str, at: str = "at", minutes: float = 20.0) -> DataFrame:
    """A row (key, quiet_since) each time a source has sent nothing for ``minutes`` of event time; ``stream`` has a watermark on ``at``."""
    kind, quiet_ms = dict(stream.dtypes)[key], int(minutes * 60_000)

    def run(keys, batches: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "quiet_since": [pd.Timestamp(last, unit="ms")]})
            return
        times = sorted(int(x.timestamp() * 1000) for b in batches for x in b[at])
        if state.exists:
            times = [state.get[0], *times]
        quiet = [x for x, after in zip(times, times[1:], strict=False) if after - x > quiet_ms]
        last = max(times)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * len(quiet), "quiet_since": pd.to_datetime(quiet, unit="ms")})

    return stream.select(key, at).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, quiet_since timestamp", "last long", "append", "EventTimeTimeout")


def with_side_input(read: Callable[[SparkSession], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: reads a small, slowly changing table anew for every batch, joins it and writes the result."""

    def run(batch: DataFrame, number: int) -> None:
        write(join(batch, read(batch.sparkSession)), number)

    return run


def every(stream: DataFrame, seconds: float, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Start a query that commits on a clock, not by rows."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def drained(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand all there is to ``write``, batch by batch, and stop."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reset_key(*parts: Column) -> Column:
    """What a monitor's segment is made of: a source, a drawing of regions. A reconnect is no part of it and resets nothing."""
    return F.concat_ws("/", *parts)
