"""State with clocks: silence by the wall clock, samples by several clocks, nearest rows of two streams.

State is bounded: a source that stays silent is forgotten, and rows that wait for a partner go as the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Timers and state lists are kept by this store alone.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def quiet(stream: DataFrame, key: str, at: str = "at", minutes: float = 20.0, forget_minutes: float = 7 * 1440.0) -> DataFrame:
    """A row (key, quiet_since) when a source has sent nothing for ``minutes`` by the wall clock, even if no source sends anything.

    ``at`` is a row's own time. A source is reported once per silence, and its state goes after ``forget_minutes``, more
    than ``minutes``. Run it with a processing-time trigger; the session's state store is set to RocksDB, which timers need.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    if forget_minutes <= minutes:
        raise ValueError("a source is forgotten after it is reported")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind, source = dict(stream.dtypes)[key], key
    wait, forget = int(minutes * 60_000), int(forget_minutes * 60_000)

    class Silence(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "last long, told boolean")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            newest = max(int(t.timestamp() * 1000) for pdf in rows for t in pdf[at])
            if self.seen.exists():
                last, _ = self.seen.get()
                if newest <= last:  # nothing newer: the silence goes on
                    return iter(())
            self.seen.update((newest, False))
            self._set(newest + wait)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            if not self.seen.exists():
                return
            last, told = self.seen.get()
            if told:
                self.seen.clear()
                return
            self.seen.update((last, True))
            self._set(last + forget)
            yield pd.DataFrame({source: [key[0]], "quiet_since": [pd.Timestamp(last, unit="ms")]})

        def _set(self, when: int) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(when)

        def close(self) -> None:
            pass

    return stream.where(F.col(at).isNotNull()).select(key, at).groupBy(key).transformWithStateInPandas(Silence(), f"{key} {kind}, quiet_since timestamp", "Append", "ProcessingTime")


def clocked(stream: DataFrame, key: str, ts: str, clocks: dict[str, float], seq: str | None = None, forget_s: float | None = None) -> DataFrame:
    """Rows (key, ts, seq, clock): for each clock those at which its seconds have passed since its last row of the key.

    The twin of ``states.throttled`` for each clock, however the input is cut, as long as a key's rows arrive in order.
    With ``forget_s`` a key that has sent nothing for so long, by the wall clock, is forgotten: its clocks start anew.
    """
    kinds = dict(stream.dtypes)
    names = list(clocks)
    columns = [ts, *([seq] if seq else [])]

    def run(keys, batches: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        lasts = list(state.get[0]) if state.exists else [None] * len(names)
        rows = pd.concat(list(batches)).sort_values(columns, kind="stable")
        out = {c: [] for c in (*columns, "clock")}
        for i, t in enumerate(rows[ts]):
            for k, name in enumerate(names):
                if lasts[k] is None or t - lasts[k] >= clocks[name]:
                    lasts[k] = float(t)
                    for c in columns:
                        out[c].append(rows[c].iloc[i])
                    out["clock"].append(name)
        state.update((lasts,))
        if forget_s:
            state.setTimeoutDuration(int(forget_s * 1000))
        yield pd.DataFrame({key: [keys[0]] * len(out["clock"]), **out})

    schema = ", ".join([f"{key} {kinds[key]}", *[f"{c} {kinds[c]}" for c in columns], "clock string"])
    return stream.select(key, *columns).groupBy(key).applyInPandasWithState(run, schema, "lasts array<double>", "append", "ProcessingTimeTimeout" if forget_s else "NoTimeout")


def nearest_stream(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_seq: str, tol_s: float, late: str = "1 minute") -> DataFrame:
    """``timeseries.nearest`` of two streams: every row of ``left`` once, with the row of ``right`` nearest in time within ``tol_s`` seconds, else nulls.

    Times are seconds. A row of ``left`` waits until the watermark, ``late`` behind the newest row of both, has passed the
    last time at which a nearer row could stand; rows of ``right`` are kept as long as a row of ``left`` may ask for them.
    Rows later than the watermark may miss partners that have gone. Null keys are one key; rows of ``left`` without a
    time have no partner.
    """
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    row = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", **exact})
    side = lambda df, ts, mine: df.select(
        F.col(key).alias("__k"), F.col(ts).cast("double").alias("__t"), F.coalesce(F.timestamp_micros((F.col(ts).cast("double") * 1_000_000).cast("long")), F.timestamp_seconds(F.lit(0))).alias("__at"),
        (F.lit(0).cast("long") if mine else F.col(right_seq).cast("long")).alias("__q"), F.lit(mine).alias("__left"), row(df).alias("__row"),
    )
    both = side(left, left_ts, True).unionByName(side(right, right_ts, False)).withWatermark("__at", late)
    tol_ms = tol_s * 1000

    def run(keys, batches: Iterator, state):
        import bisect

        import pandas as pd

        held = state.get if state.exists else ([], [], [], [], [])
        lefts = list(zip(*held[:2], strict=True))
        rights = list(zip(*held[2:], strict=True))
        out = []
        for pdf in batches if not state.hasTimedOut else ():
            for t, q, mine, text in zip(pdf["__t"], pdf["__q"], pdf["__left"], pdf["__row"], strict=True):
                if pd.isna(t):
                    out += [(text, None)] if mine else []
                elif mine:
                    lefts.append((float(t), text))
                else:
                    rights.append((float(t), int(q), text))
        rights.sort(key=lambda r: r[:2])
        times = [r[0] for r in rights]
        past = state.getCurrentWatermarkMs()
        waiting = []
        for t, text in lefts:
            if (t * 1000 + tol_ms) >= past:
                waiting.append((t, text))
                continue
            at = bisect.bisect_right(times, t)
            before = rights[bisect.bisect_left(times, times[at - 1])] if at else None  # of equal times the smallest seq
            after = rights[at] if at < len(rights) else None
            found = [r for r in (before, after) if r is not None and abs(r[0] - t) <= tol_s]
            out.append((text, min(found, key=lambda r: (abs(r[0] - t), r[0], r[1]))[2] if found else None))
        oldest = min([past / 1000, *(t for t, _ in waiting)])
        rights = [r for r in rights if r[0] >= oldest - tol_s]
        if waiting or rights:
            state.update(([t for t, _ in waiting], [x for _, x in waiting], [r[0] for r in rights], [r[1] for r in rights], [r[2] for r in rights]))
            due = min([t * 1000 + tol_ms for t, _ in waiting] or [max(r[0] for r in rights) * 1000 + 2 * tol_ms])
            state.setTimeoutTimestamp(int(max(due, past)) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"__l": [o[0] for o in out], "__m": pd.Series([o[1] for o in out], dtype=object)})

    held = "lt array<double>, lrow array<string>, rt array<double>, rq array<long>, rrow array<string>"
    made = both.groupBy("__k").applyInPandasWithState(run, "__l string, __m string", held, "append", "EventTimeTimeout")
    kept = [f for f in right.schema.fields if f.name != key]
    ours = F.from_json("__l", left.schema, exact)
    theirs = F.from_json("__m", right.schema, exact)
    return made.select(ours.alias("__l"), theirs.alias("__m")).select("__l.*", *[F.col("__m")[f.name].alias(f.name) for f in kept])
