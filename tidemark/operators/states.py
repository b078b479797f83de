"""State machines over ordered rows of a key: batch twins of the streaming processors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("AMAN", "WASPADA", "BAHAYA")


def next_level(now: int, since_low: float | None, t: float, height, rain, enter, leave, rains, dwell: float, wrap: float | None = None) -> tuple[int, float | None]:
    """(level, start of the calm spell) after one reading.

    Height or rain beyond a level's limit raises it at once. It falls by one level after ``dwell`` seconds below the exit
    edge without rain beyond the level's limit; a null height holds it. ``wrap`` is the span of a clock that starts anew.
    """
    if height is None:
        return now, since_low
    wet = rain or 0
    up = 2 if height > enter[1] or wet > rains[1] else 1 if height > enter[0] or wet > rains[0] else 0
    if up > now:
        return up, None
    if now == 0 or height >= leave[now - 1] or wet > rains[now - 1]:
        return now, None
    since_low = t if since_low is None else since_low
    calm = (t - since_low) % wrap if wrap else t - since_low
    return (now - 1, None) if calm >= dwell else (now, since_low)


def levels(df: DataFrame, key: str, ts: str, height: str, rain: str, enter=(30.0, 60.0), leave=(25.0, 55.0), rains=(10.0, 30.0), dwell: float = 60.0, seq: str | None = None, wrap: float | None = None) -> DataFrame:
    """``df`` (key, ts, height, rain) with ``level`` by hysteresis, folded row by row within each key, in the order of ``ts``, then ``seq``.

    A clock that wraps is no order: give rows with ``wrap`` a ``seq`` alone, as ``ts`` then only measures time.
    """

    number = lambda v: None if v is None or v != v else v

    def run(batches):
        import pyarrow as pa

        at, now, low = object(), 0, None
        for batch in batches:  # Arrow's own values: ids stay whole numbers beside nulls
            out = []
            for k, t, h, r in zip(*[batch.column(c).to_pylist() for c in (key, ts, height, rain)], strict=True):
                if k != at:
                    at, now, low = k, 0, None
                now, low = next_level(now, low, t, number(h), number(r), enter, leave, rains, dwell, wrap)
                out.append(LEVELS[now])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "level"])

    order = [seq] if wrap and seq else [ts, *([seq] if seq else [])]
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, df.withColumn("level", F.lit("")).schema)


def throttled(df: DataFrame, key: str, ts: str, interval: float, seq: str | None = None) -> DataFrame:
    """Rows emitted when ``interval`` seconds have passed since the last emitted row of the key, in the order of ``ts``, then ``seq``."""

    def run(batches):
        import pyarrow as pa

        at, last = object(), None
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(ts).to_pylist(), strict=True):
                if k != at:
                    at, last = k, None
                go = last is None or t - last >= interval
                last = t if go else last
                keep.append(go)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(key).sortWithinPartitions(key, ts, *([seq] if seq else [])).mapInArrow(run, df.schema)


def greedy_split(groups: DataFrame, dataset: str, group: str, size: str, ratios=(("train", 0.7), ("val", 0.15), ("test", 0.15)), seed: int = 42) -> DataFrame:
    """Whole groups to splits: one group each first if there are enough, then each to the split with the largest remaining deficit.

    ``groups`` holds a row per group, in md5 order of ``seed:dataset:group``; a dataset's groups are few.
    """

    def run(table):
        import hashlib

        import pyarrow as pa

        sets, names, sizes = (table.column(c).to_pylist() for c in (dataset, group, size))
        order = sorted(range(len(names)), key=lambda i: hashlib.md5(f"{seed}:{sets[i]}:{names[i]}".encode()).hexdigest())
        total, filled, out = sum(sizes), [0] * len(ratios), [""] * len(names)
        for n, i in enumerate(order):
            k = n if n < len(ratios) <= len(names) else max(range(len(ratios)), key=lambda j: ratios[j][1] * total - filled[j])
            filled[k] += sizes[i]
            out[i] = ratios[k][0]
        return table.append_column("split", pa.array(out, pa.string()))

    return groups.groupBy(dataset).applyInArrow(run, groups.withColumn("split", F.lit("")).schema)
