"""Polygons to pixels by scanlines, and shapes painted to class masks.

An edge crosses each row of pixels between its ends once; the pixels of a row lie inside between its odd and even
crossings. All crossings of all rows are found at once in whole numbers, so a frame costs its rows times its edges plus
its pixels, not their product. Pixels on an edge belong to the polygon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(corners, width: int, height: int):
    """Booleans (height, width) of a polygon of whole-number corners (k, 2), even-odd, its edges included.

    Corners may lie outside the frame; one or two of them are a point or a line.
    """
    import numpy as np

    out = np.zeros((height, width), bool)
    a = np.asarray(corners, np.int64).reshape(-1, 2)
    if not len(a) or not out.size:
        return out
    b = np.roll(a, -1, axis=0)
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    first, upto = np.clip(low, 0, height), np.clip(high, 0, height)  # rows that an edge crosses: low <= y < high
    n = upto - first
    edge = np.repeat(np.arange(len(a)), n)
    y = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + first[edge]
    dy = b[edge, 1] - a[edge, 1]
    over = (b[edge, 0] - a[edge, 0]) * (y - a[edge, 1])
    sign = np.sign(dy)
    x = a[edge, 0] - (-(over * sign)) // (dy * sign)  # first pixel that is not left of the crossing
    toggles = np.zeros((height, width + 1), np.int32)
    np.add.at(toggles, (y, np.clip(x, 0, width)), 1)
    out |= (np.cumsum(toggles[:, :-1], axis=1) % 2).astype(bool)
    d = b - a
    steps = np.gcd(np.abs(d[:, 0]), np.abs(d[:, 1]))  # lattice points of an edge
    of = np.repeat(np.arange(len(a)), steps + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    at = a[of] + d[of] // np.maximum(steps, 1)[of, None] * k[:, None]
    at = at[(at >= 0).all(axis=1) & (at[:, 0] < width) & (at[:, 1] < height)]
    out[at[:, 1], at[:, 0]] = True
    return out


def polygon_pixels(corners: Column, width: int, height: int) -> Column:
    """Booleans by rows: the pixels of a polygon of corners (x, y) on whole pixels; null stays null, a corner without a number fails the query."""

    @F.arrow_udf("array<boolean>")
    def run(polygons):
        import numpy as np
        import pyarrow as pa

        made, offsets, missing = [], [0], []
        for p in polygons:
            points = p.as_py()
            missing.append(points is None)
            if points is not None:
                made.append(filled([(int(q["x"]), int(q["y"])) for q in points], width, height).ravel())
            offsets.append(offsets[-1] + (0 if points is None else width * height))
        flat = pa.array(np.concatenate(made) if made else np.zeros(0, bool))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(missing))

    return run(corners)


def painted_masks(shapes: DataFrame, frame: str, width: str, height: str, slot: str, polygon: str = "polygon", pixels: str | None = None, paint_order: Sequence[int] = ()) -> DataFrame:
    """(frame, height, width, px: slots by rows) of annotated frames: every shape painted into its frame, 0 where none is.

    A shape is a ``polygon`` of x1, y1, x2, ... (corners rounded to whole pixels, halves to the even one; fewer than three
    points paint nothing) or ``pixels``, the frame's mask of 0 and 1 by rows. Slots of ``paint_order`` are painted after all
    others, in order, so that the last wins; shapes of one slot need no order. A frame whose rows have neither shape is
    empty; one without a size, or pixels of another size, fail the query. A frame's shapes are one group.
    """
    later = list(paint_order)
    kind = dict(shapes.dtypes)[frame]
    rows = shapes.select(F.col(frame).alias("frame"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"), F.col(slot).cast("int").alias("slot"), F.col(polygon).cast("array<double>").alias("polygon"), (F.col(pixels).cast("array<int>") if pixels else F.lit(None).cast("array<int>")).alias("pixels"))

    def run(table):
        import numpy as np
        import pyarrow as pa

        w, h = (table.column(c)[0].as_py() for c in ("w", "h"))
        if w is None or h is None:
            raise ValueError("a frame needs a width and a height")
        mask = np.zeros(h * w, np.int32)
        slots = np.array([-1 if s is None else s for s in table.column("slot").to_pylist()])
        rank = np.array([later.index(s) if s in later else -1 for s in slots.tolist()])
        for i in np.lexsort([slots, rank]):
            points, own = table.column("polygon")[int(i)], table.column("pixels")[int(i)]
            if points.is_valid and len(points) >= 6:
                flat = points.values.to_numpy()
                mask[filled(np.rint(flat[: len(flat) // 2 * 2]).reshape(-1, 2), w, h).ravel()] = slots[i]
            elif own.is_valid:
                on = own.values.to_numpy()
                if len(on) != h * w:
                    raise ValueError("pixels do not fill their frame")
                mask[on == 1] = slots[i]
        px = pa.ListArray.from_arrays(pa.array([0, len(mask)], pa.int32()), pa.array(mask))
        return pa.table([table.column("frame").slice(0, 1).combine_chunks(), pa.array([h], pa.int32()), pa.array([w], pa.int32()), px], ["frame", "height", "width", "px"])

    made = rows.groupBy("frame").applyInArrow(run, f"frame {kind}, height int, width int, px array<int>")
    return made.withColumnRenamed("frame", frame)
