"""Connected regions of masks, by runs of pixels.

A row of pixels is a few runs; runs of neighbouring rows that touch are joined, and the joined runs are labelled by
union-find. A frame that is too large for one row comes in tiles: each tile labels its own runs, the runs that touch a
seam are joined with those across it, and only these few pairs are put together for the whole frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(n: int, u, v):
    """The smallest number of each node's component in a graph of ``n`` nodes with edges ``u`` - ``v``."""
    import numpy as np

    parent = np.arange(n)
    while len(u):
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def runs(on):
    """(row, start, end) of the runs of a boolean frame, by row and start."""
    import numpy as np

    wide = np.zeros((on.shape[0], on.shape[1] + 2), np.int8)
    wide[:, 1:-1] = on
    change = np.diff(wide, axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1]


def touching(row, start, end, reach: int):
    """Pairs of runs in neighbouring rows that share a column, or with ``reach`` 1 touch by a corner."""
    import numpy as np

    span = int(end.max(initial=0)) + 2
    # runs are sorted by row, and within a row both by start and by end
    lo = np.searchsorted(row * span + end, (row + 1) * span + start - reach, side="right")
    hi = np.searchsorted(row * span + start, (row + 1) * span + np.minimum(end + reach, span - 1), side="left")
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(row)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]


def labelled(on, corners: bool = True):
    """(row, start, end, label, area of the label) of the runs of a frame; equal labels are one region."""
    import numpy as np

    row, start, end = runs(on)
    label = joined(len(row), *touching(row, start, end, int(corners)))
    area = np.bincount(label, weights=end - start, minlength=len(row)).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    return row, start, end, label, area[label]


def closed(on, size: int):
    """Gaps narrower than ``size`` (odd) bridged: the largest, then the smallest of each square; nothing lies beyond the frame's edge."""
    import numpy as np

    for pick, outside in ((np.logical_or, False), (np.logical_and, True)):
        for axis in (0, 1):
            wide = np.pad(on, [(size // 2,) * 2 if i == axis else (0, 0) for i in range(2)], constant_values=outside)
            n = on.shape[axis]
            out = np.take(wide, range(n), axis=axis)
            for k in range(1, size):
                out = pick(out, np.take(wide, range(k, k + n), axis=axis))
            on = out
    return on


def _painted(mask, on, pieces, large, debris: int, clump: int):
    """``mask`` with the debris inside the runs that ``large`` marks turned into clumps."""
    import numpy as np

    row, start, end = pieces
    mark = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.add.at(mark, (row[large], start[large]), 1)
    np.add.at(mark, (row[large], end[large]), -1)
    inside = np.cumsum(mark, axis=1)[:, :-1] > 0
    return np.where(inside & (mask == debris), clump, mask)


def promoted(frames: DataFrame, width: int, least: int | None = None, debris: int = 2, clump: int = 3, frame: str = "frame_id", px: str = "px", share: float = 0.005, close: int = 0, corners: bool = True) -> DataFrame:
    """``frames`` (frame, px: array of classes by rows) with large connected debris regions turned into clumps, and their number.

    A region is large with ``least`` pixels or more (None: ``share`` of the frame). Gaps narrower than ``close`` (odd;
    0: none) are bridged first; a bridge counts as area but stays what it was, so no debris is invented. Neighbours touch
    by a side, or with ``corners`` by a corner too. Null and empty frames keep their pixels and have none.
    A frame is one row, so no frame leaves its task.
    """
    if close and close % 2 == 0:
        raise ValueError("close must be odd")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column("px")
            made, counts, offsets, missing = [], [], [0], []
            for i in range(batch.num_rows):
                values, n = column[i], 0
                missing.append(not values.is_valid)
                flat = values.values.to_numpy(zero_copy_only=False) if values.is_valid else np.zeros(0, np.int32)
                if len(flat):
                    mask = flat.reshape(-1, width)
                    on = mask == debris
                    row, start, end, label, area = labelled(closed(on, close) if close > 1 else on, corners)
                    large = area >= (share * mask.size if least is None else least)
                    n = len(np.unique(label[large]))
                    flat = _painted(mask, on, (row, start, end), large, debris, clump).ravel()
                made.append(flat.astype(np.int32))
                counts.append(n)
                offsets.append(offsets[-1] + len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)), mask=pa.array(missing, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("frame"), lists, pa.array(counts, pa.int64())], ["frame", "px", "n_clumps"])

    kind = dict(frames.dtypes)[frame]
    rows = frames.select(F.col(frame).alias("frame"), F.col(px).cast("array<int>").alias("px"))
    return rows.mapInArrow(run, f"frame {kind}, px array<int>, n_clumps long").select(F.col("frame").alias(frame), F.col("px").alias(px), "n_clumps")


def promoted_tiles(tiles: DataFrame, frame: str, ty: str, tx: str, height: str, width: str, px: str, debris: int = 2, clump: int = 3, share: float = 0.005, least: int | None = None, corners: bool = True) -> DataFrame:
    """``promoted`` for frames that come in a grid of tiles (frame, ty, tx, height, width, px by rows), with the regions' areas over all tiles.

    Returns (frame, ty, tx, height, width, px). A tile is one row; of a whole frame only the runs on seams meet. Tiles of
    a row have one height, tiles of a column one width. Gaps are not bridged. Null tiles have no debris.
    """
    kind = dict(tiles.dtypes)[frame]
    rows = tiles.select(F.col(frame).alias("frame"), F.col(ty).cast("long").alias("ty"), F.col(tx).cast("long").alias("tx"), F.col(height).cast("int").alias("h"), F.col(width).cast("int").alias("w"), F.col(px).cast("array<int>").alias("px"))
    reach = int(corners)

    def mask_of(batch, i):
        import numpy as np

        values, h, w = (batch.column(c)[i] for c in ("px", "h", "w"))
        return values.values.to_numpy(zero_copy_only=False).reshape(h.as_py(), w.as_py()) if values.is_valid else np.zeros((0, 0), np.int32)

    def local(batches):
        """A row per region of a tile with its area, and one per run on a border: side, place along it."""
        import pyarrow as pa

        for batch in batches:
            out = {k: [] for k in ("frame", "ty", "tx", "label", "area", "w", "side", "lo", "hi")}
            for i in range(batch.num_rows):
                mask = mask_of(batch, i)
                if not mask.size:
                    continue
                h, w = mask.shape
                row, start, end, label, area = labelled(mask == debris, corners)
                at = [batch.column(c)[i].as_py() for c in ("frame", "ty", "tx")]

                def put(labels, areas, side, lo, hi, at=at, w=w):
                    n = len(labels)
                    for k, v in zip(out, ([at[0]] * n, [at[1]] * n, [at[2]] * n, labels, areas, [w] * n, [side] * n, lo, hi), strict=True):
                        out[k] += list(v)

                heads = label == range(len(label))
                put(label[heads].tolist(), area[heads].tolist(), None, [None] * int(heads.sum()), [None] * int(heads.sum()))
                for side, on in (("top", row == 0), ("bottom", row == h - 1)):
                    put(label[on].tolist(), [0] * int(on.sum()), side, start[on].tolist(), (end[on] - 1).tolist())
                for side, on in (("left", start == 0), ("right", end == w)):
                    put(label[on].tolist(), [0] * int(on.sum()), side, row[on].tolist(), row[on].tolist())
            types = [batch.schema.field("frame").type, *[pa.int64()] * 4, pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    from ..sources.scratch import staged

    parts = staged(rows.mapInArrow(local, f"frame {kind}, ty long, tx long, label long, area long, w int, side string, lo int, hi int"), "regions")
    sizes = rows.select("frame", "ty", "tx", "h", "w")
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    seam = lambda side: named(parts.where(F.col("side") == side), side)
    pair = lambda a, b: F.struct(F.col(f"{a}_frame").alias("frame"), *[F.col(f"{s}_{c}").alias(f"{n}_{c}") for n, s in (("u", a), ("v", b)) for c in ("ty", "tx", "label")])
    near = lambda a, b: (F.col(f"{a}_lo") <= F.col(f"{b}_hi") + reach) & (F.col(f"{b}_lo") <= F.col(f"{a}_hi") + reach)
    same_frame = lambda a, b: F.col(f"{a}_frame").eqNullSafe(F.col(f"{b}_frame"))
    below = seam("bottom").join(seam("top"), same_frame("bottom", "top") & (F.col("top_ty") == F.col("bottom_ty") + 1) & (F.col("top_tx") == F.col("bottom_tx")) & near("bottom", "top")).select(pair("bottom", "top").alias("e"))
    beside = seam("right").join(seam("left"), same_frame("right", "left") & (F.col("left_tx") == F.col("right_tx") + 1) & (F.col("left_ty") == F.col("right_ty")) & near("right", "left")).select(pair("right", "left").alias("e"))
    edges = below.unionByName(beside)
    if corners:  # tiles that share a corner alone
        across = lambda step, ends: seam("bottom").join(seam("top"), same_frame("bottom", "top") & (F.col("top_ty") == F.col("bottom_ty") + 1) & (F.col("top_tx") == F.col("bottom_tx") + step) & F.expr(ends)).select(pair("bottom", "top").alias("e"))
        edges = edges.unionByName(across(1, "bottom_hi = bottom_w - 1 AND top_lo = 0")).unionByName(across(-1, "bottom_lo = 0 AND top_hi = top_w - 1"))
    edges = edges.select("e.*").distinct()
    areas = parts.where("side IS NULL").select("frame", "ty", "tx", "label", "area")
    total = sizes.groupBy("frame").agg(F.sum(F.col("h").cast("long") * F.col("w")).alias("total"))
    end = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("ty", "tx", "label")])
    at_seam = edges.select("frame", F.explode(F.array(end("u"), end("v"))).alias("x")).select("frame", "x.*").distinct()

    def stitch(table):
        """Regions on seams of one frame with the area of their whole region."""
        import numpy as np
        import pyarrow as pa

        nodes = {}
        of = lambda *k: nodes.setdefault(k, len(nodes))
        rows = table.to_pylist()
        own = {of(r["ty"], r["tx"], r["label"]): r["area"] for r in rows if r["area"] is not None}
        pairs = [(of(r["ty"], r["tx"], r["label"]), of(r["v_ty"], r["v_tx"], r["v_label"])) for r in rows if r["area"] is None]
        root = joined(len(nodes), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
        whole = np.bincount(root, weights=[own[i] for i in range(len(nodes))], minlength=len(nodes)).astype(np.int64)[root]
        keys = list(nodes)
        return pa.table([pa.array([rows[0]["frame"]] * len(keys), table.schema.field("frame").type), *[pa.array([k[j] for k in keys], pa.int64()) for j in range(3)], pa.array(whole)], ["frame", "ty", "tx", "label", "whole"])

    nulls = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    match = lambda a, b: a["frame"].eqNullSafe(b["frame"]) & (a["ty"] == b["ty"]) & (a["tx"] == b["tx"]) & (a["label"] == b["label"])
    seam_areas = areas.join(at_seam, match(areas, at_seam), "left_semi").select("frame", "ty", "tx", "label", "area", *nulls("v_ty", "v_tx", "v_label"))
    seam_pairs = edges.select("frame", F.col("u_ty").alias("ty"), F.col("u_tx").alias("tx"), F.col("u_label").alias("label"), *nulls("area"), "v_ty", "v_tx", "v_label")
    stitched = seam_areas.unionByName(seam_pairs).groupBy("frame").applyInArrow(stitch, f"frame {kind}, ty long, tx long, label long, whole long")
    stitched = named(stitched, "s")
    every = areas.join(stitched, areas["frame"].eqNullSafe(stitched["s_frame"]) & (areas["ty"] == stitched["s_ty"]) & (areas["tx"] == stitched["s_tx"]) & (areas["label"] == stitched["s_label"]), "left")
    totals = named(total, "t")
    large = every.join(totals, every["frame"].eqNullSafe(totals["t_frame"])).where(F.coalesce("s_whole", "area") >= (F.lit(least) if least is not None else F.col("t_total") * share))
    large = named(large.groupBy("frame", "ty", "tx").agg(F.collect_list("label").alias("labels")), "l")  # of one tile

    def paint(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made, offsets, missing = [], [0], []
            for i in range(batch.num_rows):
                mask, labels = mask_of(batch, i), batch.column("labels")[i]
                missing.append(not batch.column("px")[i].is_valid)
                if mask.size and labels.is_valid:
                    on = mask == debris
                    row, start, end, label, _ = labelled(on, corners)
                    mask = _painted(mask, on, (row, start, end), np.isin(label, labels.values.to_numpy()), debris, clump)
                made.append(mask.ravel().astype(np.int32))
                offsets.append(offsets[-1] + mask.size)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)), mask=pa.array(missing, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("frame", "ty", "tx", "h", "w")], lists], ["frame", "ty", "tx", "h", "w", "px"])

    both = rows.join(large, rows["frame"].eqNullSafe(large["l_frame"]) & (rows["ty"] == large["l_ty"]) & (rows["tx"] == large["l_tx"]), "left").select("frame", "ty", "tx", "h", "w", "px", F.col("l_labels").alias("labels"))
    out = both.mapInArrow(paint, f"frame {kind}, ty long, tx long, h int, w int, px array<int>")
    return out.select(F.col("frame").alias(frame), F.col("ty").alias(ty), F.col("tx").alias(tx), F.col("h").alias(height), F.col("w").alias(width), F.col("px").alias(px))
