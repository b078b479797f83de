"""Class masks in PNG files, read whole in the task that holds the file: chunks, inflation and row filters.

Grey and palette images are masks: grey of 8 bits as it is, of 16 bits its lower byte, of 2 and 4 bits spread over 0 to 255,
of 1 bit as 0 and 1; of a palette the index. Colour and alpha channels are none, and fail the query as broken files do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file's first bytes; first column and row and steps of the seven passes of an interlaced image.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
GREY, PALETTE = 0, 3


def chunks(data: bytes):
    """(type, body) of each chunk, its checksum compared."""
    import struct
    import zlib

    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG file")
    at = len(SIGNATURE)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a PNG file ends within a chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a chunk of a PNG file is broken")
        yield kind, body
        at += 12 + n


def unfiltered(raw: bytes, row_bytes: int, rows: int, step: int):
    """Rows of bytes (rows, row_bytes) behind their filters; ``step`` is the distance to the byte on the left."""
    import numpy as np

    lines = np.frombuffer(raw, np.uint8)
    if len(lines) < rows * (row_bytes + 1):
        raise ValueError("a PNG file holds too few pixels")
    lines = lines[: rows * (row_bytes + 1)].reshape(rows, row_bytes + 1)
    out = np.zeros((rows, row_bytes), np.uint8)
    above = np.zeros(row_bytes, np.uint8)
    for y in range(rows):
        how, line = int(lines[y, 0]), lines[y, 1:]
        if how == 0:
            now = line
        elif how == 1:  # the left neighbour: running sums of every step-th byte
            now = np.empty_like(line)
            for k in range(step):
                now[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif how == 2:
            now = line + above
        elif how in (3, 4):
            up, made = above.tolist(), line.tolist()
            for x, v in enumerate(made):
                left, b = made[x - step] if x >= step else 0, up[x]
                if how == 3:
                    guess = (left + b) >> 1
                else:  # of left, above and their corner the nearest to left + above - corner
                    c = up[x - step] if x >= step else 0
                    p, q, r = abs(b - c), abs(left - c), abs(left + b - 2 * c)
                    guess = left if p <= q and p <= r else b if q <= r else c
                made[x] = (v + guess) & 255
            now = np.array(made, np.uint8)
        else:
            raise ValueError(f"a PNG file has a row filter {how}")
        out[y] = above = now
    return out


def mask(data: bytes):
    """Pixels (height, width) of a PNG file of one channel."""
    import struct
    import zlib

    import numpy as np

    head, body, ended = None, [], False
    for kind, part in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = ended or kind == b"IEND"
    if head is None or not ended:
        raise ValueError("a PNG file has no header or no end")
    width, height, depth, colour, _, _, laced = head
    if colour not in (GREY, PALETTE):
        raise ValueError("a mask must have one channel")
    raw = zlib.decompress(b"".join(body))

    def pixels(w: int, h: int, raw: bytes):
        row = -(-w * depth // 8)
        lines = unfiltered(raw, row, h, max(1, depth // 8))
        if depth == 16:
            return lines[:, 1::2]  # the lower byte
        if depth == 8:
            return lines
        bits = np.unpackbits(lines, axis=1)[:, : w * depth].reshape(h, w, depth)
        return (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)

    if not laced:
        out = pixels(width, height, raw)
    else:
        out, at = np.zeros((height, width), np.uint8), 0
        for x, y, dx, dy in PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                n = h * (-(-w * depth // 8) + 1)
                out[y::dy, x::dx] = pixels(w, h, raw[at : at + n])
                at += n
    return out * (255 // ((1 << depth) - 1)) if colour == GREY and depth in (2, 4) else out


def size(data: bytes) -> tuple[int, int]:
    """(width, height) that the header of a PNG or JPEG file gives."""
    import struct

    if data.startswith(SIGNATURE):
        return struct.unpack_from(">II", data, 16)
    if not data.startswith(b"\xff\xd8"):
        raise ValueError("neither a PNG nor a JPEG file")
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            raise ValueError("a JPEG file is broken")
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        else:
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    raise ValueError("a JPEG file has no size")


def files(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def masks(found: DataFrame) -> DataFrame:
    """(path, height, width, px: classes by rows) of files (path, content)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                m = mask(batch.column("content")[i].as_py())
                px = pa.ListArray.from_arrays(pa.array([0, m.size], pa.int32()), pa.array(m.ravel().astype("int32")))
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(i, 1), pa.array([m.shape[0]], pa.int32()), pa.array([m.shape[1]], pa.int32()), px], ["path", "height", "width", "px"])

    return found.select("path", "content").mapInArrow(run, "path string, height int, width int, px array<int>")


def sizes(found: DataFrame) -> DataFrame:
    """(path, width, height) of image files (path, content) by their headers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [size(c.as_py()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([m[k] for m in made], pa.int32()) for k in (0, 1)]], ["path", "width", "height"])

    return found.select("path", "content").mapInArrow(run, "path string, width int, height int")


def size_findings(meta: DataFrame, masks_: DataFrame, images: DataFrame) -> DataFrame:
    """(scope, level, message) for every sample of ``meta`` (sample_id, image, mask, width, height) whose mask differs in size from its image or from what ``meta`` says.

    ``masks_`` and ``images`` have path, width and height; samples without either file are another finding's.
    """
    m = masks_.select(F.col("path").alias("__m"), F.col("width").alias("mw"), F.col("height").alias("mh"))
    i = images.select(F.col("path").alias("__i"), F.col("width").alias("iw"), F.col("height").alias("ih"))
    joined = meta.join(m, meta["mask"] == m["__m"]).join(i, meta["image"] == i["__i"])
    text = lambda w, h: F.concat(F.coalesce(F.col(w).cast("string"), F.lit("-")), F.lit("x"), F.coalesce(F.col(h).cast("string"), F.lit("-")))
    differs = lambda w, h, what: F.when(~(F.col("mw").eqNullSafe(F.col(w)) & F.col("mh").eqNullSafe(F.col(h))), F.concat(F.lit("mask is "), text("mw", "mh"), F.lit(f", {what} "), text(w, h)))
    said = F.filter(F.array(differs("iw", "ih", "image is"), differs("width", "height", "metadata says")), lambda x: x.isNotNull())
    return joined.select(F.col("sample_id").alias("scope"), F.lit("error").alias("level"), F.explode(said).alias("message"))
