"""Vector bin packing of examples into training sequences.

A piece has a size in three dimensions: tokens, segments and loss-bearing tokens. A sequence has a limit in each.
The dot-product heuristic fills one sequence at a time: of the pieces that fit, it takes the one whose size has the
largest weighted dot product with what is left of the sequence (weights: the inverse of each limit). Pieces of equal
size are one class, so a step looks at classes, not at pieces.

Defined results: null and empty texts hold the end id alone; an empty table gives no pieces; a document longer than
a sequence is cut into full sequences and a rest; an example over a limit by itself is cut too; rows that repeat a
document id are packed as documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, staged, table

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (1024, 256, 1024)
#: Pieces that are packed together; the last sequence of each group may stay partly empty.
GROUP_ROWS = 3000
PIECES = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def _pieces(path: str, most: int, end: int):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        from .common import string_parts, text_slices
        from .tokens import encoder_for, ragged, with_end

        encoder = encoder_for(path)
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, bounds = with_end(*encoder(*string_parts(part.column(1))), end)
                total = np.diff(bounds)
                n = -(-total // most)
                doc = np.repeat(np.arange(len(total)), n)
                start = ragged(np.zeros(len(n), np.int64), n) * most
                length = np.minimum(total[doc] - start, most)
                raw, lo = memoryview(ids.view("uint8")), bounds[doc] + start
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo, lo + length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(length), pa.array(sums, pa.int64()), pa.array(total[doc])],
                    ["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens"],
                )

    return run


def text_pieces(docs: DataFrame, tokenizer: str, most: int = LIMITS[0], end: int = 0) -> DataFrame:
    """Pieces of at most ``most`` ids of every document (doc_id, text); all their tokens bear loss."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, most, end), PIECES)


def fill(sizes, limits) -> list[list[int]]:
    """Sequences, as lists of row numbers, of pieces of the given sizes (n x 3), none over a limit."""
    import numpy as np

    sizes, limits = np.asarray(sizes, np.int64).reshape(-1, len(limits)), np.asarray(limits, np.int64)
    if not len(sizes):
        return []
    classes, of = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(of.ravel()))
    rows = [list(order[a:b][::-1]) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
    left = np.array([len(x) for x in rows])
    scaled = classes / limits**2.0
    out: list[list[int]] = []
    while len(classes):
        rest, now = limits.copy(), []
        while True:
            fits = (classes <= rest).all(axis=1) & (left > 0)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, scaled @ rest, -1.0)))
            now.append(int(rows[best].pop()))
            left[best] -= 1
            rest = rest - classes[best]
        if not now:
            raise ValueError("a piece is over a limit by itself")
        out.append(now)
        if not left.any():
            break
        if (left > 0).sum() < len(left) // 2:
            keep = left > 0
            classes, scaled, left, rows = classes[keep], scaled[keep], left[keep], [r for r, k in zip(rows, keep, strict=True) if k]
    return out


def pack(pieces: DataFrame, limits=LIMITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place every row of ``pieces`` (PIECES) in a sequence.

    Groups are drawn by a hash of the piece, so that none depends on one document or source, and hold about
    ``group_rows`` pieces at every size of the table.
    """
    pieces = staged(pieces, "pieces")
    groups = buckets_for(pieces.count(), group_rows)

    def run(rows):
        import numpy as np
        import pyarrow as pa

        # Arrow's own values all the way: ids stay whole numbers beside nulls
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length, loss = (rows.column(c).to_numpy() for c in ("length", "loss"))
        made = fill(np.stack([length, np.ones(len(length), np.int64), loss], axis=1), limits)
        order = np.concatenate([np.array(x) for x in made]) if made else np.zeros(0, np.int64)
        n = np.array([len(x) for x in made], np.int64)
        sequence = np.repeat(np.arange(len(made)), n)
        ends = np.cumsum(length[order])
        first = np.cumsum(n) - n
        base = np.repeat((ends - length[order])[first], n) if len(n) else ends
        out = rows.take(pa.array(order))
        bucket = out.column("bucket").to_numpy().astype(np.int64)
        out = out.drop_columns("bucket").append_column("sequence_id", pa.array(bucket * 2**32 + sequence))
        return out.append_column("offset", pa.array(ends - length[order] - base))

    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(run, PACKED)


def pack_examples(turns: DataFrame, tokenizer: str, limits=LIMITS, loss_role: str = "assistant") -> DataFrame:
    """Instruction data: conversations (conv_id, turn, role, text) become examples whose loss-bearing tokens are those of ``loss_role``.

    Each turn is one piece or more; pieces are packed under the limits on tokens, segments and loss-bearing tokens. A
    piece carries the hash of its turn (conv_id, turn, role, text) as doc_id; turns that are equal in all of these are
    packed each and share it. A null text is empty, a null role bears no loss, an empty table gives no pieces.
    """
    flagged = turns.select(F.xxhash64("conv_id", "turn", "role", "text").alias("doc_id"), F.col("text"), "role")
    made = text_pieces(flagged.select("doc_id", "text"), tokenizer, min(limits[0], limits[2]))
    roles = flagged.groupBy("doc_id").agg(F.max(F.coalesce(F.col("role") == loss_role, F.lit(False))).alias("bears"))
    made = made.join(roles, made["doc_id"].eqNullSafe(roles["doc_id"])).select(made["doc_id"], "start", "length", F.when(F.col("bears"), F.col("length")).otherwise(0).alias("loss"), "ids_crc32", "doc_tokens")
    return pack(made, limits)


def documents_packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(text_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))).drop("loss")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_packed(table(spark, sf_dir, "documents"))
