"""Exact deduplication with a cuckoo-filter index over content digests.

Texts are equal when they are identical after deleting blanks and the control characters 9 to 13. The index is a table
of buckets by digest; a bucket keeps a cuckoo filter and, under it, its live digests with the row that stays and the
number of rows. A filter miss proves a digest new; a hit is verified against the stored digests. A filter that
overflows is rebuilt at twice the size from the stored digests, and an index whose buckets have grown past
``BUCKET_DIGESTS`` twofold is laid out anew with more buckets. Entries can be inserted, deleted and looked up in
batches: buckets that a batch does not touch keep their rows.

Defined results: a null text counts as empty, and all empty texts are equal; of equal texts the row with the most code
points stays, then the smallest id (a null id comes last); rows that repeat one id share its fate; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, staged, table, text_of

#: Digests that one bucket of the index holds, about.
BUCKET_DIGESTS = 20_000
#: A digest is pre-aggregated in so many groups, and so a bucket meets no digest more often, however many rows share it.
SALTS = 8
#: Entries of a filter's slot; moves tried before a filter counts as full.
SLOT, KICKS = 4, 200
WHITE = "[\\u0020\\u0009-\\u000D]"
BEST = "struct<shorter:int,no_id:boolean,doc_id:long>"
INDEX = f"bucket int, slots long, table binary, digests array<binary>, best array<{BEST}>, sizes array<long>"


class CuckooFilter:
    """A cuckoo filter over 32-byte digests: 16-bit fingerprints, two candidate slots of four entries each."""

    def __init__(self, expected: int = 0, slots: int | None = None, cells=None):
        want = max(2, -(-expected * 10 // (9 * SLOT)))
        self.slots = slots or 1 << (want - 1).bit_length()
        self.cells = list(cells) if cells is not None else [0] * (self.slots * SLOT)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & (self.slots - 1)
        return mark, one, self._other(one, mark)

    def _other(self, slot: int, mark: int) -> int:
        return slot ^ (mark * 0x5BD1E995 & (self.slots - 1))

    def _put(self, slot: int, mark: int) -> bool:
        for i in range(slot * SLOT, slot * SLOT + SLOT):
            if not self.cells[i]:
                self.cells[i] = mark
                return True
        return False

    def may_hold(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        return mark in self.cells[one * SLOT : one * SLOT + SLOT] or mark in self.cells[two * SLOT : two * SLOT + SLOT]

    def insert(self, digest: bytes) -> bool:
        """False when the filter is full; then it must be rebuilt from the stored digests."""
        mark, one, two = self._places(digest)
        if self._put(one, mark) or self._put(two, mark):
            return True
        slot = two
        for step in range(KICKS):
            at = slot * SLOT + step % SLOT
            mark, self.cells[at] = self.cells[at], mark
            slot = self._other(slot, mark)
            if self._put(slot, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for a digest that was inserted."""
        mark, one, two = self._places(digest)
        for slot in (one, two):
            for i in range(slot * SLOT, slot * SLOT + SLOT):
                if self.cells[i] == mark:
                    self.cells[i] = 0
                    return True
        return False


class Bucket:
    """One bucket of the index: a filter and the digests stored under it."""

    def __init__(self, expected: int = 0, stored=()):
        self.stored: dict[bytes, int] = {}
        self.filter = CuckooFilter(expected)
        for digest in stored:
            self.add(bytes(digest), 0)

    def find(self, digest: bytes) -> int | None:
        """What is stored with a digest. The filter answers for new ones; hits are verified."""
        return self.stored.get(digest) if self.filter.may_hold(digest) else None

    def add(self, digest: bytes, value: int) -> None:
        self.stored[digest] = value
        if not self.filter.insert(digest):
            self._rebuild()

    def remove(self, digest: bytes) -> bool:
        if self.find(digest) is None:
            return False
        del self.stored[digest]
        return self.filter.delete(digest)

    def _rebuild(self) -> None:
        slots = self.filter.slots
        while True:
            slots *= 2
            self.filter = CuckooFilter(slots=slots)
            if all(self.filter.insert(x) for x in self.stored):
                return


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text and the digest of its normalised form."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).alias("points"), F.unhex(F.sha2(normalised(text_of()), 256)).alias("digest"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def rank(best: dict) -> tuple:
    """Of equal texts the row with the most code points stays, then the smallest id."""
    return best["shorter"], best["no_id"], best["doc_id"] if best["doc_id"] is not None else 0


def combined(rows: DataFrame) -> DataFrame:
    """(digest, best, group_size) of ``rows`` (doc_id, points, digest), SALTS times at most for a digest, however many rows share it."""
    best = F.min(F.struct((-F.col("points")).alias("shorter"), F.isnull("doc_id").alias("no_id"), F.col("doc_id"))).alias("best")
    return rows.groupBy("digest", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt")).agg(best, F.count(F.lit(1)).alias("group_size")).drop("salt")


class Entries:
    """A bucket of the index being changed: a filter hit is verified in ``bucket.stored``, whose values are places in the lists."""

    def __init__(self, digests=(), best=(), sizes=(), expected: int = 0):
        self.best, self.sizes = list(best), list(sizes)
        self.bucket = Bucket(max(expected, len(self.best)))
        for at, digest in enumerate(digests):
            self.bucket.add(bytes(digest), at)

    def insert(self, digest: bytes, best: dict, n: int) -> None:
        at = self.bucket.find(digest)
        if at is None:
            self.bucket.add(digest, len(self.best))
            self.best.append(best)
            self.sizes.append(n)
        else:
            self.best[at] = min(self.best[at], best, key=rank)
            self.sizes[at] += n

    def row(self, number: int):
        import numpy as np
        import pandas as pd

        live, table = self.bucket.stored, np.array(self.bucket.filter.cells, np.uint16).tobytes()
        return pd.DataFrame({"bucket": [number], "slots": [self.bucket.filter.slots], "table": [table], "digests": [list(live)], "best": [[self.best[i] for i in live.values()]], "sizes": [[self.sizes[i] for i in live.values()]]})


def build_index(entries: DataFrame, buckets: int) -> DataFrame:
    """The index of ``entries`` (digest, best, group_size), a row per bucket; a digest that comes again is found by the filter. ``buckets`` bounds what a row holds: choose it by ``buckets_for``."""

    def run(pdf):
        made = Entries(expected=len(pdf))
        for digest, best, n in zip(pdf["digest"], pdf["best"], pdf["group_size"], strict=True):
            made.insert(bytes(digest), best, n)
        return made.row(pdf["bucket"].iloc[0])

    return entries.select("digest", "best", "group_size", _bucket(buckets)).groupBy("bucket").applyInPandas(run, INDEX)


def entries_of(index: DataFrame) -> DataFrame:
    """(digest, best, group_size) of all live digests."""
    each = F.explode(F.arrays_zip("digests", "best", "sizes")).alias("x")
    return index.select(each).select(F.col("x.digests").alias("digest"), F.col("x.best").alias("best"), F.col("x.sizes").alias("group_size"))


def update_index(index: DataFrame, changes: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """(``index`` after ``changes``, number of buckets): ``changes`` (digest, best, group_size, live) insert where ``live`` is true and delete a digest where it is false.

    Of several changes to one digest deletions come first. When the buckets have grown past twice what they should hold,
    the index is laid out anew from its stored digests.
    """

    def run(key, left, right):
        old = left.iloc[0] if len(left) else None
        made = Entries(*(old[c] for c in ("digests", "best", "sizes")), expected=len(old["sizes"]) + len(right)) if old is not None else Entries(expected=len(right))
        for digest, best, n, live in sorted(zip(right["digest"], right["best"], right["group_size"], right["live"], strict=True), key=lambda x: bool(x[3])):
            if live:
                made.insert(bytes(digest), best, int(n))
            else:
                made.bucket.remove(bytes(digest))
        return made.row(key[0])

    keyed = changes.select("digest", "best", "group_size", "live", _bucket(buckets))
    out = staged(index.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInPandas(run, INDEX), "index")
    total = out.agg(F.sum(F.size("digests"))).first()[0] or 0
    if total <= 2 * BUCKET_DIGESTS * buckets:
        return out, buckets
    buckets = buckets_for(total, BUCKET_DIGESTS)
    return staged(build_index(entries_of(out), buckets), "index"), buckets


def probe_index(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """The distinct digests of ``batch`` with ``known``: whether the index holds them."""

    def run(key, left, right):
        import numpy as np

        out = right[["digest"]].copy()
        if not len(left):
            return out.assign(known=False)
        row = left.iloc[0]
        cells = CuckooFilter(slots=int(row["slots"]), cells=np.frombuffer(row["table"], np.uint16).tolist())
        stored = {bytes(x) for x in row["digests"]}
        out["known"] = [cells.may_hold(bytes(d)) and bytes(d) in stored for d in out["digest"]]
        return out

    keyed = batch.select("digest").distinct().select("digest", _bucket(buckets))
    return index.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInPandas(run, "digest binary, known boolean")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the row of its group that stays."""
    rows = staged(digests(docs), "digests")
    buckets = buckets_for(rows.count(), BUCKET_DIGESTS, least=64)
    index = staged(build_index(combined(rows), buckets), "index")
    many = entries_of(index).where("group_size > 1").select("digest", F.col("best.doc_id").alias("best_id"), "group_size")
    # a digest that many rows share is a skewed key of this join; adaptive execution splits it
    joined = rows.join(many, "digest", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("best_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that equal another: the whole rows of those that stay, one of each group."""
    made = staged(deduplicated(docs).select("doc_id", "kept", "text_sha256", "group_size"), "dedup")
    key = F.sha2(normalised(text_of()), 256)

    def on(right: DataFrame, left: DataFrame, how: str) -> DataFrame:
        right = right.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
        return left.join(right, left["doc_id"].eqNullSafe(right["__id"]) & (key == right["__sha"]), how)

    kept = on(made.where("NOT kept"), docs, "left_anti")
    repeated = staged(made.where("kept AND group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    # rows that repeat id and text: partial maxima are made before the shuffle
    several = on(repeated, kept, "left_semi").groupBy("doc_id", key.alias("__sha")).agg(F.max_by(F.struct(*(docs[c] for c in docs.columns)), F.length(text_of())).alias("row"))
    return on(repeated, kept, "left_anti").unionByName(several.select("row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
