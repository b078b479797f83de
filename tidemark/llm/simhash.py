"""Near duplicates by SimHash fingerprints, compared around the anchors of a covering code.

A fingerprint is cut into blocks. Two fingerprints that differ in at most four bits differ in at most one bit of one of
three blocks (22, 21 and 21 bits), and in at most two bits of one of two blocks of 32. In a block, the anchors are the
words whose first 15 (or 31) bits are a codeword of the perfect Hamming code; every word lies within one bit of its home
anchor (the covering radius). A fingerprint goes to every anchor within radius plus threshold of its block, and so
meets, at the home of any partner, that partner. There the full fingerprints are compared. Texts with equal
fingerprints are one row throughout.

Three blocks make 45 rows of a fingerprint and 2**18 anchors a block, two make 346 and 2**27. The number of different
fingerprints decides: beyond ``THREE_UPTO`` there are so many at an anchor that comparing them costs more than the rows.

Defined results: null and empty texts have fingerprint zero, which links like any other; a text with fewer words than
a shingle is one shingle; component ids are the smallest ids reachable (null ids are never smallest); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_hash, staged, table, text_of
from .components import components

WORDS, SEED, BITS = 4, 42, 4
#: (lowest bit, bits) of each block, bits of the code, and bits in which partners may differ in one of the blocks.
THREE = (((0, 22), (22, 21), (43, 21)), 15, 1)
TWO = (((0, 32), (32, 32)), 31, 2)
THREE_UPTO = 1 << 28
#: Comparisons around an anchor that are made at once; beyond, clusters are grown one member at a time.
AT_ONCE = 20_000
#: Rows of an anchor that one task takes; a fuller anchor's homes are dealt over more tasks, each with all its guests.
ANCHOR_ROWS = 500_000


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the hashes of all word shingles of a text whose A-Z are already lower case."""
    from itertools import accumulate

    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    parts = text.split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[: len(parts) - words]]
    ends = ends[words - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):  # a very long text a part at a time
        hashes = [xxh(joined[a : b - 1], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
        ones += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa

    from .common import text_slices

    for batch in (part for whole in batches for part in text_slices(whole, 2)):
        made = np.fromiter((fingerprint(b.lower()) for b in batch.column(2).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], ["doc_id", "row_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), row_hash(), text_of().alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, row_hash long, fp long")


def layout(classes: int) -> tuple:
    """The blocks for so many different fingerprints."""
    return THREE if classes <= THREE_UPTO else TWO


def block_patterns(bits: int, coded: int, reach: int):
    """By syndrome of the first ``coded`` bits: (flips that lead to the anchors within ``reach`` + 1 bits, the flip that leads home)."""
    from itertools import combinations

    syndrome = [i + 1 if i < coded else 0 for i in range(bits)]  # column i of the parity check matrix is the number i + 1
    near: list[list[int]] = [[] for _ in range(coded + 1)]
    for k in range(reach + 2):
        for flips in combinations(range(bits), k):
            s = word = 0
            for i in flips:
                s ^= syndrome[i]
                word |= 1 << i
            near[s].append(word)
    home = [0, *(1 << i for i in range(coded))]
    return near, home


def _to_anchors(plan):
    """(anchor, fp) rows; the lowest bit of ``anchor`` says whether it is the fingerprint's home."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        blocks, coded, reach = plan
        plans = [(low, bits, *block_patterns(bits, coded, reach)) for low, bits in blocks]
        for whole in batches:
            for batch in (whole.slice(at, 5000) for at in range(0, whole.num_rows, 5000)):
                fps = batch.column(0).to_numpy().view(np.uint64)
                anchors, members = [], []
                for b, (low, bits, near, home) in enumerate(plans):
                    word = (fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)
                    syndrome = np.zeros(len(fps), np.int64)
                    for i in range(coded):
                        syndrome ^= ((word >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
                    for s in range(coded + 1):
                        here = np.flatnonzero(syndrome == s)
                        flips = np.array(near[s], np.uint64)
                        at = (word[here, None] ^ flips[None, :]) | np.uint64(b << 32)
                        anchors.append((at * np.uint64(2) + (flips == home[s]).astype(np.uint64)[None, :]).ravel())
                        members.append(np.repeat(fps[here], len(flips)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(members).view(np.int64))], ["anchor", "fp"])

    return run


def link_groups(group, home, fps, bits: int = BITS):
    """Pairs (i, j) of rows that join all linked rows of each group, where at least one of a linked pair is at home.

    ``group`` is sorted. In small groups these are all linked pairs; in large ones a spanning forest.
    """
    import numpy as np

    from .tokens import ragged

    n = len(group)
    edge = np.flatnonzero(np.diff(group)) + 1
    begin, end = np.append(0, edge), np.append(edge, n)
    homes = np.add.reduceat(home.astype(np.int64), begin) if n else np.zeros(0, np.int64)
    work = homes * (end - begin)
    out = []
    few = (work > 0) & (work <= AT_ONCE) & (end - begin > 1)
    rows = np.flatnonzero(home & np.repeat(few, end - begin))
    of = np.searchsorted(edge, rows, side="right")
    size = (end - begin)[of]
    for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(size) // 2_000_000)) + 1) if len(rows) else []:
        i, j = np.repeat(rows[at], size[at]), ragged(begin[of[at]], size[at])
        hit = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        hit &= (i < j) | ((i > j) & ~home[j])
        out.append((i[hit], j[hit]))
    for g in np.flatnonzero(work > AT_ONCE):
        out.extend(_grow(begin[g], home[begin[g] : end[g]], fps[begin[g] : end[g]], bits))
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (np.zeros(0, np.int64),) * 2


def _grow(base: int, home, fps, bits: int):
    """Clusters of one full anchor: each member reached looks only at what none has reached yet."""
    import numpy as np

    free, free_home = np.arange(len(fps)), np.flatnonzero(home)
    reached = np.zeros(len(fps), bool)
    for seed in np.flatnonzero(home):
        if reached[seed]:
            continue
        queue = [seed]
        reached[seed] = True
        free, free_home = free[~reached[free]], free_home[~reached[free_home]]
        while queue:
            i = queue.pop()
            pool = free if home[i] else free_home
            hit = pool[np.bitwise_count(fps[pool] ^ fps[i]) <= bits]
            if len(hit):
                yield np.full(len(hit), base + i), base + hit
                reached[hit] = True
                queue.extend(hit)
                free, free_home = free[~reached[free]], free_home[~reached[free_home]]


def _link(batches):
    import numpy as np
    import pyarrow as pa

    rest = np.zeros((0, 2), np.int64)

    def edges(rows):
        group, home, fps = rows[:, 0], (rows[:, 0] & 1).astype(bool), rows[:, 1].view(np.uint64)
        i, j = link_groups(group >> 1, home, np.ascontiguousarray(fps))
        return pa.RecordBatch.from_arrays([pa.array(rows[i, 1]), pa.array(rows[j, 1])], ["u", "v"])

    for batch in batches:
        rows = np.concatenate([rest, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)])
        last = np.searchsorted(rows[:, 0] >> 1, rows[-1, 0] >> 1) if len(rows) else 0
        rest = rows[last:]
        if last:
            yield edges(rows[:last])
    if len(rest):
        yield edges(rest)


def links(classes: DataFrame, anchor_rows: int = ANCHOR_ROWS, plan: tuple | None = None) -> DataFrame:
    """Edges (u, v) that join all fingerprints of ``classes`` (fp, distinct) at ``BITS`` or fewer differing bits."""
    n = classes.count()
    spread = classes.select("fp").mapInArrow(_to_anchors(plan or layout(n)), "anchor long, fp long")
    if n <= anchor_rows:  # no anchor holds a fingerprint twice
        return _linked(spread)
    full = spread.groupBy(F.shiftright("anchor", 1).alias("at")).count().where(F.col("count") > anchor_rows)
    full = staged(full.select("at", F.ceil(F.col("count") / anchor_rows).cast("long").alias("parts")), "anchors")
    if full.isEmpty():
        return _linked(spread.select("anchor", "fp"))
    # the homes of a full anchor are dealt over parts; every part sees all guests of the anchor, as guests
    keyed = spread.withColumn("at", F.shiftright("anchor", 1)).join(full, "at", "left")
    own = keyed.where("parts IS NULL").select("anchor", "fp")
    parts = keyed.where("parts IS NOT NULL")
    is_home, key = F.col("anchor").bitwiseAND(1) == 1, (F.col("at") + F.shiftleft(F.col("part"), 36)) * 2
    guests = parts.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts")))).select(key.alias("anchor"), "fp")
    homes = parts.where(is_home).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")) + 1).select((key + 1).alias("anchor"), "fp")
    return _linked(own.unionByName(guests).unionByName(homes))


def _linked(rows: DataFrame) -> DataFrame:
    laid = rows.repartition(F.shiftright("anchor", 1)).sortWithinPartitions("anchor")
    return laid.mapInArrow(_link, "u long, v long").where("u <> v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, fp, component (the least fingerprint reachable) and component_id of every row of ``docs`` (doc_id, text)."""
    rows = staged(fingerprints(docs), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "classes")
    joined = staged(components(links(classes)), "components")
    labelled = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("component"))
    least = joined.join(classes.withColumnRenamed("fp", "node"), "node").groupBy("component").agg(F.min("first_id").alias("least_id"))
    ids = labelled.join(least, "component", "left").select("fp", "component", F.coalesce("least_id", "first_id").alias("component_id"), ((F.col("n") > 1) | F.col("least_id").isNotNull()).alias("shared"))
    # a fingerprint that many rows share is a skewed key of this join; adaptive execution splits it
    out = rows.join(ids.where("shared").select("fp", "component", "component_id"), "fp", "left")
    return out.select("doc_id", "row_hash", "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))


def others_of_groups(found: DataFrame) -> DataFrame:
    """(doc_id, row_hash) of the rows of ``found`` that are not the one that stays of their group.

    That is the row with the group's smallest id, of several with that id the one with the smallest ``row_hash``. Groups
    whose ids are all null cannot be told apart by id and keep their rows.
    """
    heads = found.where("doc_id = component_id").groupBy(F.col("component").alias("__in"), F.col("doc_id").alias("__id")).agg(F.min("row_hash").alias("__stays"), F.max("row_hash").alias("__last")).where("__stays < __last")
    later = found.join(heads, (found["doc_id"] == heads["__id"]) & (found["component"] == heads["__in"])).where("doc_id = component_id AND row_hash <> __stays").select("doc_id", "row_hash")
    return found.where("NOT (doc_id <=> component_id)").select("doc_id", "row_hash").unionByName(later)


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
