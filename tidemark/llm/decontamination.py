"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` k-grams, as many as ``SPAN`` words hold, the least hash is chosen, of equal ones the last, and
kept once as a fingerprint with its place, on the benchmark's side and on the documents' side: about two in ten k-grams.
Equal spans of ``SPAN`` words choose the same k-gram at the same place in them, so none is missed. Fingerprints that meet
are extended word by word on both sides, as far as a span that holds the k-gram can reach; those that come to ``SPAN``
words are hits, and hits that overlap make one span. Items shorter than that are found by the hash of their first
words, at every place, and extended to their end.

Which documents' fingerprints the benchmark may have is told by a bit map, at most ``MAP_BITS`` bits however large the
benchmark; where it lets others through, the join drops them. Everything else is joins: equal surroundings of a
fingerprint are one row, and the benchmark's rows are sent to the tasks if they are measured as small, else shuffled,
dealt by salt.

Defined results: null texts have no words; an item shorter than a window counts where all its words occur in a row; an
item without words occurs nowhere; items with equal texts are reported each; an item without an id counts for hit words
only; rows that repeat a document id are judged on their own; empty tables give no rows or no hits; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_hash, staged, table, text_of

#: Words of a window, of a fingerprint's k-gram, and k-grams that one fingerprint is the least of.
SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
#: Bits of the map of fingerprints, at least and at most, and for each fingerprint between the two.
LEAST_BITS, MAP_BITS, BITS_EACH = 1 << 16, 1 << 26, 32
#: Rows of the benchmark's windows that are sent to every task; more are joined by a shuffle, each dealt ``SALTS`` times.
SENT_ROWS, SALTS = 200_000, 8
#: Words on each side of a k-gram that a span which holds it can reach.
REACH = SPAN - GRAM
WINDOWS = "item_id string, n int, fp long, beside array<long>"
LOOKED = "doc_id long, row_hash long, n_words long, at array<int>, n array<int>, fp array<long>, beside array<array<long>>"


def word_table():
    """Byte map: A-Z to lower case, other characters outside words to 0."""
    import numpy as np

    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    for a, b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        out[a : b + 1] = 0
    return out


class WordHasher:
    """Words of texts laid end to end: where they are, whose they are, and their hashes."""

    def __init__(self):
        from .tokens import BASES, PrefixHash

        self.prefix, self.map = PrefixHash(BASES[0]), word_table()

    def __call__(self, raw, offsets):
        import numpy as np

        from .tokens import mixed

        low = self.map[raw]
        inside = np.concatenate([[False], low > 0, [False]])
        begins = np.zeros(len(raw) + 1, bool)
        begins[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
        text = np.searchsorted(offsets, starts, side="right") - 1
        return low, starts, ends, text, mixed(self.prefix.spans(self.prefix.sums(low), starts, ends))


def gram_hashes(words, k: int):
    """Hash of the k words from each position on."""
    import numpy as np

    from .tokens import BASES, mixed, powers

    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(powers(BASES[1], k)):
        out += words[j : j + n] * c
    return mixed(out)


def winnowed(hashes, text):
    """Places of the k-grams that some window of WINDOW of them in one text chooses: the least hash, of equal ones the last."""
    import numpy as np

    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least, place = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW):
        now = hashes[j : j + n]
        lower = now <= least
        np.copyto(least, now, where=lower)
        place[lower] = j
    one = text[:n] == text[SPAN - 1 :][:n]
    return np.unique((np.arange(n) + place)[one])


def found_at(words, text, n: int):
    """(places of k-grams, fingerprints) by which windows of ``n`` words are found: chosen ones, or for short windows each first k-gram."""
    import numpy as np

    from .tokens import mixed

    if n == SPAN:
        hashes = gram_hashes(words, GRAM)
        at = winnowed(hashes, text)
    else:
        hashes = gram_hashes(words, min(n, GRAM))
        m = max(0, len(words) - n + 1)
        at = np.flatnonzero(text[:m] == text[n - 1 :][:m])
    return at, mixed(hashes[at] + np.uint64(n))


def surroundings(words, text, at, n: int, none: int):
    """Rows of 2 * REACH word hashes: those before a k-gram, the nearest first, then those after it; ``none`` beyond the text's ends."""
    import numpy as np

    step = np.arange(1, REACH + 1)
    place = at[:, None] + np.concatenate([-step, min(n, GRAM) - 1 + step])[None]
    held = np.clip(place, 0, max(0, len(words) - 1))
    inside = (place >= 0) & (place < len(words)) & (text[held] == text[at][:, None])
    return np.where(inside, np.maximum(words[held], np.uint64(2)), np.uint64(none)).view(np.int64)


def _item_windows(batches):
    """Rows WINDOWS of items (item_id, text)."""
    import numpy as np
    import pyarrow as pa

    from .common import string_parts, text_slices

    hasher = WordHasher()
    for batch in (part for whole in batches for part in text_slices(whole, 1)):
        _, _, _, text, words = hasher(*string_parts(batch.column(1)))
        counts = np.bincount(text, minlength=batch.num_rows)
        first = np.cumsum(counts) - counts
        for n in np.unique(np.minimum(counts, SPAN)):
            if n:
                at, fp = found_at(words, text, int(n))
                if n < SPAN:  # an item's own first k-gram
                    mine = np.isin(at, first[counts == n])
                    at, fp = at[mine], fp[mine]
                beside = surroundings(words, text, at, int(n), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, beside.size + 1, 2 * REACH, dtype=np.int32)), pa.array(beside.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(fp.view(np.int64)), lists], ["item_id", "n", "fp", "beside"])


def _look(shared):
    """Rows LOOKED of documents (doc_id, row_hash, text): candidate windows of each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import string_parts, text_slices

        lengths, bits = shared.value
        bits = np.frombuffer(bits, np.uint64)
        hasher, mask = WordHasher(), np.uint64(64 * len(bits) - 1)
        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            _, _, _, text, words = hasher(*string_parts(batch.column(2)))
            counts = np.bincount(text, minlength=batch.num_rows)
            first = np.cumsum(counts) - counts
            made = []
            for n in lengths:
                at, fp = found_at(words, text, n)
                slot = fp & mask
                may = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                at, fp = at[may], fp[may]
                made.append((at, np.full(len(at), n, np.int32), fp, surroundings(words, text, at, n, 0)))
            at = np.concatenate([np.zeros(0, np.int64), *(m[0] for m in made)])
            order = np.argsort(at, kind="stable")
            joint = lambda k, empty: np.concatenate([empty, *(m[k] for m in made)])[order]  # noqa: B023, E731
            n, fp, beside = joint(1, np.zeros(0, np.int32)), joint(2, np.zeros(0, np.uint64)), joint(3, np.zeros((0, 2 * REACH), np.int64))
            at = at[order]
            of = text[at] if len(at) else at
            ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=batch.num_rows))).astype(np.int32))
            sides = pa.ListArray.from_arrays(pa.array(np.arange(0, beside.size + 1, 2 * REACH, dtype=np.int32)), pa.array(beside.ravel()))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array((at - first[of]).astype(np.int32)), pa.array(n), pa.array(fp.view(np.int64)), sides)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)), *lists], ["doc_id", "row_hash", "n_words", "at", "n", "fp", "beside"])

    return run


def fingerprint_map(windows: DataFrame) -> bytes:
    """A bit map of the fingerprints of ``windows``: bit ``fp mod size`` is set. At most MAP_BITS bits reach the driver."""
    import numpy as np

    size = LEAST_BITS
    while size < min(MAP_BITS, BITS_EACH * windows.count()):
        size *= 2
    bit = F.col("fp").bitwiseAND(size - 1)
    words = windows.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(fp & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def met(left: DataFrame, windows: DataFrame, rows: int, on: list[str]) -> DataFrame:
    """``left`` joined to ``windows`` (``rows`` of them); a fingerprint that very many rows of ``left`` hold is dealt by salt of the document."""
    if rows <= SENT_ROWS:
        return left.join(F.broadcast(windows), on)
    salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def extended(near: DataFrame) -> DataFrame:
    """Spans (start, end) of the rows of ``near`` (at, n, mine, beside) whose words agree far enough on both sides of the k-gram."""
    same = F.zip_with("mine", "beside", lambda a, b: a == b)

    def run(first: int):
        """How many words from the k-gram on agree."""
        breaks = F.array_position(F.slice(same, first, REACH), F.lit(False))
        return F.when(breaks == 0, REACH).otherwise(breaks - 1)

    gram = F.least("n", F.lit(GRAM))
    before = F.when(F.col("n") == SPAN, run(1)).otherwise(0)
    after = F.least(run(REACH + 1), F.col("n") - gram + F.when(F.col("n") == SPAN, REACH).otherwise(0))
    made = near.withColumns({"before": before, "after": after})
    long_enough = F.col("before") + gram + F.col("after") >= F.col("n")
    return made.where(long_enough).withColumns({"start": (F.col("at") - F.col("before")).cast("long"), "end": (F.col("at") + gram + F.col("after")).cast("long")})


def benchmark_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its words, the merged word spans that ``items`` (item_id, text) hit, and those items."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(), text_of().alias("text"))
    bench = items.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = staged(bench.mapInArrow(_item_windows, WINDOWS).distinct(), "windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # SPAN of them at most
    bits = fingerprint_map(windows)
    looked = staged(rows.mapInArrow(_look(spark.sparkContext.broadcast((lengths, bits))), LOOKED), "looked")
    doc = ["doc_id", "row_hash"]
    each = F.explode(F.arrays_zip("at", "fp", "beside")).alias("x")
    near = looked.where(F.size("at") > 0).select(*doc, each).select(*doc, F.col("x.at").cast("long").alias("at"), "x.fp", F.col("x.beside").alias("mine"))
    known = staged(windows.select("n", "fp", "beside").distinct(), "known")
    rows = known.count()
    hits = staged(extended(met(near, known, rows, ["fp"])).select(*doc, "start", "end", "fp", "beside").distinct(), "hits")
    # spans: a window that starts beyond the ends of all before it opens a new one
    by_start = Window.partitionBy(*doc).orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select(*doc, "start", "end", F.coalesce((F.col("start") > reached).cast("int"), F.lit(0)).alias("opens"))
    islands = opened.withColumn("island", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy(*doc, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = islands.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = windows.where("item_id IS NOT NULL").select("fp", "beside", "item_id")
    found = met(hits.select(*doc, "fp", "beside").distinct(), named, windows.count(), ["fp", "beside"]).select(*doc, "item_id").distinct()
    found = found.groupBy(*doc).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    both = spans.join(found, (spans["doc_id"].eqNullSafe(found["doc_id"])) & (spans["row_hash"] == found["row_hash"]), "left").select(spans["doc_id"].alias("__id"), spans["row_hash"].alias("__hash"), "spans", "items")
    made = looked.join(both, looked["doc_id"].eqNullSafe(both["__id"]) & (looked["row_hash"] == both["__hash"]), "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return made.select("doc_id", "row_hash", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs``: words, hit words, items that occur, and whether one word in twenty or more is hit."""
    found = benchmark_hits(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.select("doc_id", "row_hash", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), span AS (
  SELECT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), hit AS (
  SELECT DISTINCT d.doc_id, d.p, d.n, s.item_id
  FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, (SELECT DISTINCT n FROM span) WHERE len(w) >= n)) d
  JOIN span s ON s.n = d.n AND s.g = d.g
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
