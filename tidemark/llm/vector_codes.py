"""Product codes of vectors by Lloyd rounds with Hamerly's bounds.

A vector of whole numbers is cut into parts; each part position has a codebook. A round assigns every part to the nearest
entry (squared Euclidean distance, ties to the lower index) and moves each entry to the floor of its parts' mean. Each
part keeps one upper bound of the distance to its entry and one lower bound of the distance to the second-nearest; only
where neither the bounds nor the own distance, measured anew, rule all other entries out strictly is the whole codebook
scanned, in whole numbers. Bounds are rounded outwards, so that they never decide a tie.

A round reads the state of the one before (numbers, indexes, bounds) and writes its own into the shared folder; the
first row of each batch holds the batch's sums by entry, so that the next entries come from one narrow column and no
part is shuffled. Codebooks, whose size is fixed, are all that goes through the driver.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped; rows that repeat an id
are vectors of their own and equal ids are ordered by their numbers, null ids last; fewer vectors than entries give
shorter codebooks; an empty table gives no rows; null labels are one label; other columns are ignored. A vector whose length is not
that of the others, or is no multiple of the parts, fails the query, and so does a component of 32768 or more in
absolute value, as distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, staged, table

#: Parts of a vector, entries of a codebook, rounds, and steps of a component's unit.
PARTS, ENTRIES, ROUNDS, STEPS = 8, 16, 6, 4096
#: Components at or beyond this are refused: 64 squared differences must fit 63 bits.
MOST = 1 << 15
#: Labels whose sums are sent to every task; more are joined by a shuffle.
SENT_LABELS = 100_000
#: Vectors that a task looks at together.
BLOCK = 4096


def whole(vectors: DataFrame, vec_id: str, vector: str, label: str, steps: int = STEPS) -> DataFrame:
    """(vec_id, label, x: array of whole numbers) of the vectors that are complete and finite."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    number = lambda v: F.when(F.abs(v) < MOST, F.floor(v.cast("double") * steps).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    return vectors.where(fine).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(x, number).alias("x"))


def first_books(rows: DataFrame, parts: int, entries: int) -> list[list[list[int]]]:
    """The codebooks of the rows with the smallest ids: by part, entry, component."""
    first = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    width = len(first[0]) // parts if first else 0
    return [[x[p * width : (p + 1) * width] for x in first] for p in range(parts)]


def _numbers(column, parts: int):
    """The rows' numbers as an array (rows, parts, components)."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.asarray(column.value_lengths())
    n = int(lengths[0]) if len(lengths) else 0
    if (lengths != n).any() or n % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return flat.reshape(len(lengths), parts, n // parts)


def _distances(x, book):
    """Squared distances (rows, entries), exact."""
    import numpy as np

    return np.stack([((x - e) ** 2).sum(axis=1) for e in book], axis=1)


def _up(v):
    import numpy as np

    return np.nextafter((v * (1 + 1e-14)).astype(np.float32), np.float32(np.inf))


def _down(v):
    import numpy as np

    return np.nextafter((v * (1 - 1e-14)).astype(np.float32), np.float32(-np.inf))


def assigned(x, book, now, upper, lower):
    """(indexes, upper, lower) of parts ``x`` (rows, components) in ``book``; ``now`` is None in the first round.

    A part keeps its index without a scan only if its upper bound lies strictly below its lower bound or half the way
    from its entry to the nearest other one.
    """
    import numpy as np

    if now is None:
        todo = np.arange(len(x))
        now, upper, lower = np.zeros(len(x), np.int8), np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
    else:
        between = _distances(book, book).astype(float)
        np.fill_diagonal(between, np.inf)
        half = _down(np.sqrt(between.min(axis=1)) / 2)
        now, upper, lower = now.copy(), upper.copy(), lower.copy()
        beyond = np.maximum(half[now], lower)
        open_ = np.flatnonzero(~(upper < beyond))
        upper[open_] = _up(np.sqrt(((x[open_] - book[now[open_]]) ** 2).sum(axis=1).astype(float)))
        todo = open_[~(upper[open_] < beyond[open_])]
    if len(todo):
        d = _distances(x[todo], book)
        best = d.argmin(axis=1)
        least = d[np.arange(len(todo)), best]
        now[todo], upper[todo] = best, _up(np.sqrt(least.astype(float)))
        if len(book) > 1:
            d[np.arange(len(todo)), best] = np.iinfo(np.int64).max
            lower[todo] = _down(np.sqrt(d.min(axis=1).astype(float)))
        else:
            lower[todo] = np.inf
    return now, upper, lower


def _moved(old, new):
    """(how far each entry went, how far any other entry went at most), rounded up."""
    import numpy as np

    went = _up(np.sqrt(((np.asarray(old) - np.asarray(new)) ** 2).sum(axis=1).astype(float)))
    others = np.array([np.delete(went, i).max(initial=0) for i in range(len(went))], np.float32)
    return went, others


def _round(books, before, parts: int):
    """A pass over rows: with the codebooks ``before`` the bounds of the last pass are moved along, without them all is scanned."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        new = [np.asarray(b, np.int64) for b in books]
        went = None if before is None else [_moved(o, n) for o, n in zip(before, new, strict=True)]
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(at, BLOCK)
                x = _numbers(batch.column("x"), parts)
                n, _, width = x.shape
                if went is not None:
                    held = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, parts) for c in ("code", "upper", "lower")]
                code, upper, lower = np.zeros((n, parts), np.int8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
                sums = np.zeros((parts, len(new[0]), width + 1), np.int64)
                for p in range(parts):
                    if went is None:
                        got = assigned(x[:, p], new[p], None, None, None)
                    else:
                        c, (own, other) = held[0][:, p], went[p]
                        got = assigned(x[:, p], new[p], c, _up(held[1][:, p].astype(float) + own[c]), _down(held[2][:, p].astype(float) - other[c]))
                    code[:, p], upper[:, p], lower[:, p] = got
                    np.add.at(sums[p, :, :width], code[:, p], x[:, p])
                    sums[p, :, width] = np.bincount(code[:, p], minlength=len(new[p]))
                lists = lambda a: pa.ListArray.from_arrays(np.arange(0, n * parts + 1, parts, dtype=np.int32), pa.array(a.ravel()))
                first = pa.array([sums.ravel().tolist(), *[None] * (n - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), lists(code), lists(upper), lists(lower), first], ["vec_id", "label", "x", "code", "upper", "lower", "sums"])

    return run


def next_books(state: DataFrame, books: list) -> list:
    """Entries moved to the floor of their parts' mean; unused ones stay. Reads one narrow column of the state."""
    sums = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    total = {r["at"]: r["n"] for r in sums.collect()}  # as many rows as the codebooks have numbers
    out, at = [], 0
    for book in books:
        made = []
        for entry in book:
            n = total[at + len(entry)]
            made.append([total[at + i] // n for i in range(len(entry))] if n else list(entry))
            at += len(entry) + 1
        out.append(made)
    return out


def _coded(books, parts: int):
    """The last pass's rows: code as hex digits, error."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        book = [np.asarray(b, np.int64) for b in books]
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(at, BLOCK)
                x = _numbers(batch.column("x"), parts)
                code = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts)
                error = sum(((x[:, p] - book[p][code[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                text = [bytes(c).hex() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def books_text(books: list) -> str:
    return ",".join(str(v) for book in books for entry in book for v in entry)


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """(rows vec_id, label, code, error; final codebooks by part, entry, component).

    ``code`` has two hex digits a part, a codebook 128 entries at most.
    """
    rows = whole(vectors, vec_id, vector, label)
    books = first_books(rows, parts, min(entries, 128))
    kinds = dict(rows.dtypes)
    keys = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    schema = f"{keys}, x array<int>, code array<tinyint>, upper array<float>, lower array<float>, sums array<bigint>"
    if not books[0]:
        return vectors.sparkSession.createDataFrame([], f"{keys}, code string, error long"), books
    state, before = staged(rows.mapInArrow(_round(books, None, parts), schema), "codes"), None
    for _ in range(rounds):
        before, books = books, next_books(state, books)
        last, state = state, staged(state.drop("sums").mapInArrow(_round(books, before, parts), schema), "codes")
        forget(last)
    return state.select("vec_id", "label", "x", "code").mapInArrow(_coded(books, parts), f"{keys}, code string, error long"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows of its label added up; null labels are one.

    Sums are written and counted: few are sent to every task, many are joined by a shuffle in which a label's rows are
    spread over eight copies of its sum.
    """
    sums = staged(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= SENT_LABELS:
        return coded.join(F.broadcast(sums), coded["label"].eqNullSafe(F.col("__label"))).drop("__label")
    many = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = coded.withColumn("__part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(8)).cast("int"))
    return rows.join(many, rows["label"].eqNullSafe(many["__label"]) & (rows["__part"] == many["__salt"])).drop("__label", "__salt", "__part")


def op11_hamerly_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by plain scans of all entries."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * {STEPS})::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM kept, range({parts}) AS r(p))""",
        f"""b0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY dense_rank() OVER (ORDER BY vec_id) <= {entries})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT v.vec_id, v.p, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS m FROM parts v JOIN b{i} b USING (p) GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""s{i} AS MATERIALIZED (SELECT p, m.e AS e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{i}, range(1, 9) AS r(i) GROUP BY ALL)""")
            steps.append(f"""n{i} AS MATERIALIZED (SELECT p, e, list(CAST(floor_div AS BIGINT) ORDER BY i) AS x FROM (SELECT p, e, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS floor_div FROM s{i}) GROUP BY p, e)""")
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN n{i} n USING (p, e))""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""


#: Numbers of 64 components, so parts of 8.
OP11_SQL = _sql()
