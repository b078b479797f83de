"""Product codes against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """(code and error by row number, books) of rows (vec_id, vector, label) by scanning everything."""
    kept = [(i, [math.floor(4096 * v) for v in x]) for i, (_, x, _) in enumerate(rows) if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    width = len(kept[0][1]) // parts
    cut = lambda x: [x[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (rows[r[0]][0] is None, rows[r[0]][0] or 0, r[1]))[:entries]
    books = [[cut(x)[p] for _, x in first] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, x in kept:
                of.setdefault(near(cut(x)[p], books[p])[1], []).append(cut(x)[p])
            books[p] = [[sum(c) // len(c) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    out = {}
    for i, x in kept:
        got = [near(cut(x)[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got))
    return out, books


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_plain_rounds(spark, seed):
    rng = random.Random(seed)
    vector = lambda: [float(np.float32(rng.choice([-0.001, 0.0, 0.001, rng.gauss(0, 0.01)]))) for _ in range(16)]  # noqa: E731  many ties
    rows = [(i, vector(), rng.choice([1, 2, None])) for i in range(120)]
    rows[3:3] = [(3000, None, 1), (3001, [None] * 16, 1), (3002, [float("nan")] * 16, None), (3003, [float("inf")] + [0.0] * 15, 2)]
    rows += [rows[0], (0, rows[5][1], 7), (None, rows[7][1], None)]  # a repeated row, a repeated id, no id
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS code", "1 AS error", "array(1) AS x")
    coded, books = vector_codes.compressed(df)
    want, want_books = plain(rows)
    assert books == want_books
    got = sorted((str(r["vec_id"]), r["code"], r["error"]) for r in coded.collect())
    assert got == sorted((str(rows[i][0]), c, e) for i, (c, e) in want.items())
    sums = {}
    for i, (_, e) in want.items():
        sums[rows[i][2]] = sums.get(rows[i][2], 0) + e
    assert {r["label"]: r["label_error"] for r in vector_codes.with_label_error(coded).collect()} == sums


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a", i, None if i % 3 == 0 else i % 3) for i in range(50)], "vec_id long, code string, error long, label int")
    few = sorted(map(str, vector_codes.with_label_error(df).collect()))
    monkeypatch.setattr(vector_codes, "SENT_LABELS", 0)
    assert sorted(map(str, vector_codes.with_label_error(df).collect())) == few


def test_bounds_leave_most_parts_alone_and_never_decide_a_tie():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (2000, 8))
    book = x[:16].copy()
    now, upper, lower = vector_codes.assigned(x, book, None, None, None)
    moved = book + rng.integers(-3, 4, book.shape)
    moved[5] = moved[3]  # equal entries: the lower index wins
    went, others = vector_codes._moved(book, moved)
    got = vector_codes.assigned(x, moved, now, vector_codes._up(upper.astype(float) + went[now]), vector_codes._down(lower.astype(float) - others[now]))
    d = ((x[:, None] - moved[None]) ** 2).sum(2)
    assert (got[0] == d.argmin(1)).all() and not (got[0] == 5).any()
    assert (got[1].astype(float) ** 2 >= d.min(1)).all()


def test_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes.compressed(spark.createDataFrame([], schema))[0].count() == 0
    one = vector_codes.with_label_error(vector_codes.compressed(spark.createDataFrame([(1, [-0.5] * 8, None)], schema))[0]).first()
    assert (one["code"], one["error"], one["label_error"]) == ("00" * 8, 0, 0)
    empty = vector_codes.compressed(spark.createDataFrame([(1, [], "a"), (2, [], "a")], schema))[0]
    assert [r["code"] for r in empty.collect()] == ["00" * 8] * 2
    for bad in ([(1, [1.0] * 8, "a"), (2, [1.0] * 9, "a")], [(1, [1e6] * 8, "a")]):
        with pytest.raises(Exception, match="one length|too large"):
            vector_codes.compressed(spark.createDataFrame(bad, schema).coalesce(1))[0].collect()


def test_digest_of_the_books():
    assert vector_codes.books_text([[[1, -2], [3, 4]], [[5, 6], [7, 8]]]) == "1,-2,3,4,5,6,7,8"
    assert len(hashlib.sha256(b"").hexdigest()) == 64
