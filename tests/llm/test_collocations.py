"""Collocations against plain counts."""

import collections
import random
import re

import numpy as np
import pytest

from tidemark.llm import collocations as c


def plain(docs, top, least=10):
    """Rows (lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f = collections.Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            f.update((lang or "und", tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    n = collections.Counter()
    for (lang, p), k in f.items():
        n[lang] += k * (len(p) == 1)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = {(lang, part) for (lang, p), a in found.items() if len(p) == 3 for part in (p[:2], p[1:]) if 100 * a >= 50 * found[lang, part]}
    rows = []
    for (lang, p), a in found.items():
        if (lang, p) not in dropped:
            score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, l, r, n[lang], score))
    out = []
    for lang in n:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "b", "A", "é", "z", "the", "of", "x-y", "ß", "İ", *[f"w{i}" for i in range(25)]]
    rows = []
    for _ in range(n):
        text = "".join(rng.choices(words, [9, 6, 5, 3, 2, 9, 9, 2, 2, 2] + [1] * 25)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!", ""]) for _ in range(rng.randrange(120)))
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return [*rows, ("en", None), ("en", ""), ("fr", " . "), *[("de", "same again and same again and")] * 40, ("en", "long " * 5000), ("en", "q" * 100_000)]


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_plain_counts(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS id", "2 AS n", "'x' AS word", "3 AS w1")
    want = plain(rows, 50)
    take = lambda df: sorted(tuple(r) for r in df.collect())
    assert take(c.collocations(docs.repartition(5), top=50)) == want
    assert take(c.collocations(docs, top=50, most=4)) == want  # rarity by slots: another order, the same counts
    assert take(c.collocations(docs, top=50, pivot_rows=20)) == want  # hot pivots over several groups


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("en", "one two three")]):
        assert c.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_a_fragment_stops_at_rarer_words():
    ids, weight = np.array([5, 6, 7, 8, 6], np.int64), np.array([90, 20, 10, 50, 20], np.int64)
    rows, pivots = c.fragments(ids, weight, np.zeros(5, np.int64))
    assert sorted(zip(*[r.tolist() for r in rows], strict=True)) == [(0, 5, 6, 0, 0), (0, 8, 6, 0, 0), (5, 6, 7, 8, 6)]
    rows, _ = c.fragments(ids, weight, np.array([0, 0, 1, 1, 1]))
    assert (0, 0, 7, 8, 6) in set(zip(*[r.tolist() for r in rows], strict=True))
    assert c.fragments(ids[:0], weight[:0], ids[:0])[1].size == 0


def test_rows_that_mix_alike_are_told_apart():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 4, 500), rng.integers(0, 4, 500)]
    first, n = c._grouped(cols, np.ones(500, np.int64))
    want = collections.Counter(zip(*[x.tolist() for x in cols], strict=True))
    assert {(int(cols[0][i]), int(cols[1][i])): int(k) for i, k in zip(first, n, strict=True)} == want
    assert c._grouped([cols[0][:0]], np.zeros(0, np.int64))[1].size == 0


def peak(run):
    """(result, most bytes that Python and numpy held meanwhile)."""
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_words_and_groups_stay_small_in_memory():
    import pyarrow as pa

    raw = np.frombuffer(b"Some words, and more of them. " * 50_000, np.uint8)
    (codes, piece, langs, words), most = peak(lambda: c._tokens(raw, np.array([0, len(raw)]), np.zeros(1, np.int64)))
    assert len(codes) == len(piece) == len(langs) == 300_000 and len(words) == 6 and piece[-1] == 99_999
    assert most < 30 * len(raw), most / len(raw)
    rng = np.random.default_rng(3)
    table = np.concatenate([rng.integers(1, 300, (600_000, 5)), np.ones((600_000, 1), np.int64), np.zeros((600_000, 1), np.int64)], axis=1).astype(np.int64)
    table[:, 2] <<= 20
    packed = pa.table({"grp": pa.array([0, 0], pa.int32()), "rows": pa.array([table[:250_000].tobytes(), table[250_000:].tobytes()], pa.binary())})
    del table
    mined, most = peak(lambda: c._mine(10)(packed))
    assert mined.num_rows > 1000 and most < 6 * packed.nbytes, most / packed.nbytes
