"""Phrase collocations by pivot partitioning.

Words of a piece of text stand in a total order by rarity: how often they stand in their language, then their hash. The
pivot of a phrase is its rarest word. Every occurrence of a frequent word is sent, with its neighbours up to the next
rarer or infrequent word or the end of the piece, to the words' own partition; equal fragments are added up before that.
There all phrases that hold the pivot and no rarer word are counted, so that each phrase is counted in one place only:
phrases of common words, which would be hot, are few where the pivot is common. Pivots that stand more than
``PIVOT_ROWS`` times are spread over several partitions by fragment, and their counts added up.

Rarity is looked up in a table of the frequent words' hashes and counts, sent to every task if it has at most
``SENT_WORDS`` rows. Beyond that, counts are added up by the upper bits of the hash into as many slots: the order is then
coarser, which moves work but no count.

Words are told apart by 64-bit hashes of language and word; two frequent words with one hash fail the query.

Defined results: null and empty texts hold no words; a null lang is ``und``; repeated rows count each; an empty table
gives no rows; words of any length are kept whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, staged, table

#: Fewest occurrences of a phrase; percentage of a phrase's occurrences within a longer one that drops it; rows a language.
LEAST, WITHIN, TOP = 10, 50, 2000
#: Words in the table that is sent to every task.
SENT_WORDS = 1 << 20
#: Occurrences of pivots that are mined together.
PIVOT_ROWS = 1_000_000
#: Rows of fragments that are sent in a batch, and that are mined at once; a pivot is not cut.
SENT_ROWS, MINED_ROWS = 1 << 17, 1 << 18
#: Bytes of text whose fragments are added up together.
CHUNK = 8 << 20
SPACES, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
UND = "und"


def _tokens(raw, offsets, langs):
    """Words of a run of texts: (codes into ``words``, piece of each, language of each, words as an Arrow array of strings).

    ``raw`` and ``offsets`` are the texts' bytes; A-Z become a-z, other bytes stay.
    """
    import numpy as np
    import pyarrow as pa

    kind = np.zeros(256, np.int8)
    kind[list(SPACES)], kind[list(ENDS)] = 1, 2
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    of = kind[raw]
    word = of == 0
    stops = np.flatnonzero(of == 2)
    del of
    apart = np.ones(len(raw) + 1, bool)  # no word runs on from the byte before
    apart[1:-1] = ~word[:-1] | ~word[1:]
    apart[offsets] = True  # texts do not run into each other
    begins = np.flatnonzero(word & apart[:-1])
    if not len(begins):
        return np.zeros(0, np.int32), begins, begins, pa.array([], pa.string())
    bounds = np.append(0, np.cumsum(np.flatnonzero(word & apart[1:]) + 1 - begins))
    del apart
    arr = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(low[raw[word]]))
    del word
    coded = arr.dictionary_encode()
    del arr, bounds
    text = np.searchsorted(offsets, begins, side="right") - 1
    piece = np.searchsorted(stops, begins) + text  # rises at every end of a piece or text
    return coded.indices.to_numpy(), piece, langs[text], coded.dictionary


def _chunks(batches):
    """(bytes, offsets, number of each text's language, languages) of about ``CHUNK`` bytes of text."""
    import numpy as np

    from .common import string_parts, text_slices

    for batch in batches:
        for part in text_slices(batch, 1, CHUNK):
            raw, offsets = string_parts(part.column(1))
            coded = part.column(0).dictionary_encode()
            yield raw, offsets, np.asarray(coded.indices), coded.dictionary.to_pylist()


def _joint(codes, langs, n_words: int):
    """(distinct pairs of language and word, the place of each token's pair)."""
    import numpy as np

    pairs, at = np.unique(langs.astype(np.int64) * max(1, n_words) + codes, return_inverse=True)
    return pairs // max(1, n_words), pairs % max(1, n_words), at


def _count(batches):
    """Words and how often each stands in a chunk; a null word stands for all."""
    import numpy as np
    import pyarrow as pa

    for raw, offsets, lang, names in _chunks(batches):
        codes, _, of, words = _tokens(raw, offsets, lang)
        if not len(codes):
            continue
        langs, at, place = _joint(codes, of, len(words))
        n = np.bincount(place)
        sums = np.bincount(of, minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(langs)), words.take(pa.array(at)).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(sums)], ["lang", "word", "n"])


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.col("text"))


def frequent_words(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, n of words that stand ``least`` times or more; lang and n of all words)."""
    counted = texts(docs).mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    kept = staged(counted.where(F.col("word").isNull() | (F.col("n") >= least)).select(F.xxhash64("lang", "word").alias("id"), "lang", "word", "n"), "words")
    return kept.where("word IS NOT NULL"), kept.where("word IS NULL").select("lang", "n")


def rarity(words: DataFrame, most: int = SENT_WORDS):
    """(sorted hashes or None, counts): the table that orders words, at most ``most`` entries or slots."""
    import numpy as np

    shape = words.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    if shape["n"] != shape["ids"]:
        raise ValueError("two frequent words share a hash")
    if shape["n"] <= most:
        rows = words.select("id", "n").toPandas().sort_values("id")
        return rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    bits = most.bit_length() - 1
    slots = words.groupBy(F.shiftrightunsigned("id", 64 - bits).alias("slot")).agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << bits, np.int64)
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    return None, counts


def _looked_up(ids, table):
    """How often words stand, 0 if they are infrequent."""
    import numpy as np

    hashes, counts = table
    if hashes is None:
        return counts[ids.view(np.uint64) >> np.uint64(64 - (len(counts).bit_length() - 1))]
    if not len(hashes):
        return np.zeros(len(ids), np.int64)
    at = np.minimum(np.searchsorted(hashes, ids), len(hashes) - 1)
    return np.where(hashes[at] == ids, counts[at], 0)


def _grouped(columns, weights):
    """(first place of each distinct row, sums of ``weights``) of rows given as columns; places by rows."""
    import numpy as np

    mixed = np.zeros(len(weights), np.uint64)
    for c in columns:
        mixed = (mixed ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    differ = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        differ[1:] |= s[1:] != s[:-1]
    edge = np.append(True, mixed[order][1:] != mixed[order][:-1])[: len(order)]
    if (differ & ~edge).any():  # two rows that mix alike: by their columns then
        order = np.lexsort(columns)
        edge = np.zeros(len(order), bool)
        for c in columns:
            edge[1:] |= c[order][1:] != c[order][:-1]
        edge[:1] = True
    starts = np.flatnonzero(edge)
    return order[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]


def fragments(ids, weight, piece):
    """Rows (two before, one before, pivot, one after, two after) of ids, 0 where a rarer word or an end stands before it."""
    import numpy as np

    def beside(step):
        """Whether a word that is not rarer stands ``step`` places on in the same piece, and which."""
        there = np.zeros(len(ids), bool)
        got = np.zeros(len(ids), np.int64)
        if len(ids) > abs(step):
            mine, other = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
            w, v = weight[mine], weight[other]
            there[mine] = (piece[mine] == piece[other]) & (v > 0) & ((v > w) | ((v == w) & (ids[other] >= ids[mine])))
            got[mine] = ids[other]
        return there, got

    (b1, left1), (b2, left2), (a1, right1), (a2, right2) = (beside(s) for s in (-1, -2, 1, 2))
    b2, a2 = b1 & b2, a1 & a2
    keep = (weight > 0) & (b1 | a1)
    return [np.where(there, got, 0)[keep] for there, got in ((b2, left2), (b1, left1))] + [ids[keep]] + [np.where(there, got, 0)[keep] for there, got in ((a1, right1), (a2, right2))], weight[keep]


def _route(sent, groups: int, pivot_rows: int):
    """A chunk's fragments, added up, packed by the group of their pivot."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        order = sent.value
        for raw, offsets, lang, names in _chunks(batches):
            codes, piece, of, words = _tokens(raw, offsets, lang)
            if not len(codes):
                continue
            langs, at, place = _joint(codes, of, len(words))
            seeds = [xxhash.xxh64_intdigest(n.encode(), 42) for n in names]
            text = words.take(pa.array(at)).to_pylist()
            known = np.array([xxhash.xxh64_intdigest(w.encode(), seeds[k]) for w, k in zip(text, langs.tolist(), strict=True)], np.uint64).view(np.int64)
            del text, codes, of
            rows, pivots = fragments(known[place], _looked_up(known, order)[place], piece)
            del place, piece
            if not len(pivots):
                continue
            first, n = _grouped(rows, np.ones(len(pivots), np.int64))
            rows, pivots = [c[first] for c in rows], pivots[first]
            spread = -(-pivots // pivot_rows)  # a hot pivot's fragments lie in so many groups
            mixed = (rows[0] ^ (rows[1] * 3) ^ (rows[3] * 5) ^ (rows[4] * 7)).view(np.uint64) >> np.uint64(33)
            group = ((rows[2].view(np.uint64) % np.uint64(groups)).astype(np.int64) + np.where(spread > 1, (mixed % np.maximum(spread, 1).astype(np.uint64)).astype(np.int64), 0)) % groups
            by = np.argsort(group, kind="stable")
            table = np.empty((len(by), 7), np.int64)
            for i, c in enumerate((*rows, n, spread > 1)):
                table[:, i] = c[by]
            group = group[by]
            del rows, n, spread, mixed, by, pivots, first
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = np.append(starts[1:], len(group))
            for few in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(ends // SENT_ROWS)) + 1):
                packed = pa.array([table[a:b].tobytes() for a, b in zip(starts[few], ends[few], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(group[starts[few]].astype(np.int32)), packed], ["grp", "rows"])

    return run


def _pivoted(table, least: int):
    """All phrases of whole pivots' fragments that hold the pivot, with counts; those of hot pivots are partial."""
    import numpy as np
    import pyarrow as pa

    l2, l1, p, r1, r2, n, hot = (np.ascontiguousarray(table[:, i]) for i in range(7))
    none, hot = np.zeros(len(p), np.int64), hot > 0
    made = []  # a phrase that holds its pivot twice is counted at the first of them
    pairs = ((l1, p, none), (l1 != 0) & (l1 != p)), ((p, r1, none), r1 != 0)
    triples = ((l2, l1, p), (l2 != 0) & (l2 != p) & (l1 != p)), ((l1, p, r1), (l1 != 0) & (r1 != 0) & (l1 != p)), ((p, r1, r2), r2 != 0)
    for kinds in (pairs, triples):
        w1, w2, w3, count, partial = (np.concatenate(c) for c in zip(*([c[there] for c in (*words, n, hot)] for words, there in kinds), strict=True))
        first, sums = _grouped([w1, w2, w3], count)
        keep = partial[first] | (sums >= least)
        first = first[keep]
        made.append(pa.table({"w1": w1[first], "w2": w2[first], "w3": w3[first], "a": sums[keep]}))
    return pa.concat_tables(made)


def _mine(least: int, rows: int = MINED_ROWS):
    """The phrases of a group, some pivots after the others, so that what is made of them stays small."""

    def run(packed):
        import numpy as np
        import pyarrow as pa

        from .common import string_parts

        tables = [string_parts(c)[0].view(np.int64).reshape(-1, 7) for c in packed.column("rows").chunks]  # the bytes as they came
        parts = max(1, -(-sum(map(len, tables)) // rows))
        part = [(t[:, 2].astype(np.uint64) >> np.uint64(20)) % np.uint64(parts) for t in tables]
        return pa.concat_tables([_pivoted(np.concatenate([t[of == k] for t, of in zip(tables, part, strict=True)]), least) for k in range(parts)])

    return run


def phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, most: int = SENT_WORDS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(w1, w2, w3 as ids, 0 for none; a) of the phrases of two and three words that stand ``least`` times or more."""
    spark = docs.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    groups = buckets_for(total, pivot_rows, 8)
    sent = spark.sparkContext.broadcast(rarity(words, most))
    routed = texts(docs).mapInArrow(_route(sent, groups, pivot_rows), "grp int, rows binary")
    mined = routed.groupBy("grp").applyInArrow(_mine(least), "w1 long, w2 long, w3 long, a long")
    return mined.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _spread(left: DataFrame, right: DataFrame, on: dict[str, str], how: str, copies: int = 8) -> DataFrame:
    """An equi-join in which a key's rows of ``left`` are spread over ``copies`` copies of its rows of ``right``, as words are hot."""
    salted = left.withColumn("__part", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(copies)).cast("int"))
    copied = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    match = salted["__part"] == copied["__salt"]
    for mine, other in on.items():
        match = match & (salted[mine] == copied[other])
    return salted.join(copied, match, how).drop("__part", "__salt", *on.values())


def scored(found: DataFrame, words: DataFrame, within: int = WITHIN) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one takes in, by the weakest cut."""
    for i in (1, 2, 3):
        named = words.select(F.col("id").alias(f"__w{i}"), *([F.col("lang")] if i == 1 else []), F.col("word").alias(f"t{i}"), F.col("n").alias(f"n{i}"))
        found = _spread(found, named, {f"w{i}": f"__w{i}"}, "left" if i == 3 else "inner")
    rows = staged(found, "phrases")
    two, three = rows.where("w3 = 0"), rows.where("w3 <> 0")
    pair = lambda x, y, name: two.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name))
    longer = three.select(F.explode(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))).alias("x")).groupBy(F.col("x.w1").alias("__x"), F.col("x.w2").alias("__y")).agg(F.max("x.a").alias("__longer"))
    outside = _spread(two, longer, {"w1": "__x", "w2": "__y"}, "left").where(f"__longer IS NULL OR 100 * __longer < {within} * a")
    three = _spread(_spread(three, pair("__x", "__y", "first2"), {"w1": "__x", "w2": "__y"}, "inner"), pair("__x", "__y", "last2"), {"w2": "__x", "w3": "__y"}, "inner")
    big = lambda c: c.cast("decimal(15,0)")

    def cut(a: Column, left: Column, right: Column, k: int) -> Column:
        value = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))
        return F.struct(value.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    best2 = outside.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", cut(F.col("a"), F.col("n1"), F.col("n2"), 1).alias("c"))
    weakest = F.least(cut(F.col("a"), F.col("n1"), F.col("last2"), 1), cut(F.col("a"), F.col("first2"), F.col("n3"), 2))
    best3 = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", weakest.alias("c"))
    return best2.unionByName(best3).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, within: int = WITHIN, most: int = SENT_WORDS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    words, sizes = frequent_words(docs, least)
    best = scored(phrases(docs, words, least, most, pivot_rows), words, within)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '{UND}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS MATERIALIZED (SELECT lang, k, list_aggregate(ws[i : i + k - 1], 'string_agg', ' ') AS phrase, ws[i : i + k - 1] AS part, count(*) AS f FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), range(1, 4) AS r(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT * FROM g WHERE k > 1 AND f >= {LEAST}),
taken AS (SELECT lang, part, max(f) AS most FROM (SELECT lang, unnest([part[1:2], part[2:3]]) AS part, f FROM c WHERE k = 3) GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g x ON x.lang = c.lang AND x.part = c.part[1:j] JOIN g y ON y.lang = c.lang AND y.part = c.part[j + 1:]
  LEFT JOIN taken t ON t.lang = c.lang AND t.part = c.part WHERE t.most IS NULL OR 100 * t.most < {WITHIN} * c.f),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN n USING (lang) QUALIFY rank <= {TOP}"""
