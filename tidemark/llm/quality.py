"""Quality classifier: perplexity under interpolated modified Kneser-Ney n-gram models of trusted text.

The model is over bytes, of order ``ORDER``; its counts come from all trusted documents of all languages that are not held
out. Four bytes before a symbol tell the language well enough, and a good text that quotes another language is not odd;
``scored`` takes a model per language just as well. How odd is too odd is told by each language's quantiles. The model is a table of additive weights: the log-probability of a symbol is a constant
plus, over all suffixes of its n-gram that the model holds, what the suffix adds as a gram (log p of its order, less
what the lower order and the back-off gave) and as a history (log of its back-off weight). A gram that the model does
not hold adds nothing, so documents and model meet in a plain equi-join of grams.

The join is sharded. Texts are laid in slices of about ``SLICE_BYTES``; a slice asks for each of its different grams
once, the shard that holds a gram (by hash) answers with its weight, and the answers come back to the slice, which sums
them by document. Common grams are so asked for once a slice, not once an occurrence. Shards hold about
``SHARD_GRAMS`` weights, and the requests of one shard are dealt over several tasks, each with a copy of the shard; the
number of shards follows the model, the number of slices the corpus. A document is rejected when its perplexity lies
far above that of held-out trusted documents of its language.

Perplexity cannot tell an insult from another word, so words are looked at too: a word marks toxic
text when its share among the texts labelled toxic is ``MARK_ODDS`` times its share among trusted ones, and chance would
not put it there: were texts that hold it toxic as often as all are, so many would be with a probability of at most
``MARK_CHANCE`` for any of the words that are looked at. Different texts count, not their copies, and no more of them
than there are different pairs of words before it (its Kneser-Ney continuation count, which near copies do not raise
much). A document that holds a marking word is rejected.

Defined results: one row per row of the input, each judged by its own text; null and empty texts have no symbols and are
kept; languages (null: the empty name) with fewer than ``MIN_HELD`` held-out documents are judged by the quantiles of
all; without trusted text perplexity rejects nothing; without ``MARK_LEAST`` toxic documents
no word marks; a short text's perplexity is drawn towards its language's mean by ``PRIOR`` symbols; other columns are
ignored. Digits are one symbol, control characters but line feeds too; letters of several bytes are several symbols.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, forget, row_hash, staged, table, text_of

#: Symbols of the longest gram; symbols before and after a text.
ORDER, PAD, END = 5, 2, 3
#: UTF-8 bytes of a block of texts that travels whole, and of the blocks that ask together, about.
BLOCK_BYTES, SLICE_BYTES = 1 << 20, 8 << 20
#: Weights of one shard, about; different grams of a slice, about; requests that one task answers, about.
SHARD_GRAMS, SLICE_GRAMS, ASKED = 1 << 18, 1 << 18, 1 << 22
#: Weights travel as thousandths in 16 bits.
UNIT = 1000.0
#: Symbols that are looked at at once.
AT_ONCE = 1 << 18
#: UTF-8 bytes of trusted text that one group of grams stands for, about.
GROUP_BYTES = 32 << 20
#: Held-out documents a language needs for quantiles of its own; one trusted document of so many is held out for them.
MIN_HELD, HELD_OUT = 20, 5
#: The threshold of a language: median + SPREAD * (upper quantile - median) of the held-out log-perplexities.
UPPER, SPREAD = 0.9, 8.0
PRIOR = 100
#: Trusted ids that are sent to every task; a larger table of labels is joined by a shuffle.
SENT_IDS = 1_000_000
#: Bytes of per-language tables that are sent to every task; more are joined by a shuffle.
SENT_BYTES = 8 << 20
#: A marking word: least share of toxic texts (none beyond significance), least number of them, least ratio to its share of trusted ones.
MARK_SHARE, MARK_LEAST, MARK_ODDS = 0.0, 5, 20.0
#: The chance that any word marks which is as frequent in all texts.
MARK_CHANCE = 0.01
#: What stands between words of lower-cased text.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Word hashes that are sent to every task; more are joined by a shuffle.
SENT_WORDS = 1_000_000


def symbol_table():
    """Byte to symbol: digits are one, control characters but the line feed are one, other bytes stand for themselves."""
    import numpy as np

    out = np.arange(256, dtype=np.uint8)
    out[:32] = 1
    out[10], out[48:58] = 10, 48
    return out


def laid(raw, offsets):
    """(symbols of texts laid end to end, where each text's symbols end): pads before and an end after each text that is not empty."""
    import numpy as np

    from .tokens import ragged

    size = np.diff(offsets)
    ends = np.cumsum(np.where(size > 0, size + ORDER, 0))
    out = np.full(int(ends[-1]) if len(ends) else 0, PAD, np.uint8)
    full = size > 0
    out[ragged((ends - size - 1)[full], size[full])] = symbol_table()[raw]
    out[ends[full] - 1] = END
    return out, ends


def grams(symbols, at: int, to: int):
    """(the gram that ends at each place from ``at`` to ``to``, its last symbol in the lowest byte; whether a text's symbol ends it; whether the text's first symbol follows)."""
    import numpy as np

    n = to - at
    part = np.concatenate([np.zeros(max(0, ORDER - 1 - at), np.uint8), symbols[max(0, at - ORDER + 1) : to]]).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out |= part[ORDER - 1 - k : ORDER - 1 - k + n] << np.uint64(8 * k)
    real = symbols[at : to + 1] != PAD
    return out, real[:n], ~real[:n] & np.append(real[1:], False)[:n]


def spans(n: int):
    """0 to ``n`` in steps of AT_ONCE."""
    return ((a, min(n, a + AT_ONCE)) for a in range(0, n, AT_ONCE))


def gram_keys(suffixes, m: int, lang_hashes):
    """64-bit keys of grams of ``m`` symbols in their languages."""
    import numpy as np

    from .tokens import mixed

    return mixed(mixed(suffixes | np.uint64(m << 56)) + lang_hashes)


def lang_hash(lang: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang.encode(), 1)


def placed(keys, shards: int):
    """Keys as (shard << 32 | low half): the order in which they are asked and answered."""
    import numpy as np

    return (keys >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def packed(values) -> bytes:
    """Integers, compressed; ascending unsigned ones as gaps, bytes of equal weight together."""
    import numpy as np
    import zstandard

    if values.dtype == np.uint32:
        values = np.diff(values, prepend=np.uint32(0))
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, dtype):
    import numpy as np
    import zstandard

    dtype = np.dtype(dtype)
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(dtype.itemsize, -1).T
    values = np.ascontiguousarray(flat).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if dtype == np.uint32 else values


def _count(batches):
    """(lang, gram, n) of texts (lang, text); grams of a language are added up until there are about SLICE_GRAMS."""
    import numpy as np
    import pyarrow as pa

    from .common import string_parts, text_slices

    held: dict[str, list] = {}

    def added(parts):
        seen, of = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return seen, np.bincount(of, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(lang, seen, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in (part for whole in batches for part in text_slices(whole, 1, 4 * BLOCK_BYTES)):
        langs = batch.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            symbols, _ = laid(*string_parts(batch.column(1).filter(pa.array(langs.indices.to_numpy() == code))))
            parts = held.pop(lang, [])
            for a, b in spans(len(symbols)):
                g, real, _ = grams(symbols, a, b)
                parts.append(np.unique(g[real], return_counts=True))
            if parts:
                parts = [added(parts)]
                if len(parts[0][0]) > SLICE_GRAMS:
                    yield rows(lang, *parts.pop())
                held[lang] = parts
        if len(held) > 64:
            yield from (rows(lang, *added(parts)) for lang, parts in held.items() if parts)
            held = {}
    yield from (rows(lang, *added(parts)) for lang, parts in held.items() if parts)


def counts_of_counts(n):
    import numpy as np

    return [int((n == k).sum()) for k in range(1, 5)]


def discounts(n):
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, from how many grams are seen once to four times."""
    if not (n[0] and n[1] and n[2]):
        return [0.0, 0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))]


def suffixes(grams, symbols: int):
    """(different suffixes of sorted grams, how many grams end in each): continuation counts."""
    import numpy as np

    return np.unique(grams & np.uint64((1 << 8 * symbols) - 1), return_counts=True)


def _gather(pdf):
    """All grams of a language whose second and third symbol from the end fall in one part, as one row."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("gram")
    five, n = pdf["gram"].to_numpy().view(np.uint64), pdf["n"].to_numpy()
    four, n4 = suffixes(five, 4)
    three, n3 = suffixes(four, 3)
    seen = [counts_of_counts(x) for x in (n3, n4, n)]
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "grams": [five.tobytes()], "counts": [n.astype(np.int64).tobytes()], "tri": [three.astype(np.uint32).tobytes()], "seen": [sum(seen, [])], "n": [len(five) + len(four) + len(three)]})


def _bases(pdf):
    """A language's discounts by order and its continuation counts of pairs, at most 2**16; at most 2**24 triples make them."""
    import numpy as np
    import pandas as pd

    three = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["tri"]]).astype(np.uint64)
    two, n2 = suffixes(three, 2)
    _, n1 = suffixes(two, 1)
    seen = np.sum([np.array(x) for x in pdf["seen"]], axis=0).reshape(3, 4).tolist()
    d = [discounts(x) for x in (counts_of_counts(n1), counts_of_counts(n2), *seen)]
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "discounts": [sum(d, [])], "pairs": [two.astype(np.uint32).tobytes()], "n_pairs": [n2.astype(np.int64).tobytes()]})


def level(g, n, d, lower):
    """(log p, histories, log of their back-off weights, index of each gram's history) of sorted grams of one order."""
    import numpy as np

    h, of = np.unique(g >> np.uint64(8), return_inverse=True)
    total = np.bincount(of, weights=n)
    cut = np.array(d)[np.minimum(n, 3)]
    back = np.bincount(of, weights=cut) / total
    return np.log(np.maximum(n - cut, 0) / total[of] + back[of] * np.exp(lower)), h, np.log(back), of


def weights_of(five, n, discounts, two, n2, first: bool):
    """[(symbols, grams, weights)] of one part of a language's model; those of single symbols and pairs only for the ``first`` part."""
    import numpy as np

    d = np.array(discounts).reshape(ORDER, 4)
    out = []

    def add(m, g, logs, lower, h, back, of):
        out.append((m, g, logs - back[of] - lower))
        out.append((m - 1, h, back))

    one, n1 = suffixes(two, 1)
    base = np.full(len(one), -math.log(256))
    p1, *rest = level(one, n1, d[0], base)
    if first:
        add(1, one, p1, base, *rest)
    lower = p1[np.searchsorted(one, two & np.uint64(0xFF))]
    p2, *rest = level(two, n2, d[1], lower)
    if first:
        add(2, two, p2, lower, *rest)
    four, n4 = suffixes(five, 4)
    three, n3 = suffixes(four, 3)
    below, logs = two, p2
    for m, g, c in ((3, three, n3), (4, four, n4), (5, five, n)):
        lower = logs[np.searchsorted(below, g & np.uint64((1 << 8 * (m - 1)) - 1))]
        logs, *rest = level(g, c, d[m - 1], lower)
        add(m, g, logs, lower, *rest)
        below = g
    return out


def _weights(shards: int):
    """Rows (shard, keys, weights) of each part of the model."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                u64 = lambda name, t=np.uint64: np.frombuffer(row[name], t).astype(np.uint64)
                made = weights_of(u64("grams"), np.frombuffer(row["counts"], np.int64), row["discounts"], u64("pairs", np.uint32), np.frombuffer(row["n_pairs"], np.int64), row["first"])
                lang = np.uint64(lang_hash(row["lang"]))
                keys = placed(np.concatenate([gram_keys(g, m, lang) for m, g, _ in made]), shards)
                w = np.clip(np.rint(np.concatenate([x for _, _, x in made]) * UNIT), -32767, 32767).astype(np.int16)
                order = np.argsort(keys, kind="stable")
                keys, w = keys[order], w[order]
                shard = (keys >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(shard)) + 1
                low = np.split((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts)
                yield pa.RecordBatch.from_arrays([pa.array(shard[np.append(0, cuts)]), pa.array([packed(x) for x in low], pa.binary()), pa.array([packed(x) for x in np.split(w, cuts)], pa.binary())], ["shard", "keys", "weights"])

    return run


def _laid(batches):
    """Rows (slice, blocks): the texts that one task reads until there are SLICE_BYTES, in compressed blocks of about a megabyte."""
    import pyarrow as pa
    from pyspark import TaskContext

    from .common import text_slices

    task, number, blocks, total, held, size = TaskContext.get().partitionId(), 0, [], 0, [], 0
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))

    def block():
        nonlocal held, size, total
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=options) as out:
            out.write_table(table.combine_chunks())
        blocks.append(sink.getvalue().to_pybytes())
        held, size, total = [], 0, total + size

    def row():
        nonlocal blocks, total, number
        made = pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([blocks], pa.list_(pa.binary()))], ["slice", "blocks"])
        blocks, total, number = [], 0, number + 1
        return made

    for batch in batches:
        for part in text_slices(batch, 3, BLOCK_BYTES):
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                block()
                if total >= SLICE_BYTES:
                    yield row()
    if held:
        block()
    if blocks:
        yield row()


class Slice:
    """The blocks of a slice and the grams that they hold."""

    def __init__(self, blocks):
        import numpy as np
        import pyarrow as pa

        self.tables = [pa.ipc.open_stream(b).read_all().combine_chunks() for b in blocks]
        self.langs = sorted({x for t in self.tables for x in t.column(2).unique().to_pylist()})
        self.hashes = np.array([lang_hash(x) for x in self.langs], np.uint64)
        seen = [np.unique(g[real]) for t in self.tables for _, g, real in self.parts(t)]
        self.seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen]))

    def parts(self, table):
        """(first place, grams with their language in the high bytes, whether they count), AT_ONCE at a time. The pads before a text count as a history."""
        import numpy as np

        from .common import string_parts

        symbols, ends = laid(*string_parts(table.column(3)))
        rank = {x: i for i, x in enumerate(self.langs)}
        code = np.array([rank[x] for x in table.column(2).to_pylist()], np.uint64) << np.uint64(8 * ORDER)
        for a, b in spans(len(symbols)):
            g, real, lead = grams(symbols, a, b)
            g |= np.repeat(code, np.diff(np.append(a, np.clip(ends, a, b))))
            yield a, g, real | lead

    def keys(self, m: int, seen=None):
        import numpy as np

        seen = self.seen if seen is None else seen
        lang = self.hashes[(seen >> np.uint64(8 * ORDER)).astype(np.int64)] if len(seen) else seen
        return gram_keys(seen & np.uint64((1 << 8 * m) - 1), m, lang)

    def asked(self, shards: int):
        """All keys of the slice, in order of shards."""
        import numpy as np

        high = ~np.uint64((1 << 8 * ORDER) - 1)
        each = [np.unique(self.seen & (high | np.uint64((1 << 8 * m) - 1))) for m in range(ORDER + 1)]
        return np.unique(placed(np.concatenate([self.keys(m, s) for m, s in enumerate(each)]), shards))


def _ask(shards: int):
    """Rows (shard, slice, keys) of each slice."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at, blocks in zip(batch.column(0), batch.column(1), strict=True):
                asked = Slice(blocks.as_py()).asked(shards)
                if len(asked):
                    shard = (asked >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(shard)) + 1
                    low = [packed(x) for x in np.split((asked & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard[np.append(0, cuts)]), pa.array([at.as_py()] * len(low), pa.int64()), pa.array(low, pa.binary())], ["shard", "slice", "keys"])

    return run


def _answer(batches):
    """Rows (slice, shard, weights): what the shard holds of the keys asked. Rows come by group, the shard's own first."""
    import numpy as np
    import pyarrow as pa

    now, held, keys, weights = None, [], None, None
    for batch in batches:
        out = []
        for group, shard, slice_, asked, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != now:
                now, held, keys = group, [], None
            if slice_ is None:
                held.append((unpacked(asked, np.uint32), unpacked(given, np.int16)))
                continue
            if keys is None:  # a gram has a weight as a gram and one as a history, from different parts of the model
                all_keys = np.concatenate([np.zeros(0, np.uint32), *(k for k, _ in held)])
                keys, of = np.unique(all_keys, return_inverse=True)
                weights = np.bincount(of, weights=np.concatenate([np.zeros(0), *(w for _, w in held)]), minlength=len(keys)).astype(np.int16)
                held = []
            want = unpacked(asked, np.uint32)
            found = np.zeros(len(want), np.int16)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                found = np.where(keys[at] == want, weights[at], np.int16(0))
            out.append((slice_, shard, packed(found)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["slice", "shard", "weights"])


def _sum(shards: int):
    """Rows (doc_id, row_hash, lang, ll, n) of a slice: thousandths of log-likelihood and symbols of each text."""

    def run(blocks, answers):
        import numpy as np
        import pyarrow as pa

        s = Slice([b for x in blocks.column("blocks").to_pylist() for b in x])
        asked = s.asked(shards)
        got = sorted(zip(answers.column("shard").to_pylist(), answers.column("weights").to_pylist(), strict=True))
        weights = np.concatenate([np.zeros(0, np.int16), *(unpacked(w, np.int16) for _, w in got)]).astype(np.int64)
        if len(weights) != len(asked):
            raise RuntimeError("a slice has other answers than it asked for")
        value = np.full(len(s.seen), round(-math.log(256) * UNIT), np.int64)
        for m in range(ORDER + 1):
            value += weights[np.searchsorted(asked, placed(s.keys(m), shards))]
            if m == 0:
                value[s.seen & np.uint64(0xFF) == PAD] = 0  # predicts nothing
        made = []
        for t in s.tables:
            size = np.diff(laid_ends(t))
            total, n = np.zeros(len(size), np.int64), np.where(size > 0, size - ORDER + 1, 0)
            ends = np.cumsum(size)
            for a, g, real in s.parts(t):
                v = np.where(real, value[np.minimum(np.searchsorted(s.seen, g), len(s.seen) - 1)], 0)
                cut = np.clip(ends, a, a + len(g)) - a
                sums = np.append(0, np.cumsum(v))
                total += sums[cut] - sums[np.append(0, cut[:-1])]
            made.append(pa.table({"doc_id": t.column(0), "row_hash": t.column(1), "lang": t.column(4), "ll": pa.array(total), "n": pa.array(n)}))
        return pa.concat_tables(made)

    return run


def laid_ends(table):
    """0 and where each text's symbols end."""
    import numpy as np

    from .common import string_parts

    size = np.diff(string_parts(table.column(3))[1])
    return np.append(0, np.cumsum(np.where(size > 0, size + ORDER, 0)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of trusted text and whether they are held out: labelled as good and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)


def toxic_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled toxic."""
    return labels.where("toxic = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def sent(df: DataFrame, most: int) -> DataFrame:
    """``df`` (a written table), marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def words_of(rows: DataFrame, *more: str) -> DataFrame:
    """(doc_id, row_hash, word) and the columns ``more``: the different words of each text, hashed."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), BETWEEN_WORDS))).alias("w")
    return rows.select("doc_id", "row_hash", *more, words).where("w <> ''").select("doc_id", "row_hash", *more, F.xxhash64("w").alias("word"))


def chance(k, g, q: float):
    """Logarithm of a bound (Chernoff's) of the probability that k or more of k + g texts are toxic if a share q of all is; columns."""
    share = k / (k + g)
    part = lambda x, y, of: F.when(x > 0, x * F.log(y / F.lit(of))).otherwise(0.0)
    return F.when(share > q, -part(k, share, q) - part(g, 1 - share, 1 - q)).otherwise(0.0)


def marking_words(rows: DataFrame, trusted: DataFrame, toxic: DataFrame) -> DataFrame:
    """Hashes of the words that mark toxic text, as a written table; ``trusted`` and ``toxic`` are ids."""
    # of equal trusted texts one stands for all: the one with the smallest id, rows that repeat it in equal parts
    alike = rows.select("doc_id", "row_hash").join(trusted, "doc_id").groupBy("row_hash", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    alike = staged(alike.groupBy("row_hash").agg(F.min(F.struct("doc_id", "copies")).alias("m")).select("row_hash", "m.*"), "alike")
    good = rows.join(sent(alike, SENT_IDS), ["doc_id", "row_hash"])
    bad = staged(rows.join(toxic, "doc_id").dropDuplicates(["row_hash"]), "bad")
    n_bad, n_good = bad.count(), alike.count()
    q = n_bad / max(n_bad + n_good, 1)
    least = max(MARK_LEAST, MARK_SHARE * n_bad)
    held = staged(words_of(bad).groupBy("word").agg(F.count(F.lit(1)).alias("n_bad")), "held")
    bar = math.log(MARK_CHANCE / max(held.count(), 1))
    texts = lambda n, g: (F.least("n_bad", n).cast("double"), g.cast("double"))
    none = F.lit(0)
    common = sent(staged(held.where((F.col("n_bad") >= least) & (chance(*texts(F.col("n_bad"), none), q) <= bar)), "common"), SENT_WORDS)
    seen = words_of(good, "copies").join(common.select("word"), "word").groupBy("word").agg(F.round(F.sum(1 / F.col("copies"))).cast("long").alias("n_good"))
    share = F.col("n_bad") / max(n_bad, 1)
    rare = common.join(seen, "word", "left").withColumn("n_good", F.coalesce("n_good", none))
    odd = rare.where((share >= MARK_ODDS * (F.col("n_good") + 0.5) / (n_good + 1)) & (chance(*texts(F.col("n_bad"), F.col("n_good")), q) <= bar))
    odd = sent(staged(odd, "odd"), SENT_WORDS)
    words = F.split(F.lower("text"), BETWEEN_WORDS)
    before = lambda k: F.concat(F.array(*[F.lit("")] * k), words)
    runs = bad.select(F.explode(F.arrays_zip(words.alias("w"), before(1).alias("a"), before(2).alias("b"))).alias("x")).where("x.w <> ''")
    contexts = runs.select(F.xxhash64("x.w").alias("word"), F.xxhash64("x.a", "x.b").alias("context")).join(odd.select("word"), "word").distinct()
    shown = odd.join(contexts.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word").where(F.col("n") >= least)
    marking = staged(shown.where(chance(*texts(F.col("n"), F.col("n_good")), q) <= bar).select("word"), "marking")
    for done in (alike, bad, held):
        forget(done)
    return marking


def sent_bytes(df: DataFrame, size, most: int) -> DataFrame:
    """``df`` (a written table), marked for broadcast if ``size`` sums to at most ``most`` bytes."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def model(train: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(rows (shard, keys, weights), number of shards) of the models that ``train`` (lang, text) names, of ``size`` bytes about."""
    counts = train.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(0xFFFF)), F.lit(buckets_for(size, GROUP_BYTES, least=8))).alias("part")
    shape = "lang string, grams binary, counts binary, tri binary, seen array<long>, n long"
    groups = staged(counts.groupBy("lang", part).applyInPandas(_gather, shape), "grams")
    bases = staged(groups.groupBy("lang").applyInPandas(_bases, "lang string, discounts array<double>, pairs binary, n_pairs binary"), "bases")
    shards = buckets_for(2 * (groups.agg(F.sum("n")).first()[0] or 0), SHARD_GRAMS)
    near = sent_bytes(bases, F.octet_length("pairs") + F.octet_length("n_pairs"), SENT_BYTES)
    own = groups.select("lang", "grams", "counts").withColumn("first", F.lit(False))
    lead = groups.select("lang").distinct().select("lang", F.lit(b"").alias("grams"), F.lit(b"").alias("counts"), F.lit(True).alias("first"))
    parts = own.unionByName(lead).join(near, "lang")
    weights = staged(parts.mapInArrow(_weights(shards), "shard long, keys binary, weights binary"), "weights")
    for done in (groups, bases):
        forget(done)
    return weights, shards


def scored(rows: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """(doc_id, row_hash, lang, ll, n) of every row of ``rows`` (doc_id, row_hash, model, text, lang); ``model`` names the model that scores it.

    Slices are written before they ask, so that those that ask and those that get answers are the same, in whatever
    order ``rows`` comes and whichever tasks are run again.
    """
    laid = staged(rows.select("doc_id", "row_hash", "model", "text", "lang").mapInArrow(_laid, "slice long, blocks array<binary>"), "slices")
    slices = laid.count()
    asked = laid.mapInArrow(_ask(shards), "shard long, slice long, keys binary")
    copies = buckets_for(slices * SLICE_GRAMS, ASKED * shards)
    group = lambda copy: (F.col("shard") * copies + copy).alias("group")
    right = asked.select(group(F.pmod(F.xxhash64("slice"), F.lit(copies))), "shard", "slice", "keys", F.lit(None).cast("binary").alias("weights"))
    left = weights.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(group(F.col("copy")), "shard", F.lit(None).cast("long").alias("slice"), "keys", "weights")
    dealt = left.unionByName(right).repartition("group").sortWithinPartitions("group", F.col("slice").asc_nulls_first())
    answers = dealt.mapInArrow(_answer, "slice long, shard long, weights binary")
    return laid.repartition(max(1, slices), "slice").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_sum(shards), "doc_id long, row_hash long, lang string, ll long, n long")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang): symbols, perplexity, the threshold, marking words and ``keep``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(), F.coalesce("lang", F.lit("")).alias("lang"), text_of().alias("text"))
    trusted = staged(trusted_ids(labels), "trusted")
    near = sent(trusted, SENT_IDS)
    rows = rows.withColumn("model", F.lit(""))
    train = rows.join(near, "doc_id").where("NOT held_out").select(F.col("model").alias("lang"), "text")
    weights, shards = model(train, train.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    marking = sent(marking_words(rows, near.select("doc_id"), sent(staged(toxic_ids(labels), "toxic"), SENT_IDS)), SENT_WORDS)
    marked = words_of(rows).join(marking, "word").groupBy("doc_id", "row_hash").agg(F.count_distinct("word").alias("marks"))
    marked = staged(marked, "marked").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), "marks")
    scores = staged(scored(rows, weights, shards), "scores")
    nll = (-F.col("ll") / UNIT).alias("nll")
    held = staged(scores.where("n > 0").join(trusted.where("held_out").select("doc_id"), "doc_id").select("lang", nll, "n"), "held")
    drawn = lambda mean: (F.col("nll") + PRIOR * F.col(mean)) / (F.col("n") + PRIOR)
    quantiles = lambda mean: F.percentile_approx(drawn(mean), F.array(F.lit(0.5), F.lit(UPPER)), 10000)
    bound = F.col("q")[0] + SPREAD * (F.col("q")[1] - F.col("q")[0])
    means = held.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("held")).where(F.col("held") >= MIN_HELD)
    bounds = held.join(sent(staged(means, "means"), SENT_IDS), "lang").groupBy("lang").agg(F.first("mean").alias("mean"), quantiles("mean").alias("q"))
    bounds = sent(staged(bounds.select("lang", "mean", bound.alias("bound")), "bounds"), SENT_IDS)
    every = held.crossJoin(F.broadcast(held.agg((F.sum("nll") / F.sum("n")).alias("any_mean"))))
    every = every.agg(F.first("any_mean").alias("any_mean"), quantiles("any_mean").alias("q")).select("any_mean", bound.alias("any_bound"))
    made = scores.select("doc_id", "row_hash", "lang", nll, "n").join(bounds, "lang", "left").crossJoin(F.broadcast(every))  # one row
    made = made.withColumns({"mean": F.coalesce("mean", "any_mean"), "bound": F.coalesce("bound", "any_bound")})
    made = made.join(marked, made["doc_id"].eqNullSafe(marked["__id"]) & (made["row_hash"] == marked["__hash"]), "left")
    fluent = F.coalesce((F.col("n") == 0) | (drawn("mean") <= F.col("bound")), F.lit(True))
    marks = F.coalesce("marks", F.lit(0))
    return made.select("doc_id", "row_hash", "lang", F.col("n").alias("n_symbols"), F.when(F.col("n") > 0, F.exp(drawn("mean"))).alias("perplexity"), F.exp("bound").alias("threshold"), marks.alias("n_marking"), (fluent & (marks == 0)).alias("keep"))


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_hash")
