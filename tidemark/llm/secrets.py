"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

The patterns give base spans. Values that the patterns leave out, next to words such as ``password``, are judged by the
number of guesses they would cost: dynamic programming finds the cheapest segmentation into common words, dates,
repeats, sequences, keyboard walks and brute-force spans. Costly ones are added, cheap ones are not. Words are ranked by
how often the documents hold them, after a short fixed list of those that passwords hold. A value in quotes may hold
blanks. Placeholders (``${NAME}``, ``<your-key>``, a sentence that asks for a value) and code (a call, an attribute, an
index) are told apart by their form and never added.

Defined results: null and empty texts hold nothing; base spans always stay, added ones (kind ``assign``) overlap no base
span; offsets count code points, ends exclusive; rows that repeat an id are judged on their own; other columns are
ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
#: Words before a value that make it a credential; all of them hold one of HINTS.
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|pwd|credential)["']?\x20*[:=]\x20*(?:"([^"\r\n]{6,}+)"|'([^'\r\n]{6,}+)'|([^\s"']{6,}+))""", re.IGNORECASE | re.ASCII)
HINTS = ("passw", "passphrase", "secret", "token", "api", "key", "pwd", "credential")
#: Common password words, by rank.
WORDS = "password admin welcome letmein login master secret monkey dragon shadow summer winter spring autumn hello football baseball sunshine princess flower love test user root guest default change changeme example sample demo temp iloveyou trustno hunter batman superman pass word token key none null true false your here insert placeholder xxxx foo bar qwerty company server database private public access secure home work local host prod production staging develop developer debug build release master main branch value values string number field name username email phone address street city country account bank money coffee cookie cheese chocolate banana orange apple cherry lemon tiger lion eagle horse puppy kitten ninja pirate wizard knight prince queen king angel heaven blue green yellow purple silver golden black white happy lucky magic star moon ocean river forest mountain music guitar piano soccer hockey tennis golf basketball charlie george michael jordan thomas robert daniel jessica ashley jennifer michelle samsung google internet computer laptop window windows linux ubuntu docker redis mysql postgres oracle mongo rabbit kafka spark hadoop encrypted redacted hidden removed missing required optional empty unknown anonymous enter replace update goes sometext lorem ipsum".split()
#: Words of the documents that are ranked, and their letters at least and at most.
RANKED, LETTERS = 50_000, (3, 24)
#: Values that stand for another: a variable, something in brackets, stars; code; words of a request for a value.
STANDS_FOR = re.compile(r"""\$\{.*\}|\$\(.*\)|\$[A-Za-z_]\w*|\{\{.*\}\}|\{\w*\}|<.*>|%\(?\w+\)?[%s]|\[[^\]]*\]""", re.ASCII | re.DOTALL)
#: What stands for characters that are not shown; fewer than SHOWN others beside it make no value.
HIDDEN, SHOWN = re.compile(r"\*{3,}|[xX]{4,}|\.{3,}"), 8
CODE = re.compile(r"""[A-Za-z_][\w.:>-]*\(.*|[A-Za-z_][\w.]*\[.*|(?:[a-z_]+|[A-Z_]+)(?:(?:\.|::|->)(?:[a-z_]+|[A-Z_]+))+[;,)]*|(?:await|new|lambda|func|def|return)\b.*""", re.ASCII | re.DOTALL)
ASKS = frozenset("your enter insert here example placeholder change changeme todo replace must should please required invalid wrong missing forgot reset the is are was not be".split())
#: Rows of a keyboard.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Decimal logarithm of guesses from which a value counts as a secret; kinds of characters it must hold at least.
COSTLY, MIXED = 8.0, 2
#: Guesses for one character by brute force, as a decimal logarithm; longest piece looked at wherever it begins. Repeats of
#: up to ``PERIOD`` characters and sequences may be longer: such a piece begins where the run begins.
BRUTE, PIECE, PERIOD = 1.0, 24, 12
SHAPE = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
LEET = str.maketrans("4@30$15!7", "aaeossiit")
NEXT = {(r[i], r[i + 1]) for r in ROWS for i in range(len(r) - 1)}
DATE = re.compile(r"(?:(?:19|20)[0-9]{2})(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12][0-9]|3[01]))?|(?:0[1-9]|[12][0-9]|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)[0-9]{2}")


def stands_for(value: str, quoted: bool) -> bool:
    """Whether a value is a placeholder, or outside quotes code."""
    if STANDS_FOR.fullmatch(value) or (not quoted and CODE.fullmatch(value)):
        return True
    shown = HIDDEN.sub("", value)
    if shown != value and len(shown) < SHOWN:
        return True
    words = re.findall("[a-z]+", value.lower())
    letters = sum(map(len, words))
    return bool(ASKS.intersection(words)) and letters >= 0.8 * len(re.sub(r"[\s_.-]", "", value))


def word_ranks(docs: DataFrame, most: int = RANKED) -> dict[str, int]:
    """Ranks of the words that passwords hold, then of the ``most`` words that ``docs`` hold most often, of equals the smaller first."""
    from .collocations import _count, texts

    plain = F.col("word").rlike("^[a-z]{%d,%d}$" % LETTERS)
    counts = texts(docs.withColumn("lang", F.lit(""))).mapInArrow(_count, "lang string, word string, n long").where(plain).groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where(~F.col("word").isin(WORDS)).orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()  # at most ``most`` words
    return RANKS | {w: i for i, w in enumerate(top.column("word").to_pylist(), len(WORDS) + 1)}


def piece_cost(piece: str, ranks: dict[str, int] | None = None) -> float:
    """Decimal logarithm of the guesses for one piece by its cheapest pattern."""
    n, low = len(piece), piece.lower()
    ranks = RANKS if ranks is None else ranks
    best = BRUTE * n + (0.5 if n == 1 else 0.0)
    case = 0.3 if piece not in (low, low.title(), low.upper()) else 0.0 if piece == low else 0.2
    for form, extra in ((low, 0.0), (low.translate(LEET), 0.5)):
        if form in ranks:
            best = min(best, math.log10(ranks[form] + 1) + case + extra)
        if form[::-1] in ranks:
            best = min(best, math.log10(ranks[form[::-1]] + 1) + case + extra + 0.3)
    if DATE.fullmatch(piece):
        best = min(best, 2.1 if n == 4 else 4.6)
    if n >= 3:
        for k in range(1, n // 2 + 1):
            if n % k == 0 and piece == piece[:k] * (n // k):
                best = min(best, BRUTE * k + math.log10(n // k) + 0.2)
                break
        steps = {ord(b) - ord(a) for a, b in zip(piece, piece[1:], strict=False)}
        if steps in ({1}, {-1}):
            best = min(best, 1.5 + math.log10(n))
        pairs = list(zip(low, low[1:], strict=False))
        if all(p in NEXT for p in pairs) or all(p[::-1] in NEXT for p in pairs):
            best = min(best, 1.7 + math.log10(n) + case)
    return best


def long_pieces(value: str):
    """For each end, the longest pieces over PIECE characters that are a repeat or a sequence, as (start, cost)."""
    same, step = [0] * (PERIOD + 1), [0, 0]
    for j in range(1, len(value) + 1):
        found = []
        for k in range(1, PERIOD + 1):
            same[k] = same[k] + 1 if j > k and value[j - 1] == value[j - 1 - k] else 0
            times = same[k] // k + 1
            if times > 1 and times * k > PIECE:
                found.append((j - times * k, BRUTE * k + math.log10(times) + 0.2))
        for x, way in enumerate((1, -1)):
            step[x] = step[x] + 1 if j > 1 and ord(value[j - 1]) - ord(value[j - 2]) == way else 0
            if step[x] >= PIECE:
                found.append((j - step[x] - 1, 1.5 + math.log10(step[x] + 1)))
        yield j, found


def cheapest(value: str, most: float = math.inf, ranks: dict[str, int] | None = None):
    """For each end of a piece: least cost of the prefix, order of pieces included, if below ``most``, and whether a long piece ends there."""
    best: list[dict[int, float]] = [{0: 0.0}]  # by end, then by number of pieces: the order in which they are tried costs a factorial
    for j, longer in long_pieces(value):
        now: dict[int, float] = {}
        for i, cost in [(i, None) for i in range(max(0, j - PIECE), j)] + longer:
            if best[i]:
                cost = piece_cost(value[i:j], ranks) if cost is None else cost
                for k, c in best[i].items():
                    if c + cost < now.get(k + 1, math.inf):
                        now[k + 1] = c + cost
        kept, least = {}, math.inf
        for k in sorted(now):  # more pieces must cost less by themselves
            if now[k] < least and now[k] + math.lgamma(k + 1) / math.log(10) < most:
                kept[k] = least = now[k]
        best.append(kept)
        yield min((c + math.lgamma(k + 1) / math.log(10) for k, c in kept.items()), default=most), bool(longer)


def guess_cost(value: str) -> float:
    """Decimal logarithm of the guesses for ``value``: the least, over all segmentations, of the pieces' costs plus that of their number."""
    least = 0.0
    for least, _ in cheapest(value):
        pass
    return least


def costly(value: str, ranks: dict[str, int] | None = None) -> bool:
    """Whether ``guess_cost`` is COSTLY or more, told from as short a prefix as tells it.

    Every segmentation without long pieces has an end within any PIECE characters in a row, and costs at least what it
    costs up to there; so the rest does not matter once all prefixes that end in such a stretch are costly and no long
    piece that began before it goes on. A piece costs log10(2) at least, so that comes soon in values that hold no long runs.
    """
    least, run = 0.0, 0
    for least, longer in cheapest(value, COSTLY, ranks):
        run = run + 1 if least >= COSTLY and not longer else 0
        if run > PIECE:
            return True
    return least >= COSTLY


def mixture(value: str) -> int:
    return sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start, then kind as listed."""
    out = [("hex", *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if hinted(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in HINTS)


def left_over(start: int, end: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What ``base`` (by start) leaves of start to end."""
    out = []
    for _, a, b in base:
        if a < end and b > start:
            if a > start:
                out.append((start, a))
            start = max(start, b)
    return [*out, (start, end)] if start < end else out


def added_spans(text: str, base: list[tuple[str, int, int]], ranks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """Costly values that no base span touches, with what makes them a credential; of others, the costly parts beside base spans."""
    out = []
    if hinted(text):
        for m in CONTEXT.finditer(text):
            first, last = next(m.span(g) for g in (1, 2, 3) if m[g] is not None)
            if stands_for(text[first:last].strip(), m[3] is None):
                continue
            for a, b in left_over(*m.span(), base):
                value = text[max(a, first) : min(b, last)].rstrip(".,;:")
                if (mixture(value) >= MIXED or " " in value.strip()) and costly(value, ranks):
                    out.append(("assign", a, b))
    return out


def joined(spans) -> str:
    return ",".join("%s:%d:%d" % s for s in spans)


def _scan(batches, ranks):
    import pyarrow as pa

    from .common import text_slices

    for batch in (part for whole in batches for part in text_slices(whole, 1)):
        cols: list[list] = [[] for _ in range(5)]
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            for c, k in zip(cols, KINDS, strict=False):
                c.append(sum(s[0] == k for s in base))
            cols[3].append(joined(base))
            cols[4].append(joined(sorted(base + added_spans(text, base, ranks), key=lambda s: (s[1], KINDS.index(s[0])))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])


def secrets_in(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base spans counted by kind, base spans and all spans as ``kind:start:end`` lists."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))  # RANKED words and a few
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(lambda batches: _scan(batches, ranks.value), SHAPE)


def op10_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = secrets_in(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
