"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns give base spans. The field looks at the regions around digits and at-signs that they leave over: it cuts
a region into atoms and scores whole candidate segments by features of the segment as a unit (its digit groups, check
digit, separators, the nearest telling word before it: "call" speaks for a phone number, "order" against any kind).
Dynamic programming over segments of bounded length chooses boundaries and
types together. Its weights are fitted once per driver by conditional likelihood on regions made from templates.

Defined results: null and empty texts hold nothing; base spans always stay, added ones never overlap a base span; offsets
count code points, ends exclusive; rows that repeat an id are judged on their own; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Atoms of the longest segment; atoms of the longest region looked at in one piece (longer ones overlap by a segment).
LONGEST, REGION = 20, 120
#: Digits of a segment without letters, and its groups of digits at most: no kind has fewer or more.
DIGITS, MOST_GROUPS = (4, 20), 6
#: A region's chosen segment is added when its label is so likely given the region.
SURE = 0.9
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
#: Seven digits or more, at most three separators between two; or four groups between dots.
DOT = r" ?(?:\.|[(\[](?:\.|dot)[)\]]) ?"
NUMBERS = re.compile(rf"(?<![A-Za-z0-9])(?:[+(]{{0,2}}[0-9](?:[ ().\-/]{{0,3}}[0-9]){{6,}}|[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}})(?![A-Za-z0-9])")
MAILS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)+")
#: An address in words: at most four parts before its at-sign.
WORDED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: (?:dot|DOT) [A-Za-z0-9._%+-]++){0,3} (?:at|AT) [A-Za-z0-9-]++(?:(?: (?:dot|DOT) |\.)[A-Za-z0-9-]++)++")
GROUPS, LETTER, AT = re.compile("[0-9]+"), re.compile("[A-Za-z]"), re.compile(r"@|[(\[]at[)\]]")
QUAD = re.compile(rf"[0-9]+(?:{DOT}[0-9]+){{3}}")
DATED = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
SHAPE = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
FORMAT = "%s:%d:%d"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def octet(digits: str) -> bool:
    """Whether a number, however long it is written, is 255 at most."""
    rest = digits.lstrip("0")
    return len(rest) < 3 or len(rest) == 3 and rest <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out, done, at = [], 0, text.find("@")
    before = 0  # no address starts before this: the last at-sign or the end of the last address
    while at >= 0:
        before = max(before, done)
        start = before + len(text[before:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        before = at + 1
        at = text.find("@", max(at + 1, done))
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Words that tell what the number or address after them is, and those that tell it is none of the kinds.
CONTEXT = {
    "phone": ("phone", "tel", "telephone", "telefon", "telefono", "call", "ring", "text", "sms", "whatsapp", "mobile", "mobil", "handy", "cell", "fax"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "payment", "paid"),
    "ip": ("ip", "host", "server", "gateway", "ping", "dns"),
    "email": ("mail", "email", "contact", "write", "courriel", "correo"),
    "none": ("order", "serial", "invoice", "ref", "reference", "ticket", "tracking", "isbn", "issn", "sku", "part", "article", "item", "batch", "lot", "model", "version", "build", "release", "section", "chapter", "page", "figure", "case", "patent", "rechnung", "bestellung", "facture", "commande", "pedido", "factura"),
}
TOLD = {w: k for k, ws in CONTEXT.items() for w in ws}
#: Last labels of an address in words.
TLDS = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "nl", "ch", "uk", "eu", "us"))


def near(text: str, start: int) -> list[str]:
    """The feature of the nearest telling word in the 24 characters before a place."""
    for w in reversed(re.findall("[a-z]+", text[max(0, start - 24) : start].lower())):
        if w in TOLD:
            return [f"near={TOLD[w]}"]
    return []


def features(text: str, start: int, end: int, before: list[str]) -> list[str]:
    """Features of a candidate segment as a whole; ``before`` are those of the words before it."""
    span = text[start:end]
    groups = GROUPS.findall(span)
    digits = "".join(groups)
    n = len(digits)
    seps = "".join(sorted(set(span) - ALNUM))
    out = ["bias", f"digits={min(n, 20)}", f"groups={min(len(groups), 6)}", "seps=" + seps[:4], *before]
    shape = "-".join([str(min(len(g), 9)) for g in groups[:6]])
    out += ["shape=" + shape, f"form={shape}{seps[:4]}"]
    if not digits or not span[0].isalnum() and span[0] not in "+(" or not span[-1].isalnum():
        out.append("ragged")
    if 13 <= n <= 19 and luhn(digits):
        out.append("luhn")
    if digits and span[0] in "+(0123456789":
        lead = digits[0] if digits[0] in "01" else "n"
        out += ["lead=" + lead, f"lead={lead}:{min(len(groups), 6)}"]
    if len(groups) == 4 and n <= 12 and all(map(octet, groups)) and QUAD.fullmatch(span):
        out.append("quad")
    if span[0] == "+":
        out.append("plus")
    if ("@" in seps or "(" in seps or "[" in seps) and AT.search(span) and MAILS.fullmatch(text, start, end):
        out.append("mail")
    elif n < len(span) and " " in seps and WORDED.fullmatch(text, start, end):
        out.append("worded" if re.split("[ .]", span)[-1].lower() in TLDS else "words")
    if len(span) > n + len(seps) and LETTER.search(span):
        out.append("letters")
    if len(groups) > 2 and DATED.match(span):
        out.append("date")
    if text[max(0, start - 5) : start].lower() == " dot " or text[end : end + 5].lower() == " dot ":
        out.append("continued")
    if text[end : end + 1] in ALNUM or (text[start - 1] in ALNUM if start else False):
        out.append("inside")
    return out


class SemiMarkovField:
    """Weights by (label, feature); segments of label ``other`` are single atoms with weight 0."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def lattice(self, text: str, start: int, end: int):
        """(atom bounds, candidate segments by end atom: [(first atom, features)])."""
        atoms = [(start + m.start(), start + m.end()) for m in ATOM.finditer(text[start:end])]
        into: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(atoms) + 1)]
        digits, letters = [0], [0]
        for a, b in atoms:
            digits.append(digits[-1] + (b - a if text[a] in "0123456789" else 0))
            letters.append(letters[-1] + text[a].isalpha())
        for i, (a, _) in enumerate(atoms):
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            before, groups = near(text, a), 0
            for j in range(i + 1, min(len(atoms), i + LONGEST) + 1):
                b, plain = atoms[j - 1][1], letters[j] == letters[i]
                groups += digits[j] > digits[j - 1]
                if plain and (digits[j] - digits[i] > DIGITS[1] or groups > MOST_GROUPS):
                    break
                if b - a >= 7 and text[b - 1].isalnum() and not (plain and digits[j] - digits[i] < DIGITS[0]):
                    into[j].append((i, features(text, a, b, before)))
        return atoms, into

    def score(self, label: str, feats: list[str]) -> float:
        return sum(self.weights.get((label, f), 0.0) for f in feats)

    def marginals(self, into):
        """(log of the sum over all segmentations, probability of each (end, first, label))."""
        n = len(into) - 1
        scored = [[(i, k, self.score(k, f)) for i, f in into[j] for k in KINDS] for j in range(n + 1)]
        fore, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            fore[j] = _logsum([fore[j - 1]] + [fore[i] + s for i, _, s in scored[j]])
        paths: list[list[float]] = [[] for _ in range(n + 1)]
        for j in range(n, 0, -1):
            if j < n:
                back[j] = _logsum(paths[j])
            paths[j - 1].append(back[j])
            for i, _, s in scored[j]:
                paths[i].append(back[j] + s)
        total = fore[n]
        return total, {(j, i, k): math.exp(fore[i] + s + back[j] - total) for j in range(1, n + 1) for i, k, s in scored[j]}

    def best(self, into) -> list[tuple[int, int, str]]:
        """The best segmentation's segments (first, end, label) but ``other``."""
        n = len(into) - 1
        top, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            top[j], back[j] = top[j - 1], (j - 1, "other")
            for i, f in into[j]:
                for k in KINDS:
                    s = top[i] + self.score(k, f)
                    if s > top[j]:
                        top[j], back[j] = s, (i, k)
        out, j = [], n
        while j:
            i, k = back[j]
            if k != "other":
                out.append((i, j, k))
            j = i
        return out[::-1]

    def find(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        atoms, into = self.lattice(text, start, end)
        if not any(into):
            return []
        chosen = self.best(into)
        if not chosen:
            return []
        _, likely = self.marginals(into)
        return [(k, atoms[i][0], atoms[j - 1][1]) for i, j, k in chosen if likely[j, i, k] >= SURE]


def _logsum(xs: list[float]) -> float:
    m = max(xs)
    return m if m == -math.inf else m + math.log(sum(math.exp(x - m) for x in xs))


def templates(n: int = 1400, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Regions with their true spans: personal data in forms of many kinds, and numbers that are none."""
    import random

    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 8)))

    def luhned(body, right=True):
        return body + next(c for c in "0123456789" if luhn(body + c) == right)

    def cut(digits, sep, *sizes):
        ends = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        return sep.join(digits[a:b] for a, b in zip(ends, ends[1:]))

    def card(right=True):
        sep = r.choice((" ", "-", ".", "/"))
        return r.choice((lambda: cut(luhned(r.choice("3456") + d(14), right), sep, 4, 4, 4, 4), lambda: cut(luhned(r.choice(("34", "37")) + d(12), right), sep, 4, 6, 5)))()

    # by kind: forms that tell for themselves, and forms that only a word before them tells
    free = {
        "phone": (lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(2)}/{d(3)}/{d(6)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", *[lambda: f"0{d(r.choice((2, 3)))}{r.choice('-/')}{d(r.choice((6, 7, 8)))}"] * 2, lambda: "0" + " ".join((d(1), d(2), d(2), d(2), d(2)))),
        "card": (card,),
        "ip": (lambda: r.choice((" . ", "[.]", "(.)", "[dot]", " (dot) ")).join(str(r.randint(0, 255)) for _ in range(4)),),
        "email": (lambda: f"{w()}{r.choice((' @ ', ' (at) ', '[at]', ' [at] '))}{w()}{r.choice((' . ', '.', ' (dot) '))}{r.choice(('com', 'org', 'net'))}", lambda: f"{w()}{r.choice(('', ' dot ' + w()))} at {w()}{r.choice((' dot ', ' dot ', '.'))}{r.choice(('com', 'org', 'de', 'net', 'fr'))}"),
    }
    told = {
        "phone": (lambda: d(r.choice((9, 10, 11))), lambda: "0" + d(r.choice((9, 10))), lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(3)} {d(4)}", lambda: f"{d(3)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)} {d(7)}"),
        "card": (lambda: luhned("37" + d(12)),),
    }
    none = (
        lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}",
        lambda: d(r.choice((8, 9, 10, 11, 12, 14))),
        lambda: f"{d(1)}.{d(7)}",
        lambda: " ".join(d(3) for _ in range(r.choice((3, 4, 5)))),
        lambda: f"{d(4)}-{d(4)}",
        lambda: f"{d(3)}-{d(4)}",
        lambda: f"20{d(2)}-20{d(2)}",
        lambda: f"{r.randint(1, 9)}{d(1)} " + " ".join(d(2) for _ in range(4)),
        lambda: f"97{r.choice('89')}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{d(2)}/{d(2)}/20{d(2)} {d(2)}.{d(2)}",
        lambda: f"{w()} at {r.choice(('the', 'a', w()))} dot {w()}",
        lambda: card(False),
    )
    say = {
        "phone": ("call ", "tel ", "phone: ", "fax ", "mobile ", "telefon "),
        "card": ("card ", "visa ", "paid by card "),
        "ip": ("host ", "server ", "ip "),
        "email": ("mail ", "contact ", "email: "),
        "none": ("order ", "serial ", "invoice ", "ref ", "ticket ", "part ", "isbn ", "order no. ", "tracking "),
    }
    out = []
    for i in range(n):
        kind = (*KINDS, "none", "none", "none")[i % 7]
        lead, piece = r.choice(("", w() + " ", r.choice(say[kind]))), r.choice(free.get(kind, none))()
        if kind in told and r.random() < 0.4:
            lead, piece = r.choice(say[kind]), r.choice(told[kind])()
        elif kind == "none" and r.random() < 0.4:  # what a word before it denies
            other = r.choice(("phone", "card"))
            lead, piece = r.choice(say["none"]), r.choice(free[other] + told[other])()
        elif kind == "none" and r.random() < 0.2:  # what no word tells
            lead, piece = r.choice(("", w() + " ")), r.choice(told["phone"])()
        out.append((lead + piece + r.choice(("", " " + w(), ", " + w())), [(kind, len(lead), len(lead) + len(piece))] if kind != "none" else []))
    return out


@lru_cache(maxsize=1)
def fitted(rounds: int = 15, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple[str, str], float]:
    """Weights by stochastic gradient ascent on the conditional log-likelihood of the templates."""
    field, data = SemiMarkovField({}), []
    for text, true in templates():
        start, end = region_of(text)
        atoms, into = field.lattice(text, start, end)
        ends = {b: j + 1 for j, (_, b) in enumerate(atoms)}
        begins = {a: i for i, (a, _) in enumerate(atoms)}
        gold = {(ends[b], begins[a], k) for k, a, b in true if b in ends and a in begins}
        data.append((into, gold))
    w = field.weights
    for t in range(rounds):
        step = rate / (1 + 0.3 * t)
        for into, gold in data:
            _, likely = field.marginals(into)
            known = {(j, i): f for j in range(len(into)) for i, f in into[j]}
            for (j, i, k), p in likely.items():
                g = ((j, i, k) in gold) - p
                if abs(g) > 1e-4:
                    for f in known[j, i]:
                        w[k, f] = w.get((k, f), 0.0) * (1 - step * decay) + step * g
    return w


def region_of(text: str) -> tuple[int, int]:
    found = [m.span() for p in (NUMBERS, MAILS, WORDED) for m in p.finditer(text)]
    return (min(a for a, _ in found), max(b for _, b in found)) if found else (0, len(text))


def left_over(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``taken`` leaves of start to end."""
    out = []
    for a, b in sorted(taken):
        if a < end and b > start:
            if a > start:
                out.append((start, a))
            start = max(start, b)
    return [*out, (start, end)] if start < end else out


def found_in(text: str, start: int, end: int, field: SemiMarkovField) -> list[tuple[str, int, int]]:
    """What the field finds from start to end, in windows of REGION atoms.

    A window decides on the segments that begin LONGEST atoms or more before its end, which it holds whole; the next
    window begins there, or after the last segment that went further.
    """
    cuts = [start + m.start() for m in ATOM.finditer(text[start:end])] + [end]
    out, at, n = [], 0, len(cuts) - 1
    while at < n:
        to = min(n, at + REGION)
        until = cuts[n if to == n else to - LONGEST]
        new = [s for s in field.find(text, cuts[at], cuts[to]) if s[1] < until]
        out += new
        last = max([until, *(s[2] for s in new)])
        while at < n and cuts[at] < last:
            at += 1
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], field: SemiMarkovField) -> list[tuple[str, int, int]]:
    """What the field finds in what base spans leave of the regions."""
    found = []
    if re.search("[0-9]", text):
        found += [m.span() for m in NUMBERS.finditer(text)]
    if "@" in text or "(at)" in text or "[at]" in text:
        found += [m.span() for m in MAILS.finditer(text)]
    if " dot " in text or " DOT " in text or " at " in text or " AT " in text:
        found += [m.span() for m in WORDED.finditer(text)]
    out, taken = [], sorted((a, b) for _, a, b in base)
    for a, b in sorted(set(found)):
        new = [s for x, y in left_over(a, b, taken) for s in found_in(text, x, y, field)]
        out += new
        taken += [(x, y) for _, x, y in new]
    return out


def joined(spans) -> str:
    return ",".join(FORMAT % s for s in spans)


def _scan(weights):
    def run(batches):
        import pyarrow as pa

        from .common import text_slices

        field = SemiMarkovField(weights)
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = added_spans(text, base, field)
                for c, k in zip(cols, KINDS, strict=False):
                    c.append(sum(s[0] == k for s in base))
                cols[4].append(joined(base))
                cols[5].append(joined(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base spans counted by kind, base spans and all spans as ``kind:start:end`` lists."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_scan(fitted()), SHAPE)


def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = personal_data(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
