"""Token ids of whole texts, a batch at a time, by the ``tokenizers`` library.

A byte-level BPE merges only inside the pieces of its splitting pattern, so a text may be cut before any
lone blank or line feed between two other characters and the parts encoded one by one. Such parts repeat
often; each is encoded once per worker and found again by a 128-bit hash computed for a whole batch at once.
"""

from __future__ import annotations

import numpy as np

#: Two odd multipliers of the polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Parts longer than this many bytes are encoded each time instead of being kept.
LONGEST_KEPT = 64
#: Closing marks, alone or in a row one piece of the splitting pattern.
MARKS = ".,;:!?#$%&*|()\"-"
#: A worker starts its store of parts anew when it holds so many.
MOST_KEPT = 480_000


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class PrefixHash:
    """Hashes of any spans of a byte array, modulo 2**64, for one odd base."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw) + 1
        if len(self._up) < n:
            self._up, self._down = powers(self.base, n * 5 // 4), powers(self.inverse, n * 5 // 4)
        out = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._up[: len(raw)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self._down[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class BatchEncoder:
    """Encodes columns of texts with one tokenizer file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.small, self.spell = self.tokenizer.model, {}, byte_letters()
        self.hashes = [PrefixHash(b) for b in BASES]
        self._reset()

    def _reset(self) -> None:
        self.kept = 0
        self.size = 1 << 18
        self.slots = np.full(self.size, -1, np.int32)  # index of a kept part
        self.keys = np.zeros((2, 1 << 16), np.uint64)
        self.start = np.zeros(1 << 16, np.int32)
        self.count = np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _store(self, h: np.ndarray, ids: list[list[int]]) -> None:
        n = self.kept + len(ids)
        while n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
        flat = np.array([i for x in ids for i in x], np.uint32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start[self.kept : n] = self.used + np.cumsum(lengths) - lengths
        self.count[self.kept : n] = lengths
        self.keys[:, self.kept : n] = h
        self.used += len(flat)
        first, self.kept = self.kept, n
        if 2 * n > self.size:
            while 2 * n > self.size:
                self.size *= 2
            self.slots, first = np.full(self.size, -1, np.int32), 0
        self._place(np.arange(first, n))

    def _place(self, new: np.ndarray) -> None:
        """Open addressing: each round places at most one part in a free slot, the others move on by one."""
        mask = np.uint64(self.size - 1)
        at = (mixed(self.keys[0, new]) & mask).astype(np.int64)
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            left = self.slots[at] != new
            new, at = new[left], (at[left] + 1) & (self.size - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each part, -1 where it isn't kept."""
        out = np.full(h.shape[1], -1, np.int64)
        at = (mixed(h[0]) & np.uint64(self.size - 1)).astype(np.int64)
        rest = np.arange(h.shape[1])
        while len(rest):
            got = self.slots[at]
            same = (got >= 0) & (self.keys[0, got] == h[0, rest]) & (self.keys[1, got] == h[1, rest])
            out[rest[same]] = got[same]
            on = (got >= 0) & ~same
            rest, at = rest[on], (at[on] + 1) & (self.size - 1)
        return out

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted starts of the parts: each text's start, and lone blanks or line feeds between characters that are surely no white space."""
        n = len(raw)
        at = np.flatnonzero((raw == 32) | (raw == 10))
        at = at[(at > 0) & (at < n - 1)]
        after, before = raw[at + 1], raw[at - 1]
        fine = (after > 32) & (before > 32) & (after != 0xC2) & ((after < 0xE1) | (after > 0xE3))
        two, three = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
        fine &= (before < 0x80) | ((two != 0xC2) & ((three < 0xE1) | (three > 0xE3)))
        cut = np.zeros(n, bool)
        cut[at[fine]] = True
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of texts laid end to end as UTF-8."""
        texts = len(offsets) - 1
        if self.kept > MOST_KEPT or self.used > 8 * MOST_KEPT:
            self._reset()
        starts = self._cuts(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        text = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.append(starts[1:], len(raw))
        h = np.stack([x.spans(x.sums(raw), starts, ends) for x in self.hashes])
        index = self._find(h)
        lost = np.flatnonzero(index < 0)
        data = raw.tobytes()
        long_ids: dict[int, np.ndarray] = {}
        if len(lost):
            size = (ends - starts)[lost]
            short = lost[size <= LONGEST_KEPT]
            for i in lost[size > LONGEST_KEPT]:
                long_ids[int(i)] = np.array(self._encode([data[starts[i] : ends[i]].decode()])[0], np.uint32)
            while len(short):  # again only for parts that share a first hash with another
                new = short[np.unique(h[0, short], return_index=True)[1]]
                self._store(h[:, new], [self._word(data[a:b].decode()) for a, b in zip(starts[new], ends[new], strict=True)])
                index[short] = self._find(h[:, short])
                short = short[index[short] < 0]
        begin, count = (np.where(index >= 0, x[index], 0).astype(np.int64) for x in (self.start, self.count))
        if not long_ids:
            ids = self.pool[ragged(begin, count)]
        else:
            extra = np.concatenate(list(long_ids.values()))
            at = self.used
            pool = np.concatenate([self.pool[:at], extra])
            for i, x in long_ids.items():
                begin[i], count[i] = at, len(x)
                at += len(x)
            ids = pool[ragged(begin, count)]
        return ids, np.bincount(text, weights=count, minlength=texts).astype(np.int64)

    def _word(self, part: str) -> list[int]:
        """Ids of a part. Latin letters between a blank or line feed and closing marks are three pieces, which the model encodes straight away."""
        body = part.rstrip(MARKS)
        word = body[1:] if body[:1] in (" ", "\n") else body
        if not word.isalpha() or max(word) >= "\u0250":
            return self._encode([part])[0]
        lead = []
        if body[:1] == "\n":
            lead, body = self._small("\n"), word
        ids = [t.id for t in self.model.tokenize(body.encode().decode("latin-1").translate(self.spell))]
        return lead + ids + self._small(part[len(part.rstrip(MARKS)) :])

    def _small(self, piece: str) -> list[int]:
        if piece not in self.small:
            self.small[piece] = self._encode([piece])[0] if piece else []
        return self.small[piece]

    def _encode(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the end id after each text, offsets of the texts in them)."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(bounds[-1], end, np.uint32)
    keep = np.ones(bounds[-1], bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder_for(path: str) -> BatchEncoder:
    """The worker's encoder of a tokenizer file; later tasks of the same worker find its parts again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]
