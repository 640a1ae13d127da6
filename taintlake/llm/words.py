"""Vectorised word hashing for Arrow batches of text.

A word is a maximal run of bytes other than space and \\x09-\\x0D.  All hashes are
64-bit polynomial prefix sums modulo 2^64 with odd bases, so the hash of any span
of words is a difference of two prefix sums times an inverse power.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        known = (pair[0], pair[1])
        if size <= 1 << 23:  # keep what usual batches need, not what one huge text needs
            _POWERS[base] = known
    return known[0][:n], known[1][:n]


def spans(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers for `span_hash`."""
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return sums, inverse


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, inverse = prefix
    return mix((sums[end] - sums[start]) * inverse[start])


class Words:
    """The words of some texts: `data` bytes, `start`/`end` byte offsets per word,
    `first` word of each text (one more entry at the end), `text` index per word,
    `prefix` for hashes of spans of words."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        buf = texts.buffers()[2]
        raw = np.frombuffer(buf, np.uint8)[offsets[0]:offsets[-1]] if buf is not None and len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        if texts.null_count:  # a null may cover bytes; give it none
            lengths = np.where(np.asarray(texts.is_valid()), np.diff(offsets), 0)
            keep = np.repeat(np.asarray(texts.is_valid()), np.diff(offsets))
            raw, offsets = raw[keep], np.concatenate(([0], np.cumsum(lengths)))
        inside = ~_SPACE[raw]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        fresh[heads] = inside[heads]  # a text's first byte starts a word of its own
        last = inside.copy()
        last[:-1] &= ~inside[1:] | fresh[1:]
        self.data, self.offsets = raw, offsets
        self.start, self.end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.word = span_hash(spans(_BYTES[raw], _BYTE_BASE), self.start, self.end)
        self.prefix = spans(self.word, _WORD_BASE)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, start: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Hash of n words from each start."""
        return span_hash(self.prefix, start, start + n)

    def windows(self, n: int) -> np.ndarray:
        """Starts of all windows of n words inside one text."""
        if len(self) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[:len(self) - n + 1] == self.text[n - 1:])

    def minimisers(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Window starts (n words) and, for each, the position of its minimiser: the
        leftmost k-word group with the smallest hash in the window."""
        at = self.windows(n)
        if not len(at):
            return at, at
        groups = np.arange(len(self) - k + 1)
        value = self.hashes(groups, k)
        best, where = value[:len(self) - n + 1].copy(), np.zeros(len(self) - n + 1, np.int16)
        for j in range(1, n - k + 1):
            here = value[j:j + len(best)]
            less = here < best
            best[less], where[less] = here[less], j
        return at, at + where[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from a[i] and from b[i] on, inside their texts: steps
        double while spans are equal, then halve."""
        length = np.zeros(len(a), np.int64)
        room = np.minimum(self.first[self.text[a] + 1] - a, self.first[self.text[b] + 1] - b) if len(a) else length
        return extend(length, room, lambda i, at, n: self.hashes(a[i] + at, n) == self.hashes(b[i] + at, n))


def extend(length: np.ndarray, room: np.ndarray, equal) -> np.ndarray:
    """Grow length[i] up to room[i] while equal(i, from, count) holds: steps double, then halve."""
    active, step = np.flatnonzero(room > 0), 1
    settle: list[tuple[int, np.ndarray]] = []
    while len(active):
        fits = length[active] + step <= room[active]
        good = fits.copy()
        good[fits] = equal(active[fits], length[active[fits]], step)
        settle.append((step, active[~good]))
        active = active[good]
        length[active] += step
        step *= 2
    for step, _ in reversed(settle):  # a failed step of n leaves less than n to find
        step //= 2
        if not step:
            continue
        i = np.concatenate([s for n, s in settle if n > step])
        i = i[length[i] + step <= room[i]]
        i = i[equal(i, length[i], step)]
        length[i] += step
    return length


def slices(texts: pa.Array, limit: int = 2 << 20) -> list[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each; a longer text is alone."""
    if not len(texts):
        return []
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    out, start, held = [], 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and (held + n > limit or i - start >= 20_000):
            out.append((start, i))
            start, held = i, 0
        held += n
    return out + [(start, len(size))]
