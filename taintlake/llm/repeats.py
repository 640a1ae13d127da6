"""Quality rules with suffix-array repetition.

Each text gets the suffix array of its words (prefix doubling; a round sorts only the
suffixes that are still tied) and the longest common prefixes of neighbours.  The
intervals of common prefixes are the text's repeated substrings that cannot go on to the
right; those that cannot go on to the left either are maximal.  The union of their spans
gives the covered share of a text.  A text is kept if that share and the longest repeat
stay within limits, and if the base rules (length, repeated three-word windows) pass.

A text is analysed by itself, so nothing is shuffled and no text meets another one.
Suffix arrays of many short texts are built at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taintlake.llm.words import Words, slices

#: Repeats below this many words are turns of phrase and count for the base rules only.
MIN_REPEAT = 10
#: Most of a text that may lie in repeats, and the longest repeat, in words.
MAX_COVERED, MAX_REPEAT = 0.3, 100
MIN_WORDS, WINDOW = 50, 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class SuffixArray:
    """`order` holds word positions, text by text, in the order of their suffixes; `lcp[r]`
    is the number of words that suffix r shares with the one before it, 0 at a text's first."""

    def __init__(self, words: Words):
        n = len(words)
        self.words = words
        _, letter = np.unique(words.word, return_inverse=True)
        first = words.text.astype(np.int64) << 32 | letter
        self.order = np.argsort(first, kind="stable")
        rank = np.zeros(n, np.int64)
        slots, key, step = np.arange(n), first[self.order], 1
        while len(slots):
            head = np.concatenate(([True], key[1:] != key[:-1]))
            rank[self.order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
            tied = ~head | ~np.append(head[1:], True)
            slots = slots[tied]
            at = self.order[slots]
            after = np.minimum(at + step, n - 1)
            inside = (at + step < n) & (words.text[after] == words.text[at])
            key = rank[at] * (n + 1) + np.where(inside, rank[after] + 1, 0)
            within = np.argsort(key, kind="stable")
            self.order[slots], key = at[within], key[within]
            step *= 2
        self.lcp = np.zeros(n, np.int64)
        a, b = self.order[:-1], self.order[1:]
        same = np.flatnonzero(first[a] == first[b])
        self.lcp[same + 1] = words.common(a[same], b[same])

    def covered(self, least: int) -> np.ndarray:
        """Marks of words that lie in a substring of `least` words or more that occurs
        twice: the deepest interval around a suffix tells how far its repeat reaches."""
        reach = np.maximum(self.lcp, np.append(self.lcp[1:], 0)) if len(self.lcp) else self.lcp
        long = reach >= least
        marks = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marks, self.order[long], 1)
        np.add.at(marks, self.order[long] + reach[long], -1)
        return np.cumsum(marks)[:-1] > 0

    def maximal(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal repeats of `least` words or more: first and last rank of each
        interval of common prefixes, and its length."""
        found: list[tuple[int, int, int]] = []
        stack: list[tuple[int, int]] = []
        before = -2
        ranks = np.flatnonzero(self.lcp >= least)
        for r, value in zip(ranks.tolist(), self.lcp[ranks].tolist(), strict=True):
            if r != before + 1:
                found += [(lo, before, v) for lo, v in stack]
                stack = []
            lo = r - 1
            while stack and stack[-1][1] > value:
                lo, v = stack.pop()
                found.append((lo, r - 1, v))
            if not stack or stack[-1][1] < value:
                stack.append((lo, value))
            before = r
        found += [(lo, before, v) for lo, v in stack]
        lo, hi, length = np.array(found, np.int64).reshape(-1, 3).T
        w = self.words
        starts = np.zeros(len(w) + 1, bool)
        starts[w.first] = True
        at = self.order
        other = np.concatenate(([True], w.word[at[1:] - 1] != w.word[at[:-1] - 1])) if len(at) else np.zeros(0, bool)
        other |= starts[at]  # nothing is left of a text's first word
        other[1:] |= starts[at[:-1]]
        sums = np.concatenate(([0], np.cumsum(other)))
        left = sums[hi + 1] > sums[lo + 1]
        return lo[left], hi[left], length[left]


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(marks)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif not line.isspace() and line:
            seen.add(line)
    return n


def _measures(texts: pa.Array, least: int) -> dict[str, np.ndarray]:
    w = Words(texts)
    sa = SuffixArray(w)
    raw = w.data.tobytes()
    in_word = np.zeros(len(raw) + 1, np.int64)
    np.add.at(in_word, w.start, 1)
    np.add.at(in_word, w.end, -1)
    letters = (np.cumsum(in_word)[:-1] > 0) & ((w.data & 0xC0) != 0x80)
    lo, _, length = sa.maximal(least)
    whose = w.text[sa.order[lo]] if len(lo) else lo
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, whose, length)
    return {"n_words": np.diff(w.first), "word_chars": _per_text(letters, w.offsets), "n_symbols": _per_text(_SYMBOL[w.data], w.offsets),
            "n_dup_lines": np.array([_duplicate_lines(raw[s:e]) for s, e in zip(w.offsets[:-1], w.offsets[1:], strict=True)], np.int64),
            "n_repeat_words": _per_text(sa.covered(WINDOW), w.first), "n_repeats": np.bincount(whose, minlength=len(texts)),
            "n_covered": _per_text(sa.covered(least), w.first), "longest_repeat": longest}


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "n_covered", "longest_repeat"]


def judge(docs: DataFrame, carry: tuple[str, ...] = (), min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
          max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per row of `docs`: doc_id, the `carry` columns, the measures, base_failed
    and kept.

    n_repeats counts the maximal repeats of `min_repeat` words or more, n_covered the words
    in their spans, longest_repeat their greatest length (0 without one).  A text goes if
    base_failed, if n_covered > max_covered * n_words or if longest_repeat > max_repeat.

    A null or empty text has no words and fails.  Rows are judged one by one, so repeated
    rows give repeated results, and doc_id may be null.  Columns of `docs` that are not
    named in `carry` are ignored, whatever their names."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]
                          + [T.StructField(f"carry_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
                          + [T.StructField(c, T.LongType()) for c in _FIELDS])
    rows = docs.select("doc_id", *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col("text").cast("string").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in slices(batch["text"]):
                part = batch.slice(s, e - s)
                found = _measures(part["text"], min_repeat)
                yield pa.RecordBatch.from_arrays([part[c] for c in part.schema.names[:-1]] + [pa.array(found[c], pa.int64()) for c in _FIELDS],
                                                 part.schema.names[:-1] + _FIELDS)

    out = rows.mapInArrow(measured, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (out.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat))
            .withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)}))


def repeated_substrings(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """Maximal repeats of every text, a row for each: doc_id, start (word number of one
    occurrence), n_words, occurrences.  Texts without one have no row."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in slices(batch["text"]):
                part = batch.slice(s, e - s)
                w = Words(part["text"])
                sa = SuffixArray(w)
                lo, hi, length = sa.maximal(min_repeat)
                at = sa.order[lo]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(w.text[at], pa.int64())), pa.array(at - w.first[w.text[at]], pa.int64()),
                                                  pa.array(length, pa.int64()), pa.array(hi - lo + 1, pa.int64())], ["doc_id", "start", "n_words", "occurrences"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(listed, f"doc_id {kind}, start long, n_words long, occurrences long")
