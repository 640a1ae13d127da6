"""Periodic runs of words by Baier's grouping.

Phase one of Baier's suffix sorter handles groups of suffixes from the greatest down.  A
group's common context is then the longest Lyndon word at each of its members, so the
Lyndon array falls out of the grouping itself; it is taken under both orders of the
words.  Every run holds a Lyndon word of its period that is the longest one at its start
under one of the two orders.  So each (start, length) of both arrays is tried as a root:
the longest common extensions to the right and to the left, of the text and the text
moved on by the root, give the run.

A word can lie in a run only if a window of three words around it occurs three times or
more in the text, one of them no further away than a quarter of the stretch under study.  Stretches
that fail this are left out before the grouping, which is exact and spares plain prose
the sequential part.  A text is analysed by itself; nothing is shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taintlake.llm.words import Words, extend, mix, slices, span_hash, spans

#: A run has at least so many words, and so many times its period.
MIN_LENGTH, MIN_PERIODS = 6, 4
_BASE = 0xA0761D6478BD642F
_WINDOW = 3
RUN = "struct<start:long,length:long,period:long>"


def lyndon_array(letters: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position.  Letters are
    numbers from 1; 0 is an end mark, less than all letters, and gets 0.

    Groups form a chain from the least to the greatest.  A list links the positions
    that no longer word has taken in yet; when a group is handled, its members are
    out of it, and what stands before k of them in a row grows by k contexts: it moves
    to a new group right above its own, higher for greater k."""
    n = len(letters)
    group = list(letters)
    greatest = max(letters, default=0)
    size = [1] * (greatest + 1)
    members: list[list[int]] = [[] for _ in range(greatest + 1)]
    for i, c in enumerate(letters):
        members[c].append(i)
    above, below = list(range(1, greatest + 2)), list(range(-1, greatest))
    left, right = list(range(-1, n)), list(range(1, n + 1))
    out = [0] * n
    g = greatest
    while g > 0:
        length, moved = size[g], {}
        for i in members[g]:
            if group[i] != g:
                continue
            out[i] = length
            before = left[i]
            if before >= 0 and group[before] == g:
                continue  # told with the first of its row
            after, k = right[i], 1
            while after < n and group[after] == g:
                after, k = right[after], k + 1
            if before >= 0:
                right[before] = after
                moved.setdefault((group[before], k), []).append(before)
            left[after] = before
        low = last = -1
        for old, k in sorted(moved):
            if not old:
                continue
            if old != last:
                low = last = old
            # Greater k go above what has just been made for less.
            fresh, high = len(size), above[low]
            size.append(size[old] + k * length)
            members.append(moved[old, k])
            above.append(high)
            below.append(low)
            above[low] = below[high] = fresh
            low = fresh
            for i in moved[old, k]:
                group[i] = fresh
        members[g] = []
        g = below[g]
    return out


def _stretches(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one words of the stretches that may hold a run."""
    at = w.windows(_WINDOW)
    value = w.hashes(at, _WINDOW)
    begin, end = w.first[:-1], w.first[1:]
    stretch = w.text
    while len(at):
        before = len(at)
        key = mix(value ^ mix(stretch[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        key, here = key[order], at[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        count = np.diff(np.append(np.flatnonzero(fresh), len(key)))
        gap = np.where(fresh, 1 << 62, here - np.concatenate(([0], here[:-1])))
        near = np.minimum(gap, np.append(gap[1:], 1 << 62))
        size = (end - begin)[stretch[here]]
        alive = (count[np.cumsum(fresh) - 1] >= 3) & (near * MIN_PERIODS <= size) & (size >= MIN_LENGTH)
        kept = np.sort(order[alive])
        at, value = at[kept], value[kept]
        marks = np.zeros(len(w) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + _WINDOW, -1)
        inside = np.cumsum(marks)[:-1] > 0
        # Windows do not cross texts, but the last of one may touch the first of the next.
        head = inside & np.concatenate(([True], ~inside[:-1] | (w.text[1:] != w.text[:-1])))
        tail = inside & np.concatenate((~inside[1:] | (w.text[1:] != w.text[:-1]), [True]))
        begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        stretch = np.cumsum(head) - 1
        if before - len(at) <= before >> 3:  # pruning is exact wherever it stops
            break
    if not len(at):
        return at, at
    long = end - begin >= MIN_LENGTH
    return begin[long], end[long]


def _reach(letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common extensions from a[i] and b[i] > a[i] to the right; 0 ends both."""
    prefix = spans(mix(letters.astype(np.uint64) + np.uint64(_BASE)), _BASE)
    stop = np.flatnonzero(letters == 0)
    room = stop[np.searchsorted(stop, b)] - b
    return extend(np.zeros(len(a), np.int64), room,
                   lambda i, at, n: span_hash(prefix, a[i] + at, a[i] + at + n) == span_hash(prefix, b[i] + at, b[i] + at + n))


def runs_of(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in stretches of letters (from 1), each
    stretch between two zeros."""
    n, top = len(letters), int(letters.max(initial=0)) + 1
    root, period = [], []
    for order in (letters, np.where(letters > 0, top - letters, 0)):
        length = np.array(lyndon_array(order.tolist()), np.int64)
        root.append(np.flatnonzero(length))
        period.append(length[length > 0])
    both = np.unique(np.concatenate(root) * (n + 1) + np.concatenate(period))
    at, q = both // (n + 1), both % (n + 1)
    right = _reach(letters, at, at + q)
    back = letters[::-1]
    left = _reach(back, n - (at + q), n - at)
    length = left + q + right
    good = (length >= MIN_LENGTH) & (length >= MIN_PERIODS * q)
    found = np.unique(np.stack((at[good] - left[good], q[good], length[good])), axis=1)
    for s, p, size in found.T.tolist():  # hashes decide above; look at the words of what they found
        whole = letters[s:s + size]
        if not ((whole[p:] == whole[:-p]).all() and letters[s - 1] != letters[s - 1 + p] and letters[s + size] != letters[s + size - p]):
            raise ArithmeticError("two spans of words share a 64-bit hash")
    return found[0], found[2], found[1]


def _text_runs(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some texts, and start (word number among all), length and period of their runs."""
    w = Words(texts)
    begin, end = _stretches(w)
    if not len(begin):
        return w, begin, begin, begin
    size = end - begin
    offset = np.cumsum(size + 1) - size  # of each stretch, behind its zero
    letters = np.zeros(int(offset[-1] + size[-1]) + 1, np.int64)
    where = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    raw, known = w.data.tobytes(), {}
    letters[where + np.repeat(offset - begin, size)] = [known.setdefault(raw[s:e], len(known) + 1)
                                                        for s, e in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)]
    start, length, period = runs_of(letters)
    start = start + (begin - offset)[np.searchsorted(offset, start, "right") - 1]
    order = np.lexsort((period, start))
    return w, start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, the `carry` columns, n_words, runs (by start,
    then period), n_dropped, collapsed_sha256, and with `with_text` collapsed_text.

    A run is a stretch of words with smallest period q, of max(6, 4q) words or more, that
    neither neighbour extends.  The collapsed text drops words that any run contains behind
    its first q words, and joins the others by one space.

    A null text has no words, no run and an empty collapsed text.  Rows are taken one by
    one: doc_id may be null or repeat.  Columns of `docs` not named in `carry` are
    ignored, whatever their names."""
    names = ["doc_id"] + [f"carry_{i}" for i in range(len(carry))]
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names[1:], carry, strict=True)]
    schema = T.StructType(fields + [T.StructField("n_words", T.LongType())]
                          + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "lengths", "periods")]
                          + [T.StructField("n_dropped", T.LongType()), T.StructField("collapsed_sha256", T.StringType())]
                          + ([T.StructField("collapsed_text", T.StringType())] if with_text else []))
    rows = docs.select("doc_id", *[F.col(c).alias(n) for c, n in zip(carry, names[1:], strict=True)], F.col("text").cast("string").alias("text"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                yield _collapsed(batch.slice(lo, hi - lo), names, with_text)

    out = rows.mapInArrow(collapse, schema)
    runs = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")))
    rest = ["n_dropped", "collapsed_sha256"] + ["collapsed_text"] * with_text
    return out.select("doc_id", *[F.col(n).alias(c) for c, n in zip(carry, names[1:], strict=True)], "n_words", runs.alias("runs"), *rest)


def _collapsed(part: pa.RecordBatch, names: list[str], with_text: bool) -> pa.RecordBatch:
    w, start, length, period = _text_runs(part["text"])
    marks = np.zeros(len(w) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    dropped = np.cumsum(marks)[:-1] > 0
    sums = np.concatenate(([0], np.cumsum(dropped)))
    n_dropped = sums[w.first[1:]] - sums[w.first[:-1]]
    raw, kept = w.data.tobytes(), []
    for i, (lo, hi) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)):
        words = raw[lo:hi].split()
        if n_dropped[i]:
            gone = dropped[w.first[i]:w.first[i + 1]].tolist()
            words = [x for x, g in zip(words, gone, strict=True) if not g]
        kept.append(b" ".join(words))
    whose = w.text[start] if len(start) else start
    bounds = pa.array(np.searchsorted(whose, np.arange(part.num_rows + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (start - w.first[whose], length, period)]
    arrays = [part[n] for n in names] + [pa.array(np.diff(w.first), pa.int64()), *lists, pa.array(n_dropped, pa.int64()),
                                         pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
    labels = names + ["n_words", "starts", "lengths", "periods", "n_dropped", "collapsed_sha256"]
    if with_text:
        arrays.append(pa.array([x.decode() for x in kept], pa.string()))
        labels.append("collapsed_text")
    return pa.RecordBatch.from_arrays(arrays, labels)


def with_periodic_tail(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, chosen by crc32 of doc_id, go on with period p from
    word a on; their words are then joined by one space.  Others are as they were."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def tail(x: Column) -> Column:
        n, g = F.size(x), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(x, lambda word, i: F.when(i < a, word).otherwise(F.get(x, (a + F.pmod(i - a, p)).cast("int")))), " ")

    edited = F.element_at(F.transform(F.array(words), tail), 1)
    has_word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & has_word, edited).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """The runs of each document as numbers and digests; the run with the greatest exact
    length / period stands for the others (ties: smallest start, then period)."""
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = runs.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      F.sha2(told, 256).alias("runs_sha256"), "collapsed_sha256")
