"""Repeated passages by sparse suffix arrays.

Every window of 50 words has an anchor, chosen by content: the minimiser (8 words) of
its first 26 words.  An anchor lies among the first 19 words of its windows, so 32 words
run on from it in all of them.  The words from an anchor's first window to the end of its
last one are its context.  Anchors are sorted by their next 32 words, then by context, a
document at a time; a sweep over each sorted partition compares neighbours, and the ends
of partitions are compared with each other.

Neighbours of one context share all windows of the anchor.  Where equal words go on in
several contexts, as after a common head, the first document of each context also sorts
the anchor's windows (19 at most), and neighbours of one window meet.  Documents that
meet are extended left and right, word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taintlake.llm.words import Words
from taintlake.plans.storage import saved

MIN_WORDS = 50
ANCHOR, SAMPLE, RIGHT = 8, 26, 32
_ROW = ["k1", "k2", "doc_id", "pos"]


def _owned(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of 50 words, and their anchors in ascending order."""
    start, anchor = w.minimisers(ANCHOR, SAMPLE)
    whole = start + MIN_WORDS <= w.first[w.text[start] + 1] if len(start) else np.zeros(0, bool)
    return start[whole], anchor[whole]


def _rows(w: Words, doc_id: pa.Array, anchor: np.ndarray, inner: np.ndarray) -> pa.RecordBatch:
    doc = np.asarray(doc_id)[w.text[anchor]]
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (w.hashes(anchor, RIGHT).view(np.int64), inner.view(np.int64), doc.astype(np.int64),
                               (anchor - w.first[w.text[anchor]]).astype(np.int32))], _ROW)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor: k1 hashes its 32 words, k2 its context."""
    for batch in batches:
        for lo in range(0, len(batch), 1000):
            part = batch.slice(lo, 1000)
            w = Words(part["text"])
            start, anchor = _owned(w)
            anchor, low, n = np.unique(anchor, return_index=True, return_counts=True)
            yield _rows(w, part["doc_id"], anchor, w.hashes(start[low], n - 1 + MIN_WORDS))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the anchors in `anchors`: k2 hashes its 50 words."""
    for batch in batches:
        for lo in range(0, len(batch), 1000):
            part = batch.slice(lo, 1000)
            w = Words(part["text"])
            start, anchor = _owned(w)
            wanted = [np.array(x, np.int64) + w.first[i] for i, x in enumerate(part["anchors"].to_pylist())]
            # A repeated doc_id may bring places of another text, beyond this one's end.
            wanted = [x[x < w.first[i + 1]] for i, x in enumerate(wanted)]
            mine = np.isin(anchor, np.concatenate(wanted))
            yield _rows(w, part["doc_id"], anchor[mine], w.hashes(start[mine], MIN_WORDS))


class _Heads:
    """Rows of the first document of each (k1, k2) whose k1 has another k2 too.  What
    only other partitions can tell is `open`: rows of the partition's first and last k1.
    `marks` has the least and the greatest k2 of these two."""

    def __init__(self):
        self.opening = self.last = self.from_ = None
        self.several, self.held = False, []
        self.sure: list[np.ndarray] = []
        self.open: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []

    def add(self, rows: np.ndarray, head: np.ndarray) -> None:
        k1, k2 = rows[:2]
        new = np.ones(len(k1), bool)
        new[1:] = k1[1:] != k1[:-1]
        other = np.ones(len(k1), bool)
        other[1:] = k2[1:] != k2[:-1]
        if self.last is None:
            self.opening = k1[0]
            self.marks.append(rows[:, :1])
        else:
            new[0], other[0] = k1[0] != self.last[0], k2[0] != self.last[1]
        if k1[0] == self.opening:
            self.marks.append(rows[:, np.flatnonzero(k1 == self.opening)[-1:]])
        run = np.cumsum(new)  # 0 goes on from the batch before
        many = np.zeros(run[-1] + 1, bool)
        many[run[other & ~new]] = True
        many[0] |= self.several
        if many[0]:
            self._let(self.sure)
        elif run[-1] > 0 and self.last is not None:
            self._let(self.open if self.last[0] == self.opening else [])
        self.sure.append(rows[:, head & many[run]])
        alone = head & ~many[run]
        self.open.append(rows[:, alone & (run < run[-1]) & (k1 == self.opening)])
        self.held.append(rows[:, alone & (run == run[-1])])
        if new[run == run[-1]][0]:
            self.from_ = rows[:, np.flatnonzero(run == run[-1])[:1]]
        self.several, self.last = bool(many[-1]), rows[:, -1]

    def _let(self, to: list[np.ndarray]) -> None:
        to.extend(self.held)
        self.held = []

    def end(self) -> None:
        if self.last is not None:
            self._let(self.open)
            self.marks += [self.from_, self.last[:, None]]

    def told(self) -> Iterator[pa.RecordBatch]:
        for edge, kept in ((3, self.sure), (4, self.open), (5, self.marks)):
            for k1, k2, doc, pos in kept:
                if len(k1):
                    yield _edge_batch(doc, pos, doc, pos, np.full(len(k1), edge), k1, k2)
            kept.clear()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep of one sorted partition: (doc_id, pos, ref_id, ref_pos) for each suffix that
    equals one of the document before it in order; edge 1 and 2 mark the partition's
    first document's rows of its first run, and its last rows of two documents; 3, 4 and
    5 are the heads that are sure or open, and their marks."""
    heads = _Heads()
    held = np.zeros((4, 0), np.int64)  # last row of the document before, last row
    opening = None
    for batch in batches:
        if not len(batch):
            continue
        fresh = np.stack([np.asarray(batch[c]).astype(np.int64) for c in _ROW])
        rows = np.concatenate((held, fresh), axis=1)
        skip = held.shape[1]
        k1, k2, doc, pos = rows
        new_run = np.ones(len(k1), bool)
        new_run[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new_doc = new_run.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        index = np.arange(len(k1))
        block = np.maximum.accumulate(np.where(new_doc, index, 0))
        ref = block - 1
        match = ~new_run[block] & (index >= skip)
        out = [(doc[match], pos[match], doc[ref[match]], pos[ref[match]], np.zeros(match.sum(), np.int64), k1[match], k2[match])]
        if opening is None:
            opening = (k1[0], k2[0], doc[0])
        if opening[0] == k1[skip] and opening[1] == k2[skip] and opening[2] == doc[skip]:
            same = (k1 == opening[0]) & (k2 == opening[1]) & (doc == opening[2]) & (index >= skip)
            out.append((doc[same], pos[same], doc[same], pos[same], np.ones(same.sum(), np.int64), k1[same], k2[same]))
        before = block[-1] - 1
        held = rows[:, [before, -1]] if not new_run[block[-1]] else rows[:, -1:]
        yield _edge_batch(*[np.concatenate(c) for c in zip(*out, strict=True)])
        heads.add(fresh, new_run[block][skip:])
        yield from heads.told()
    heads.end()
    yield from heads.told()
    if held.shape[1]:
        k, l, d, p = held
        yield _edge_batch(d, p, d, p, np.full(len(d), 2), k, l)


def _edge_batch(*cols) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)],
                                      ["doc_id", "pos", "ref_id", "ref_pos", "edge", "k1", "k2"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of equal words on the diagonals of a pair that hold a matched suffix."""
    for batch in batches:
        out: list[tuple] = []
        for lo in range(0, len(batch), 200):
            part = batch.slice(lo, 200)
            a, b = Words(part["text"]), Words(part["ref_text"])
            for i, (doc, ref, places) in enumerate(zip(part["doc_id"].to_pylist(), part["ref_id"].to_pylist(), part["places"].to_pylist(), strict=True)):
                x, y = a.word[a.first[i]:a.first[i + 1]], b.word[b.first[i]:b.first[i + 1]]
                # diagonal: position in the document minus that in the other
                lines: dict[int, list[int]] = {}
                for place in places:
                    lines.setdefault(place["diagonal"], []).append(place["pos"])
                for diagonal, at in lines.items():
                    start = max(0, diagonal)
                    n = max(0, min(len(x) - start, len(y) - (start - diagonal)))
                    same = np.zeros(n + 2, np.int8)
                    same[1:-1] = x[start:start + n] == y[start - diagonal:start - diagonal + n]
                    turn = np.diff(same)
                    first, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                    run = np.unique(np.searchsorted(first, np.array(at) - start, side="right") - 1)
                    for r in run[run >= 0]:
                        if stop[r] - first[r] >= MIN_WORDS:
                            out.append((doc, int(start + first[r]), int(stop[r] - first[r]), ref, int(start + first[r] - diagonal)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "start", "n_words", "other_id", "other_start"])


def _sorted(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The swept rows, and (doc_id, pos, ref_id, ref_pos) of all neighbours."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = saved(rows.repartitionByRange(parts, *_ROW).sortWithinPartitions(*_ROW).mapInArrow(
        _neighbours, "doc_id long, pos long, ref_id long, ref_pos long, edge int, k1 long, k2 long"), name)
    # The last row of a partition precedes the first rows of the next one.  There are as
    # many last rows as partitions, and the rows that open a partition are of one document.
    ends = swept.where("edge = 2").select("k1", "k2", "doc_id", "pos")
    opens = swept.where("edge = 1").select("k1", "k2", "doc_id", "pos")
    across = (opens.alias("o").join(ends.groupBy("k1", "k2").agg(F.collect_list(F.struct("doc_id", "pos")).alias("ends")), ["k1", "k2"])
              .withColumn("before", F.array_max(F.filter("ends", lambda e: e["doc_id"] < F.col("o.doc_id"))))
              .where("before IS NOT NULL").select("doc_id", "pos", F.col("before.doc_id").alias("ref_id"), F.col("before.pos").alias("ref_pos")))
    return swept, swept.where("edge = 0").select("doc_id", "pos", "ref_id", "ref_pos").union(across)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of 50 words or more that two documents share, as maximal runs of equal
    words: doc_id, start, n_words, other_id, other_start (in words); other_id is smaller.

    Every window of 50 words that a document shares with another one lies in a passage of
    the result, with that document as doc_id or as other_id.  Of many documents with one
    window, each meets one or two others, not all.  Of a window that one document holds
    at several places, one place may stand for all; repeats inside one document don't
    count.  Null and empty texts have no words, and rows without a doc_id take no part.
    Rows that repeat a doc_id are texts of one document.  Other columns are ignored."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    form = "k1 long, k2 long, doc_id long, pos int"
    swept, matches = _sorted(slim.mapInArrow(_suffixes, form), "suffix-neighbours")
    marks = swept.where("edge = 5").groupBy("k1").agg((F.min("k2") < F.max("k2")).alias("several")).where("several")
    heads = swept.where("edge = 3").select("doc_id", "pos").union(swept.where("edge = 4").join(marks, "k1").select("doc_id", "pos"))
    # From here on only texts of documents that meet another one or have a head move.
    none = F.lit(None).cast("long").alias("pos")
    wanted = heads.union(matches.select("doc_id", none)).union(matches.select("ref_id", none)).groupBy("doc_id").agg(F.collect_set("pos").alias("anchors"))
    known = saved(slim.join(wanted, "doc_id"), "suffix-texts")
    matches = matches.union(_sorted(known.where("size(anchors) > 0").mapInArrow(_windows, form), "suffix-windows")[1])
    # One row for each pair of documents, so that each text meets another one once.
    place = F.struct((F.col("pos") - F.col("ref_pos")).alias("diagonal"), F.col("pos"))
    lines = matches.groupBy("doc_id", "ref_id").agg(F.collect_set(place).alias("places"))
    texts = lines.join(known.select("doc_id", "text"), "doc_id").join(known.select(F.col("doc_id").alias("ref_id"), F.col("text").alias("ref_text")), "ref_id")
    return texts.select("doc_id", "ref_id", "places", "text", "ref_text").mapInArrow(
        _extend, "doc_id long, start long, n_words long, other_id long, other_start long").distinct()
