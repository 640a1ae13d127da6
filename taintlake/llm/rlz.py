"""Substring deduplication by relative Lempel-Ziv parsing.

Documents lie in reference blocks: ranges of ascending doc_id.  Every block is
indexed by the content of its texts, and the index is spread over hash buckets, so
each document is factored against every earlier block without meeting it:

1. Anchors are the minimisers (5 words) of all windows; the words from one anchor to
   the end of the next are a phrase.  Blocks send distinct anchors and phrases, each
   once, to the buckets; a bucket answers which anchors other blocks hold and where
   a phrase stood first.
2. Greedy parse: as long as consecutive phrases stood consecutively in the same
   earlier text, they are one factor.  A factor of a window's length or more is a
   duplicate span.
3. Factor boundaries: a window that no factor holds can still repeat, but only if its
   own minimiser is shared.  Only those windows go to the buckets, by their hash; the
   smallest block that holds one decides.

The first document with a window can't have it inside a factor, so step 3 always
meets it there: the result is exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taintlake.llm.tables import range_of, range_starts
from taintlake.llm.words import Words, mix

WINDOW = 13
ANCHOR = 5
BLOCK_ROWS = 256
BUCKET_BYTES = 10_000_000
_MESSAGE = "kind int, bucket long, block long, base int, data binary"


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _sorted_table(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class _Block:
    """One block's parse; the same whenever it is made again."""

    def __init__(self, table: pa.Table, window: int):
        self.table = _sorted_table(table)
        self.words = w = Words(self.table["text"].combine_chunks().cast(pa.large_binary()))
        column = self.table["doc_id"].combine_chunks()
        self.placed = np.asarray(column.is_valid())
        self.doc = np.cumsum(np.diff(np.asarray(column.fill_null(0)), prepend=0) != 0)  # rank of the id
        at, anchor = w.minimisers(ANCHOR, window)
        good = self.placed[w.text[at]] if len(at) else np.zeros(0, bool)
        self.window_at, anchor = at[good], anchor[good]
        self.at, self.of_window = np.unique(anchor, return_inverse=True)
        self.anchor = w.hashes(self.at, ANCHOR)
        # A phrase runs from anchor i to the end of anchor i + 1 of the same text.
        self.has = np.zeros(len(self.at), bool)
        self.end = self.at + ANCHOR
        if len(self.at) > 1:
            self.has[:-1] = w.text[self.at[1:]] == w.text[self.at[:-1]]
            self.end[:-1] = np.where(self.has[:-1], self.at[1:] + ANCHOR, self.end[:-1])
        i = np.flatnonzero(self.has)
        self.phrase_at = i
        self.phrase = mix(w.hashes(self.at[i], self.end[i] - self.at[i]) + (self.end[i] - self.at[i]).astype(np.uint64))

    def anchors(self):
        """Distinct anchors; which ones stand in two documents of this block."""
        h, inverse = np.unique(self.anchor, return_inverse=True)
        doc = self.doc[self.words.text[self.at]]
        low, high = np.full(len(h), 1 << 62), np.full(len(h), -1)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        return h, inverse, low < high

    def phrases(self):
        """Distinct phrases, the anchor number where each stands first."""
        h, first, inverse = np.unique(self.phrase, return_index=True, return_inverse=True)
        return h, self.phrase_at[first] if len(h) else first, inverse

    def parse(self, answers: pa.Table) -> np.ndarray:
        """Starts of windows that factors leave open; sets `removed` for the factors."""
        w = self.words
        keys, inverse, shared = self.anchors()
        known, first, which = self.phrases()
        ref_block, ref_at = np.full(len(known), -1, np.int64), first.astype(np.int64)
        for kind, base, data in zip(answers["kind"].to_pylist(), answers["base"].to_pylist(), answers["data"].to_pylist(), strict=True):
            if kind == 0:
                shared[base + np.frombuffer(data, np.uint32).astype(np.int64)] = True
            elif kind == 1:
                got = np.frombuffer(data, np.dtype([("i", "<u4"), ("at", "<u4"), ("block", "<i8")]))
                ref_block[base + got["i"].astype(np.int64)], ref_at[base + got["i"].astype(np.int64)] = got["block"], got["at"]
        block, at = ref_block[which], ref_at[which]
        own = block < 0
        here, there = w.text[self.at[self.phrase_at]], w.text[self.at[np.where(own, at, 0)]] if len(self.at) else at
        earlier = ~own | (self.doc[there] < self.doc[here]) if len(which) else own
        # Factors: runs of phrases whose references follow each other in one text.
        n = len(which)
        joins = np.zeros(n, bool)
        if n > 1:
            joins[1:] = (earlier[1:] & earlier[:-1] & (block[1:] == block[:-1]) & (at[1:] == at[:-1] + 1)
                         & (self.phrase_at[1:] == self.phrase_at[:-1] + 1))
        run = np.cumsum(~joins) - 1
        start = self.at[self.phrase_at[~joins]]
        stop = np.zeros(len(start), np.int64)
        if n:
            stop[run] = self.end[self.phrase_at]  # the last phrase of a run wins
        long = (stop - start >= WINDOW) & earlier[~joins] if n else np.zeros(0, bool)
        step = np.zeros(len(w) + 1, np.int64)
        np.add.at(step, start[long], 1)
        np.add.at(step, stop[long], -1)
        self.removed = np.cumsum(step)[:-1] > 0
        # The furthest end of any factor that starts at or before a word.
        reach = np.zeros(len(w) + 1, np.int64)
        np.maximum.at(reach, start[long], stop[long])
        reach = np.maximum.accumulate(reach)
        open_ = shared[inverse][self.of_window] if len(self.at) else np.zeros(0, bool)
        return self.window_at[open_ & (reach[self.window_at] < self.window_at + WINDOW)]


def _messages(kind: int, block: int, h: np.ndarray, buckets: int, pack) -> list[tuple]:
    b = _bucket(h, buckets).astype(np.int64)
    cuts = np.concatenate((np.flatnonzero(np.diff(b, prepend=-1)), [len(b)]))
    return [(kind, int(b[s]), block, int(s), pack(s, e)) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["kind", "bucket", "block", "base", "data"]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


def _answer_entries(table: pa.Table) -> pa.Table:
    """One bucket: anchors held by two blocks, the first place of each phrase, or the
    windows that an earlier block holds."""
    out = []
    kinds = np.asarray(table["kind"])
    blocks, bases, data = np.asarray(table["block"]), np.asarray(table["base"]), table["data"].to_pylist()
    form = {0: np.dtype([("h", "<u8"), ("multi", "u1")]), 1: np.dtype([("h", "<u8"), ("at", "<u4")]), 2: np.dtype([("h", "<u8")])}
    for kind in (0, 1, 2):
        rows = np.flatnonzero(kinds == kind)
        if not len(rows):
            continue
        rows = rows[np.argsort(blocks[rows], kind="stable")]
        parts = [np.frombuffer(data[i], form[kind]) for i in rows]
        sizes = np.array([len(p) for p in parts])
        entry = np.concatenate(parts)
        whose = np.repeat(np.arange(len(rows)), sizes)
        local = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(entry["h"], kind="stable")  # blocks ascend within equal hashes
        h = entry["h"][order]
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.concatenate((lead, [len(h)])))
        group = np.repeat(np.arange(len(lead)), size)
        first = order[lead][group]  # the entry of the smallest block
        if kind == 0:
            told = order[np.repeat(size, size) > 1]
        else:
            told = order[order != first]
            source = first[order != first]
        told_by = np.argsort(whose[told], kind="stable")
        told = told[told_by]
        owner = whose[told]
        cuts = np.concatenate((np.flatnonzero(np.diff(owner, prepend=-1)), [len(owner)]))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            i = rows[owner[s]]
            if kind == 1:
                reply = np.zeros(e - s, np.dtype([("i", "<u4"), ("at", "<u4"), ("block", "<i8")]))
                src = source[told_by[s:e]]
                reply["i"], reply["at"], reply["block"] = local[told[s:e]], entry["at"][src], blocks[rows[whose[src]]]
            else:
                reply = local[told[s:e]].astype(np.uint32)
            out.append((kind, 0, int(blocks[i]), int(bases[i]), reply.tobytes()))
    return _table(out)


def dedup_substrings(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document that a smaller doc_id already has in a run of 13 words.

    Returns per row of `docs`: doc_id, the `carry` columns, kept_text (the text with
    the removed words and the space after them cut out; unchanged where nothing is
    removed), n_words, n_removed, kept_sha256 (of the kept words joined by spaces).

    A null text has no words and stays null.  Rows without a doc_id take no part and
    lose nothing.  Rows that repeat a doc_id are one document for "smaller", and each
    gets a row.  Other columns of `docs` are ignored, whatever their names."""
    spark = docs.sparkSession
    carried = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    starts = range_starts(rows, "doc_id", BLOCK_ROWS)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    # Rows without an id are spread over blocks of their own.
    block = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(len(starts) + 1))).otherwise(range_of(F.col("doc_id"), starts))
    placed = rows.withColumn("block", block.cast("long"))

    def index(key: tuple, table: pa.Table) -> pa.Table:
        b = _Block(table, WINDOW)
        block = key[0].as_py()
        h, _, multi = b.anchors()
        entry = np.rec.fromarrays([h, multi.astype("u1")], dtype=[("h", "<u8"), ("multi", "u1")])
        out = _messages(0, block, h, buckets, lambda s, e: entry[s:e].tobytes())
        h, first, _ = b.phrases()
        named = np.rec.fromarrays([h, first.astype("<u4")], dtype=[("h", "<u8"), ("at", "<u4")])
        return _table(out + _messages(1, block, h, buckets, lambda s, e: named[s:e].tobytes()))

    def boundaries(key: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(left):
            return _table([])
        b = _Block(left, WINDOW)
        h = np.unique(b.words.hashes(b.parse(answers), WINDOW))
        return _table(_messages(2, key[0].as_py(), h, buckets, lambda s, e: h[s:e].tobytes()))

    def answer(table: pa.Table) -> pa.Table:
        return _answer_entries(table)

    result = T.StructType([T.StructField("doc_id", T.LongType())]
                          + [T.StructField(f"carry_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
                          + [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()),
                             T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    names = [f.name for f in result]

    def cut(key: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(left, WINDOW)
        w = b.words
        kinds = np.asarray(answers["kind"])
        at = b.parse(answers.filter(pa.array(kinds < 2)))
        removed = b.removed
        h, inverse = np.unique(w.hashes(at, WINDOW), return_inverse=True)
        doc = b.doc[w.text[at]] if len(at) else at
        low = np.full(len(h), 1 << 62)
        np.minimum.at(low, inverse, doc)
        earlier = low[inverse] < doc
        mine = answers.filter(pa.array(kinds == 2))
        known = np.zeros(len(h), bool)
        for base, data in zip(mine["base"].to_pylist(), mine["data"].to_pylist(), strict=True):
            known[base + np.frombuffer(data, np.uint32).astype(np.int64)] = True
        hit = at[earlier | known[inverse]]
        step = np.zeros(len(w) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + WINDOW, -1)
        removed = removed | (np.cumsum(step)[:-1] > 0)
        gone = np.concatenate(([0], np.cumsum(removed)))
        n_removed = gone[w.first[1:]] - gone[w.first[:-1]]
        raw, texts, shas = w.data.tobytes(), [], []
        for i, valid in enumerate(np.asarray(b.table["text"].combine_chunks().is_valid())):
            lo, hi = w.offsets[i], w.offsets[i + 1]
            s, e = w.first[i], w.first[i + 1]
            text = raw[lo:hi]
            if n_removed[i]:
                keep = ~removed[s:e]
                # Cut from the start of a removed word to the start of the next word.
                after = np.append(w.start[s + 1:e], hi)
                pieces = [raw[lo:w.start[s]]] + [raw[x:y] for x, y in zip(w.start[s:e][keep], after[keep], strict=True)]
                shas.append(hashlib.sha256(b" ".join(b"".join(pieces).split())).hexdigest())
                text = b"".join(pieces)
            else:
                shas.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
            texts.append(text.decode() if valid else None)
        cols = {"doc_id": b.table["doc_id"], "kept_text": pa.array(texts, pa.string()), "n_words": pa.array(np.diff(w.first)),
                "n_removed": pa.array(n_removed), "kept_sha256": pa.array(shas, pa.string())}
        return pa.table([cols[n] if n in cols else b.table[n] for n in names], names)

    asked = placed.groupBy("block").applyInArrow(index, _MESSAGE)
    factors = asked.groupBy("bucket").applyInArrow(answer, _MESSAGE)
    open_ = placed.groupBy("block").cogroup(factors.groupBy("block")).applyInArrow(boundaries, _MESSAGE)
    all_answers = factors.union(open_.groupBy("bucket").applyInArrow(answer, _MESSAGE))
    out = placed.groupBy("block").cogroup(all_answers.groupBy("block")).applyInArrow(cut, result)
    return out.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})
