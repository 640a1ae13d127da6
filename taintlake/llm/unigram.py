"""Unigram encoding and decoding of text with a given set of scored pieces.

Spaces become the marker U+2581 and one marker is put in front.  The best split by the
sum of piece scores is found by Viterbi over a double-array trie of the pieces' UTF-8
bytes; a character that no piece covers falls back to its bytes.  No piece holds a
marker behind another character, so a best split never crosses the start of a word (a
run of markers and what follows): words are solved alone and remembered per worker.

The pieces' scores are log probabilities: those of the file, or, for a file that has only
merge ranks, logarithms by the law of rank and frequency, as tokenizers aren't trained."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_WORDS = 400_000
UNKNOWN_PENALTY = 10.0
_LITERAL = "\0literal"
_WORD = re.compile(rf"{MARK}*[^{MARK}]*")


class DoubleArray:
    """Trie in two arrays: the child of state s by byte c is base[s] + c + 1 if check
    there is s; a key ends in the child by code 0, whose base is -1 - value."""

    def __init__(self, keys: list[bytes], values: list[int]):
        self.base, self.check = [0] * 1024, [-1] * 1024
        self.check[0] = 0
        self._free = 1
        pairs = sorted(zip(keys, values, strict=True))
        stack = [(0, 0, len(pairs), 0)]
        while stack:
            state, lo, hi, depth = stack.pop()
            children = []  # (code, lo, hi)
            while lo < hi:
                key = pairs[lo][0]
                code = key[depth] + 1 if len(key) > depth else 0
                end = lo + 1
                while end < hi and (pairs[end][0][depth] + 1 if len(pairs[end][0]) > depth else 0) == code:
                    end += 1
                children.append((code, lo, end))
                lo = end
            base = self._place([c for c, _, _ in children])
            self.base[state] = base
            for code, start, end in children:
                self.check[base + code] = state
                if code == 0:
                    self.base[base] = -1 - pairs[start][1]
                else:
                    stack.append((base + code, start, end, depth + 1))

    def _place(self, codes: list[int]) -> int:
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        at, tries = max(1, self._free - codes[0]), 0
        while True:
            need = at + 257 - len(self.check)
            if need > 0:
                self.base += [0] * (need + 4096)
                self.check += [-1] * (need + 4096)
            if all(self.check[at + c] < 0 for c in codes):
                break
            at, tries = at + 1, tries + 1
        if tries > 64 and len(codes) == 1:
            self._free = max(self._free, at)
        return at

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that starts at data[start]."""
        base, check, state = self.base, self.check, 0
        for i in range(start, len(data)):
            child = base[state] + data[i] + 1
            if check[child] != state:
                return
            state = child
            leaf = base[state]
            if check[leaf] == state and base[leaf] < 0:
                yield i + 1, -1 - base[leaf]


class Unigram:
    """Encoder and decoder.  `pieces` are (text, score); `bytes_at` is the id of byte 0
    in 256 consecutive byte pieces; `control` ids never match text."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_at: int, control: frozenset[int]):
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece holds a marker inside")
        self.pieces, self.bytes_at = [p for p, _ in pieces], bytes_at
        plain = [i for i in range(len(pieces)) if i not in control and not bytes_at <= i < bytes_at + 256]
        self.score = [s for _, s in pieces]
        self.trie = DoubleArray([pieces[i][0].encode() for i in plain], plain)
        self.plain = frozenset(plain)
        self.unknown = min([self.score[i] for i in plain], default=0.0) - UNKNOWN_PENALTY
        self.known = self._start()

    def split(self, word: str) -> list[int]:
        """Ids of the best split; of equal ones, that whose last pieces are longest."""
        data = word.encode()
        n = len(data)
        best, back = [float("-inf")] * (n + 1), [(0, ())] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == float("-inf"):
                continue
            size = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            alone = False
            for end, piece in self.trie.prefixes(data, i):
                alone |= end == i + size
                value = here + self.score[piece]
                if value > best[end]:
                    best[end], back[end] = value, (i, (piece,))
            if not alone and here + self.unknown > best[i + size]:
                best[i + size] = here + self.unknown
                back[i + size] = (i, tuple(self.bytes_at + b for b in data[i:i + size]))
        out: list[int] = []
        at = n
        while at:
            at, ids = back[at]
            out[:0] = ids
        return out

    def split_all(self, words: list[str]) -> list[bytes]:
        """Packed ids of many words: the steps of `split` for all of them at once.  Words
        of over 32 bytes, or with a character that no piece covers, go one by one."""
        data = [w.encode() for w in words]
        length = np.array([len(d) for d in data])
        out: list[bytes | None] = [None] * len(words)
        rows = np.flatnonzero((length <= 32) & (length > 0))
        n = length[rows]
        width = int(n.max(initial=0))
        text = np.frombuffer(b"".join([data[i].ljust(width + 1, b"\xff") for i in rows]), np.uint8).reshape(len(rows), width + 1).astype(np.int32)
        base, check, score = self._arrays()
        best = np.full((len(rows), width + 1), -np.inf)
        best[:, 0] = 0.0
        back, piece = np.zeros((len(rows), width + 1), np.int32), np.zeros((len(rows), width + 1), np.int32)
        covered = np.ones(len(rows), bool)
        size = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        for i in range(width):
            live = np.flatnonzero(np.isfinite(best[:, i]) & (i < n))
            state, alone, all_live = np.zeros(len(live), np.int64), np.zeros(len(best), bool), live
            for j in range(i, width):
                child = base[state] + text[live, j] + 1
                go = (check[child] == state) & (j < n[live])
                live, state = live[go], child[go]
                if not len(live):
                    break
                leaf = base[state]
                ends = (check[leaf] == state) & (base[leaf] < 0)
                who, value = live[ends], -1 - base[leaf[ends]]
                alone[who] |= size[who, i] == j + 1 - i
                total = best[who, i] + score[value]
                more = total > best[who, j + 1]
                who, value = who[more], value[more]
                best[who, j + 1], back[who, j + 1], piece[who, j + 1] = total[more], i, value
            covered[all_live] &= alone[all_live]
        # Walk back, all words a piece at a time; column k holds the k-th piece from the end.
        at, columns = np.where(covered, n, 0), []
        while (at > 0).any():
            row = np.arange(len(at))
            columns.append(np.where(at > 0, piece[row, at], -1))
            at = np.where(at > 0, back[row, at], 0)
        if columns:
            ids = np.stack(columns[::-1], axis=1)
            flat = ids[ids >= 0].astype("<u4").tobytes()
            stop = np.cumsum((ids >= 0).sum(axis=1)) * 4
            for i, ok, s, e in zip(rows.tolist(), covered.tolist(), (stop - (ids >= 0).sum(axis=1) * 4).tolist(), stop.tolist(), strict=True):
                if ok:
                    out[i] = flat[s:e]
        return [np.array(self.split(w), "<u4").tobytes() if x is None else x for w, x in zip(words, out, strict=True)]

    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "_packed"):
            pad = [-1] * 512
            self._packed = (np.array(self.trie.base + [0] * 512), np.array(self.trie.check + pad), np.array(self.score))
        return self._packed

    def _start(self) -> dict[str, bytes]:
        """A literal marker is a word of its own, known as the bytes of its three byte pieces."""
        return {_LITERAL: np.array([self.bytes_at + b for b in MARK.encode()], "<u4").tobytes()}

    def learn(self, words: set[str]) -> None:
        """Solve those words together that are not known."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = self._start()
            new = words - self.known.keys()
        ordered = list(new)
        for i in range(0, len(ordered), 20_000):
            self.known.update(zip(ordered[i:i + 20_000], self.split_all(ordered[i:i + 20_000]), strict=True))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids.  A marker in the text itself becomes its bytes, so
        that decoding returns it."""
        words = self._cut(text)
        self.learn(set(words))
        return self._joined(words)

    def _joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))

    def _cut(self, text: str) -> list[str]:
        if MARK not in text:
            return _WORD.findall(MARK + text.replace(" ", MARK))
        head, *rest = text.split(MARK)
        return _WORD.findall(MARK + head.replace(" ", MARK)) + [w for r in rest for w in (_LITERAL, *_WORD.findall(r.replace(" ", MARK)))]

    def decode(self, ids: bytes) -> str:
        """Text of ids: byte pieces form characters, markers are spaces, and the first
        one is dropped."""
        table = self._byte_table()
        got = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return got.decode("utf-8", errors="replace")[1:]

    def _byte_table(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            self._table = [bytes([i - self.bytes_at]) if self.bytes_at <= i < self.bytes_at + 256
                           else p.replace(MARK, " ").encode() if i in self.plain else b"" for i, p in enumerate(self.pieces)]
        return self._table


@lru_cache(maxsize=4)
def load(path: str) -> Unigram:
    """Pieces of a sentencepiece model file with log scores.  A file of merges has ranks
    for scores, whose sums mean nothing; they become logarithms by `log_scores`."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    first = next(i for i in range(n) if model.is_byte(i))
    special = frozenset(i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    scores = [model.get_score(i) for i in range(n)]
    plain = [i for i in range(n) if i not in special and not model.is_byte(i)]
    if all(scores[i] <= 0 and float(scores[i]).is_integer() for i in plain):
        for i, score in zip(plain, log_scores([-scores[i] for i in plain]), strict=True):
            scores[i] = score
    return Unigram([(model.id_to_piece(i), scores[i]) for i in range(n)], first, special)


def log_scores(ranks: list[float]) -> list[float]:
    """Log probabilities of pieces known by rank alone: in proportion to 1 / (1 + rank), the
    law that word frequencies follow.  Nothing is learnt from any text."""
    whole = math.log(math.fsum(1 / (1 + r) for r in ranks))
    return [-math.log1p(r) - whole for r in ranks]


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip (decoding returns the text), n_bytes_used
    (ids that are bytes) and, with `with_ids`, ids (binary, little-endian 32 bits).

    `model` is the path of a model file that all executors can read.  A null text gives
    null in every other column; an empty one is a single marker.  Repeated rows and null
    doc_ids are kept.  Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = load(model)
        low, high = unigram.bytes_at, unigram.bytes_at + 256
        for batch in batches:
            rows, texts = [], batch["text"].to_pylist()
            for i, text in enumerate(texts):
                if i % 200 == 0:  # cut texts once, and solve the new words of some of them together
                    cuts = [unigram._cut(t) if t is not None else [] for t in texts[i:i + 200]]
                    unigram.learn(set().union(*cuts))
                if text is None:
                    rows.append((None,) * 5)
                    continue
                ids = unigram._joined(cuts[i % 200])
                number = np.frombuffer(ids, "<u4")
                rows.append((len(number), zlib.crc32(ids), unigram.decode(ids) == text, int(((number >= low) & (number < high)).sum()), ids if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"]] + [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "n_tokens", "ids_crc32", "round_trip", "n_bytes_used", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, n_bytes_used long, ids binary")
    return out if with_ids else out.drop("ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of (doc_id, ids)."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        unigram = load(model)
        return ids.map(lambda x: None if x is None else unigram.decode(bytes(x)))

    return encoded.select("doc_id", text("ids").alias("text"))
