"""Packing token sequences: first-fit decreasing in randomised groups of documents.

Each document is cut into pieces of a full sequence and a rest.  Documents are dealt at
random into groups of bounded size; each group packs its pieces in decreasing order,
every one into the first sequence with room, which a tournament tree over the room of
the open sequences finds in logarithmic time."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024
GROUP_ROWS = 2_000
CACHE_WORDS = 400_000
_SPECIAL = "<|endoftext|>"
_PART, _LATIN = re.compile(r"(?= \S)"), re.compile("[\x00-\u024f]*")


class Tournament:
    """First bin with enough room, over a growing number of bins."""

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.leaves = capacity, 1 << max(1, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item; it takes the room."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.room[node] < size:
                node += 1
        left = self.room[node]
        self.room[node] = left - size
        spot = node - self.leaves
        while node > 1:
            node //= 2
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
        return spot, self.capacity - left


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by its rule:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts, remembered by word.

    Byte-level pre-tokenisation never joins a space that a non-space follows to what
    is before it, so a text may be cut there and each part encoded alone.  Parts are
    kept per worker up to a fixed number.  A new part of Latin letters is merged by the
    faster library from the same vocabulary file, whose order of ids is that of its
    merges; other parts, and texts with the special string, go to `tokenizers`."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token != _SPECIAL}
        self.fast = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, part: str) -> bytes:
        ids = self.fast(part) if _LATIN.fullmatch(part) else self.model.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if _SPECIAL in text:
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _PART.split(text)
        known = self.known
        new = [p for p in parts if p not in known]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = parts
            for p in new:
                if p not in known:
                    known[p] = self._encode(p)
        return b"".join([known[p] for p in parts])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; with `with_ids` also ids (binary, little-endian 32 bits).

    `tokenizer` is the path of a tokenizer file that all executors can read.  A document
    is its ids and one id 0, so a null or empty text is one id.  Repeated rows are
    packed as rows of their own, and so are rows without a doc_id.  Sequence ids are
    unique, not gapless.  An empty table gives no rows.  Other columns are ignored."""
    groups = max(1, math.ceil(docs.count() / GROUP_ROWS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                out = [[], [], [], [], [], [], []]
                for doc, text, group in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["pack"].to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    for start in range(0, n, sequence):
                        piece = ids[4 * start:4 * (start + sequence)]
                        for column, x in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n, group, piece if with_ids else None), strict=True):
                            column.append(x)
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        size = np.asarray(table["length"])
        order = np.lexsort((np.asarray(table["start"]), np.asarray(table["doc_id"].fill_null(-1)), -size))
        full = int((size == sequence).sum())  # these fill a sequence each and come first
        tree = Tournament(sequence, len(order) - full)
        spot, offset = np.arange(len(order)), np.zeros(len(order), np.int64)
        for i, item in enumerate(size[order[full:]].tolist()):
            s, o = tree.place(item)
            spot[full + i], offset[full + i] = full + s, o
        table = table.take(pa.array(order)).drop_columns(["pack"])
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + spot)).append_column("offset", pa.array(offset))
        return table.select(kept)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack", "ids"]
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    form = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, {}ids binary"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("pack", F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(groups)).cast("long"))
    pieces = slim.mapInArrow(cut, form.format("pack long, "))
    result = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return pieces.groupBy("pack").applyInArrow(fit, result)
