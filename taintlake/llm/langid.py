"""Language identification as a mixture of languages.

Each language is a distribution over byte trigrams, learnt from labelled texts.  A
document's trigrams are drawn from a mixture of languages; expectation-maximisation
estimates the proportions, and the set of languages grows one at a time as long as the
likelihood, less a penalty per language (half the logarithm of the trigrams), grows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
TRAIN_ROWS = 20_000
ROUNDS = 25
UNKNOWN = "und"


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of the lower-cased words, and their counts."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    seen = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(seen)
    return at, seen[at]


def proportions(table: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights by expectation-maximisation, and the log-likelihood, for a table
    of likelihoods (languages x grams)."""
    weight = np.full(len(table), 1 / len(table))
    total = counts.sum()
    for _ in range(ROUNDS if len(table) > 1 else 0):
        mixed = weight @ table
        fresh = weight * (table @ (counts / mixed)) / total
        done = np.abs(fresh - weight).max() < 1e-4
        weight = fresh
        if done:
            break
    return weight, float(counts @ np.log(weight @ table))


def mixture(model: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportion of every language in one document; those not selected have zero."""
    table = model[:, grams]
    alone = np.log(table) @ counts
    chosen = [int(np.argmax(alone))]
    weight, best = np.ones(1), float(alone.max())
    penalty = 0.5 * math.log(max(2, counts.sum()))
    while len(chosen) < len(model):
        mixed = weight @ table[chosen]
        rest = [i for i in range(len(model)) if i not in chosen]
        # The language with the steepest rise of the likelihood is the one to try.
        rise = table[rest] @ (counts / mixed)
        add = rest[int(np.argmax(rise))]
        if rise.max() <= counts.sum():
            break
        tried, likelihood = proportions(table[[*chosen, add]], counts)
        if likelihood - best <= penalty:
            break
        chosen, weight, best = [*chosen, add], tried, likelihood
    out = np.zeros(len(model))
    out[chosen] = weight
    return out


def learn(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their gram distributions (lang x 2^16), from (text, lang).  About
    `rows` rows a language are drawn by a hash of the text; the model's size depends on
    the number of languages only."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, 1 << BITS))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / n))]), F.col("lang"))
    drawn = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                at, n = trigrams(text)
                total.setdefault(lang, np.zeros(1 << BITS, np.int64))[at] += n
        for lang, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(seen[at])], ["lang", "gram", "n"])

    seen = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts)
    model = np.full((len(langs), 1 << BITS), 0.05)
    model[seen["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), seen["gram"].to_numpy(int)] += seen["n"].to_numpy(float)
    return langs, model / model.sum(axis=1, keepdims=True)


def held_out(docs: DataFrame):
    """True for documents that no model may learn from."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; false for a null one."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t) and any(map(str.isalpha, t))).astype(bool)

    return found(text)


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of `docs` with lang_pred, lang_score and lang_held_out appended.

    The model learns from text and lang of rows that are not held out; prediction reads
    the text alone.  lang_score is the proportion of the predicted language.  A text
    that is null, empty or without a letter, and any text if nothing could be learnt, is
    `und` with score 0.  A row without doc_id is neither held out nor learnt from.
    Columns of `docs` with the names of the new ones are replaced."""
    known = docs.where(docs["text"].isNotNull() & docs["lang"].isNotNull() & ~held_out(docs)).select(
        docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    langs, model = learn(known, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # 256 KB a language

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        likelihood = shared.value.astype(np.float64)
        out = []
        for text in texts:
            grams, counts = trigrams(text) if text and langs and any(map(str.isalpha, text)) else ((), ())
            if len(grams):
                weight = mixture(likelihood, grams, counts)
                top = int(np.argmax(weight))
                out.append((langs[top], float(min(1.0, weight[top]))))
            else:
                out.append((UNKNOWN, 0.0))
        return pd.DataFrame(out, columns=["lang", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_held_out")]
    found = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), predict(docs["text"].cast("string")).alias("found"),
                        F.coalesce(held_out(docs), F.lit(False)).alias("lang_held_out"))
    return found.select(*[F.col("row")[c].alias(c) for c in own], F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("lang_score"), "lang_held_out")
