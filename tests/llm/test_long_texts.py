"""Texts of tens of thousands of words through every operator on documents."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from taintlake.llm import fingerprint, langid, packing, rlz, sharding, simhash, suffixes, unigram

N = 30_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(5_000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    first, other = some(N), some(N)
    return {1: first, 2: first, 3: other, 4: other[:len(other) // 2] + " " + some(N // 2), 5: some(40)}


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def test_passages(docs, rows):
    got = suffixes.repeated_passages(docs).collect()
    assert max(r.n_words for r in got if (r.doc_id, r.other_id) == (2, 1)) == N
    half = len(rows[3][:len(rows[3]) // 2].split())
    assert max(r.n_words for r in got if (r.doc_id, r.other_id) == (4, 3)) >= half - 1


def test_fingerprints_of_words(docs, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert all(int(got[i].fingerprint, 16) == simhash.fingerprint(t) for i, t in rows.items())
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3)


def test_substrings(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in rlz.dedup_substrings(docs).collect()}
    half = len(rows[3][:len(rows[3]) // 2].split())
    assert got[1] == (N, 0) and got[2] == (N, N) and got[3] == (N, 0) and half - 1 <= got[4][1] <= half and got[5] == (40, 0)


def test_other_operators(docs, rows):
    assert {r.doc_id for r in langid.identify(docs).collect()} == set(rows)
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r.n == r["all"] for r in packed) and {r.doc_id for r in packed} == set(rows)
    shards = {r.doc_id: r for r in sharding.shard(docs).collect()}
    assert {i: r.size for i, r in shards.items()} == {i: len(t) + 1 for i, t in rows.items()} and shards[1].shard == shards[2].shard
    assert all(r.round_trip for r in unigram.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect())
    marks = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert marks[1] == marks[2] and len(set(marks.values())) == 4


def test_mixture_by_plain_arithmetic():
    """Expectation maximisation gram by gram, and the penalised choice over all sets of
    languages, against the vectorised greedy one."""
    rng = np.random.default_rng(3)

    def plain(table, grams):
        weight = [1 / len(table)] * len(table)
        for _ in range(300):
            new = [0.0] * len(table)
            for g in grams:
                whole = sum(w * t[g] for w, t in zip(weight, table, strict=True))
                for i, t in enumerate(table):
                    new[i] += weight[i] * t[g] / whole / len(grams)
            weight = new
        return weight, sum(math.log(sum(w * t[g] for w, t in zip(weight, table, strict=True))) for g in grams)

    for shares in ((1, 0, 0), (0, 0.5, 0.5), (0.7, 0, 0.3), (0.3, 0.4, 0.3)):
        model = rng.dirichlet(np.full(40, 0.3), size=3) * 0.99 + 0.01 / 40
        drawn = rng.choice(40, size=400, p=np.array(shares) @ model).tolist()
        at, counts = np.unique(drawn, return_counts=True)
        best = []
        for size in (1, 2, 3):
            for chosen in itertools.combinations(range(3), size):
                weight, likelihood = plain([model[i].tolist() for i in chosen], drawn)
                near, same = langid.proportions(model[list(chosen)][:, at], counts)
                assert np.allclose(near, weight, atol=0.01) and abs(same - likelihood) < 0.1
                best.append((likelihood - (size - 1) * 0.5 * math.log(len(drawn)), chosen, weight))
        _, chosen, weight = max(best)
        got = langid.mixture(model, at, counts)
        assert tuple(np.flatnonzero(got)) == chosen and np.allclose(got[list(chosen)], weight, atol=0.01)
