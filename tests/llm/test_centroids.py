"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from taintlake.llm import centroids


def plain(rows, clusters=16, rounds=3):
    """(key, cluster, distance, own inertia, inertia, sha256) of {key: components}."""
    ints = [(k, [math.floor(64 * x) if abs(x) < 1e15 else int(x) * 64 for x in v]) for k, v in rows]
    order = sorted(ints, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0], r[1]))
    centers = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers)) for _, v in ints]

    for _ in range(rounds):
        who = assign()
        for i in range(len(centers)):
            mine = [v for (_, v), (_, k) in zip(ints, who) if k == i]
            if mine:
                centers[i] = [sum(c) // len(mine) for c in zip(*mine)]
    who, most = assign(), 2**63 - 1
    own = {i: min(most, sum(min(d, most) for d, k in who if k == i)) for i in range(len(centers))}
    total = min(most, sum(min(d, most) for d, _ in who))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((key, k, min(d, most), own[k], total, shas[k]) for (key, _), (d, k) in zip(ints, who))


def ran(df, **kwargs):
    return sorted(map(tuple, centroids.cluster(df, **kwargs).collect()))


def test_transform():
    h = centroids.hadamard()
    assert (h @ h.T == 64 * np.eye(64, dtype=int)).all()
    assert (h[:, 1:] != h[:, :-1]).sum(axis=1).tolist() == list(range(64))


def test_nearest_with_ties():
    rng = np.random.default_rng(1)
    for spread in (1, 2, 60):
        c = rng.integers(-spread, spread + 1, (16, 64))
        c[5] = c[2]
        x = np.concatenate((rng.integers(-spread, spread + 1, (300, 64)), c, (c[:8] + c[8:]) // 2))
        who, distance = centroids.nearest(x, c)
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (who == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert [len(a) for a in centroids.nearest(np.zeros((0, 64), np.int64), c)] == [0, 0]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters(spark, kind):
    rng = random.Random(2)
    good = [(i, [float(np.float32(rng.gauss(i % 5, 0.4))) for _ in range(64)]) for i in range(150)]
    good += [(150, good[3][1]), (151, good[3][1]), (152, [0.0] * 64), (152, [0.0] * 64)]  # ties and a repeated row
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63)]
    rows = [(k, v, "c", 1) for k, v in good + bad]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, distance int").repartition(3)
    assert ran(df) == plain(good)


def test_far_vectors(spark):
    """Components whose squares leave 63 bits are still compared exactly."""
    rng = random.Random(3)
    good = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 6, 12, 30])] + [0.0] * 63) for i in range(60)]
    assert ran(spark.createDataFrame(good, "vec_id long, embedding array<double>")) == plain(good)


def test_few_rows_null_keys_and_empty_tables(spark):
    form = "vec_id long, embedding array<float>, label int"
    one = spark.createDataFrame([(7, [0.5] * 64, 1), (None, [0.25] * 64, 1)], form)
    got = centroids.cluster(one, carry=("label",)).collect()
    assert {(r.vec_id, r.label, r.distance, r.inertia) for r in got} == {(7, 1, 0, 0), (None, 1, 0, 0)} and len({r.cluster for r in got}) == 2
    assert centroids.cluster(spark.createDataFrame([], form)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, 1)], form)).collect() == []
