"""Periodic runs against their plain definition."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from taintlake.llm import lyndon

FORM = "doc_id long, text string, runs string, start int, n_words double"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_lyndon(s):
    out = []
    for i in range(len(s)):
        best = 0
        for j in range(i + 1, len(s) + 1):
            u = s[i:j]
            if 0 in u:
                break
            if all(u < u[k:] for k in range(1, len(u))):
                best = len(u)
        out.append(best)
    return out


def plain_runs(u):
    out, n = set(), len(u)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and u[i] == u[i + q]:
                i += 1
            size = i + q - s
            if i > s and size >= max(6, 4 * q) and not any(u[s + r:s + size] == u[s:s + size - r] for r in range(1, q)):
                out.add((s, size, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(u, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(u) if i not in gone)


def texts(rng):
    out = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 3, "a b\n" * 4, "é ü " * 9 + "é"]
    for _ in range(120):
        u = []
        while len(u) < rng.randint(0, 90):
            u += rng.choices("abc", k=rng.randint(1, 7)) * rng.choice([1, 1, 2, 3, 4, 5, 7])
        out.append(rng.choice([" ", "\n", " \t "]).join(u))
    # A run within a run, runs that touch, and one that ends with its text.
    out += ["x " + ("a a a a a a b " * 5).strip(), "a b c " * 5 + "d e " * 6, ("p q r s t u v w " * 11).strip()]
    return out


def test_lyndon_arrays():
    rng = random.Random(2)
    for _ in range(400):
        s = [0, *[rng.choice([1, 2, 3, 0] if rng.random() < .2 else [1, 2]) for _ in range(rng.randint(0, 18))], 0]
        assert lyndon.lyndon_array(s) == plain_lyndon(s)


def test_runs(spark):
    rng = random.Random(3)
    rows = [(i if i % 9 else None, t, "x", 7, 1.5) for i, t in enumerate(texts(rng))]
    rows += rows[5:8]  # repeated rows give repeated results
    got = lyndon.periodic_runs(spark.createDataFrame(rows, FORM).repartition(3), carry=("runs",)).toDF(
        "doc_id", "carried", "n_words", "runs", "n_dropped", "sha", "kept").collect()
    want = []
    for d, t, *_ in rows:
        u = words(t)
        runs = plain_runs(u)
        kept = collapsed(u, runs)
        want.append((d, "x", len(u), runs, len(u) - len(kept.split()), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert sorted(((*r[:3], [tuple(x) for x in r.runs], *r[4:]) for r in got), key=repr) == sorted(want, key=repr)


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(4)
    period = [f"w{rng.randrange(10**9)}" for _ in range(9_000)]
    noise = [f"n{rng.randrange(10**9)}" for _ in range(20_000)]
    u = noise + (period * 6)[:50_000] + noise[:500]
    df = spark.createDataFrame([(1, " ".join(u)), (2, "z " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in lyndon.periodic_runs(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(20_000, 50_000, 9_000)]
    assert got[1].collapsed_text == " ".join(noise + period + noise[:500])
    assert [tuple(r) for r in got[2].runs] == [(0, 40_000, 1)] and got[2].collapsed_text == "z"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lyndon.digests(lyndon.periodic_runs(lyndon.with_periodic_tail(none))).collect() == []


def test_query(spark):
    """The edit by crc32 and the digests, worked out by hand."""
    rng = random.Random(5)
    rows = [(d, None if d % 50 == 0 else " ".join(rng.choices("abcdefgh", k=rng.randint(0, 120)))) for d in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lyndon.digests(lyndon.periodic_runs(lyndon.with_periodic_tail(df), with_text=False)).collect()
    want, edited = [], 0
    for d, t in rows:
        u, h = words(t), zlib.crc32(str(d).encode())
        if h % 10 == 0 and u:
            edited += 1
            a = h // 10 % len(u)
            p = 1 + (len(u) - a) // (3 + h // 10 % 8)
            u = u[:a] + [u[a + (i - a) % p] for i in range(a, len(u))]
        runs = plain_runs(u)
        best = (None,) * 3
        for r in runs:
            if best[0] is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((d, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                     hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed(u, runs).encode()).hexdigest()))
    assert edited > 20 and sum(w[1] > 0 for w in want) > 10
    assert sorted(map(tuple, got)) == want


def test_stretches_lose_no_run():
    rng = random.Random(6)
    for _ in range(200):
        t = []
        for _ in range(3):
            u = []
            for _ in range(rng.randint(1, 6)):
                u += [f"{rng.random()}" for _ in range(rng.randint(0, 12))] + rng.choices("abcd", k=rng.randint(1, 6)) * rng.randint(1, 7)
            t.append(" ".join(u))
        w, start, length, period = lyndon._text_runs(pa.array(t))
        for d, x in enumerate(t):
            mine = [(int(a - w.first[d]), int(n), int(q)) for a, n, q in zip(start, length, period, strict=True) if w.text[a] == d]
            assert mine == plain_runs(x.split())


def test_collision_is_told(monkeypatch):
    import numpy as np
    monkeypatch.setattr(lyndon, "span_hash", lambda prefix, a, b: np.zeros(len(a), np.uint64))
    with pytest.raises(ArithmeticError):
        lyndon.runs_of(np.array([0, 1, 2, 1, 3, 1, 2, 1, 4, 2, 2, 0]))
