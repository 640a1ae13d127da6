"""Suffix arrays, maximal repeats and the quality verdict against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from taintlake.llm import repeats
from taintlake.llm.words import Words

FORM = "doc_id long, text string, n_words string, kept int, base_failed string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_repeats(u, least):
    """{repeated substring: occurrences} of all maximal repeats, and all covered words."""
    n, seen = len(u), {}
    for i in range(n):
        for j in range(i + least, n + 1):
            seen.setdefault(tuple(u[i:j]), []).append(i)
    seen = {s: at for s, at in seen.items() if len(at) > 1}
    covered = {i + x for s, at in seen.items() for i in at for x in range(len(s))}
    maximal = {s: at for s, at in seen.items()
               if len({u[i + len(s)] if i + len(s) < n else i for i in at}) > 1 and len({u[i - 1] if i else -1 for i in at}) > 1}
    return maximal, covered


def some(rng, k=4, most=45):
    return rng.choice([" ", "\n", " \t"]).join(rng.choices("abcd"[:rng.randint(1, k)], k=rng.randint(0, most)))


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(150):
        texts = [some(rng, most=30) if rng.random() > .1 else None for _ in range(4)]
        w = Words(pa.array(texts, pa.string()))
        sa, least = repeats.SuffixArray(w), rng.randint(1, 4)
        rank = {x: i for i, x in enumerate(np.unique(w.word).tolist())}
        want_order, want_lcp = [], []
        for d in range(4):
            s = [rank[x] for x in w.word[w.first[d]:w.first[d + 1]].tolist()]
            order = sorted(range(len(s)), key=lambda i: s[i:])
            want_order += [int(w.first[d]) + i for i in order]
            for a, b in zip([None, *order], order):
                n = 0
                while a is not None and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                    n += 1
                want_lcp.append(n)
        assert sa.order.tolist() == want_order and sa.lcp.tolist() == want_lcp
        lo, hi, length = sa.maximal(least)
        got = sorted((int(w.text[sa.order[a]]), int(n), sorted((sa.order[a:b + 1] - w.first[w.text[sa.order[a]]]).tolist()))
                     for a, b, n in zip(lo, hi, length, strict=True))
        plain = [plain_repeats(words(t), least) for t in texts]
        assert got == sorted((d, len(s), at) for d, (m, _) in enumerate(plain) for s, at in m.items())
        assert np.flatnonzero(sa.covered(least)).tolist() == sorted(int(w.first[d]) + i for d, (_, c) in enumerate(plain) for i in c)


def test_judge(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, block = prose(12), prose(30)
    texts = [None, "", "\n \t", "a", some(rng, most=60), prose(49), prose(50), prose(120), "naïve ▁ é# *$%&|<>\n" + prose(60)]
    texts += [prose(80) + "\n" + line + "\n" + prose(40) + "\n" + line + "\n" + line, "\n".join([block, prose(20), block, prose(20), block])]
    texts += [(prose(3) + " ") * 40, block + " " + prose(5) + " " + block, "x\n\nx\n \n \nx\r\nx\r\n" + prose(60)]
    texts += ["\n".join(some(rng, most=9) for _ in range(30)) for _ in range(10)]
    several = [prose(9) for _ in range(5)]
    texts += [block + "\n" + prose(100) + "\n" + block, "\n".join([*several, prose(110), *several])]  # too long a repeat, too large a share
    rows = [(i if i != 7 else None, t, "clash", 3, "c") for i, t in enumerate(texts)] + [(1, "", "clash", 3, "c")]
    limits = dict(min_repeat=6, max_covered=0.4, max_repeat=25)
    df = spark.createDataFrame(rows, FORM).repartition(3)
    fields = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "n_covered", "longest_repeat", "base_failed", "kept")
    got = repeats.judge(df, **limits).select(*fields).collect()
    want = []
    for d, t, *_ in rows:
        t = t or ""
        u = words(t)
        m, covered = plain_repeats(u, 6)
        _, three = plain_repeats(u, 3)
        lines = [x for x in t.split("\n") if words(x)]
        longest = max(map(len, m), default=0)
        failed = len(u) < 50 or 100 * len(three) > 50 * len(u)
        want.append((d, len(u), sum(map(len, u)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(three), len(m), len(covered), longest,
                     failed, not failed and len(covered) <= 0.4 * len(u) and longest <= 25))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    verdicts = {(w[9], w[10]) for w in want}
    assert verdicts == {(True, False), (False, True), (False, False)}
    spans = repeats.repeated_substrings(df.where("doc_id = 10"), 6).collect()
    assert max((r.n_words, r.occurrences) for r in spans) == (30, 3)


def test_long_text_and_empty_table(spark):
    rng = random.Random(3)
    u = [f"w{rng.randrange(10**8)}" for _ in range(60_000)]
    df = spark.createDataFrame([(1, " ".join(u)), (2, " ".join(u[:30_000] + u[100:30_100])), (3, "z " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.judge(df).collect()}
    assert got[1].kept and got[1].n_covered == 0
    assert not got[2].kept and (got[2].longest_repeat, got[2].base_failed) == (29_900, True)
    assert got[3].longest_repeat == 49_999 and got[3].base_failed
    empty = spark.createDataFrame([], FORM)
    assert repeats.judge(empty).collect() == [] and repeats.repeated_substrings(empty).collect() == []
    assert repeats.judge(empty, carry=("kept",)).count() == 0
