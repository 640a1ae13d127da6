"""Each operator against brute force on small tables with odd rows."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from taintlake.llm import fingerprint, hnsw, langid, packing, rlz, sharding, simhash, suffixes, unigram, warc

FORM = "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id string, block int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(300)]
    plain = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 150))) + "." for _ in range(60)]
    shared = " ".join(rng.choices(vocabulary, k=70))
    out = list(plain)
    out += [plain[3], plain[3], plain[3].upper()]
    out += [plain[i] + " " + shared + "\n" + plain[i + 1] for i in (5, 9, 20)]
    out += [plain[7].replace("a", "b", 1), "", None, " \t\n", "one two", "é ü ▁ 日本   x", shared]
    # Parts of one text in several others, in other orders.
    w = plain[11].split() + plain[12].split() + plain[13].split()
    out += [" ".join(w[30:60] + w[0:20] + w[100:140]), " ".join(w[10:50]), " ".join(w[25:70] + w[25:70]), "a b " * 40]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, "en", "s", len(t or ""), "x", "y", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, FORM).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


def brute_windows(rows, n=13):
    """(doc_id, text) -> removed word marks."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_substrings(docs, texts, monkeypatch, block):
    monkeypatch.setattr(rlz, "BLOCK_ROWS", block)
    got = rlz.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_windows([(i * 3 + 1, t) for i, t in enumerate(texts)]))


def test_substrings_odd_rows(spark, empty, texts):
    assert rlz.dedup_substrings(empty).collect() == []
    t = texts[-1]
    rows = [(None, t), (None, t), (2, t), (2, t), (9, t), (4, None)]
    got = rlz.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The text repeats itself, but within one document nothing goes.
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 0), (2, 0), (2, 0), (4, 0), (9, 80)]
    assert {r.kept_text for r in got if r.doc_id == 4} == {None} and {r.kept_text for r in got if r.doc_id == 2} == {t}


def test_passages(docs, texts, empty):
    got = suffixes.repeated_passages(docs).collect()
    by_id = {i * 3 + 1: words(t) for i, t in enumerate(texts)}
    for r in got:
        a, b = by_id[r.doc_id], by_id[r.other_id]
        assert r.other_id < r.doc_id and r.n_words >= 50
        assert a[r.start:r.start + r.n_words] == b[r.other_start:r.other_start + r.n_words]
    seen = {}
    for d, w in by_id.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i:i + 50]), set()).add(d)
    want = set().union(*[s for s in seen.values() if len(s) > 1])
    assert {r.doc_id for r in got} | {r.other_id for r in got} == want and want
    assert suffixes.repeated_passages(empty).collect() == []


@pytest.mark.parametrize("parts", [4, 40])
def test_passages_behind_a_shared_head(spark, parts):
    """Documents with the head of many others, some of which share more words."""
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = {}
    for g in range(25):
        head, left = some(rng.randint(32, 49) if g < 10 else 49), some(rng.randint(0, 18) if g < 10 else 0)
        passage = left + head + some(max(0, rng.randint(50, 67 if g < 10 else 52) - len(left) - len(head)))
        # The first and the last hold the passage; those between have the head alone.
        group = [some(30) + passage + some(20)] + [some(rng.randint(0, 30)) + head + some(30) for _ in range(6)] + [some(10) + passage + some(9)]
        if g % 2:
            group[0] += head[-32:] + some(5) + head
        rows |= {g * 100 + i: w for i, w in enumerate(group)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = suffixes.repeated_passages(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    windows = lambda w: {tuple(w[i:i + 50]) for i in range(len(w) - 49)}
    found, holders = {i: set() for i in rows}, {}
    for r in got:
        run = rows[r.doc_id][r.start:r.start + r.n_words]
        assert r.other_id < r.doc_id and run == rows[r.other_id][r.other_start:r.other_start + r.n_words] and len(run) >= 50
        found[r.doc_id] |= windows(run)
        found[r.other_id] |= windows(run)
    for i, w in rows.items():
        for x in windows(w):
            holders.setdefault(x, set()).add(i)
    want = {i: {x for x in windows(w) if len(holders[x]) > 1} for i, w in rows.items()}
    assert found == want and sum(map(bool, want.values())) >= 50


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [simhash.TILE_ROWS, 3])
def test_simhash(docs, texts, monkeypatch, tile):
    monkeypatch.setattr(simhash.link_fingerprints, "__defaults__", (4, tile))
    prints = {i * 3 + 1: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == sorted((d, f"{prints[d]:016x}", want[d]) for d in prints)


def test_simhash_chains(spark):
    """Components through many tiles, with fingerprints close to each other."""
    rng = random.Random(1)
    prints = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"), "t", 4, 10).collect()
    want = brute_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    expected = {}
    for k, v in want.items():
        expected.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_simhash_empty(empty, spark):
    assert simhash.near_duplicates(empty).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(5, None), (5, None), (3, ""), (None, "x y")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got.collect()) == [(0, 0), (3, 3), (5, 3), (5, 3)]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 60)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.3])], int(i % 3)) for i in range(400)]
    odd = [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [None] + [1.0] * 7, 1), (1003, [float("nan")] + [1.0] * 7, 1),
           (1004, [float("inf")] + [1.0] * 7, 1), (1005, rows[0][1], None), (1006, rows[0][1][:4], 0), (1007, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    linked = lambda a, b: label[a] == label[b] and x[a] @ x[b] >= 0.93
    component = brute_components(x, linked)
    want = {i: (sum(linked(i, j) for j in x if j != i), component[i], component[i] == i) for i in x}
    assert {i: got[i] for i in x} == want
    assert all(got[i] == (0, i, True) for i, _, _ in odd)
    assert hnsw.near_duplicates(df.limit(0)).collect() == []


def test_links_that_no_beam_reaches():
    """Nodes that the graph can't reach are compared; links to oneself are no evidence."""
    x = np.random.default_rng(4).normal(size=(700, 16))
    x[350:] = x[:350] + 0.01 * x[350:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    for links in graph.links:
        links[:] = -1
    for rows in (x, x[:40]):
        truth = rows @ x.T >= 0.93
        for same in (True, False):
            q, node, audit = hnsw.links(graph, rows.astype(np.float32), x, rows, 0.93, same)
            assert audit.exact and audit.beam == 700
            found = np.zeros_like(truth)
            found[q, node] = True
            apart = ~np.eye(*truth.shape, dtype=bool) | (not same)
            assert (found[apart] == truth[apart]).all()


def test_embeddings_with_rare_links(spark, monkeypatch):
    """Several shards of thousands of nodes; one node in some hundreds has a partner."""
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 2000)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 48))
    at = rng.permutation(4000)[:24]
    x[at[12:]] = x[at[:12]] + 0.2 * rng.normal(size=(12, 48))
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n_links = (x @ x.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(df).collect()}
    assert got == dict(enumerate(n_links.tolist())) and 10 < (n_links > 0).sum() < 40
    told = hnsw.audits(df).collect()
    assert len(told) == 3 and all(not r.exact and r.recall >= 0.99 and r.beam < 2000 for r in told)


def test_the_graph_answers(monkeypatch):
    """Links come from searches, not from the comparison that audits them."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24))
    x[1500:2000] = x[:500] + 0.1 * rng.normal(size=(500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, asked = hnsw.Graph(x), []
    search = hnsw.Graph.within
    monkeypatch.setattr(hnsw.Graph, "within", lambda self, q, *a: (asked.append(len(q)), search(self, q, *a))[1])
    monkeypatch.setattr(hnsw, "_compared", None)
    q, node, audit = hnsw.links(graph, x.astype(np.float32), x, x, 0.93, True)
    assert asked[-1] == 3000 and not audit.exact and audit.recall >= 0.99
    found = np.zeros((3000, 3000), bool)
    found[q, node] = found[node, q] = True
    truth = x @ x.T >= 0.93
    off = ~np.eye(3000, dtype=bool)
    assert truth[off].sum() >= 900 and (found[off] == truth[off]).all()


def test_language(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ba", "ka", "lo", "mi"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["qué", "ñor", "ión", "aux"]}
    make = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(n))
    rows = [(i, make(k, rng.randint(5, 80)), k, k) for i, k in enumerate(rng.choices(list(sounds), k=300))]
    odd = [(900, None, "aa", "s"), (901, "12 34 !", "aa", "s"), (902, "", None, "s"), (903, make("bb", 60), None, "s"), (None, make("cc", 60), None, "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_found string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows) + len(odd)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "cc"]
    assert all(r.lang_held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    held = [r for i, _, k, _ in rows if (r := got[i]).lang_held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 20
    mixed = make("aa", 100) + " " + make("bb", 100)
    langs, model = langid.learn(df.where("lang IS NOT NULL AND text IS NOT NULL"))
    weight = dict(zip(langs, langid.mixture(model, *langid.trigrams(mixed)), strict=True))
    assert abs(weight["aa"] - 0.4) < 0.2 and weight["bb"] > 0.3 and weight["cc"] == 0
    none = langid.identify(df.where("doc_id < 0")).collect()
    assert none == []
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.lang_score) for r in unlabelled} == {("und", 0.0)}


def test_packing(docs, texts, empty, spark, monkeypatch):
    import tokenizers

    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokenizers.Tokenizer.from_file(path)
    extra = ["<|endoftext|> is special", "tab\tand\n\n lines  twice ", "a \x1c b\x85c", "don't 'll 日本語 " * 900]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = {i * 3 + 1: t for i, t in enumerate(texts)} | {10_000 + i: t for i, t in enumerate(extra)}
    by_doc, by_sequence = {}, {}
    for r in packing.pack(rows, path, with_ids=True).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, t in want.items():
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert ids == model.encode(t or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in pieces] == list(itertools.accumulate([0] + [r.length for r in pieces[:-1]])) and {r.doc_tokens for r in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(itertools.accumulate([0] + [r.length for r in pieces[:-1]]))
        assert sum(r.length for r in pieces) <= 1024
    assert packing.pack(empty, path).collect() == []


def test_first_fit():
    rng = random.Random(4)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 50) for _ in range(40)), reverse=True)
        tree, bins = packing.Tournament(50, len(sizes)), []
        for s in sizes:
            spot = next((i for i, used in enumerate(bins) if used + s <= 50), len(bins))
            bins += [0] * (spot == len(bins))
            assert tree.place(s) == (spot, bins[spot])
            bins[spot] += s


@pytest.mark.parametrize("hot", [0, 30, 400])
def test_sharding(spark, texts, hot):
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "hot text " * 3) for i in range(hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    got = sharding.shard(df, 5).collect()
    assert len(got) == len(rows)
    assert all(r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
               for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True))
    totals, where = {}, {}
    for r in got:
        totals.setdefault(r.shard, []).append(r)
        where.setdefault((dict(rows)[r.doc_id] or ""), set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and set(totals) <= set(range(5))
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in totals.values())
    # The largest shard is as small as any contiguous cut in hash order can make it.
    sizes = {}
    for _, t in rows:
        h = xxhash.xxh64_intdigest((t or "").encode(), seed=42)
        sizes[h] = sizes.get(h, 0) + len((t or "").encode()) + 1
    order = [sizes[h] for h in sorted(sizes)]

    def fits(cap):
        n, room = 1, cap
        for s in order:
            if s > cap:
                return False
            if s > room:
                n, room = n + 1, cap
            room -= s
        return n <= 5

    assert max(sum(r.size for r in rs) for rs in totals.values()) == next(c for c in itertools.count(1) if fits(c))
    assert sharding.shard(df.limit(0)).collect() == []


def test_fingerprints(docs, texts, empty, spark):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    ids = sorted(got)
    text = {i * 3 + 1: t or "" for i, t in enumerate(texts)}
    for d, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t = text[d]
        edited = t[:len(t) - len(t) // 4] + text[after][:len(t) // 4]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for value, s in ((got[d].fingerprint, t), (got[d].edited_fingerprint, edited)):
            digests = [hashlib.md5(p.encode()).hexdigest() for p in re.split(r"[\n\r.!?]+", s) if p]
            a, b = [int(m[:15], 16) for m in digests], [int(m[15:30], 16) for m in digests]
            spread = 1 | 1 << 20 | 1 << 40
            lanes = [f"{len(a):08x}", f"{sum(x & (1 << 30) - 1 for x in b) % 2**32:08x}", f"{sum(x >> 30 for x in b) % 2**32:08x}"]
            assert value == "".join(lanes + [f"{sum(x >> j & spread for x in a) % 2**60:015x}" for j in range(20)])
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert fingerprint.fingerprints(empty).collect() == []
    one = spark.createDataFrame([(4, "Ab. Cd", "x"), (None, "q", "x")], "doc_id long, text string, lanes string")
    assert sorted((r.doc_id or 0, r.near_next) for r in fingerprint.fingerprints(one).collect()) == [(0, 0.0), (4, 1.0)]


def test_fingerprint_algebra(spark):
    df = spark.createDataFrame([("b! a.\nc", "a. c", "b")], "whole string, part string, rest string")
    lanes = df.select(*[fingerprint.lanes(c).alias(c) for c in df.columns], fingerprint.lanes("'c. b. a'").alias("other"))
    r = lanes.select(fingerprint.merged("part", "rest").alias("sum"), fingerprint.merged("whole", "rest", -1).alias("less"), "*").first()
    trimmed = spark.createDataFrame([("b! a.\nc",)], "t string")
    assert r.less == lanes.select(fingerprint.merged("whole", "rest", -1).alias("x")).first().x and len(r.sum) == 23
    assert trimmed.select(fingerprint.lanes("t").alias("x")).first().x == r.whole


def brute_split(u, word):
    best = (-math.inf, None)
    scored = {u.pieces[i]: u.score[i] for i in u.plain}

    def walk(at, value):
        nonlocal best
        if at == len(word):
            best = max(best, (value, 0))
            return
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in scored:
                walk(end, value + scored[word[at:end]])
        if word[at] not in scored:
            walk(at + 1, value + u.unknown)

    walk(0, 0.0)
    return best[0]


def test_unigram(docs, texts, empty, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    u = unigram.load(path)
    value = lambda ids: sum(u.score[i] for i in ids if i in u.plain)
    for w in ["▁hello", "▁thning", "s.", "▁▁x", "▁日本x"]:
        ids = u.split(w)
        unknown = sum(1 for c in w if c not in {u.pieces[i] for i in u.plain})
        assert math.isclose(value(ids) + unknown * u.unknown, brute_split(u, w))
        assert u.split_all([w])[0] == np.array(ids, "<u4").tobytes()
    rng = random.Random(8)
    pieces = [u.pieces[i] for i in sorted(u.plain)]
    for _ in range(300):  # random words of pieces and letters, some without a piece
        w = "▁" * rng.randint(1, 2) + "".join(rng.choice(pieces).replace("▁", "") if rng.random() < .6 else rng.choice("abcxyzéß日\U0001F9FF") for _ in range(rng.randint(1, 4)))
        if len(w) > 14:
            continue
        ids = u.split(w)
        unknown = sum(1 for c in w if c not in {u.pieces[i] for i in u.plain})
        assert math.isclose(value(ids) + unknown * u.unknown, brute_split(u, w)) and u.split_all([w])[0] == np.array(ids, "<u4").tobytes()
    assert math.isclose(math.fsum(math.exp(u.score[i]) for i in u.plain), 1.0)
    common, rare = u.pieces.index("om"), u.pieces.index("END")
    assert math.isclose(u.score[common] - u.score[rare], math.log(4742 / 42))
    got = unigram.encode(docs, path)
    assert {r.doc_id: r.text for r in unigram.decode(got, path).collect()} == {i * 3 + 1: t for i, t in enumerate(texts)}
    rows = got.collect()
    assert all(r.round_trip for r in rows if r.round_trip is not None) and sum(r.round_trip is None for r in rows) == 1
    assert unigram.encode(empty, path).collect() == []
    monkeypatch.setattr(unigram, "CACHE_WORDS", 5)  # what is forgotten is solved again, markers in a text too
    for t in ["a▁b c", "d e f g h▁", "▁▁ i j k l", "m"] * 2:
        assert u.decode(u.encode(t)) == t


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "u", "WARC/1.1\r\n\r\nbody\r\n\r\n"),
            (None, "u", "lonely"), (None, "u", "<p>é</p>"), (7, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, head string").repartition(2)
    got = {(r.page_id, r.payload_bytes): r for r in warc.archived_pages(df).collect()}
    assert len(got) == len(rows)
    assert (got[1, 9].record_type, got[1, 9].refers_to, got[2, 9].record_type) == ("revisit", 2, "response")
    assert (got[3, 0].refers_to, got[4, 0].record_type, got[None, 6].record_type, got[None, 9].refers_to) == (4, "response", "response", 2)
    import base64

    for _, _, html in rows:
        data = (html or "").encode()
        assert any(r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.payload_bytes == len(data) for r in got.values())
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_pages(df, path, compression)
        read = warc.read_warc(spark, path)
        assert read.count() == len(rows)
        assert {bytes(r.payload).decode() for r in read.where("page_id IN (5, 7)").collect()} == {rows[4][2], rows[7][2]}
        assert {r.page_id for r in read.where("target_uri = 'http://a/1' AND record_type = 'revisit'").collect()} == {1}
        assert all(r.payload is None and r.reject_reason is None for r in warc.read_warc(spark, path, payload=False).collect())
        heads = {r.page_id: r for r in read.collect()}
        assert heads[1].refers_to == heads[2].record_id and heads[2].refers_to is None
    assert warc.archived_pages(df.limit(0)).collect() == []


def test_bad_records(spark, tmp_path):
    """Records that cannot be read are rows with a reason; those around them are read."""
    import gzip

    def record(page, body, kind="response", length=None, http=True):
        block = (b"HTTP/1.1 200 OK\r\n\r\n" if http else b"") + body
        return b"WARC/1.1\r\nWARC-Type: %s\r\nX-Page-Id: %s\r\nContent-Type: application/http\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n" % (
            kind.encode(), str(page).encode(), str(len(block) if length is None else length).encode(), block)

    good = [record(i, b"body %d" % i) for i in range(6)]
    files = {"length.warc": good[0] + record(90, b"x", length="many") + good[1] + record(91, b"x", length="") + good[2],
             "http.warc": record(92, b"no header end", http=False) + good[3], "cut.warc": good[4] + record(93, b"short", length=5_000_000),
             "junk.warc": b"not a record\r\n\r\nmore\r\nWARC-like\r\n" + good[5], "tail.warc": b"WARC/1.1\r\nX-Page-Id: 94\r\nno end",
             "wide.warc": b"WARC/1.1\r\nX-Page-Id: 95\r\nX: " + b"y" * 3_000_000 + b"\r\n" + record(6, b"body 6"),
             "number.warc": record("9x", b"body"), "empty.warc": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    packed = gzip.compress(record(7, b"body 7") + b"".join(record(1000 + i, bytes(os.urandom(9_000).hex(), "ascii")) for i in range(400)))
    (tmp_path / "broken.warc.gz").write_bytes(packed[:len(packed) // 2] + b"\x00" * 50)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    fine = {r.page_id: r.payload for r in rows if r.reject_reason is None}
    assert all(bytes(fine[i]) == b"body %d" % i for i in range(8)) and bytes(fine[None]) == b"body"
    assert not {90, 91, 92, 93, 94, 95} & set(fine)
    bad = [r for r in rows if r.reject_reason is not None]
    assert {r.page_id for r in bad} >= {90, 91, 92, 93} and all(r.payload is None for r in bad)
    assert {r.reject_reason.split(":")[0].split(" '")[0] for r in bad} >= {"content length", "HTTP block without header end", "record is cut off", "no WARC record", "header without end"}
    told = warc.read_warc(spark, str(tmp_path)).where("record_type = 'response' AND page_id < 90").collect()
    assert {r.page_id for r in told} >= set(range(8)) and all(r.record_type == "response" for r in told)
    assert warc.read_warc(spark, str(tmp_path), payload=False).where("reject_reason IS NOT NULL").count() >= 6


def test_reader_takes_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader("/nowhere", True)
    left = GreaterThan(("page_id",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), left])) == [left]
    assert reader.tests == [("record_type", "equal", "response")]
