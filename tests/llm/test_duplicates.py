"""SimHash, embeddings and repeated passages against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridlens.llm import common, embedding, repeats, simhash


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def by_hand(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("shifts", [8, 1])
def test_simhash(docs, texts, monkeypatch, shifts):
    monkeypatch.setattr(simhash, "SHIFTS", shifts)
    fps = [by_hand(t, 3) for _, t in texts]
    root = roots(len(fps), [(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for (i, _), r in zip(texts, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(texts, fps, root))
    got = simhash.near_duplicates(docs, shingle=3)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and Counter(map(tuple, got.collect())) == want


def test_simhash_links_all_within_three_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, d, replace=False)) for b in base for d in (1, 2, 3, 4)]
    values = [int(b) for b in base] + near
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(v,) for v in set(values)], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= 3}
    assert got <= want and len(got) >= 120
    index = {v: i for i, v in enumerate(sorted(set(values)))}
    assert roots(len(index), [(index[a], index[b]) for a, b in got]) == roots(len(index), [(index[a], index[b]) for a, b in want])


def test_first_of_each(docs):
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and not {6, 8} & set(ids) and ids.count(None) == 2


def test_similar_texts_meet(spark, empty):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = []
    for i in range(40):
        words = [word() for _ in range(400)]
        rows.append((2 * i, " ".join(words)))
        for k in rng.choice(400, 6 if i % 2 else 120, replace=False):
            words[k] = word()
        rows.append((2 * i + 1, " ".join(words)))
    got = dict(map(tuple, simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] == 2 * i + (0 if i % 2 else 1) for i in range(40))
    assert simhash.similar(empty).count() == 0


@pytest.mark.parametrize("hubs", [(1, 8), (1,)])
def test_similar_is_exact_at_the_threshold(spark, monkeypatch, hubs):
    monkeypatch.setattr(simhash, "HUBS", hubs)
    monkeypatch.setattr(simhash, "SHORT", 32 if len(hubs) > 1 else 2)
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    rows = []
    for i in range(120):  # m shingles of 5 words are n - 4 words; k last words changed leave n - 4 - k shared
        n, words = (44, 76, 184)[i % 3], []
        words = [word() for _ in range(n)]
        k = (n - 4) // 9 + (i % 2)  # Jaccard 0.8 or just below
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: n - k] + [word() for _ in range(k)]))]
    shared = " ".join(word() for _ in range(30))
    rows += [(1000 + i, " ".join([shared, *(word() for _ in range(20))])) for i in range(60)]
    chain = [word() for _ in range(300)]
    rows += [(2000 + i, " ".join(chain[i * 10 : i * 10 + 100])) for i in range(20)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(roots(len(rows), near))}
    got = dict(map(tuple, simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == want and len(near) >= 60 and max(np.bincount(list(Counter(want.values()).values()))) > 1


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(map(tuple, common.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(400) if i % 50] + [tuple(x) for x in rng.integers(-(1 << 62), 1 << 62, 200)[rng.integers(0, 200, (150, 2))].tolist()]
    frame = spark.createDataFrame(pairs, "a long, b long")
    spark.sparkContext.setJobGroup("few", "few")
    few = sorted(map(tuple, common.components(frame).collect()))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 8
    monkeypatch.setattr(common, "FEW", 0)
    assert few == sorted(map(tuple, common.components(frame).collect())) and len({r for _, r in few}) > 8


@pytest.mark.parametrize("block", [512, 3])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + rng.normal(size=16) * 0.05 * (i % 7)).tolist()) for i in range(90)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (202, (np.array(rows[0][1]) * 1e-3).tolist()), (203, None), (204, []), (205, [0.0] * 16), (206, [float("nan")] + [1.0] * 15), (207, [None] + [1.0] * 15), (208, [float("inf")] * 16), (209, [1.0, 2.0]), (210, [2.0, 4.0]), (None, rows[1][1])]
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    pairs = [(a, b) for a in good for b in good if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    links, root = Counter(x for p in pairs for x in p), roots(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, links[k], least.get(root[k]), i == least.get(root[k])) for k, (i, _) in enumerate(rows))
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, cid long, key long, least string")
    assert Counter(map(tuple, embedding.near_duplicates(frame).collect())) == want
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_at_the_threshold_share_a_bucket():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    mine, theirs = embedding.buckets(a), embedding.buckets(b)
    assert (mine[:, :, :, None] == theirs[:, :, None, :]).any((1, 2, 3)).all()


@pytest.mark.parametrize("block", [16_384, 40, 2])
def test_repeats(docs, texts, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "POOL", 50_000 if block > 100 else 64)
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 20 if block > 100 else 1000)
    own = [(i, (t or "").encode()) for i, t in texts]
    first = {}
    for i, data in own:
        for p in range(len(data) - 49) if i is not None else ():
            s = data[p : p + 50]
            first[s] = min(i, first.get(s, i))
    want = Counter()
    for i, data in own:
        gone = bytearray(len(data))
        for p in range(len(data) - 49) if i is not None else ():
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(g and not b for g, b in zip(gone, b"\0" + bytes(gone)))
        want[i, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()] += 1
    assert Counter(map(tuple, repeats.removed(docs).collect())) == want


def test_without_repeats(docs, empty):
    kept = repeats.without_repeats(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString() and kept.count() == docs.count()
    text = {r.doc_id: r.text for r in kept.collect()}
    assert text[1] is None and text[6] == "" and text[5]
    assert repeats.removed(empty).count() == simhash.near_duplicates(empty).count() == simhash.first_of_each(empty).count() == 0
