import random
import re

import numpy as np
import pyarrow as pa

from glintscan.llm import jaccard


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                head[find(i)] = find(j)
    ids = {}
    for i, t in rows:
        if i is not None:
            k = find(texts.index(t or ""))
            ids[k] = min(i, ids.get(k, i))
    return [(i, ids.get(find(texts.index(t or ""))), links[texts.index(t or "")]) for i, t in rows]


def corpus(seed, groups=12, copies=12):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bdfgklm" for b in ("a", "en", "i", "or", "ust")]
    rows = [(0, None), (1, ""), (2, "..."), (3, "Few words"), (4, "few, words!"), (None, "few words more")]
    i = 10
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i if rng.random() > 0.02 else None, " ".join(w)))
            i += 1
    rows += rows[8:12]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 256), (2, 3)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
        got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)
        kept = [(r.doc_id, r.text) for r in jaccard.keep_one(df).collect()]
        classes = {c for i, c, _ in brute(rows) if c is not None}
        assert {i for i, _ in kept if i is not None} == classes
        assert len(kept) == len(set(kept))


def test_overlaps_and_depth():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    out = jaccard.overlaps(sets)
    for i in range(30):
        for j in range(30):
            assert out[i, j] == len(np.intersect1d(sets[i], sets[j]))
    d = jaccard.matched_depth(0.8)
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= jaccard.TARGET_RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


def connected(edges):
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        head[find(a)] = find(b)
    groups = {}
    for x in head:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_walk_over_any_ranges():
    rng = np.random.default_rng(5)
    depth, shortest = 5, 2
    for _ in range(60):
        m = int(rng.integers(1, 40))
        rows = sorted((bytes([int(rng.integers(0, 2))]) + rng.integers(0, 3, depth).astype(">u2").tobytes(), b"k%03d" % k) for k in range(m))
        edges, ends = [], []
        cuts = [0, *sorted(rng.integers(0, m + 1, 3).tolist()), m]
        for a, b in zip(cuts, cuts[1:]):
            part = rows[a:b]
            step = int(rng.integers(1, 9))
            batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in part[k : k + step]], pa.binary()) for c in (0, 1)], names=["path", "key"]) for k in range(0, len(part), step)]
            for out in jaccard.walk(iter(batches), depth, shortest):
                for x, y, root in (tuple(r.values()) for r in out.to_pylist()):
                    (ends if root is not None else edges).append((x, root if root is not None else y))
        path = {key: p for p, key in rows}
        for x, y in edges:  # y is the first of its range below the deepest node that x shares with an earlier text
            assert path[x][: 1 + 2 * shortest] == path[y][: 1 + 2 * shortest] and (path[y], y) < (path[x], x)
        assert len({x for x, _ in edges}) == len(edges)
        want = connected((x, p[: 1 + 2 * shortest]) for p, x in rows)
        roots = {p[: 1 + 2 * shortest] for p, _ in rows}
        met = connected(edges + ends)
        strip = lambda groups: {g - roots for g in groups if len(g - roots) > 1}
        assert strip(met) == strip(want)


def test_forest_connects_what_shares_a_prefix(spark):
    rng = np.random.default_rng(6)
    trees, depth, shortest = 3, 4, 2
    rows = [(b"k%03d" % k, rng.integers(0, 4, trees * depth).astype(">u2").tobytes()) for k in range(80)] + [(b"none", None)]
    df = spark.createDataFrame(rows, "key binary, labels binary")
    got = connected((bytes(r.a), bytes(r.b)) for r in jaccard.forest(df, trees, depth, shortest).collect())
    pairs = []
    for i, (x, p) in enumerate(rows[:-1]):
        for y, q in rows[:i]:
            if any(p[8 * t : 8 * t + 4] == q[8 * t : 8 * t + 4] for t in range(trees)):
                pairs.append((x, y))
    assert got == connected(pairs)


def test_registered_query_against_all_pairs(spark):
    from glintscan.llm.queries import op1_ngram_jaccard

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.class_id, r.n_links) for r in op1_ngram_jaccard(spark, sf).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0
    assert jaccard.keep_one(df).count() == 0
