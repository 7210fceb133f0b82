import hashlib
import random

import numpy as np
import pytest

from glintscan.llm import queries
from glintscan.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), i if i is not None else 2**63 - 1
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), i if i is not None else 2**63 - 1
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < own:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, t, kept, len(b), int(gone.sum()), spans))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted([(r.doc_id, r.text, bytes(r.kept), r.n_bytes, r.n_removed, len(r.spans)) for r in S.remove_repeats(df, **kw).collect()], key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.choice([2, 5])))
    passages = ["".join(word() for _ in range(n)) for n in (8, 12, 14, 15, 30, 60)] + ["ab" * 60, "a" * 130, "x" * 49, "y" * 50, "z" * 51]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 50), (None, passages[5]), (None, passages[5] + "!"), (5, passages[5])]
    for i in range(6, 60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(word() for _ in range(rng.choice([1, 4, 15]))) for _ in range(rng.randint(1, 6))]
        rows.append((i, "".join(parts)))
    rows += rows[9:12] + [(9, rows[20][1]), (70, rows[21][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("way", ["plain", "hot", "small"])
def test_against_brute_force(spark, monkeypatch, seed, way):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "u") for i, t in rows], "doc_id long, text string, uid string").repartition(3)
    if way == "hot":  # anchors of more than four texts go string by string
        monkeypatch.setattr(S, "HOT_TEXTS", 4)
    if way == "small":  # longer grams, several flushes of a task, many copies answered where they are read
        monkeypatch.setattr(S, "gram_size", lambda size: 24 + 8 * (seed % 2))
        monkeypatch.setattr(S, "FLUSH", 300)
        monkeypatch.setattr(S, "MANY", 1)
    assert found(df) == brute(rows)


def test_answers_are_no_row_for_each_text_and_bucket(spark, monkeypatch):
    rng = random.Random(8)
    passages = ["".join(rng.choices("abcdefgh ", k=90)) for _ in range(60)]
    rows = [(i, "".join(rng.choice(passages) + f"{i:05}" for _ in range(8))) for i in range(400)]
    made = {}

    def counted(df, plain=S.checkpoint):
        out = plain(df)
        made[tuple(out.columns)] = out.count()
        return out

    monkeypatch.setattr(S, "checkpoint", counted)
    monkeypatch.setattr(S, "BUCKET_BYTES", (32 << 10, 32 << 10))
    monkeypatch.setattr(S, "SLOT_BYTES", 64 << 10, raising=False)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    answers = [n for columns, n in made.items() if "got" in columns]
    assert answers and max(answers) < len(rows)


def test_many_repeated_rows(spark):
    text = "one sentence of more than fifty bytes that is here again and again. " * 20
    df = spark.range(20_000).selectExpr("2L AS doc_id", f"'{text}' AS text").union(spark.createDataFrame([(1, text), (3, "new " + text)], "doc_id long, text string"))
    got = {(r.doc_id, r.n_removed, r.n_spans): r.n for r in S.remove_repeats(df).selectExpr("doc_id", "n_removed", "size(spans) AS n_spans").groupBy("doc_id", "n_removed", "n_spans").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {(1, 0, 0): 1, (2, len(text), 1): 20_000, (3, len(text) + 1, 1): 1}  # the blank before is in the first as well


def test_query(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, _, kept, n, gone, spans in brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert sorted(map(tuple, queries.op4_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want


def test_hot_anchors_are_told_by_bits():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    hot = S.HotAnchors(24)
    assert not hot.has(keys).any()
    part = S.bucket_of(keys[:50], 24)
    for p in range(24):
        if (part == p).any():
            low, high = S.low_bits(keys[:50][part == p])
            hot.add(p, hot.marks(S.from_bits(low.tobytes(), high.tobytes())))
    assert hot.has(keys[:50]).all() and hot.has(keys[50:]).mean() < 0.01


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string, kept int")).count() == 0


def test_suffix_ranks_order_prefixes():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 4, 5, 50, 51, 52, 700):
        for top in (1, 2, 5, 200):
            s = rng.integers(1, top + 1, n).astype(np.int64)
            for need in (1, 5, 50):
                rank = S.suffix_ranks(s, need)
                prefix = [tuple(s[i : i + need].tolist()) for i in range(n)]
                by_rank = sorted(range(n), key=lambda i: (rank[i], prefix[i]))
                assert [prefix[i] for i in by_rank] == sorted(prefix), (n, top, need)


def test_repeats_numbers_equal_strings():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 84))) for _ in range(40)] + [b"a" * 80] * 3
    starts = np.array([len(p) - 49 for p in parts])
    number, part = S.repeats(parts, starts)
    strings = [p[i : i + 50] for p in parts for i in range(len(p) - 49)]
    seen = {}
    for s, k in zip(strings, number.tolist()):
        assert seen.setdefault(s, k) == k
    assert len(set(seen.values())) == len(seen)


def test_answers_of_a_bucket_are_the_places_of_shared_anchors(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 500, dtype=np.uint8).tobytes() for _ in range(60)]
    texts += [t[:200] + texts[0] for t in texts[:40]]
    rows = []
    for own in (texts[:70], texts[30:], texts[5:6]):  # of three tasks; some texts are in two
        batch = pa.RecordBatch.from_arrays([pa.array([hashlib.md5(t).digest() for t in own], pa.binary()), pa.array(own, pa.binary())], names=["key", "text"])
        rows += S.first_pass(12, 16, 3)(iter([batch]))
    places: dict[int, set] = {}
    for t in texts:
        _, low, _, _, key = S.segments(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 16)
        for k, at in zip(key.tolist(), low.tolist(), strict=True):
            places.setdefault(k, set()).add((hashlib.md5(t).digest(), at))
    wanted = {x for found in places.values() if len({u for u, _ in found}) > 1 for x in found}
    for hot, some in ((8192, False), (20, True)):
        monkeypatch.setattr(S, "HOT_TEXTS", hot)
        got, marks = [], 0
        for bucket in range(2):
            answer = S.first_answer(S.HotAnchors(12), 3)(pa.Table.from_batches([r for r in rows if r.column(0)[0].as_py() == bucket])).to_pylist()
            uid, values = S.from_slots([(r["uid"], r["n"], r["got"]) for r in answer if r["uid"] is not None], 1)
            got += [(u.tobytes(), v) for u, v in zip(uid, values[:, 0].tolist(), strict=True)]
            marks += sum(r["uid"] is None for r in answer)
        assert set(got) == wanted and bool(marks) == some
