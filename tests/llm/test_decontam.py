import re
import random

import pytest

from glintscan.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for _, text in docs:
        w, hit, met = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(13, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        met.add(str(item))
        out.append((text, len(w), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    rng = random.Random(seed)
    vocabulary = ["the", "The", "été", "x1", "b", "ß", "no", "Ärger"]
    some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, some(30)), (1, some(13)), (2, some(12)), (3, some(3)), (None, some(14)), (4, ""), (5, None), (6, "... !"), (30, some(40))]
    docs = [(1, None), (2, ""), (3, "?!"), (None, some(50))]
    docs += [(i, some(rng.choice([1, 12, 13, 40])) + " " + (rng.choice(items)[1] or "") + " " + some(rng.choice([0, 5, 400]))) for i in range(4, 40)]
    docs += docs[5:9]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.mark(a.selectExpr("*", "1 AS key_", "2 AS n_hit"), b)
    assert "key_" in got.columns
    assert sorted([(r.text, r.n_words, r.n_hit, list(r.hit_items), r.contaminated) for r in got.collect()], key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.mark(docs.limit(0), items).count() == 0
    assert [(r.n_words, r.n_hit) for r in decontam.mark(docs, items.limit(0)).collect()] == [(2, 0)]


def test_very_long_texts(spark):
    item = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "x " * 100_000 + item + " y" * 100_000), (2, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontam.mark(docs, items).collect()) == [(1, 200_040, 40, False), (2, 40, 40, True)]
