import zlib
from collections import Counter, defaultdict

import pytest

from glintscan.llm import shards


def check(rows, out, n):
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    for k in range(n):
        assert sorted(slots[k]) == list(range(len(rows) // n + (k < len(rows) % n)))
    assert set(slots) <= set(range(n))


@pytest.mark.parametrize("hot", [0, 300])
def test_law_and_groups(spark, hot, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 50)
    rows = [(k, f"text {k % 250}" if k < 500 else f"alone {k}") for k in range(900)] + [(None, None), (None, None), (5, ""), (7, "text 7"), (7, "text 7")]
    rows += [(2000 + k, "hot") for k in range(hot)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, slot int").repartition(3)
    out = shards.assign(df, 7).collect()
    check(rows, out, 7)
    if not hot:
        groups = defaultdict(set)
        for r in out:
            if r.doc_id is not None and r.doc_id < 500:
                groups[r.doc_id % 250].add(r.shard)
        assert sum(len(v) > 1 for v in groups.values()) <= 15
    else:
        assert len({r.shard for r in out if r.doc_id is not None and r.doc_id >= 2000}) <= 5


def test_refused_groups_find_another_shard(spark):
    rows = [(k, "hot") for k in range(1000)] + [(1000 + k, f"pair {k % 800}") for k in range(1600)] + [(3000 + k, f"alone {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = shards.assign(df, 20).collect()
    check(rows, out, 20)
    groups = defaultdict(set)
    for r in out:
        if 1000 <= r.doc_id < 2600:
            groups[(r.doc_id - 1000) % 800].add(r.shard)
    split = sum(len(v) > 1 for v in groups.values())
    print("split pairs", split)
    assert split <= 8


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "same")] * 100, "doc_id long, text string")
    check([(1, "same")] * 100, shards.assign(df, 40).collect(), 40)
    check([(1, "a")], shards.assign(df.limit(1).selectExpr("doc_id", "'a' AS text"), 40).collect(), 40)
    assert shards.assign(df.limit(0), 40).count() == 0
