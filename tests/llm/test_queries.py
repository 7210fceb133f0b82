import base64
import hashlib
from collections import Counter

import duckdb
import public_tokenizers as P
import tiktoken

from glintscan.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_sql_of_decontamination(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.OP5_SQL)
    got = queries.op5_decontamination(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_digests_of_tokens(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op10_byte_bpe(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_counts_of_edited_documents(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op6_token_counts(spark, SF).collect()
    assert len(out) == len(texts)
    assert all(r.n_tokens == len(theirs.encode_ordinary(texts[r.doc_id])) for r in out)


def test_shards_of_documents(spark):
    out = queries.op3_label_shards(spark, SF).collect()
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
