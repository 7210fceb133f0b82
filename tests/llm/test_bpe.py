import base64
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from glintscan.llm import bpe, token_counts
from glintscan.llm import bpe as bpe_module

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
BPE = bpe.ByteBPE(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
ODD = [None, "", " ", "  \n\n x", "a" * 3000, "日本語" * 400, "I'll don't ''s 'S \t", "<|endoftext|>", "x" * 257 + "!" * 700, "‍😀é\r\n"]


def split(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_odd_texts_as_the_library():
    ids, offsets = BPE.encode(ODD)
    assert split(ids, offsets) == [THEIRS.encode_ordinary(t or "") for t in ODD]
    data, at = BPE.decode(ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == [t or "" for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_texts_as_the_library(texts):
    ids, offsets = BPE.encode(texts)
    assert split(ids, offsets) == [THEIRS.encode_ordinary(t) for t in texts]


def test_long_pretokens_merge_in_matrices(monkeypatch):
    rng = random.Random(4)
    for letters in ("ab", "abehinorst", "漢字a", "a", "aeinst"):
        pieces = ["".join(rng.choice(letters) for _ in range(n)) for n in (2, 5, 40, 63, 64, 65, 66, 130, 256, 300, 1500)]
        ids, offsets = bpe_module.ByteBPE(RANKS, P.PATTERN).encode(pieces)
        want = [THEIRS.encode_ordinary(p) for p in pieces]
        assert split(ids, offsets) == want
        assert [BPE._merge_one(p.encode()) for p in pieces] == want  # an edit's way
        monkeypatch.setattr(bpe_module, "LONG", 1)  # short ones in the long ones' way
        ids, offsets = bpe_module.ByteBPE(RANKS, P.PATTERN).encode(pieces)
        assert split(ids, offsets) == want
        monkeypatch.undo()


def test_every_pretoken_of_a_text_goes_through_matrices(monkeypatch):
    bpe = bpe_module.ByteBPE(RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "_merge_one", None)
    text = "qzxvunheardof qqzzword " + "longer" * 900
    ids, offsets = bpe.encode([text])
    assert split(ids, offsets) == [THEIRS.encode_ordinary(text)]


def test_decoding_in_slices_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(bpe, "DECODED", 2000)
    rows = [(k, "word " * (k * 7 % 200)) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "ids_in long, text string").selectExpr("*", "1 AS ids_in_")
    out = bpe.decode_ids(bpe.encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((r.ids_in, bytes(r.decoded)) for r in out) == sorted((i, (t or "").encode()) for i, t in rows)


def test_documents(spark):
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 5), (None, None, 6), (2, "", 7), (3, "x" * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode_ids(bpe.encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(i, THEIRS.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows], key=str)
    assert bpe.encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_edits_give_the_counts_of_a_full_encoding():
    rng = random.Random(1)
    letters = list("ab c'stlre \n\t.!1é漢") + ["don't ", "  ", "hello", "\n\n"]
    for trial in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30, 900])))
        held = token_counts.EditedText.of(BPE, text)
        for _ in range(5):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 2, 7, 60])
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 2, 9])))
            held.edit(a, b, new)
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + new + text[b:]
            assert held.text == text
            assert held.tree.total == len(THEIRS.encode_ordinary(text)), (trial, text)


def test_edits_touch_little():
    text = "The quick brown fox jumps over the lazy dog. " * 400
    held = token_counts.EditedText.of(BPE, text)
    held.edit(9000, 9003, "slow")
    assert held.encoded < 10


def test_edits_of_documents(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (1, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    edits = F.array(F.struct(F.lit(4).alias("start"), F.lit(7).alias("stop"), F.lit("2").alias("new")), F.lit(None))
    out = sorted((r.doc_id, r.n_tokens, r.edited_text, r.edited_tokens) for r in token_counts.count_with_edits(df, edits, RANKS, P.PATTERN, keep=["doc_id"]).collect())
    n = lambda t: len(THEIRS.encode_ordinary(t))
    assert out == sorted([(1, n("one two three"), "one 2 three", n("one 2 three"))] * 2 + [(2, 0, "2", 1), (3, 0, "2", 1)])


def test_kept_leaves_spare_the_encoding(spark):
    from pyspark.sql import functions as F

    n = lambda t: len(THEIRS.encode_ordinary(t))
    rows = [(1, "The quick brown fox. " * 500), (2, None), (3, ""), (4, "one two three")]
    df = spark.createDataFrame(rows, "text_in long, text string").selectExpr("*", "0 AS edits_in_", "1 AS in_0")
    edit = lambda a, b, new: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(new).alias("new")))
    once = token_counts.count_with_edits(df, edit(4, 9, "slow"), RANKS, P.PATTERN, keep=["text_in", "edits_in_", "in_0"], keep_leaves=True)
    texts = {r.text_in: r.edited_text for r in once.collect()}
    assert texts[4] == "one slowhree" and all(r.n_built == r.n_pretokens for r in once.collect())
    again = token_counts.count_with_edits(once.withColumnRenamed("edited_text", "text"), edit(0, 1, "A"), RANKS, P.PATTERN, leaves=(F.col("leaf_chars"), F.col("leaf_tokens")), keep=["text_in", "edits_in_"], keep_leaves=True)
    for r in again.collect():
        want = "A" + texts[r.text_in][1:]
        assert (r.edited_text, r.n_tokens, r.edited_tokens) == (want, n(texts[r.text_in]), n(want))
        assert r.n_built == 0 and r.n_encoded < 10
        assert sum(r.leaf_chars) == len(want) and sum(r.leaf_tokens) == n(want)
    # leaves that don't cover the text are built anew
    other = token_counts.count_with_edits(once.withColumn("text", F.lit("quite another text")), F.lit(None), RANKS, P.PATTERN, leaves=(F.col("leaf_chars"), F.col("leaf_tokens")), keep=["text_in"])
    assert {(r.n_tokens, r.n_built > 0) for r in other.collect()} == {(n("quite another text"), True)}
    assert token_counts.count_with_edits(df.limit(0), F.lit(None), RANKS, P.PATTERN).count() == 0


def test_edits_of_very_long_texts(spark):
    from pyspark.sql import functions as F

    text = "A sentence of some words, again and again. " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    edits = F.array(F.struct(F.lit(400_000).alias("start"), F.lit(400_020).alias("stop"), F.lit("new words").alias("new")))
    r = token_counts.count_with_edits(df, edits, RANKS, P.PATTERN).collect()[0]
    assert r.edited_text == text[:400_000] + "new words" + text[400_020:]
    assert (r.n_tokens, r.edited_tokens) == (len(THEIRS.encode_ordinary(text)), len(THEIRS.encode_ordinary(r.edited_text))) and r.n_encoded < 20
