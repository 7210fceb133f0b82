import base64

import corpus_pipeline
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from glintscan.config import shared_folder

SF = "/root/testdata/sf0.001"


def test_stages_on_whole_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].schema.names == docs.schema.names, name
    counts = [d.count() for d in seen]
    assert counts[0] >= counts[1] > counts[2] >= counts[3] >= counts[4] == counts[5] > 100
    total = lambda d: sum(len(r.text) for r in d.collect())
    assert total(seen[3]) < total(seen[2])
    assert corpus_pipeline.run(spark, SF).count() == counts[5]


def test_cuts_drop_only_the_characters_they_break(spark):
    same = "é" + "a repeated passage of more than fifty bytes, met twice" + "ê"  # é and ê share their first byte, è and ê too
    rows = [(1, same, 9), (2, "\ufffdown start \ufffd" + same[:-1] + "è end\ufffd", 9), (3, "not cut \ufffd", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    text = "\ufffdown start \ufffd end\ufffd"
    assert got == {1: (same, 9), 2: (text, len(text)), 3: ("not cut \ufffd", 9)}


def test_spans_are_widened_to_whole_characters(spark):
    text = "a漢😀\ufffdé"
    raw = text.encode()
    cuts = [(a, b) for a in range(len(raw)) for b in range(a + 1, len(raw) + 1)]
    rows = [(text, [(a, b)]) for a, b in cuts] + [(text, [(0, 2), (3, 6)])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start int, stop int>>")
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    want = ["".join(c for c, s, e in zip(text, at, at[1:]) if e <= a or s >= b) for a, b in cuts] + [text[3:]]
    assert [r.t for r in df.select(corpus_pipeline.whole_characters(df.text, df.spans).alias("t")).collect()] == want


LONG = "a long text of many words without an end " * 3000
SAME = "one passage that two documents share, of clearly more than fifty bytes, word by word"
ITEM = " ".join(f"item{k}" for k in range(20))
ODD = [(1, None, None, 0, 1), (2, "", "en", 0, 2), (3, "12 34 !?", "en", 8, 3), (4, "first " + SAME, "en", 9, 4), (5, "second " + SAME + " and more of it", None, 9, 5), (6, LONG, "en", 9, 6), (7, "copy of a few words", "en", 9, 7), (7, "copy of a few words", "en", 9, 7), (8, "copy of a few words", "de", 9, 8), (9, ITEM, "en", 9, 9), (10, "Das ist ein Haus und das ist gut so", "de", 9, 10), (None, "nobody's text with words of its own", "en", 9, 11), (11, "x", "en", 1, 12)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, n_chars long, key_ long").withColumn("source", F.lit("s"))


@pytest.fixture
def bench(spark, tmp_path):
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_rows_by_stage(spark, bench):
    docs = odd(spark)
    out = {name: stage(spark, docs, bench) for name, stage in corpus_pipeline.STAGES}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == docs.columns, name
    ids = lambda name: sorted((r.doc_id for r in out[name].collect()), key=str)
    every = [r[0] for r in ODD]
    without = lambda *gone: sorted((i for i in every if i not in gone), key=str)
    assert ids("language") == without(1, 2, 3)
    assert {(r.doc_id, r.lang) for r in out["language"].collect()} >= {(5, "en"), (8, "en"), (10, "de")}
    kept = without(2, 8)  # the empty text is a copy of the null one
    kept.remove(7)
    assert ids("near_duplicates") == kept
    cut = {(r.doc_id, r.key_): (r.text, r.n_chars) for r in out["repeated_passages"].collect()}
    assert cut[(4, 4)] == ("first " + SAME, 9) and cut[(5, 5)] == ("second and more of it", 21) and cut[(1, 1)] == (None, 0) and len(cut) == 12
    assert ids("decontaminate") == without(9)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.RANKS, "rb"))}, special_tokens={})
    assert sorted(((r.doc_id, r.ids) for r in out["tokens"].collect()), key=str) == sorted(((r[0], theirs.encode_ordinary(r[1] or "")) for r in ODD), key=str)


def test_empty_tables_by_stage(spark, bench):
    docs = odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, bench).count() == 0, name


def test_without_labelled_languages_only_texts_without_a_letter_go(spark, bench):
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs, bench).count() == len(ODD) - 3


def test_whole_pipeline_against_brute_force(spark, bench):
    """Language, copies, passages, contamination and tokens of the odd rows, by hand."""
    odd(spark).write.parquet(f"{bench}/documents.parquet")
    got = {r.doc_id: (r.lang, r.n_tokens) for r in corpus_pipeline.run(spark, bench).collect()}
    texts = {r[0]: r[1] for r in ODD if r[0] in (4, 6, 7, 10, 11, None)} | {5: "second and more of it"}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.RANKS, "rb"))}, special_tokens={})
    assert {i: n for i, (_, n) in got.items()} == {i: len(theirs.encode_ordinary(t)) for i, t in texts.items()}
    assert got[5][0] == "en" and got[10][0] == "de"


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, name, other):
            return other

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://h:7077"

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_workers_release_after_their_variables_are_gone(monkeypatch):
    import weakref

    import numpy as np

    from glintscan.llm import common, suffix_dedup

    class Table:
        pass

    seen, alive = [], []

    def run(batches):
        table = Table()
        seen.append(weakref.ref(table))
        yield from batches

    plain = common.release
    monkeypatch.setattr(common, "release", lambda: (alive.append(seen[0]() is not None), plain()))
    suffix_dedup.piece_hashes(np.zeros(100, np.uint8), np.array([0]), np.array([60]))
    assert common._WORKER
    assert list(common.releasing(run)(iter([1, 2]))) == [1, 2]
    assert alive == [False] and not common._WORKER


def test_batches_for_workers_are_bounded_by_bytes(spark):
    from glintscan.llm import common

    session = spark.newSession()  # without a limit of its own
    common.ship(session)
    wide = session.range(0, 400, 1, 1).withColumn("text", F.repeat(F.lit("x"), 50_000))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    got = wide.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 400 and max(r.bytes for r in got) < 1.1 * common.BATCH_BYTES
    chosen = spark.newSession()
    chosen.conf.set(common.BATCH_SETTING, "1m")
    common.ship(chosen)
    assert chosen.conf.get(common.BATCH_SETTING) == "1m"


def test_fitting_makes_no_rows_from_the_drivers(spark, monkeypatch):
    from pyspark.sql import SparkSession

    from glintscan.llm import common

    docs = spark.createDataFrame([(k, f"text {k}", "xy"[k % 2]) for k in range(20)], "doc_id long, text string, lang string")
    chosen = docs.select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_group"), (-F.col("doc_id")).alias("draw"))
    monkeypatch.setattr(common, "MOST_BYTES", 2 * 21)
    monkeypatch.setattr(SparkSession, "createDataFrame", None)
    assert common.fitting_texts(docs, chosen, "doc_id", "text", "lang", []) == [(k, f"text {k}") for k in (18, 16, 14, 19, 17, 15)]
