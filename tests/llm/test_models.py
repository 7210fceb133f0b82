from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from glintscan.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", "x"), (3, "12 34 ?! ½", "x"), (4, "Das ist ein sehr kleines Haus", "x"), (4, "Das ist ein sehr kleines Haus", "x"), (None, "the house of the " + "word " * 30_000, "x")]


def odd(spark, clash):
    return spark.createDataFrame(ODD, f"doc_id long, text string, {clash} string")


def test_forward_sums_every_segmentation():
    rng = np.random.default_rng(1)
    pieces = ["a", "b", "ab", "aba", "ba", "bb"]
    prob = np.concatenate([rng.random((len(pieces) + 1, 2)), np.zeros((1, 2))])
    ids = {p: i for i, p in enumerate(pieces)}

    @lru_cache
    def total(word, k):
        if not word:
            return 1.0
        return sum(prob[ids.get(word[:n], len(pieces) if n == 1 else -1), k] * total(word[n:], k) for n in range(1, len(word) + 1))

    words = ["abab", "bbba", "caba", "b𐐨ab"]
    alpha = langid.forward(langid.lattice(words, langid.Trie(ids), 3, len(pieces)), prob)
    for w, word in enumerate(words):
        for k in (0, 1):
            assert abs(alpha[w, -1, k] - total(word, k)) < 1e-12


def test_long_words_and_long_pieces_are_summed_whole(monkeypatch):
    pieces = ["▁", "a", "b", "ab", "ba", "abbaabbaabbaabba"]
    counts = {"x": Counter({"abba" * 30: 2, "ab" * 40: 1, "ab": 3}), "y": Counter({"b" * 50: 2, "ba" * 20: 3})}
    model = langid.train(counts, pieces)
    assert model.pieces == pieces
    ids = {p: i for i, p in enumerate(pieces)}
    words = ["abba" * 30, "b" * 33 + "?a", "abb" * 11, "ab" * 40, "ab"]
    scores, _ = model.word_scores(langid.Trie(ids), words)
    for word, row in zip(words, scores):
        alpha = langid.forward(langid.lattice([langid.marked(word)], langid.Trie(ids), model.longest, len(pieces)), model.prob)[0, -1]
        assert np.abs(row - np.log(alpha)).max() < 1e-9
    monkeypatch.setattr(langid, "CELLS", 50)  # one batch a word, several steps
    assert np.abs(model.word_scores(langid.Trie(ids), words)[0] - scores).max() < 1e-9
    monkeypatch.setattr(langid, "SHORT", 200)  # the short words' way of learning
    assert np.abs(langid.train(counts, pieces).prob - model.prob).max() < 1e-9
    long = model.word_scores(langid.Trie(ids), ["abba" * 5000])[0]
    assert np.isfinite(long).all() and long[0, 0] > long[0, 1]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).collect()[0]
    assert n > 100 and right >= 0.98 * n


def test_languages_of_odd_rows(spark):
    model = langid.train({"en": Counter({"the": 9, "house": 3, "of": 5, "word": 2}), "de": Counter({"das": 5, "ist": 5, "haus": 2, "ein": 4})}, langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    out = langid.detect(odd(spark, "score"), model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = sorted(((r.doc_id, r.lang_pred) for r in out.collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en")], key=str)
    empty = langid.fit(odd(spark, "lang").limit(0), ["▁the"], F.lit(True))
    assert {r.lang_pred for r in langid.detect(odd(spark, "lang"), empty).collect()} == {"und"}


def make(rng, bad, n):
    words = ["ka", "mo", "ri", "tesu", "polo", "nami", "sora", "hito"]
    text = ["".join(rng.choice(words, 2)) for _ in range(n)]
    if bad:
        for _ in range(3):
            text[rng.integers(n)] = rng.choice(["gruffling", "gruffled", "gruffy"])
    return " ".join(text)


def test_toxicity_knows_unseen_inflections():
    rng = np.random.default_rng(2)
    labels = [k % 2 for k in range(400)]
    texts = [make(rng, y, int(rng.integers(20, 200))) for y in labels]
    model = toxicity.train(texts, labels)
    score = lambda ts: _toxic(model, ts)
    base = [make(rng, 0, 60) for _ in range(40)]
    assert (score(base) < 0.5).mean() > 0.9
    assert (score([b + " gruffle grufflings gruffler" for b in base]) > 0.5).mean() > 0.9


def _toxic(model, texts):
    from glintscan.llm.common import Numbering

    seen = Numbering()
    numbers = [np.array([seen[w] for w in toxicity.WORD.findall(t.lower())], np.int64) for t in texts]
    sums, counts = model.word_sums(seen.take_fresh())
    return model.score(np.concatenate(numbers), np.array([len(x) for x in numbers]), sums, counts)


def test_scores_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    labels = [k % 2 for k in range(60)]
    toxic = toxicity.train([make(rng, y, 30) for y in labels], labels, steps=5)
    good = quality.train([("Well said. " * 9 if y else "||| *** " * 9) for y in labels], labels, steps=20)
    for scored in (toxicity.score(odd(spark, "score"), toxic), quality.score(odd(spark, "score"), good)):
        got = {}
        for r in scored.collect():
            assert 0 <= r.score <= 1
            assert abs(got.setdefault((r.doc_id, r.text), r.score) - r.score) < 1e-12
        assert abs(got[(1, None)] - got[(2, "")]) < 1e-12
    untrained = toxicity.train([], []), quality.train(["a", "b"], [1, 1])
    assert [r.score for r in toxicity.score(odd(spark, "x"), untrained[0]).collect()] == [0.5] * 6
    assert [r.score for r in quality.score(odd(spark, "x"), untrained[1]).collect()] == [0.5] * 6
    assert quality.score(odd(spark, "x").limit(0), good).count() == 0


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.op9_quality(spark, SF).join(labels, "doc_id").filter("held_out")
    n, right = out.agg(F.count("*"), F.count_if(F.col("quality") == F.col("predicted"))).collect()[0]
    assert n > 50 and right >= 0.95 * n


def test_quality_reads_the_middle_of_long_runs(spark):
    def run(good, n):
        return "文章" * n + ("清楚明白" if good else "0#|9") * n + "文章" * n

    texts, labels = [run(k % 2, 50 + k) for k in range(40)], [k % 2 for k in range(40)]
    model = quality.train(texts, labels, steps=80)
    df = spark.createDataFrame([(0, run(0, 300)), (1, run(1, 300))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert got[1] > 0.5 > got[0]
    for k in range(70):  # wherever the cuts fall, no character and no :// is lost
        w = "a" * k + "://" * 60
        assert "".join(quality.tokens(w)) == w and sum(p.count("://") for p in quality.tokens(w)) == 60


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    # toxicity: 5 passages of 6 words of 9 buckets
    owner = np.repeat(np.arange(6), 3)
    bucket = rng.integers(0, 9, len(owner))
    passage = np.repeat(np.arange(5), 4)
    word = np.concatenate([rng.permutation(6)[:4] for _ in range(5)])
    params = [rng.normal(0, 0.1, (9, 3)), rng.normal(0, 0.5, (3, 2)), rng.normal(0, 0.1, 2)]
    rest = (passage, word, owner, bucket, np.full(5, 0.05), np.full(5, 0.2), np.array([0, 1, 1, 0, 1.0]))
    check(lambda: toxicity.gradients(params, *rest), params)
    # quality: 4 documents of 1 to 4 passages
    n = np.array([1, 4, 2, 3])
    x = rng.normal(0, 1, (10, quality.WIDTH))
    params = [rng.normal(0, 0.3, s) for s in ((quality.WIDTH, 5), (5,), (5, 3), (5, 3), (3,), (5,))] + [np.array([0.1])]
    model = quality.QualityModel(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), params)
    check(lambda: quality.gradients(model, x, n, np.array([0, 1, 1, 0.0]), np.full(4, 0.25)), params)


def check(gradients, params, step=1e-5):
    """Every gradient against the difference of losses."""
    grads, _ = gradients()
    for p, g in zip(params, grads):
        flat, rng = p.reshape(-1), np.random.default_rng(1)
        for k in rng.permutation(len(flat))[:12]:
            held = flat[k]
            flat[k] = held + step
            up = gradients()[1]
            flat[k] = held - step
            down = gradients()[1]
            flat[k] = held
            assert abs((up - down) / (2 * step) - g.reshape(-1)[k]) < 1e-6 + 1e-4 * abs(g.reshape(-1)[k])


def test_toxicity_against_a_plain_scorer(spark):
    rng = np.random.default_rng(5)
    labels = [k % 2 for k in range(60)]
    model = toxicity.train([make(rng, y, 30) for y in labels], labels, steps=20)

    def plain(text):
        words = toxicity.WORD.findall((text or "").lower())
        n = max(1, -(-len(words) // toxicity.PASSAGE))
        size = [len(words) // n + (k < len(words) % n) for k in range(n)]
        best, at = -np.inf, 0
        for s in size:
            subs = [b for w in sorted(set(words[at : at + s])) for b in toxicity.subwords([w])[1].tolist()]
            best = max(best, toxicity.GAIN * sum(float(model.weight[b]) for b in subs) / max(len(subs), toxicity.LEAST) + model.bias)
            at += s
        return 1 / (1 + np.exp(-best))

    texts = [make(rng, k % 2, int(rng.integers(1, 300))) for k in range(20)] + [None, "", "...", "x" * 3000]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts) and all(abs(r.score - plain(texts[r.doc_id])) < 1e-9 for r in got)


def test_quality_against_a_plain_scorer(spark):
    rng = np.random.default_rng(6)
    model = quality.train([("Well said. " * 9 if k % 2 else "||| *** " * 9) for k in range(40)], [k % 2 for k in range(40)], steps=20)
    enc, enc_b, att, gate, w, head, head_b = model.params

    def plain(text):
        words = quality.tokens(text or "")
        n = max(1, -(-len(words) // quality.PASSAGE))
        size = [len(words) // n + (k < len(words) % n) for k in range(n)]
        h, at = [], 0
        for s in size:
            rows = []
            for i in range(at, at + s):
                back = [float(i - lag >= 0 and words[i] == words[i - lag]) for lag in range(1, quality.LAGS + 1)]
                rows.append([*quality.token_features([words[i]])[0].tolist(), *back, max(back)])
            x = np.append(np.mean(rows, axis=0) if rows else np.zeros(quality.WIDTH - 1), s / quality.PASSAGE)
            h.append(np.tanh((x - model.centre) / model.scale @ enc + enc_b))
            at += s
        h = np.array(h)
        e = (np.tanh(h @ att) / (1 + np.exp(-h @ gate))) @ w
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return 1 / (1 + np.exp(-(a @ h @ head + head_b[0])))

    texts = ["Well said. " * int(rng.integers(1, 80)) + "||| " * int(rng.integers(0, 90)) for _ in range(20)] + [None, "", "x" * 500]
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts) and all(abs(r.score - plain(texts[r.doc_id])) < 1e-5 for r in got)


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op2_toxicity(spark, SF)
    assert out.count() == docs.count() and out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    found, toxic = sum(r.predicted for r in rows if r.toxic == 1), sum(r.toxic == 1 for r in rows)
    false, clean = sum(r.predicted for r in rows if r.toxic == 0), sum(r.toxic == 0 for r in rows)
    print("toxic found", found, "of", toxic, "false", false, "of", clean)
    assert false <= 0.05 * clean and found >= 0.2 * toxic  # few dozen examples; the score's order says more
    scores = [(r.score, r.toxic) for r in rows]
    auc = np.mean([a > b for a, y in scores for b, z in scores if y == 1 and z == 0])
    print("share of pairs in order", auc)
    assert auc > 0.75


def test_fits_take_whole_texts_once(spark, monkeypatch):
    from glintscan.llm import common

    rows = [(1, "b text", "x"), (1, "a text", "x"), (1, "z other", "y"), (2, None, "x"), (3, "c text", None), (None, "d text", "x"), (4, "e" * 50, "x"), (5, "last", "x")] + [(6, "same", "y")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("draw", F.lit(1))
    seen = []
    monkeypatch.setattr(langid, "train", lambda counts, pieces: seen.append({k: dict(v) for k, v in counts.items()}))
    langid.fit(docs, [], F.lit(True))
    assert seen[0] == {"x": {"a": 1, "text": 1, "e" * 50: 1, "last": 1}, "y": {"z": 1, "other": 1, "same": 1}}
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, F.lit(True), "toxic", (9, 9)) == (["a text", "e" * 50, "last"], [1, 0, 1])
    monkeypatch.setattr(common, "MOST_BYTES", 40)
    assert toxicity.labelled_sample(docs, labels, F.lit(True), "toxic", (9, 9)) == (["a text", "last"], [1, 1])
    assert toxicity.labelled_sample(docs.limit(0), labels, F.lit(True), "toxic", (9, 9)) == ([], [])
    model = toxicity.fit(docs.limit(0), labels, F.lit(True))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert langid.detect(docs.limit(0), langid.LanguageModel([], [], np.zeros((2, 0)), 1)).count() == 0


def test_capitals_of_the_vocabulary_are_read_in_lower_case():
    model = langid.train({"de": Counter({"Haus": 3})}, ["▁Haus", "▁haus", "▁", "HA", "us", "1a"])
    assert model.pieces == ["▁haus", "▁", "ha", "us"]
