"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3-, 4- and 5-grams (with word marks) and of itself, hashed into a table of vectors.
The vectors of a passage's distinct words are averaged (over at least LEAST subwords, so that a passage of one repeated
word has no more weight than that word elsewhere) and a linear softmax gives the passage's class; a document is as
toxic as its most toxic passage, so that a few words are not averaged away in a long text. Vectors and softmax are
trained together over all chosen documents, by gradient descent with momentum: unlike adaptive rates it leaves
n-grams of few documents near zero. Misspelt and inflected words share most n-grams with those seen in training.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.llm import common
from glintscan.llm.common import Grown, Numbering, fitting_texts, map_text, worker_state

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
PASSAGE = 32
#: The mean vector is multiplied by this before the softmax, so that one word in a passage can decide.
GAIN = 30.0
LEAST = 400


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword of every word."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    ends = np.repeat(np.cumsum(size), size)
    owners = [np.arange(len(words))]
    buckets = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], np.int64)]
    rolling = chars + np.uint64(1)
    for n in range(2, 6):
        if len(chars) < n:
            break
        rolling = rolling[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(1)
        if n >= 3:
            at = np.flatnonzero(np.arange(len(rolling)) + n <= ends[: len(rolling)])
            mixed = (rolling[at] ^ (rolling[at] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            owners.append(owner[at])
            buckets.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners), np.concatenate(buckets)


def passages(lengths: np.ndarray, most: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of each document's near-equal passages of at most `most` words, and how many it has (one at least)."""
    n = np.maximum(1, -(-lengths // most))
    first = np.cumsum(n) - n
    rank = np.arange(int(n.sum())) - np.repeat(first, n)
    base, over = lengths // n, lengths % n
    return np.repeat(base, n) + (rank < np.repeat(over, n)), n


def bags(number: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word) of the distinct words of every passage, and how many passages each document has."""
    size, n = passages(lengths)
    passage = np.repeat(np.arange(len(size)), size)
    width = int(number.max()) + 1 if len(number) else 1
    code = np.unique(passage * width + number)
    return code // width, code % width, n


@dataclass
class ToxicModel:
    weight: np.ndarray  # for each bucket: its vector times the difference of the two class weights
    bias: float

    def word_sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        owner, bucket = subwords(words)
        return np.bincount(owner, self.weight[bucket], len(words)), np.bincount(owner, minlength=len(words))

    def score(self, number: np.ndarray, lengths: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of documents, from their words' numbers in one array and the sums and subword counts of each word."""
        passage, word, n = bags(number, lengths)
        total = int(n.sum())
        mean = np.bincount(passage, sums[word], total) / np.maximum(np.bincount(passage, counts[word], total), LEAST)
        logit = GAIN * mean + self.bias
        return 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logit, np.cumsum(n) - n), -60, 60)))


def gradients(params: list[np.ndarray], passage: np.ndarray, word: np.ndarray, owner: np.ndarray, bucket: np.ndarray, weight_of: np.ndarray, share: np.ndarray, truth: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the weighted cross-entropy of passages with these labels, and the loss.

    (passage, word) and (word, subword) pairs are sorted by their first numbers; every passage and word has one at least.
    """
    emb, out, bias = params
    mean, words = means(emb, passage, word, owner, bucket, weight_of)
    logits = GAIN * mean @ out + bias
    p = sigmoid(logits[:, 1] - logits[:, 0])
    g = (p - truth) * share
    grad_logit = np.stack([-g, g], axis=1)
    grad_mean = GAIN * grad_logit @ out.T * weight_of[:, None]
    grad_emb = np.empty_like(emb)
    for d in range(emb.shape[1]):
        grad_word = np.bincount(word, grad_mean[passage, d], words)
        grad_emb[:, d] = np.bincount(bucket, grad_word[owner], len(emb))
    loss = -float((share * (truth * np.log(p) + (1 - truth) * np.log(1 - p))).sum())
    return [grad_emb, GAIN * mean.T @ grad_logit, grad_logit.sum(axis=0)], loss


def means(emb: np.ndarray, passage: np.ndarray, word: np.ndarray, owner: np.ndarray, bucket: np.ndarray, weight_of: np.ndarray) -> tuple[np.ndarray, int]:
    """Mean vectors of passages, and the number of words."""
    words = int(owner.max()) + 1 if len(owner) else 0
    mean = np.empty((len(weight_of), emb.shape[1]))
    for d in range(emb.shape[1]):
        vec = np.bincount(owner, emb[bucket, d], words)
        mean[:, d] = np.bincount(passage, vec[word], len(weight_of)) * weight_of
    return mean, words


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str], labels: list[int], dim: int = 4, steps: int = 100, rate: float = 120.0, decay: float = 2e-6, warm: int = 12, again: int = 4, seed: int = 7) -> ToxicModel:
    """Full-batch gradient descent over the buckets seen; all others weigh nothing. Without both classes the model scores every
    text 0.5. After `warm` steps a document's most toxic passage speaks for it; it is chosen anew every `again` steps, and between
    choices only the chosen passages are read."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicModel(np.zeros(BUCKETS), 0.0)
    seen = Numbering()
    numbers = [np.array([seen[w] for w in WORD.findall((t or "").lower())], np.int64) for t in texts]
    lengths = np.array([len(x) for x in numbers], np.int64)
    passage, word, n = bags(np.concatenate(numbers), lengths)
    del numbers
    owner, hashed = subwords(seen.take_fresh())
    buckets, bucket = np.unique(hashed, return_inverse=True)
    words, total = len(seen), int(n.sum())
    passage, word, owner, bucket = (x.astype(np.int32) for x in (passage, word, owner, bucket))
    starts = np.cumsum(n) - n
    weight_of = 1 / np.maximum(np.bincount(passage, np.bincount(owner, minlength=words)[word], total), LEAST)
    share_of = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.02, (BUCKETS, dim))[buckets]
    out = rng.normal(0, 0.5, (dim, 2))
    params = [emb, out, np.zeros(2)]
    pace = [np.zeros_like(p) for p in params]
    now = passage, word, weight_of, np.repeat(share_of / n, n), np.repeat(y, n)  # every passage speaks for its document at first
    edges = np.searchsorted(passage, np.arange(total + 1))
    for step in range(steps):
        ease = 0.5 + 0.5 * np.cos(np.pi * step / steps)
        if step >= warm and (step - warm) % again == 0:
            mean, _ = means(params[0], passage, word, owner, bucket, weight_of)
            logits = GAIN * mean @ params[1] + params[2]
            delta = logits[:, 1] - logits[:, 0]
            hit = np.flatnonzero(delta >= np.repeat(np.maximum.reduceat(delta, starts), n))
            pick = hit[np.unique(np.repeat(np.arange(len(n)), n)[hit], return_index=True)[1]]
            size = (edges[pick + 1] - edges[pick]).astype(np.int64)
            at = np.arange(int(size.sum())) + np.repeat(edges[pick] - (np.cumsum(size) - size), size)
            now = np.repeat(np.arange(len(pick), dtype=np.int32), size), word[at], weight_of[pick], share_of, y
        some, its_words, weights, share, truth = now
        grads, _ = gradients(params, some, its_words, owner, bucket, weights, share, truth)
        grads[0] += decay * params[0]
        for p_, g_, v, r in zip(params, grads, pace, (rate, 0.02, 0.3), strict=True):
            v *= 0.9
            v -= r * ease * g_
            np.clip(v, -0.5, 0.5, out=v)  # a few documents alone must not make it diverge
            p_ += v
    weight = np.zeros(BUCKETS, np.float32)
    weight[buckets] = params[0] @ (params[1][:, 1] - params[1][:, 0])
    return ToxicModel(weight, float(params[2][1] - params[2][0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, label_col: str, per_class: tuple[int, int]) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most per_class[y] documents of class y, those of least xxhash64 of the id, and of at most
    common.MOST_BYTES together.

    The ids are chosen from `labels` alone and broadcast (so many rows at most). An id labelled more than
    once has its greatest label, one with several texts the least of them; null ids, labels and texts are never used.
    Empty tables give an empty sample.
    """
    one = labels.filter(usable & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    drawn = [one.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in enumerate(per_class)]
    chosen = drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("chosen_id"), F.col("y").alias("chosen_group"), F.xxhash64("doc_id").alias("draw"), "y")
    found = sorted(fitting_texts(docs, chosen, "doc_id", "text", "", ["y"]))
    return [r[2] for r in found], [r[1] for r in found]


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: tuple[int, int] = (2500, 1400)) -> ToxicModel:
    """Learns `labels.toxic` from the documents of `labelled_sample`. Without both classes, every text scores 0.5."""
    texts, y = labelled_sample(docs, labels, usable, "toxic", per_class)
    return train(texts, y)


def score(df: DataFrame, model: ToxicModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends `score double` in [0, 1] for the whole text.

    Null and empty texts, and those without a word, get the score of an empty passage (the softmax of its bias).
    Equal texts have equal scores; rows repeat as given; a clashing input column is replaced.
    """

    def compute():
        table = worker_state(("toxic", model.bias, model.weight.tobytes()[:4096]), lambda: [Numbering(), Grown(np.float64), Grown(np.int64)])

        def apply(texts):
            if len(table[0]) > common.TABLE_LIMIT:
                table[:] = [Numbering(), Grown(np.float64), Grown(np.int64)]
            seen, sums, counts = table
            numbers: list[int] = []
            lengths = np.zeros(len(texts), np.int64)
            for k, text in enumerate(texts):
                if text:
                    before = len(numbers)
                    numbers.extend(map(seen.__getitem__, WORD.findall(text.lower())))
                    lengths[k] = len(numbers) - before
            fresh = seen.take_fresh()
            for k in range(0, len(fresh), 50_000):
                s, c = model.word_sums(fresh[k : k + 50_000])
                sums.extend(s)
                counts.extend(c)
            number = np.array(numbers, np.int64)
            return [pa.array(model.score(number, lengths, sums.data, counts.data))]

        return apply

    return map_text(df, compute, [T.StructField("score", T.DoubleType(), True)], text_col, keep)
