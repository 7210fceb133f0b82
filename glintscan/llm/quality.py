"""Quality: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of at most PASSAGE tokens. A run without blanks of over LONGEST characters is as many
tokens as it needs, so that every character reaches a passage. Each passage is encoded from the shapes of its tokens and
from how they repeat; gated attention, learned from document labels alone, weighs the encodings; a logistic unit
scores the weighted sum. All of it is trained in numpy by Adam over a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glintscan.llm import common
from glintscan.llm.common import Grown, Numbering, map_text, sums_by_row, worker_state
from glintscan.llm.toxicity import labelled_sample, passages

PASSAGE = 40
LONGEST = 64
#: A token of a long run; the :// that its end would part stays whole.
PIECE = re.compile(r".{1,%d}(?:(?<=:)//|(?<=:/)/)?" % LONGEST, re.DOTALL)
SHAPES = 16
BASE = 14
LAGS = 12
#: Token features, repeats of the token 1..LAGS places back, repeats at any of these, and the passage's size.
WIDTH = BASE + SHAPES + LAGS + 2


def tokens(text: str) -> list[str]:
    """The text's runs without blanks, long ones in consecutive pieces."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [piece for w in words for piece in ([w] if len(w) <= LONGEST else PIECE.findall(w))]


def token_features(words: list[str]) -> np.ndarray:
    """Length, character classes, ending and hashed shape of each distinct token."""
    out = np.zeros((len(words), BASE + SHAPES), np.float32)
    for k, w in enumerate(words):
        n = len(w)
        alpha = digit = upper = 0
        shape, last = [], ""
        for c in w:
            if c.isalpha():
                alpha += 1
                s = "X" if c.isupper() else "x"
                upper += s == "X"
            elif c.isdigit():
                digit += 1
                s = "0"
            else:
                s = c
            if s != last:
                shape.append(s)
                last = s
        end = w[-1]
        out[k, :BASE] = (n / 10, alpha / n, digit / n, 1 - (alpha + digit) / n, w[0].isupper(), upper == alpha and alpha > 1, alpha + digit == 0, end in ".!?", end in ",;:", not (end.isalnum() or end in ".!?,;:"), "@" in w or "://" in w, n <= 2, n > 14, alpha == n)
        out[k, BASE + zlib.crc32("".join(shape).encode("utf-8", "surrogatepass")) % SHAPES] = 1
    return out


def passage_features(number: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every document, and the number of passages of each."""
    size, n = passages(lengths, PASSAGE)
    tokens = np.zeros((len(number), BASE + SHAPES + LAGS + 1), np.float32)
    tokens[:, : BASE + SHAPES] = table[number]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    for lag in range(1, LAGS + 1):
        tokens[lag:, BASE + SHAPES + lag - 1] = (number[lag:] == number[:-lag]) & (doc[lag:] == doc[:-lag])
    tokens[:, -1] = tokens[:, BASE + SHAPES : -1].max(axis=1)
    x = np.zeros((len(size), WIDTH))
    x[:, :-1] = sums_by_row(tokens, size) / np.maximum(size, 1)[:, None]
    x[:, -1] = size / PASSAGE
    return x, n


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]  # encoder, its bias, attention, gate, attention weight, head, its bias

    def forward(self, x: np.ndarray, n: np.ndarray):
        enc, enc_b, att, gate, w, head, head_b = self.params
        x = (x - self.centre) / self.scale
        h = np.tanh(x @ enc + enc_b)
        t, s = np.tanh(h @ att), sigmoid(h @ gate)
        e = (t * s) @ w
        starts = np.cumsum(n) - n
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a /= np.repeat(np.add.reduceat(a, starts), n)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return x, h, t, s, a, z, sigmoid(z @ head + head_b[0])

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)[-1] if len(n) else np.zeros(0)


def gradients(model: QualityModel, x: np.ndarray, n: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the weighted cross-entropy by the model's parameters, and the loss."""
    _, _, att, gate, w, head, _ = model.params
    starts = np.cumsum(n) - n
    xs, h, t, s, a, z, p = model.forward(x, n)
    g = (p - y) * share
    g_zr = np.repeat(g[:, None] * head, n, axis=0)
    g_a = (g_zr * h).sum(axis=1)
    g_e = a * (g_a - np.repeat(np.add.reduceat(a * g_a, starts), n))
    g_t, g_s = g_e[:, None] * w * s * (1 - t**2), g_e[:, None] * w * t * s * (1 - s)
    g_h = (g_zr * a[:, None] + g_t @ att.T + g_s @ gate.T) * (1 - h**2)
    loss = -float((share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    return [xs.T @ g_h, g_h.sum(axis=0), h.T @ g_t, h.T @ g_s, (t * s).T @ g_e, z.T @ g, np.array([g.sum()])], loss


def train(texts: list[str], labels: list[int], hidden: int = 16, inner: int = 8, steps: int = 250, rate: float = 0.02, seed: int = 11) -> QualityModel:
    """Full-batch Adam. Without both classes the model scores every text 0.5."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, s) for s in ((WIDTH, hidden), (hidden,), (hidden, inner), (hidden, inner), (inner,), (hidden,))] + [np.zeros(1)]
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        params[5][:] = 0
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), params)
    made = []
    for k in range(0, len(texts), 64):  # bounds the token matrix
        seen = Numbering()
        numbers = [np.array([seen[w] for w in tokens(t or "")], np.int64) for t in texts[k : k + 64]]
        made.append(passage_features(np.concatenate(numbers), np.array([len(v) for v in numbers], np.int64), token_features(seen.take_fresh())))
    x, n = (np.concatenate(c) for c in zip(*made, strict=True))
    model = QualityModel(x.mean(axis=0), x.std(axis=0) + 0.05, params)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        grads, _ = gradients(model, x, n, y, share)
        for p_, g_, (m, v) in zip(params, grads, moments, strict=True):
            g_ = g_ + 1e-4 * p_
            m += 0.1 * (g_ - m)
            v += 0.01 * (g_**2 - v)
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: tuple[int, int] = (1500, 1500)) -> QualityModel:
    """Learns `labels.quality` from the documents of `toxicity.labelled_sample`. Without both classes, every text scores 0.5."""
    texts, y = labelled_sample(docs, labels, usable, "quality", per_class)
    return train(texts, y)


def score(df: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends `score double` in [0, 1] for the whole text.

    Null and empty texts, and those of white space only, get the score of one passage without a token. Equal texts have
    equal scores; rows repeat as given; a clashing input column is replaced.
    """

    def compute():
        table = worker_state(("quality", model.params[0].tobytes()), lambda: [Numbering(), Grown(np.float32, BASE + SHAPES)])

        def apply(texts):
            if len(table[0]) > common.TABLE_LIMIT:
                table[:] = [Numbering(), Grown(np.float32, BASE + SHAPES)]
            seen, known = table
            numbers: list[int] = []
            lengths = np.zeros(len(texts), np.int64)
            for k, text in enumerate(texts):
                if text:
                    before = len(numbers)
                    numbers.extend(map(seen.__getitem__, tokens(text)))
                    lengths[k] = len(numbers) - before
            if seen.fresh:
                known.extend(token_features(seen.take_fresh()))
            number = np.array(numbers, np.int64)
            made = np.zeros(len(texts))
            ends = np.cumsum(lengths)
            for a in range(0, len(texts), 64):  # bounds the token matrix
                b = min(a + 64, len(texts))
                low = int(ends[a] - lengths[a])
                made[a:b] = model.score(*passage_features(number[low : int(ends[b - 1])], lengths[a:b], known.data))
            return [pa.array(made)]

        return apply

    return map_text(df, compute, [T.StructField("score", T.DoubleType(), True)], text_col, keep)
