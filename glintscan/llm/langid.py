"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability under a
language is the sum over all its segmentations into pieces, computed by a forward pass over the word's lattice;
expectation-maximisation over the same lattices learns the piece probabilities. No piece of the vocabulary crosses a word,
so the sum over all segmentations of a text is the product over its words, and a worker scores each distinct
word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.llm import common
from glintscan.llm.common import Grown, Numbering, fitting_texts, map_text, sums_by_row, worker_state

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Longer words are summed in logarithms, so that no length underflows.
SHORT = 32
#: Characters of a batch of long words; one word may have more.
CELLS = 1 << 15
UNKNOWN = "und"
#: Documents that a model is fitted on at most.
MOST_DOCUMENTS = 20_000


class Trie:
    """The pieces as a trie in sorted arrays, which walks many strings at once. The root is node 0."""

    def __init__(self, piece_ids: dict[str, int]):
        self.piece_ids = piece_ids
        steps: dict[int, int] = {}
        ends = {0: -1}
        for piece, p in piece_ids.items():
            node = 0
            for c in piece:
                node = steps.setdefault(node << 21 | ord(c), len(steps) + 1)
            ends[node] = p
        self.steps = np.array(sorted(steps), np.int64)  # a node and the character after it
        self.nodes = np.array([steps[k] for k in self.steps.tolist()], np.int64)
        self.piece = np.array([ends.get(k, -1) for k in range(len(steps) + 1)], np.int32)

    def walk(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes go on with that character, and those they lead to."""
        if not len(self.steps):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = node << 21 | char
        at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        live = np.flatnonzero(self.steps[at] == step)
        return live, self.nodes[at[live]]


def lattice(words: list[str], trie: Trie, longest: int, unknown: int) -> np.ndarray:
    """ids[w, start, length - 1]: the piece there, or -1. All words have the same length."""
    n, size = len(words), len(words[0])
    out = np.full((n, size, min(longest, size)), -1, np.int32)
    # by their bytes, as numpy's own strings drop a NUL at the end; a lone surrogate is a character like any other
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.int64)
    w, start = (x.ravel() for x in np.indices((n, size)))
    node = np.zeros(n * size, np.int64)
    for length in range(1, out.shape[2] + 1):
        live, node = trie.walk(node, chars[w, start + length - 1])
        w, start = w[live], start[live]
        out[w, start, length - 1] = trie.piece[node]
        inside = start + length < size
        w, start, node = w[inside], start[inside], node[inside]
    out[:, :, 0][out[:, :, 0] < 0] = unknown
    return out


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[w, end, language]: the summed probability of all segmentations of the first `end` characters."""
    n, size, longest = ids.shape
    alpha = np.zeros((n, size + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, size + 1):
        for length in range(1, min(longest, end) + 1):
            # row -1 of prob is all zeros: no such piece
            alpha[:, end] += alpha[:, end - length] * prob[ids[:, end - length, length - 1]]
    return alpha


def expected(ids: np.ndarray, prob: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected piece counts of words seen counts[w, language] times to out[piece, language]."""
    n, size, longest = ids.shape
    alpha = forward(ids, prob)
    beta = np.zeros_like(alpha)
    beta[:, size] = counts / np.maximum(alpha[:, size], 1e-300)
    for start in range(size - 1, -1, -1):
        for length in range(1, min(longest, size - start) + 1):
            p = ids[:, start, length - 1]
            step = prob[p] * beta[:, start + length]
            beta[:, start] += step
            gain = alpha[:, start] * step
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(p + 1, gain[:, k], len(out) + 1)[1:]


def marked(word: str) -> str:
    """Lower-cased letters of a word behind the word-start mark; empty without a letter."""
    word = word.lower()
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    return word and START + word


def batches(words: list[str]) -> Iterator[list[str]]:
    """Words of up to SHORT characters in batches of one length; longer ones in batches of similar lengths."""
    by_size: dict[int, list[str]] = {}
    for word in words:
        by_size.setdefault(min(len(word), SHORT + 1), []).append(word)
    for size, group in by_size.items():
        if size <= SHORT:
            yield from (group[k : k + 4096] for k in range(0, len(group), 4096))
            continue
        group.sort(key=len)
        batch: list[str] = []
        for word in group:
            if batch and (len(batch) + 1) * len(word) > CELLS:
                yield batch
                batch = []
            batch.append(word)
        yield batch


def endings(words: list[str], low: int, high: int, piece_ids: dict[str, int], longest: int, unknown: int) -> np.ndarray:
    """ids[w, end - low - 1, length - 1]: the piece that ends there, or -1, for the ends in (low, high]; words may be shorter."""
    out = np.full((len(words), high - low, longest), -1, np.int32)
    get = piece_ids.get
    for w, word in enumerate(words):
        for end in range(low + 1, min(high, len(word)) + 1):
            for length in range(1, min(longest, end) + 1):
                p = get(word[end - length : end])
                if p is not None:
                    out[w, end - low - 1, length - 1] = p
    out[:, :, 0][out[:, :, 0] < 0] = unknown
    return out


def advance(ids: np.ndarray, prob: np.ndarray, window: np.ndarray) -> Iterator[np.ndarray]:
    """Logs of alpha at end after end. window[w, length - 1, language] holds those before, the nearest first."""
    for k in range(ids.shape[1]):
        steps = prob[ids[:, k]] * np.exp(window - window[:, :1])
        now = window[:, 0] + np.log(steps.sum(axis=1))
        window = np.concatenate([now[:, None], window[:, :-1]], axis=1)
        yield now


def opening(n: int, longest: int, languages: int) -> np.ndarray:
    """The window at a word's start."""
    window = np.full((n, longest, languages), -np.inf)
    window[:, 0] = 0
    return window


def log_forward(words: list[str], piece_ids: dict[str, int], longest: int, unknown: int, prob: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of long words; of alpha only the last `longest` values are held."""
    sizes = np.array([len(w) for w in words])
    out = np.zeros((len(words), prob.shape[1]))
    held = [opening(len(words), longest, prob.shape[1])[:, k] for k in range(longest)]
    step = max(1, CELLS // len(words))
    for low in range(0, int(sizes.max()), step):
        high = min(low + step, int(sizes.max()))
        ids = endings(words, low, high, piece_ids, longest, unknown)
        for end, now in enumerate(advance(ids, prob, np.stack(held, axis=1)), low + 1):
            held = [now, *held[:-1]]
            out[sizes == end] = now[sizes == end]
    return out


def log_expected(ids: np.ndarray, sizes: np.ndarray, prob: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """As `expected`, for long words and the ids of `endings`: backwards, the chance that a piece ends at each place."""
    n, size, longest = ids.shape
    alpha = np.full((n, longest + size, out.shape[1]), -np.inf)  # from `longest` - 1 places before the start
    alpha[:, longest - 1] = 0
    for end, now in enumerate(advance(ids, prob, opening(n, longest, out.shape[1])), longest):
        alpha[:, end] = now
    ends = np.zeros_like(alpha)
    ends[np.arange(n), longest - 1 + sizes] = counts
    for end in range(size, 0, -1):
        at = longest - 1 + end
        before = slice(at - longest, at)
        p = ids[:, end - 1, ::-1]  # by start, as alpha
        gain = ends[:, at, None] * prob[p] * np.exp(alpha[:, before] - alpha[:, at, None])
        ends[:, before] += gain
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(p.ravel() + 1, gain[:, :, k].ravel(), len(out) + 1)[1:]


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # (pieces + unknown + absent, languages); the last row is zero
    longest: int
    stamp: str = field(default="")

    def word_scores(self, trie: Trie, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word under each language, and whether it has a letter."""
        lower = [marked(word) for word in words]
        distinct = {word: i for i, word in enumerate(dict.fromkeys(filter(None, lower)))}
        table = np.zeros((len(distinct) + 1, len(self.languages)))  # the last row is for words without a letter
        for batch in batches(list(distinct)):
            if len(batch[0]) > SHORT:
                made = log_forward(batch, trie.piece_ids, self.longest, len(self.pieces), self.prob)
            else:
                ids = lattice(batch, trie, self.longest, len(self.pieces))
                made = np.log(np.maximum(forward(ids, self.prob)[:, -1], 1e-300))
            table[[distinct[word] for word in batch]] = made
        number = np.array([distinct.get(word, len(distinct)) for word in lower], np.int64)
        return table[number], number < len(distinct)


def train(counts: dict[str, Counter], pieces: list[str], rounds: int = 3) -> LanguageModel:
    """Learns piece probabilities from word counts by language. Languages are sorted; ties go to the first."""
    languages = sorted(counts)
    # words are read in lower case, so that pieces which differ in case alone are one
    pieces = list(dict.fromkeys(p.lower() for p in pieces if p == START or p.removeprefix(START).isalpha()))
    longest = max(map(len, pieces), default=1)
    piece_ids = {p: i for i, p in enumerate(pieces)}
    trie = Trie(piece_ids)
    size = len(pieces)
    prob = np.full((size + 2, len(languages)), 1.0 / (size + 1))
    prob[-1] = 0
    seen: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        for word, n in counts[lang].items():
            if lower := marked(word):
                seen.setdefault(lower, np.zeros(len(languages)))[k] += n
    lattices = []
    for batch in batches(list(seen)):
        if len(batch[0]) > SHORT:
            lattices.append((batch, endings(batch, 0, len(batch[-1]), piece_ids, longest, size)))
        else:
            lattices.append((batch, lattice(batch, trie, longest, size)))
    for _ in range(rounds):
        total = np.zeros((size + 1, len(languages)))
        for batch, ids in lattices:
            times = np.array([seen[w] for w in batch])
            if len(batch[0]) > SHORT:
                log_expected(ids, np.array([len(w) for w in batch]), prob, times, total)
            else:
                expected(ids, prob, times, total)
        total += 0.05
        prob[:-1] = total / total.sum(axis=0)
    return LanguageModel(languages, pieces, prob, longest)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model file, control and byte pieces aside."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def fit(docs: DataFrame, pieces: list[str], usable: Column, per_language: int = 250, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on at most `per_language` whole documents of each language, those of least xxhash64 of the id, and of at most
    common.MOST_BYTES of text together; with over MOST_DOCUMENTS / `per_language` languages, on fewer of each.

    Of an id that repeats with the same language the least text is used. Rows with a null id, language or text are never
    used. An empty table gives a model without languages.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("chosen_id"), F.col(lang_col).alias("chosen_group"), F.xxhash64(F.col(id_col)).alias("draw")).distinct()
    languages = ids.select(F.count_distinct("chosen_group")).collect()[0][0]
    most = max(1, min(per_language, MOST_DOCUMENTS // max(1, languages)))
    order = W.partitionBy("chosen_group").orderBy("draw", "chosen_id")
    chosen = ids.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth").withColumn("lang", F.col("chosen_group"))
    counts: dict[str, Counter] = {}
    for _, lang, text in fitting_texts(rows, chosen, id_col, text_col, lang_col, ["lang"]):
        counts.setdefault(lang, Counter()).update(WORD.findall(text))
    return train(counts, pieces)


def detect(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends `lang_pred string` and `score double` (the posterior under equal priors).

    A null text, an empty one and one without a letter get `und` and 0.0, as does every text if the model has no
    language. Ties go to the first language in sorted order. Rows repeat as given; clashing columns are replaced.
    """

    def compute():
        def build():
            return Trie({p: i for i, p in enumerate(model.pieces)}), [Numbering(), Grown(np.float64, max(1, len(model.languages))), Grown(bool)]

        trie, table = worker_state(("langid", model.prob.tobytes()[:4096], tuple(model.languages)), build)

        def apply(texts):
            if not model.languages:
                return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))]
            if len(table[0]) > common.TABLE_LIMIT:
                table[:] = [Numbering(), Grown(np.float64, len(model.languages)), Grown(bool)]
            seen, scores, letters = table
            numbers: list[int] = []
            lengths = np.zeros(len(texts), np.int64)
            for k, text in enumerate(texts):
                if text:
                    before = len(numbers)
                    numbers.extend(map(seen.__getitem__, WORD.findall(text)))
                    lengths[k] = len(numbers) - before
            if seen.fresh:
                s, has = model.word_scores(trie, seen.take_fresh())
                scores.extend(s)
                letters.extend(has)
            number = np.array(numbers, np.int64)
            total = sums_by_row(scores.data[number], lengths)
            any_letter = sums_by_row(letters.data[number].astype(np.float64), lengths) > 0
            best = total.argmax(axis=1)
            post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            pred = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), any_letter.tolist(), strict=True)]
            return [pa.array(pred, pa.string()), pa.array(np.where(any_letter, post, 0.0))]

        return apply

    return map_text(df, compute, [T.StructField("lang_pred", T.StringType(), True), T.StructField("score", T.DoubleType(), True)], text_col, keep)
