"""Token counts that follow edits: a segment tree over a document's pre-tokens.

The leaves hold runs of pre-tokens (characters and tokens of each); every inner node holds the sums below it. An edit
goes down the tree to the first pre-token whose match could have seen the edited place, encodes the new text from
there, and stops at the first boundary that the old text had as well (behind the edit, a match depends only on what
follows). The replaced pre-tokens' leaves and the sums on their paths to the root are updated; nothing else is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.llm.bpe import ByteBPE, tokenizer
from glintscan.llm.common import free_name, releasing, ship, slices

LEAF = 64
#: The pattern looks at most this many characters past the end of a match (a contraction's letters, a blank's follower).
LOOKAHEAD = 2


class TokenTree:
    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self._build(chars.tolist(), tokens.tolist())

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = [(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])]
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for k, (c, t) in enumerate(self.leaves):
            self.chars[size + k], self.tokens[size + k] = sum(c), sum(t)
        for k in range(size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def runs(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of all pre-tokens."""
        return [c for x in self.leaves for c in x[0]], [t for x in self.leaves for t in x[1]]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int, int]:
        """Leaf, index in it and start of the pre-token that covers the character; behind the end, those of the end."""
        if place >= self.chars[1]:
            last = len(self.leaves) - 1
            while last and not self.leaves[last][0]:
                last -= 1
            return last, len(self.leaves[last][0]), self.chars[1]
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if place >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        leaf = k - self.size
        for i, n in enumerate(self.leaves[leaf][0]):
            if place < start + n:
                return leaf, i, start
            start += n
        raise AssertionError("sums and leaves differ")

    def replace(self, first: tuple[int, int], last: tuple[int, int], chars: list[int], tokens: list[int]) -> None:
        """Puts new pre-tokens in place of those from `first` up to, without, `last` (leaf, index)."""
        a, i = first
        b, j = last
        touched = range(a, b + 1)
        if a == b:
            self.leaves[a] = (self.leaves[a][0][:i] + chars + self.leaves[a][0][j:], self.leaves[a][1][:i] + tokens + self.leaves[a][1][j:])
        else:
            self.leaves[a] = (self.leaves[a][0][:i] + chars, self.leaves[a][1][:i] + tokens)
            self.leaves[b] = (self.leaves[b][0][j:], self.leaves[b][1][j:])
            for k in range(a + 1, b):
                self.leaves[k] = ([], [])
        if len(self.leaves[a][0]) > 4 * LEAF:
            self._build([c for x in self.leaves for c in x[0]], [t for x in self.leaves for t in x[1]])
            return
        parents = set()
        for k in touched:
            c, t = self.leaves[k]
            self.chars[self.size + k], self.tokens[self.size + k] = sum(c), sum(t)
            parents.add((self.size + k) // 2)
        while parents - {0}:
            for k in parents:
                self._sum(k)
            parents = {k // 2 for k in parents}


class EditedText:
    """A text, its tree, and edits of it."""

    def __init__(self, bpe: ByteBPE, text: str, tree: TokenTree):
        self.bpe, self.text, self.tree, self.encoded = bpe, text, tree, 0

    @classmethod
    def of(cls, bpe: ByteBPE, text: str) -> EditedText:
        words = bpe.pretokens(text)
        return cls(bpe, text, TokenTree(np.array([len(w) for w in words], np.int64), np.array(bpe.counts(words), np.int64)))

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the characters from start up to, without, stop; places beyond the end mean the end."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        text = self.text[:start] + new + self.text[stop:]
        grown, behind = len(text) - len(self.text), start + len(new)
        tree = self.tree
        # the first pre-token whose match could see the edited place
        leaf, i, at = tree.find(max(0, start - LOOKAHEAD))
        if at and at == len(self.text):
            leaf, i, at = tree.find(at - 1)
        while at > 0 and at + (tree.leaves[leaf][0][i] if i < len(tree.leaves[leaf][0]) else 0) > start - LOOKAHEAD:
            before = tree.find(at - 1)
            if before[2] + tree.leaves[before[0]][0][before[1]] <= start - LOOKAHEAD:
                break
            leaf, i, at = before
        # the old pre-tokens from there on, one by one, as far as needed
        old_leaf, old_i, old_at = leaf, i, at
        words: list[str] = []
        place = at
        match = self.bpe.pattern.match
        while True:
            while old_at + grown < place or old_at < stop:
                if old_i < len(tree.leaves[old_leaf][0]):
                    old_at += tree.leaves[old_leaf][0][old_i]
                    old_i += 1
                elif old_leaf + 1 < len(tree.leaves):
                    old_leaf, old_i = old_leaf + 1, 0
                else:
                    break
            if place >= behind and old_at >= stop and old_at + grown == place:
                break
            if place >= len(text):
                break
            m = match(text, place)
            words.append(m.group())
            place = m.end()
        self.encoded += len(words)
        tree.replace((leaf, i), (old_leaf, old_i), [len(w) for w in words], self.bpe.counts(words))
        self.text = text


EDIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("new", T.StringType())]))
FIELDS = [("n_tokens", pa.int64(), T.LongType()), ("n_pretokens", pa.int64(), T.LongType()), ("edited_tokens", pa.int64(), T.LongType()), ("n_encoded", pa.int64(), T.LongType()), ("n_built", pa.int64(), T.LongType()), ("edited_text", pa.string(), T.StringType())]
#: The leaves of the tree after the edits: characters and tokens of every pre-token.
LEAVES = [("leaf_chars", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("leaf_tokens", pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))]


def count_with_edits(df: DataFrame, edits: Column, rank_file: bytes, pattern: str, text_col: str = "text", keep: list[str] | None = None, leaves: tuple[Column, Column] | None = None, keep_leaves: bool = False) -> DataFrame:
    """Appends the counts of the whole text before and after its edits, applied in order.

    `edits` is an array of (start, stop, new), in characters of the text as the edits before left it. Appended:
    n_tokens, n_pretokens, edited_tokens, n_encoded (pre-tokens encoded for the edits), n_built (those encoded for the tree)
    and edited_text; with `keep_leaves` also leaf_chars and leaf_tokens, the tree's leaves after the edits. Given
    as `leaves` together with the edited text, they stand for the tree in a later call, which then encodes nothing but its
    own edits; null leaves, or leaves that don't cover the text, are built anew. A null text counts as empty; null
    edits are none; a null start, stop or new counts as 0, start or "". Rows repeat as given; clashing input columns are
    replaced; an empty table stays empty.
    """
    ship(df.sparkSession)
    fields = FIELDS + LEAVES * keep_leaves
    names = [f[0] for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    kept = len(keep)  # the columns behind are read by their places, whatever their names
    none = F.lit(None).cast("array<int>")
    inner = [F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(edits.cast(EDIT), F.array().cast(EDIT)), *[c.cast("array<int>") for c in leaves or (none, none)]]
    src = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(free_name(df, f"in_{i}")) for i, c in enumerate(inner)])
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, t) for n, _, t in fields])

    def run(batches):
        bpe = tokenizer(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, kept):
                texts, todo, chars, tokens = (part.column(kept + i).to_pylist() for i in range(4))
                held = [c is not None and t is not None and len(c) == len(t) and None not in c and None not in t and sum(c) == len(x) for x, c, t in zip(texts, chars, tokens, strict=True)]
                number, lengths = bpe.number(["" if h else x for x, h in zip(texts, held, strict=True)])
                all_chars, all_tokens, ends = bpe.chars.data[number], bpe.count.data[number], np.cumsum(lengths)
                rows = []
                for k, (text, n, end) in enumerate(zip(texts, lengths.tolist(), ends.tolist(), strict=True)):
                    c, t = (np.array(x[k], np.int64) for x in (chars, tokens)) if held[k] else (x[end - n : end] for x in (all_chars, all_tokens))
                    edited = EditedText(bpe, text, TokenTree(c, t))
                    before = edited.tree.total
                    for e in todo[k]:
                        if e is not None:
                            start = e["start"] or 0
                            edited.edit(start, start if e["stop"] is None else e["stop"], e["new"] or "")
                    rows.append((before, len(c), edited.tree.total, edited.encoded, n, edited.text, *(edited.tree.runs() if keep_leaves else ())))
                columns = [pa.array(list(c), kind) for c, (_, kind, _) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(kept)] + columns, names=[*keep, *names])

    return src.mapInArrow(releasing(run), schema)
