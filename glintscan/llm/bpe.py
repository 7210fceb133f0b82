"""Byte-level BPE encoding and decoding in length-bucketed numpy matrices.

The distinct pre-tokens of a batch become rows of padded matrices, one matrix for each bucket of lengths.
In every round each row merges its leftmost pair of least rank; the pair's rank comes from an open-addressing
hash table over (left id, right id); the row is then compacted by one place. Rows without a pair that can
merge leave the matrix. Rows of long pre-tokens merge all places of that pair in one round, from the left up to the first that makes a
pair of lesser rank, since the next rounds would do nothing else. Pre-tokens repeat, so each worker keeps the ids of those it has seen (bounded by
common.TABLE_LIMIT); whole texts are gathered from them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.llm import common
from glintscan.llm.common import Grown, Numbering, free_name, map_text, releasing, ship, worker_state

NO_RANK = np.int32(2**31 - 1)
#: Upper lengths in bytes of the matrix buckets; from the last on they double.
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64)
#: Rows of this length merge all places of their pair at once.
LONG = 64
ROWS = 1 << 16
#: So few new pre-tokens of an edit merge one by one through a heap: matrices would cost more than they save.
FEW = 16
#: Bytes that one decoded batch holds at most (one row at least).
DECODED = 32 << 20


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(keys)) * 2.5))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 1
        while len(left):
            free = self.keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            placed = left[free][first]
            self.keys[at], self.values[at] = keys[placed], values[placed]
            rest = self.keys[slot] != keys[left]
            left, slot = left[rest], (slot[rest] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (held != -1)
            open_, slot = open_[on], slot[on]
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for one rank file (base64 token, space, rank on each line)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        keys, values = [], []
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.token_len, self.token_at = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.seen = Numbering()
        self.flat, self.start, self.count, self.chars = Grown(np.int32), Grown(np.int64), Grown(np.int32), Grown(np.int32)

    # one matrix of pre-tokens whose lengths lie in one bucket
    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = ids.shape
        done, final = ids.copy(), lengths.copy()
        rows = np.arange(n)
        rank = np.full((n, width), NO_RANK, np.int32)
        if width > 1:
            rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
            rank[np.arange(width)[None, :] >= (lengths - 1)[:, None]] = NO_RANK
        lengths = lengths.copy()
        while len(rows):
            at = rank.argmin(axis=1)  # argmin gives the leftmost of equal ranks
            each = np.arange(len(rows))
            best = rank[each, at]
            live = best != NO_RANK
            if not live.all():
                out = ~live
                done[rows[out], : ids.shape[1]] = ids[out]
                final[rows[out]] = lengths[out]
                rows, ids, rank, lengths, at, best = rows[live], ids[live], rank[live], lengths[live], at[live], best[live]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            width = int(lengths.max())
            column = np.arange(width - 1)[None, :]
            source = column + (column > at[:, None])
            merged = np.take_along_axis(ids, source, axis=1)
            merged[each, at] = best
            lengths -= 1
            # the pair that was merged goes; those on either side of it are looked up anew
            kept = np.take_along_axis(rank, np.minimum(column + (column >= at[:, None]), rank.shape[1] - 1), axis=1)
            ids, rank = merged, kept
            right = np.minimum(at + 1, ids.shape[1] - 1)
            rank[each, at] = np.where(at + 1 < lengths, self.pairs.find(best, ids[each, right]), NO_RANK)
            left = np.maximum(at - 1, 0)
            rank[each, left] = np.where(at > 0, self.pairs.find(ids[each, left], best), rank[each, left])
        return done, final

    def _merge_long_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `_merge_rows`, with all places of a row's pair in one round."""
        done, final = ids.copy(), lengths.copy()
        rows, lengths = np.arange(len(ids)), lengths.copy()
        column = np.arange(ids.shape[1], dtype=np.int32)
        rank = np.full(ids.shape, NO_RANK, np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rank[column[None, :] >= (lengths - 1)[:, None]] = NO_RANK
        while True:
            best = rank.min(axis=1)
            live = best != NO_RANK
            if not live.all():
                out = ~live
                done[rows[out], : ids.shape[1]] = ids[out]
                final[rows[out]] = lengths[out]
                rows, ids, rank, lengths, best = rows[live], ids[live], rank[live], lengths[live], best[live]
            if not len(rows):
                return done, final
            column = column[: ids.shape[1]]
            hit = rank == best[:, None]
            # of neighbouring places every other one from the left
            before = np.maximum.accumulate(np.where(hit, np.int32(-1), column[None, :]), axis=1)
            hit &= (column[None, :] - before) % 2 == 1
            # up to the first place whose new id makes a pair of lesser rank, which would be next
            r, c = np.nonzero(hit)
            left = np.where((c > 1) & hit[r, c - 2], best[r], ids[r, c - 1])
            right = ids[r, np.minimum(c + 2, ids.shape[1] - 1)]
            early = (c > 0) & (self.pairs.find(left, best[r]) < best[r])
            early |= (c + 2 < lengths[r]) & (self.pairs.find(best[r], right) < best[r])
            if early.any():
                stop = np.full(len(rows), ids.shape[1])
                np.minimum.at(stop, r[early], c[early])
                hit &= column[None, :] <= stop[:, None]
            ids = np.where(hit, best[:, None], ids)
            keep = column[None, :] < lengths[:, None]
            keep[:, 1:] &= ~hit[:, :-1]
            lengths = keep.sum(axis=1)
            column = column[: int(lengths.max())]
            inside = column[None, :] < lengths[:, None]
            compact = [np.zeros(inside.shape, x.dtype) for x in (ids, rank, hit)]
            for new, old in zip(compact, (ids, rank, hit), strict=True):
                new[inside] = old[keep]
            ids, rank, hit = compact
            # the pairs on either side of a new id are looked up anew
            look = hit.copy()
            look[:, :-1] |= hit[:, 1:]
            rank[~inside] = NO_RANK
            r, c = np.nonzero(look & inside)
            edge = c + 1 >= lengths[r]
            rank[r[edge], c[edge]] = NO_RANK
            r, c = r[~edge], c[~edge]
            rank[r, c] = self.pairs.find(ids[r, c], ids[r, c + 1])

    def _merge_one(self, piece: bytes) -> list[int]:
        """The same merges for one pre-token of an edit: a linked list and a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # byte place where the part that starts at i ends; 0 once it is absorbed
        get = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            ids[i], end[i], end[j] = rank, stop, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ids[i] for i in range(n) if end[i]]

    def _learn(self, words: list[str], edit: bool = False) -> None:
        """Encodes pre-tokens not seen before and appends their ids to the worker's table; the few of an edit one by one."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        if edit and len(words) < FEW:
            made = [[self.ranks[b]] if b in self.ranks else self._merge_one(b) for b in raw]
            sizes = np.array([len(ids) for ids in made], np.int64)
            self.start.extend(self.flat.n + np.cumsum(sizes) - sizes)
            self.flat.extend(np.array([i for ids in made for i in ids], np.int32))
            self.count.extend(sizes.astype(np.int32))
            self.chars.extend(np.array([len(w) for w in words], np.int32))
            return
        size = np.array([len(b) for b in raw], np.int64)
        counts = np.zeros(len(raw), np.int32)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (row of words, ids) for blocks of equal treatment
        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int64)
        known = np.flatnonzero(whole >= 0)
        counts[known] = 1
        found.append((known, whole[known].astype(np.int32)))
        low, longest = 0, int(size[whole < 0].max(initial=0))
        for high in [*BUCKETS, *(BUCKETS[-1] << k for k in range(1, longest.bit_length()))]:
            rows = np.flatnonzero((whole < 0) & (size > low) & (size <= high))
            low = high
            step = max(1, ROWS * 8 // high)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                lens = size[part]
                column = np.arange(int(lens.max()))[None, :]
                matrix = np.zeros((len(part), column.shape[1]), np.uint8)
                matrix[column < lens[:, None]] = np.frombuffer(b"".join([raw[i] for i in part.tolist()]), np.uint8)
                ids, final = (self._merge_long_rows if high > LONG else self._merge_rows)(self.byte_ids[matrix], lens)
                counts[part] = final
                found.append((part, ids[column < final[:, None]]))
        start = np.zeros(len(raw), np.int64)
        base = self.flat.n
        for rows, ids in found:
            ends = np.cumsum(counts[rows], dtype=np.int64)
            start[rows] = base + ends - counts[rows]
            base += len(ids)
            self.flat.extend(ids)
        self.start.extend(start)
        self.count.extend(counts)
        self.chars.extend(np.array([len(w) for w in words], np.int32))

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token of an edited place."""
        numbers = [self.seen[w] for w in words]
        if self.seen.fresh:
            self._learn(self.seen.take_fresh(), edit=True)
        return self.count.data[numbers].tolist() if numbers else []

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-token numbers of all texts in one array, and how many belong to each text."""
        if len(self.seen) > common.TABLE_LIMIT:
            self.reset()
        numbers: list[int] = []
        lengths = np.zeros(len(texts), np.int64)
        get = self.seen.__getitem__
        for k, text in enumerate(texts):
            if text:
                before = len(numbers)
                numbers.extend(map(get, self.pattern.findall(text)))
                lengths[k] = len(numbers) - before
        if self.seen.fresh:
            self._learn(self.seen.take_fresh())
        return np.array(numbers, np.int64), lengths

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and offsets of each text in it. A null text has none."""
        number, lengths = self.number(texts)
        count = self.count.data[number].astype(np.int64)
        start = self.start.data[number]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(start - (ends - count), count)
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(lengths)]])
        return self.flat.data[place], offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences in one array, and offsets of each sequence in it."""
        size = self.token_len[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.token_at[ids] - (ends - size), size)
        return self.token_bytes[place], np.concatenate([[0], ends])[offsets]


def tokenizer(rank_file: bytes, pattern: str) -> ByteBPE:
    return worker_state(("bpe", hashlib.sha256(rank_file).digest(), pattern), lambda: ByteBPE(rank_file, pattern))


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read once on the driver and sent with the tasks (a vocabulary file is under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, rank_file: bytes, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends `ids array<int>`: the BPE ids of the whole text, special tokens aside.

    Null and empty texts get an empty array. Repeated rows, null ids and extra columns pass through; an input
    column named ids is replaced. An empty table gives an empty table.
    """

    def compute():
        bpe = tokenizer(rank_file, pattern)

        def apply(texts):
            ids, offsets = bpe.encode(texts)
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]

        return apply

    return map_text(df, compute, [T.StructField("ids", T.ArrayType(T.IntegerType(), True), True)], text_col, keep)


def decode_ids(df: DataFrame, rank_file: bytes, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Appends `decoded binary`: the bytes that the ids stand for. A null or empty array gives empty bytes."""
    ship(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "decoded"]
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias(free_name(df, "ids_in"))
    src = df.select(*[F.col(f"`{c}`") for c in keep], ids)
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType(), True)])

    def run(batches):
        bpe = tokenizer(rank_file, pattern)
        longest = int(bpe.token_len.max())
        for batch in batches:
            k = 0
            while k < batch.num_rows:
                column = batch.column(len(keep)).slice(k)
                offsets = np.asarray(column.offsets)[: len(column) + 1].astype(np.int64)
                # so many rows as surely fit
                n = min(512, max(1, int(np.searchsorted(offsets - offsets[0], DECODED // longest, "right")) - 1))
                flat = np.asarray(column.values)[offsets[0] : offsets[n]]
                data, at = bpe.decode(flat, offsets[: n + 1] - offsets[0])
                decoded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(k, n) for i in range(len(keep))] + [decoded], names=[*keep, "decoded"])
                k += n

    return src.mapInArrow(releasing(run), schema)
