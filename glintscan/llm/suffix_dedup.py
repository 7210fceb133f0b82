"""Suffix-array deduplication: bytes covered by a long string that also starts in an earlier document are removed.

0. Equal texts. Each distinct text is worked on once, for the least id that has it; a copy under a greater id loses all its
   bytes (if it has 50), and rows of one id and text share the result.
1. Anchors. The 50-byte string at each place has an anchor: of its grams of 16 to 32 bytes the one of least hash (leftmost of
   equals). The anchor depends on the string alone, so equal strings have equal anchors at equal offsets, and
   neighbouring strings with the same anchor form one segment (their starts, and 49 bytes more).
2. Filter. Anchors that occur in one text only can't take part in a repeat. Each task sends an anchor once to the
   bucket of its hash; what it has itself seen in two texts needs no answer. Buckets answer with the rest that
   is shared, and count the texts of every anchor: one of more than HOT_TEXTS texts would fill a bucket, whatever
   their number. Strings of such anchors take themselves as anchors and go through the filter once more.
3. Suffix array. The distinct segments of shared anchors go to the bucket of their anchor, each with the least
   document that has it. In a bucket the suffixes are put in order by the difference-cover algorithm modulo 3: sampled
   triples are sorted and named, the names are sorted by recursion, the other suffixes are merged in. Adjacent suffixes
   whose first 50 bytes are equal belong together; the least document of such a run decides for all its members.
4. The starts found go back to their texts, which drop the bytes that they cover.

Answers of a bucket are packed, a row for each slot: a range of the texts' keys. A row for each text would make texts times
buckets, and both grow with the corpus. A slot then puts its rows together, one for each text.

The text is shuffled once; the passes over it read the same exchange. A bucket holds at most one entry for each task and
anchor (or segment), whatever the number of copies, and at most HOT_TEXTS different segments of an anchor. Which anchors have
more is told by a bit for each hash, in a set of bounded size: two anchors may share a bit, which only sends the other
one's strings the longer way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.llm.common import _WORKER, checkpoint, release, releasing, ship

LENGTH = 50
#: In place of its anchor: a string of a hot anchor, which meets none but its equals.
ALONE = 255
NO_ID = np.int64(2**63 - 1)
#: Texts that an anchor may have before its strings go alone.
HOT_TEXTS = 8192
#: Bits that tell hot anchors, of each bucket and in all (32 MB).
HOT_BITS = (1 << 16, 1 << 28)
CHUNK = 1 << 20
#: Bytes of segments that one suffix array covers at most, but for a single anchor's.
PORTION = 1 << 19
#: Bytes of text whose anchors a task of the first pass holds at a time.
FLUSH = 32 << 20
#: A bucket is worked off in so many parts in the first and in the second pass, which bounds memory; its answers go out together, a row
#: for each slot.
PARTS = (6, 6)
#: A bucket serves so much text in the first and in the second pass: what it holds is bounded whatever the size of all.
BUCKET_BYTES = (100 << 20, 50 << 20)
#: Bytes of text that a slot of answers stands for.
SLOT_BYTES = 32 << 20
#: Rows of a text beyond which its copies are answered where they are read: at least so many, and at least such a share of all.
MANY, SHARE = 1000, 10_000
U = np.uint64


def gram_size(size: int) -> int:
    """Bytes of a gram for so many bytes of text: longer in larger corpora, where short ones are shared by chance."""
    return 16 if size < 1 << 33 else 24 if size < 1 << 41 else 32


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Of the `gram` bytes (a multiple of 8) from each place on: runs of 1, 2, 4, 8 bytes, then eights in a row."""
    h = (data.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    for step, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (4, 0x27D4EB2F165667C5)):
        if len(h) <= step:
            return np.zeros(0, U)
        h = h[:-step] * U(odd) + (h[step:] ^ (h[step:] >> U(31)))
    eight = h ^ (h >> U(31))
    for step in range(8, gram, 8):
        if len(eight) <= step:
            return np.zeros(0, U)
        h = h[: len(eight) - step] * U(0x9FB21C651E98DF25) + eight[step:]
    return (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)


def segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gram: int, length: int = LENGTH):
    """(document, first start, last start, anchor, key) of every segment; at most CHUNK * 2 bytes or one document at a time."""
    h = gram_hashes(data, gram)
    windows = length - gram + 1
    if len(h) < windows:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)]
    bits = max(1, int(len(h)).bit_length())
    packed = (h >> U(bits) << U(bits)) | np.arange(len(h), dtype=U)
    have = 1
    while have < windows:
        by = min(have, windows - have)
        packed = np.minimum(packed[:-by], packed[by:])
        have += by
    # places whose string lies in one document
    edge = np.zeros(len(packed) + 1, np.int8)
    fits = np.flatnonzero(sizes >= length)
    np.add.at(edge, starts[fits], 1)
    np.add.at(edge, starts[fits] + sizes[fits] - length + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    turn = packed[1:] != packed[:-1]
    turn |= valid[1:] != valid[:-1]
    # neighbouring documents of no more than the length in between can't be valid on both sides of an edge
    turn[starts[fits][1:] - 1] = True
    new = np.flatnonzero(np.concatenate([[True], turn]) & valid)
    last = np.flatnonzero(np.concatenate([turn, [True]]) & valid)
    anchor = (packed[new] & U((1 << bits) - 1)).astype(np.int64)
    doc = np.searchsorted(starts, new, "right") - 1
    return [doc, new, last, anchor, h[anchor]]


def chunks(texts: list[bytes]):
    """(first document, buffer, starts, sizes) for runs of documents of about CHUNK bytes."""
    k = 0
    while k < len(texts):
        j, total = k, 0
        while j < len(texts) and (j == k or total + len(texts[j]) <= CHUNK):
            total += len(texts[j])
            j += 1
        sizes = np.array([len(t) for t in texts[k:j]], np.int64)
        yield k, np.frombuffer(b"".join(texts[k:j]), np.uint8), np.cumsum(sizes) - sizes, sizes
        k = j


# ---- difference-cover suffix sorting ----


def names_of(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Dense ranks, from 1, of rows of non-negative numbers, and how many there are."""
    now = columns[0]
    for c in columns[1:]:
        width = int(c.max()).bit_length() if len(c) else 1
        if int(now.max() if len(now) else 0).bit_length() + width > 63:
            now = np.unique(now, return_inverse=True)[1].astype(np.int64)
        now = (now << width) | c
    values, inverse = np.unique(now, return_inverse=True)
    return inverse.astype(np.int64) + 1, len(values)


def suffix_ranks(s: np.ndarray, need: int, reach: int = 1) -> np.ndarray:
    """Ranks of all suffixes of s (numbers of at least 1). Suffixes that differ in their first `need` bytes are ranked by
    them, and others lie together; a number of s stands for `reach` bytes."""
    n = len(s)
    if n < 3:
        tail = np.concatenate([s, np.zeros(3, np.int64)])
        return names_of([tail[:n], tail[1 : n + 1], tail[2 : n + 2]])[0]
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    name, many = names_of([t[sample], t[sample + 1], t[sample + 2]])
    if many < len(sample) and 3 * reach < need:
        name = suffix_ranks(name, need, 3 * reach)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    wide = max(1, int(name.max()).bit_length())

    def pair(at):
        return (t[at] << wide) | rank[at + 1]

    # names that need more than 62 bits in all are shortened first, in the same way for all suffixes
    if int(t.max()).bit_length() * 2 + wide > 62:
        t = np.concatenate([np.unique(s, return_inverse=True)[1].astype(np.int64) + 1, np.zeros(3, np.int64)])
    tall = max(1, int(t.max()).bit_length())
    if 2 * tall + wide > 62:
        two_names = np.zeros(n + 3, np.int64)
        two_names[:n] = names_of([t[:n], t[1 : n + 1]])[0]
    else:
        two_names = (t[: n + 3] << tall) | np.concatenate([t[1:], [0]])

    def triple(at):
        return (two_names[at] << wide) | rank[np.minimum(at + 2, n + 2)]

    real_one = one[one < n]
    zero2, one2, zero3, two3 = (in_order(k) for k in (pair(zero), pair(real_one), triple(zero), triple(two)))
    both = in_order(rank[np.concatenate([real_one, two])])
    out = np.zeros(n, np.int64)
    out[zero] = below(zero2, zero2) + below(one2, zero2) + below(two3, zero3)
    less = below(both, both)
    out[real_one] = less[: len(real_one)] + below(zero2, one2)
    out[two] = less[len(real_one) :] + below(zero3, two3)
    return out + 1


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys sorted, and where each came from."""
    order = np.argsort(keys)
    return keys[order], order


def below(held: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each asked key, in its first place, how many held keys are less: a merge of two sorted runs."""
    out = np.empty(len(asked[1]), np.int64)
    out[asked[1]] = np.searchsorted(held[0], asked[0])
    return out


def repeats(parts: list[bytes], starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For the first starts[k] places of each part: numbers that are equal where the next `length` bytes are equal.

    Returned are the number of every such place, part after part, and the part of each.
    """
    joined = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    s = joined.astype(np.int64) + 1
    rank = suffix_ranks(s, length)
    part = np.repeat(np.arange(len(parts)), starts)
    place = np.arange(int(starts.sum())) + np.repeat(begin - (np.cumsum(starts) - starts), starts)
    order = np.argsort(rank[place], kind="stable")
    at = place[order]
    # adjacent prefixes, compared as numbers of 8 bytes and a rest
    words = np.lib.stride_tricks.sliding_window_view(joined, length)[at].tobytes() if len(at) else b""
    rows = np.frombuffer(words, np.uint8).reshape(-1, length)
    fresh = np.ones(len(at), np.int64)
    if len(at) > 1:
        fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, part


# ---- packing ----


def packed(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


BLOBS = "abcdefgh"
SENT = [("bucket", pa.int32()), ("part", pa.int32()), ("uid", pa.binary()), *[(c, pa.binary()) for c in BLOBS]]
SENT_DDL = "bucket int, part int, uid binary, " + ", ".join(f"{c} binary" for c in BLOBS)
CODEC = pa.Codec("zstd", compression_level=3)
#: Answers: for the texts of a slot (uid, their keys) what was got, `n` rows of values each, or (uid null) the bits of the hot anchors of
#: a part of a bucket.
BACK = [("slot", pa.int32()), ("uid", pa.binary()), ("n", pa.binary()), ("got", pa.binary())]
BACK_DDL = "slot int, uid binary, n binary, got binary"


def uid_array(uids) -> np.ndarray:
    """Keys of 16 bytes as pairs of numbers."""
    return np.frombuffer(b"".join(uids), np.int64).reshape(-1, 2)


def sent(bucket: int, parts: int, uid: bytes | None, *blobs: bytes | np.ndarray) -> pa.RecordBatch:
    values = [b if isinstance(b, bytes) else np.ascontiguousarray(b).tobytes() for b in blobs]
    return packed([(bucket // parts, bucket % parts, uid, *values, *[None] * (len(BLOBS) - len(values)))], SENT)


def squeeze(data: bytes | np.ndarray) -> bytes:
    """Compressed, with its size in front."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def expand(blob: bytes) -> bytes:
    return CODEC.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def joined(arrays: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list is emptied, so that they are not held twice for long."""
    out = np.concatenate(arrays)
    arrays.clear()
    return out


def numbered(uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct uids in order, and the number of each given one among them."""
    u = np.ascontiguousarray(uid).view(U)
    order = np.lexsort((u[:, 1], u[:, 0]))
    u = u[order]
    fresh = np.concatenate([[True], (u[1:] != u[:-1]).any(axis=1)])[: len(u)]
    number = np.empty(len(u), np.int32)
    number[order] = np.cumsum(fresh) - 1
    return u[fresh], number


def by_number(number: np.ndarray, many: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At which row each of so many numbers begins (and the end), and the rows of int32 values in that order."""
    begin = np.append(0, np.cumsum(np.bincount(number, minlength=many)))
    return begin, np.ascontiguousarray(values[np.argsort(number, kind="stable")].astype(np.int32, copy=False))


def by_uid(uid: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct uids in order, at which row each begins (and the end), and the rows of int32 values in that order."""
    lead, number = numbered(uid)
    return lead, *by_number(number, len(lead), values)


def by_slot(uid: np.ndarray, values: np.ndarray, slots: int, number: np.ndarray | None = None) -> list[tuple[int, bytes, bytes, bytes]]:
    """(slot, its uids, the number of rows of each, the rows) for answers; with `number`, that of each row's uid."""
    lead, of = numbered(uid)
    begin, values = by_number(of if number is None else of[number], len(lead), values)
    edges = np.searchsorted((lead[:, 0] >> U(32)) * U(slots) >> U(32), np.arange(slots + 1)).tolist()
    n = np.diff(begin).astype(np.uint32)
    return [(i, lead[a:b].tobytes(), squeeze(n[a:b]), squeeze(values[begin[a] : begin[b]])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def from_slots(rows: list[tuple[bytes, bytes, bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, values) of rows (uids, number of rows of each, rows)."""
    n = np.frombuffer(b"".join(expand(k) for _, k, _ in rows), np.uint32)
    return np.repeat(uid_array(u for u, _, _ in rows), n, axis=0), np.frombuffer(b"".join(expand(v) for _, _, v in rows), np.int32).reshape(-1, width)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * U(0xD6E8FEB86659FD93)) >> U(33)).astype(np.int64) % buckets


_CODES = np.random.default_rng(41).integers(0, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """At least n powers of the base, from 0, kept from call to call of a task."""
    kept = _WORKER.setdefault("powers", {})
    held = kept.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, CHUNK + 1), base, U)
        held[0] = 1
        kept[base] = np.cumprod(held, out=held)
    return held


def piece_hashes(data: np.ndarray, low: np.ndarray, stop: np.ndarray, words: int = 2) -> np.ndarray:
    """128 bits for each piece data[low:stop], as two numbers: differences of running sums, brought to power 0."""
    out = np.empty((words, len(low)), U)
    for k, (codes, base) in enumerate(zip(_CODES[:words], _BASES, strict=False)):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(codes[data] * powers(int(base), len(data))[: len(data)], out=total[1:])
        out[k] = (total[stop] - total[low]) * powers(pow(int(base), -1, 1 << 64), len(data) + 1)[low]
    return out


class HotAnchors:
    """Which anchors have too many texts: bits by the part of a bucket that counted them and by the rest of the hash."""

    def __init__(self, parts: int):
        self.parts, self.each = parts, max(8, min(HOT_BITS[0], HOT_BITS[1] // parts) // 8 * 8)
        self.bits: np.ndarray | None = None

    def place(self, low: np.ndarray) -> np.ndarray:
        """Of 48 bits of a key, within its part."""
        return ((low.astype(U) * U(0xA24BAED4963EE407)) >> U(20)).astype(np.int64) % self.each

    def marks(self, low: np.ndarray) -> bytes:
        bits = np.zeros(self.each, bool)
        bits[self.place(low)] = True
        return squeeze(np.packbits(bits))

    def add(self, part: int, marks: bytes) -> None:
        if self.bits is None:
            self.bits = np.zeros(self.parts * self.each // 8, np.uint8)
        begin = part * self.each // 8
        self.bits[begin : begin + self.each // 8] |= np.frombuffer(expand(marks), np.uint8)

    def has(self, key: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(key), bool)
        at = bucket_of(key, self.parts) * self.each + self.place(key & U((1 << 48) - 1))
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def parted(data: np.ndarray, doc, low, high, anchor, key, hot: np.ndarray):
    """The hot segments' strings: one segment for each start, with the string's hash as key."""
    n = (high - low + 1)[hot]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    doc, low = np.repeat(doc[hot], n), np.repeat(low[hot], n) + step
    return doc, low, low, low + ALONE, piece_hashes(data, low, low + LENGTH, 1)[0]


def with_parted(data: np.ndarray, found, hot: HotAnchors):
    """Segments, with those of hot anchors replaced by their strings, in document order."""
    mask = hot.has(found[4])
    if not mask.any():
        return found
    both = [np.concatenate([x[~mask], y]) for x, y in zip(found, parted(data, *found, mask), strict=True)]
    order = np.argsort(both[1], kind="stable")
    return [x[order] for x in both]


def first_pass(buckets: int, gram: int, slots: int, hot: HotAnchors | None = None):
    """From rows (key, text): what each FLUSH bytes of a task's texts know of their anchors, as rows for the buckets and (uid set)
    the shared ones found at once. With `hot`, of the strings of these anchors instead."""

    def anchors(texts: list[bytes], uid: np.ndarray):
        keys, docs, places = [], [], []
        for first, data, starts, sizes in chunks(texts):
            found = segments(data, starts, sizes, gram)
            if hot is not None:
                found = parted(data, *found, hot.has(found[4]))
            doc, low, _, _, key = found
            keys.append(key)
            docs.append((doc + first).astype(np.int32))
            places.append((low - starts[doc]).astype(np.int32))
        key, doc, place = (np.concatenate(x) for x in (keys, docs, places))
        del texts, keys, docs, places
        order = np.argsort(key, kind="stable")  # documents stay in order
        k, d = key[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        many = np.zeros(len(k), bool)
        known, known_texts = np.zeros(0, U), np.zeros(0, np.uint32)
        if len(k):
            fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]).astype(np.int64)
            texts_of = np.add.reduceat(fresh, head)
            several = texts_of > 1
            del fresh
            many = np.repeat(several, np.diff(np.append(head, len(k))))
            known, known_texts = k[head[several]], texts_of[several].astype(np.uint32)
        shared = np.zeros(len(key), bool)
        shared[order[many]] = True
        del order, k, d, many
        for slot, *answer in by_slot(uid[doc[shared]], place[shared][:, None], slots):
            yield sent(slot * buckets // slots, PARTS[0], *answer)
        key, doc, place = key[~shared], doc[~shared], place[~shared]
        b, kb = bucket_of(key, buckets), bucket_of(known, buckets)
        order, by_known = np.argsort(b, kind="stable"), np.argsort(kb, kind="stable")
        edges, known_edges = (np.searchsorted(x, np.arange(buckets + 1)) for x in (b[order], kb[by_known]))
        for i in range(buckets):
            mine = order[edges[i] : edges[i + 1]]  # still in document order
            runs = np.flatnonzero(np.concatenate([[True], np.diff(doc[mine]) != 0])) if len(mine) else np.zeros(0, np.int64)
            counts = np.diff(np.append(runs, len(mine))).astype(np.uint32)
            own = by_known[known_edges[i] : known_edges[i + 1]]
            if len(mine) or len(own):
                low, high = low_bits(key[mine])
                yield sent(i, PARTS[0], None, low, high, uid[doc[mine][runs]], squeeze(counts), squeeze(np.diff(place[mine], prepend=np.int32(0)).astype(np.int32)), *low_bits(known[own]), squeeze(known_texts[own]))

    def flushed(held: dict[bytes, bytes]):
        texts, uid = list(held.values()), uid_array(held)
        held.clear()
        return anchors(texts, uid)

    def run(batches):
        held: dict[bytes, bytes] = {}  # copies within the task are taken once
        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in held:
                    held[key] = text
                    size += len(text)
            if size > FLUSH:
                yield from flushed(held)
                size = 0
        if held:
            yield from flushed(held)

    return releasing(run)


def low_bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of a key: within a bucket, which other bits choose, they tell keys apart. (Equal bits of different keys would only
    let an anchor through the filter.)"""
    return keys.astype(np.uint32), (keys >> U(32)).astype(np.uint16)


def from_bits(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.int64) | (np.frombuffer(high, np.uint16).astype(np.int64) << 32)


def by_part(table: pa.Table):
    """(part, its rows) of a bucket (uid null), one row in memory at a time."""
    part = table.column("part").to_numpy()
    own = table.column("uid").is_null().to_numpy()
    for k in range(max(PARTS)):
        if (found := np.flatnonzero((part == k) & own)).size:
            yield k, (table.slice(int(i), 1).to_pylist()[0] for i in found)


def own_answers(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, values) that tasks had found themselves."""
    rows = table.filter(table.column("uid").is_valid())
    return from_slots(list(zip(*(rows.column(c).to_pylist() for c in ("uid", "a", "b")), strict=True)), width)


def first_answer(hot: HotAnchors, slots: int):
    """Of one bucket: the places of anchors that more than one task has sent or that a task knows to be shared, and which
    anchors are hot."""

    def run(table: pa.Table) -> pa.Table:
        release()
        uid, values = own_answers(table, 1)
        found = [(*numbered(uid), values)]  # of the bucket and of each part: uids, and for each answer the number of its uid
        marks = []
        bucket = table.column("bucket")[0].as_py()
        for part, rows in by_part(table):
            keys, leads, lengths, places, known, texts_of = [], [], [], [], [], []
            for r in rows:
                keys.append(from_bits(r["a"], r["b"]))
                leads.append(r["c"])
                lengths.append(np.frombuffer(expand(r["d"]), np.uint32))
                places.append(np.cumsum(np.frombuffer(expand(r["e"]), np.int32), dtype=np.int32))
                known.append(from_bits(r["f"], r["g"]))
                texts_of.append(np.frombuffer(expand(r["h"]), np.uint32))
            lead, number = numbered(uid_array(leads))  # a text may have come from several tasks
            text, n = np.repeat(number, joined(lengths)), sum(map(len, keys))
            key, place, texts_of = joined(keys + known), joined(places), joined(texts_of)
            del keys, leads, number, known
            if not len(key):
                continue
            order = np.argsort(key)
            k, own = key[order], order < n  # not own: only known to be shared
            del key
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            many = np.diff(np.append(head, len(k)))
            t = np.append(text, np.full(len(k) - n, -1, np.int32))[order]
            other = np.concatenate([[False], (t[1:] != t[:-1]) & (k[1:] == k[:-1])])
            hit = order[np.repeat(np.logical_or.reduceat(other | ~own, head), many) & own]
            met, answered = np.unique(text[hit], return_inverse=True)
            found.append((lead[met], answered.astype(np.int32), place[hit][:, None]))
            at = np.flatnonzero(~own)
            np.add.at(many, np.searchsorted(head, at, "right") - 1, texts_of[order[at] - n].astype(np.int64) - 1)
            if (many > HOT_TEXTS).any():
                marks.append((bucket * PARTS[0] + part, None, None, hot.marks(k[head[many > HOT_TEXTS]])))
            del lead, text, place, order, k, own, t, other, hit, head, many, met, answered
        uids, numbers, places = (list(x) for x in zip(*found, strict=True))
        del found, uid, values
        begin = np.cumsum([0, *map(len, uids)], dtype=np.int32)
        number, values = joined([x + b for x, b in zip(numbers, begin, strict=False)]), joined(places)
        del numbers
        release()
        return pa.Table.from_batches([packed(by_slot(joined(uids), values, slots, number) + marks, BACK)])

    return run


def second_pass(buckets: int, at: dict[str, int], gram: int, slots: int, hot: HotAnchors):
    """Distinct segments of shared anchors for the buckets; starts that the task itself finds covered (uid set).

    Copies within the task are told by 128-bit hashes; buckets compare the bytes.
    """

    def run(batches):
        texts_held: list[bytes] = []  # the task's text, from which segments are cut at the end
        base = 0
        cols: list[list[np.ndarray]] = [[] for _ in range(9)]
        for batch in batches:
            texts = [b or b"" for b in batch.column(at["text"]).to_pylist()]
            uid = uid_array(batch.column(at["key"]).to_pylist())
            did = batch.column(at["id"]).to_numpy(zero_copy_only=False)
            got = batch.column(at["got"]).to_pylist()
            for first, data, starts, sizes in chunks(texts):
                doc, low, high, anchor, key = with_parted(data, segments(data, starts, sizes, gram), hot)
                lists = [got[first + j] or b"" for j in range(len(sizes))]
                codes = np.frombuffer(b"".join(lists), np.int32) + np.repeat(starts, [len(x) // 4 for x in lists])
                wanted = np.zeros(len(data) + 1, bool)
                wanted[codes] = True
                hit = wanted[low]
                doc, low, high, key, anchor = doc[hit], low[hit], high[hit], key[hit], anchor[hit]
                h = piece_hashes(data, low, high + LENGTH)
                for c, x in zip(cols, (h[0], h[1], did[first + doc], uid[first + doc], low - starts[doc], high - low + 1, base + low, key, anchor - low), strict=True):
                    c.append(x)
                texts_held.append(data.tobytes())
                base += len(data)
        if not base:
            return
        h0, h1, did, uid, place, n, where, key, anchor = (np.concatenate(c) for c in cols)
        whole = b"".join(texts_held)
        del cols, texts_held
        order = np.lexsort((did, h1, h0))
        head = np.concatenate([[True], (h0[order][1:] != h0[order][:-1]) | (h1[order][1:] != h1[order][:-1])]) if len(order) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        lead = order[head]  # of each segment, an occurrence in its least document
        least = did[lead]
        own = did[order] == least[group]
        late = order[~own]
        for slot, *answer in by_slot(uid[late], np.stack([place[late], place[late] + n[late]], axis=1), slots):
            yield sent(slot * buckets // slots, PARTS[1], *answer)
        kept, group = order[own], group[own]  # occurrences in the least document, segment by segment
        counts = np.bincount(group, minlength=len(lead))
        begin = np.cumsum(counts) - counts
        bucket = bucket_of(key[lead], buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for i in range(buckets):
            mine = by_bucket[edges[i] : edges[i + 1]]
            if not len(mine):
                continue
            pieces = [whole[w : w + m + LENGTH - 1] for w, m in zip(where[lead[mine]].tolist(), n[lead[mine]].tolist(), strict=True)]
            alike = sorted(range(len(pieces)), key=pieces.__getitem__)  # neighbours share much, which compresses well
            pieces, mine = [pieces[j] for j in alike], mine[alike]
            c = counts[mine]
            places = kept[np.repeat(begin[mine] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
            yield sent(i, PARTS[1], None, squeeze(b"".join(pieces)), squeeze(np.stack([n[lead[mine]] + LENGTH - 1, anchor[lead[mine]]]).astype(np.uint8)), squeeze(least[mine]), squeeze(c.astype(np.uint32)), uid[places], squeeze(place[places].astype(np.int32)))

    return releasing(run)


def second_answer(gram: int, slots: int):
    """Of one bucket: (uid, runs of starts that an earlier document has as well)."""

    def run(table: pa.Table) -> pa.Table:
        release()
        found = [own_answers(table, 2)] + [covered(rows, gram) for _, rows in by_part(table)]
        uid, values = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        release()
        return pa.Table.from_batches([packed(by_slot(uid, values, slots), BACK)])

    return run


def by_text(answers: DataFrame, width: int) -> DataFrame:
    """Rows (uid, got), one for each text, of the answers of all buckets."""

    def run(table: pa.Table) -> pa.Table:
        lead, begin, values = by_uid(*from_slots(list(zip(*(table.column(c).to_pylist() for c in ("uid", "n", "got")), strict=True)), width))
        edges = (begin * (4 * width)).tolist()
        whole = values.tobytes()
        return pa.table({"uid": pa.array([u.tobytes() for u in lead], pa.binary()), "got": pa.array([whole[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})

    return answers.groupBy("slot").applyInArrow(run, "uid binary, got binary")


def covered(rows, gram: int) -> tuple[np.ndarray, np.ndarray]:
    merged: dict[bytes, int] = {}
    keys: list[int] = []
    least: list[int] = []
    anchors: list[int] = []
    where: list[tuple] = []  # of each task's occurrences: piece, document's id, uid, place
    for r in rows:
        whole, lines = expand(r["a"]), np.frombuffer(expand(r["b"]), np.uint8).reshape(2, -1)
        size_of, anchor_of = lines.astype(np.int64)
        alone = anchor_of == ALONE
        grams = gram_hashes(np.frombuffer(whole, np.uint8), gram)
        key = np.where(alone, np.arange(len(alone), dtype=U), grams[np.cumsum(size_of) - size_of + np.where(alone, 0, anchor_of)]).tolist()
        lines = lines.tolist()
        ids, counts = np.frombuffer(expand(r["c"]), np.int64).tolist(), np.frombuffer(expand(r["d"]), np.uint32)
        numbers, spot = [], 0
        for size, anchor, k, i in zip(*lines, key, ids, strict=True):
            piece = whole[spot : spot + size]
            spot += size
            m = merged.setdefault(piece, len(keys))
            if m == len(keys):
                keys.append(k)
                least.append(i)
                anchors.append(anchor)
            elif i < least[m]:
                least[m] = i
            numbers.append(m)
        where.append((np.repeat(np.array(numbers, np.int64), counts), np.repeat(np.array(ids, np.int64), counts), np.frombuffer(r["e"], np.int64).reshape(-1, 2), np.frombuffer(expand(r["f"]), np.int32).astype(np.int64)))
    pieces, low = list(merged), np.array(least, np.int64)
    starts = np.array([len(p) - LENGTH + 1 for p in pieces], np.int64)
    begin = np.cumsum(starts) - starts
    first_id = np.repeat(low, starts)  # of each start: the least document that has its string
    key = np.array(keys, U)
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    same |= np.append(same[1:], False)
    same &= np.array(anchors)[order] != ALONE
    several = order[same]  # pieces that share their anchor with another piece
    several = several[alike([pieces[m] for m in several.tolist()], [anchors[m] for m in several.tolist()], gram)]
    # anchor by anchor, in portions that bound the memory of one suffix array
    sizes = np.cumsum(np.array([len(pieces[m]) for m in several.tolist()], np.int64))
    fresh = np.concatenate([[True], key[several][1:] != key[several][:-1]]) if len(several) else np.zeros(0, bool)
    cuts, last = [0], 0
    for j in np.flatnonzero(fresh).tolist():
        if j and sizes[j - 1] - last > PORTION:
            cuts.append(j)
            last = int(sizes[j - 1])
    for a, b in zip(cuts, [*cuts[1:], len(several)], strict=True):
        group = several[a:b]
        if not len(group):
            continue
        number, part = repeats([pieces[m] for m in group.tolist()], starts[group])
        best = np.full(int(number.max()) + 1, NO_ID, np.int64)
        np.minimum.at(best, number, low[group][part])
        spot = np.arange(len(part)) - np.repeat(np.cumsum(starts[group]) - starts[group], starts[group]) + begin[group][part]
        first_id[spot] = best[number]
    w, ids, uid, place = (np.concatenate([x[i] for x in where]) for i in range(4))
    # an occurrence in the least document of a piece whose strings are in no other piece can't be covered
    open_pieces = np.zeros(len(pieces), bool)
    open_pieces[several] = True
    live = open_pieces[w] | (ids > low[w])
    w, ids, uid, place = w[live], ids[live], uid[live], place[live]
    n = starts[w]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hit = first_id[np.repeat(begin[w], n) + at] < np.repeat(ids, n)
    owner = np.repeat(np.arange(len(w)), n)
    # runs of covered starts
    open_ = hit & ~np.concatenate([[False], (hit[:-1] & (owner[1:] == owner[:-1]))])[: len(hit)]
    close = hit & ~np.append(hit[1:] & (owner[1:] == owner[:-1]), False)[: len(hit)]
    o = owner[open_]
    return uid[o], np.stack([place[o] + at[open_], place[o] + at[close] + 1], axis=1).astype(np.int32)


def alike(pieces: list[bytes], anchors: list[int], gram: int) -> np.ndarray:
    """Which pieces can have a string in common with another one of the same anchor.

    A string that starts at most `side` bytes before its anchor holds the LENGTH - side bytes from the anchor on, any other the
    side + 1 bytes before the anchor and its gram. A piece alone with both contexts is alone with all its strings.
    """
    side = (LENGTH - gram) // 2
    seen: dict[bytes, int] = {}
    contexts = []
    for p, a in zip(pieces, anchors, strict=True):
        right = p[a : a + LENGTH - side] if a + LENGTH - side <= len(p) else None
        left = p[a - side - 1 : a + gram] if a > side else None
        contexts.append((right, left))
        if right is not None:
            seen[right] = seen.get(right, 0) + 1
        if left is not None:
            seen[left] = seen.get(left, 0) + 1
    return np.array([(r is not None and seen[r] > 1) or (x is not None and seen[x] > 1) for r, x in contexts], bool)


def cut(text: bytes, runs: np.ndarray, length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes left, and the maximal removed spans, for runs of covered starts."""
    if not len(runs):
        return text, []
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, runs[:, 0], 1)
    np.add.at(mark, runs[:, 1] + length - 1, -1)
    gone = np.cumsum(mark[:-1]) > 0
    step = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), spans


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def repeated_places(docs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Rows (uid, got) with the runs of covered starts of each text that has any. `docs` are rows (key, text) as they lie, `texts` the distinct
    ones (key, id, text), of so many bytes."""
    gram = gram_size(size)
    first, second = (n * max(2, -(-size // b)) for n, b in zip(PARTS, BUCKET_BYTES, strict=True))  # parts of buckets
    slots = max(2, -(-size // SLOT_BYTES))
    hot = HotAnchors(first)
    shared = checkpoint(docs.mapInArrow(first_pass(first, gram, slots), SENT_DDL).groupBy("bucket").applyInArrow(first_answer(hot, slots), BACK_DDL))
    for r in shared.filter(F.col("uid").isNull()).select("slot", "got").toLocalIterator():  # HOT_BITS[1] bits at most
        hot.add(r["slot"], bytes(r["got"]))
    if hot.bits is not None:
        shared = shared.unionByName(docs.mapInArrow(first_pass(first, gram, slots, hot), SENT_DDL).groupBy("bucket").applyInArrow(first_answer(HotAnchors(first), slots), BACK_DDL))
    shared = by_text(shared.filter(F.col("uid").isNotNull()), 1)
    asked = texts.join(shared, F.col("key") == F.col("uid")).select("key", "id", "text", "got")
    found = asked.mapInArrow(second_pass(second, {"key": 0, "id": 1, "text": 2, "got": 3}, gram, slots, hot), SENT_DDL).groupBy("bucket").applyInArrow(second_answer(gram, slots), BACK_DDL)
    return by_text(found, 2)


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Appends `kept binary`, `n_bytes long`, `n_removed long` and `spans array<struct<start int, stop int>>` to every row.

    A byte is removed if a string of 50 bytes that covers it also starts in a row with a smaller id. The text is taken
    as UTF-8 bytes, so a cut may fall inside a character; null counts as empty. A null id counts as the greatest 64-bit
    number. Rows of one id, repeated rows among them, never remove each other's bytes. Result columns replace
    input columns of the same name; an empty table stays empty. Texts are equal if their MD5 is.
    """
    spark = df.sparkSession
    ship(spark)
    result = ["kept", "n_bytes", "n_removed", "spans"]
    keep = [c for c in df.columns if c.lower() not in result]
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    number = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(NO_ID)))
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(keep) if c != text_col]
    base = df.select(F.unhex(F.md5(raw)).alias("key"), number.alias("id"), raw.alias("text"), F.col(f"`{text_col}`").isNull().alias("no_text"), *own)

    copies = checkpoint(base.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max(F.octet_length("text")).cast("long").alias("size")))
    size = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).collect()[0]
    many = copies.filter(F.col("n") > max(MANY, size["rows"] // SHARE)).select(F.col("key").alias("many_key"), F.col("least").alias("many_least"))  # fewer than SHARE rows
    base = base.join(F.broadcast(many), F.col("key") == F.col("many_key"), "left")
    far = F.col("many_least").isNotNull() & (F.col("id") != F.col("many_least"))  # answered without a shuffle

    docs = base.filter(~far)
    texts = docs.groupBy("key").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    found = repeated_places(docs.select("key", "text"), texts, size["bytes"])
    columns = ["id", "no_text", *[f"own_{i}" for i, c in enumerate(keep) if c != text_col]]
    rows = docs.select(F.col("key").alias("row_key"), *columns)
    near = texts.select("key", F.col("id").alias("least"), "text").join(found, F.col("key") == F.col("uid"), "left").join(rows, F.col("key") == F.col("row_key"))
    near = near.select("text", "got", "least", *columns)
    copied = base.filter(far).select("text", F.lit(None).cast("binary").alias("got"), F.col("many_least").alias("least"), *columns)
    places = [columns.index(f"own_{i}") + 3 if c != text_col else None for i, c in enumerate(keep)]
    schema = T.StructType([df.schema[c] if c != text_col else T.StructField(c, T.StringType(), True) for c in keep] + [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPAN)])

    def finish(batches):
        for batch in batches:
            texts, got = [b or b"" for b in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            made = []
            for t, g, least, i in zip(texts, got, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if i == least:
                    made.append(cut(t, np.frombuffer(g or b"", np.int32).reshape(-1, 2).astype(np.int64)))
                else:
                    made.append((b"", [(0, len(t))]) if len(t) >= LENGTH else (t, []))
            columns = [pa.array([k for k, _ in made], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, (k, _) in zip(texts, made, strict=True)], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in made], ARROW_SPAN)]
            text = pa.array([None if no else t.decode("utf-8", "replace") for t, no in zip(texts, batch.column(4).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text if i is None else batch.column(i) for i in places] + columns, names=[*keep, *result])

    return near.unionByName(copied).mapInArrow(releasing(finish), schema)
