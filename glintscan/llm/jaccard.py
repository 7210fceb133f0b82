"""N-gram Jaccard self-join through a MinHash LSH forest, with exact verification.

Each distinct text has a label in each of TREES trees: DEPTH minimum hashes over its word shingles. The labels of all trees are
sorted over Spark by ranges, so that each tree lies in the order of its prefix trie and a range may end anywhere, also
within a crowded prefix. One pass over each range keeps the path of the trie that leads to the current label. A text
is linked to the first text below the deepest node that both share, so by its longest matched prefix; that text is linked by its own, shorter
one, and so on upwards. Prefixes are shortened no further than the target recall asks: `matched_depth` is the longest at which a pair at the threshold
is missed with a chance of at most 1 - TARGET_RECALL. Texts that share a prefix of that length in some tree are candidates. They are put into
clusters (components over the forest's edges), a cluster into blocks, and each pair of
blocks is verified in one task from the texts' whole shingle sets: only sums of links and one edge for
each text leave it, never the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintscan.llm import common
from glintscan.llm.common import Grown, Numbering, checkpoint, free_name, map_text, releasing, ship, worker_state
from glintscan.llm.components import components

WORD = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 27, 8, 0.999999
#: Bytes of a minimum hash in a label; equal ones may come from different hashes, which only adds candidates.
LEVEL = 2
#: Texts of a block; a task holds two blocks.
BLOCK = 256
STEP = np.uint64(0x9E3779B97F4A7C15)


def matched_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair of that similarity is found with at least the target chance."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def word_numbers(texts: list[str | None], table: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased, and the number of words of each text."""
    if len(table[0]) > common.TABLE_LIMIT:
        table[:] = [Numbering(), Grown(np.uint64)]
    seen, hashes = table
    numbers: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            before = len(numbers)
            numbers.extend(map(seen.__getitem__, WORD.findall(text.lower())))
            lengths[k] = len(numbers) - before
    if seen.fresh:
        hashes.extend(np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in seen.take_fresh()], np.uint64))
    return hashes.data[np.array(numbers, np.int64)], lengths


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, lengths: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words of each text, and their number; a text of 1 to n - 1 words is one shingle."""
    ends = np.cumsum(lengths)
    counts = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    starts = np.repeat(ends - lengths - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    have = np.repeat(np.minimum(lengths, n), counts)
    out = have.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        out = np.where(k < have, out * STEP + padded[starts + k], out)
        out ^= out >> np.uint64(32)
    return mix(out), counts


def signatures(sh: np.ndarray, counts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The labels of each text, tree after tree: `depth` minimum hashes of LEVEL bytes. Texts without shingles must not be given."""
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), trees * depth), f">u{LEVEL}")
    for k in range(trees * depth):
        out[:, k] = mix(np.minimum.reduceat(sh * odd[k], starts)) >> np.uint64(64 - 8 * LEVEL)
    return out.view(np.uint8)


def with_labels(df: DataFrame, trees: int, depth: int, n: int, text_col: str, keep: list[str]) -> DataFrame:
    """Appends `labels binary`; null for texts without a word."""

    def compute():
        table = worker_state("jaccard words", lambda: [Numbering(), Grown(np.uint64)])

        def apply(texts):
            words, lengths = word_numbers(texts, table)
            sh, counts = shingles(words, lengths, n)
            full = np.flatnonzero(counts)
            out: list[bytes | None] = [None] * len(texts)
            if len(full):
                for k, row in zip(full.tolist(), signatures(sh, counts[full], trees, depth), strict=True):
                    out[k] = row.tobytes()
            return [pa.array(out, pa.binary())]

        return apply

    return map_text(df, compute, [T.StructField("labels", T.BinaryType(), True)], text_col, keep)


def walk(batches: Iterator[pa.RecordBatch], depth: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """Edges of the tries whose sorted (path, key) rows are given; a path is a byte for the tree and the label.

    Rows (a, b, root): a's longest prefix shared with the row before it leads to a node of the trie, below which b comes first; prefixes
    under `shortest` levels make no edge, and root is null. Two more rows, (first key, null, root) and (last key,
    null, root), tell which prefixes of `shortest` levels may go on in a neighbouring range.
    """
    levels = np.arange(shortest, depth + 1)
    names = ["a", "b", "root"]
    last: tuple[np.ndarray, bytes] | None = None
    heads: list[bytes] = [b""] * len(levels)  # the first text below each node of the current path
    for batch in batches:
        m = batch.num_rows
        if m == 0:
            continue
        keys = batch.column(1).to_pylist()
        paths = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(m, 1 + depth * LEVEL)
        before = np.concatenate([paths[:1] if last is None else last[0][None, :], paths[:-1]])
        same = np.cumprod(before == paths, axis=1).sum(axis=1)
        shared = (same - 1) // LEVEL  # levels in common with the row before; -1 in another tree
        if last is None:
            shared[0] = -1
            yield pa.RecordBatch.from_arrays([pa.array([keys[0]], pa.binary()), pa.array([None], pa.binary()), pa.array([paths[0, : 1 + shortest * LEVEL].tobytes()], pa.binary())], names=names)
        first = np.maximum.accumulate(np.where(shared[None, :] < levels[:, None], np.arange(m), -1), axis=1)
        met = np.flatnonzero(shared >= shortest)
        at = first[shared[met] - shortest, met].tolist()
        to = [keys[f] if f >= 0 else heads[d] for f, d in zip(at, (shared[met] - shortest).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in met.tolist()], pa.binary()), pa.array(to, pa.binary()), pa.nulls(len(met), pa.binary())], names=names)
        heads = [keys[f] if f >= 0 else h for f, h in zip(first[:, -1].tolist(), heads, strict=True)]
        last = paths[-1].copy(), keys[-1]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[1]], pa.binary()), pa.array([None], pa.binary()), pa.array([last[0][: 1 + shortest * LEVEL].tobytes()], pa.binary())], names=names)


def forest(labels: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """Edges (a, b) between the keys of rows (key, labels) that share a prefix of at least `shortest` levels in some tree.

    Not all such pairs are edges, but all are connected by edges of one tree. The ends of ranges, two for each range, are put together by prefix.
    """
    width = depth * LEVEL
    path = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substr(F.col("labels"), t * width + 1, F.lit(width)))))
    paths = labels.filter(F.col("labels").isNotNull()).select(path.alias("path"), "key")
    ranges = paths.repartitionByRange("path", "key").sortWithinPartitions("path", "key")
    walked = checkpoint(ranges.mapInArrow(releasing(lambda batches: walk(batches, depth, shortest)), "a binary, b binary, root binary"))
    ends = walked.filter(F.col("root").isNotNull()).select("root", "a")
    met = ends.join(ends.groupBy("root").agg(F.min("a").alias("b")), "root").select("a", "b")
    return walked.filter(F.col("root").isNull()).select("a", "b").unionByName(met).distinct()


def with_shingles(df: DataFrame, n: int, text_col: str, keep: list[str]) -> DataFrame:
    """Appends `shingles binary`: the sorted distinct shingle hashes."""

    def compute():
        table = worker_state("jaccard words", lambda: [Numbering(), Grown(np.uint64)])

        def apply(texts):
            words, lengths = word_numbers(texts, table)
            sh, counts = shingles(words, lengths, n)
            ends = np.cumsum(counts).tolist()
            return [pa.array([np.unique(sh[e - c : e]).tobytes() for e, c in zip(ends, counts.tolist(), strict=True)], pa.binary())]

        return apply

    return map_text(df, compute, [T.StructField("shingles", T.BinaryType(), True)], text_col, keep)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Shingles with the same holders are counted together, so that near copies are cheap."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.append(first, len(flat)))
    shared = size > 1
    out = np.zeros((m, m), np.int64)
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    if not shared.any():
        return out
    rng = np.random.default_rng(3)
    marks = rng.integers(1, 2**63, (m, 2), dtype=np.uint64)
    pattern = np.stack([np.add.reduceat(marks[owner, k], first)[shared] for k in (0, 1)], axis=1)
    _, one, weight = np.unique(pattern, axis=0, return_index=True, return_counts=True)
    start, size = first[shared][one], size[shared][one]
    total = np.zeros((m, m), np.float64)
    for k in range(0, len(one), 2048):
        s, z = start[k : k + 2048], size[k : k + 2048]
        rows = owner[np.repeat(s - (np.cumsum(z) - z), z) + np.arange(int(z.sum()))]
        held = np.zeros((m, len(s)), np.float32)
        held[rows, np.repeat(np.arange(len(s)), z)] = 1
        total += (held * weight[k : k + 2048].astype(np.float32)) @ held.T
    np.fill_diagonal(total, 0)
    return out + np.rint(total).astype(np.int64)


def matched(labels: list[bytes], depth: int) -> np.ndarray:
    """A number for each text and tree that is equal where the first `depth` levels of the labels are."""
    levels = np.frombuffer(b"".join(labels), np.dtype(f"u{LEVEL}")).reshape(len(labels), TREES, DEPTH)
    out = np.zeros((len(labels), TREES), np.uint64)
    for d in range(depth):
        out = mix(out * STEP + levels[:, :, d])
    return out


def verify(keys: list[bytes], left: np.ndarray, sets: list[np.ndarray], prefix: np.ndarray, threshold: float, across: bool) -> list[tuple[bytes, int, bytes]]:
    """(key, links, least key that its links lead to) of each text of a pair of blocks; `left` marks the first block.

    Between two blocks (`across`) only pairs across are counted; those within a block have a task of their own.
    """
    m = len(keys)
    near = np.zeros((m, m), bool)
    for t in range(prefix.shape[1]):
        near |= prefix[:, t][:, None] == prefix[:, t][None, :]
    if across:
        near &= left[:, None] != left[None, :]
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    if len(a) > 4 * m:
        both = overlaps(sets)[a, b]
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
    a, b = a[linked], b[linked]
    links = np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
    root = np.argsort(np.argsort(np.array(keys, object)))  # ranks, so that least labels are least keys
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    ordered = sorted(keys)
    return [(k, n, ordered[r]) for k, n, r in zip(keys, links.tolist(), root.tolist(), strict=True) if n]


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, gathered by their first `width` columns; one group is held at a time."""
    group: list[tuple] = []
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            for row in zip(*[c.to_pylist() for c in batch.slice(k, BLOCK).columns], strict=True):
                if group and row[:width] != group[0][:width]:
                    yield group
                    group = []
                group.append(row)
    if group:
        yield group


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Classes of texts with linked ones: rows (key, class_id, n_links) and the documents' rows (id, key).

    key is the MD5 of the text (null counts as empty); class_id is the least id of the texts that links connect, null if
    all are null; n_links is the number of other texts with Jaccard similarity of at least the threshold, copies
    counted once. Words are runs of letters, digits and underscores in lower case; a text with fewer words than a
    shingle is one shingle; texts without a word have no links. An empty table gives empty tables.
    """
    ship(docs.sparkSession)
    depth = matched_depth(threshold)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary"))).alias("key")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), key)
    signed = with_labels(docs.select(F.col(f"`{id_col}`").alias("id"), key, text.alias("text")), TREES, DEPTH, n, "text", ["id", "key"])
    classes = checkpoint(signed.groupBy("key").agg(F.min("id").alias("rep"), F.first("labels").alias("labels")))

    edges = forest(classes.select("key", "labels"), TREES, DEPTH, depth)
    members = components(edges)
    clusters = members.select(F.col("a").alias("key"), F.col("b").alias("cluster")).unionByName(members.select(F.col("b").alias("key"), F.col("b").alias("cluster")).distinct())
    sizes = members.groupBy(F.col("b").alias("cluster")).agg(F.ceil((F.count("*") + 1) / BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    found = docs.select(key, text.alias("text")).join(placed, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("cluster").alias("cluster"), F.first("block").alias("block"), F.first("blocks").alias("blocks"))
    sets = with_shingles(found, n, "text", ["key", "cluster", "block", "blocks"]).join(classes.select("key", "labels"), "key")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high"))))
    dealt = sets.select("cluster", "key", "block", "shingles", "labels", pair.alias("pair")).select("cluster", "pair.low", "pair.high", "key", "block", "shingles", "labels")
    dealt = dealt.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")

    def check(batches):
        for group in runs(batches, 3):
            if len(group) > 1:
                made = verify([r[3] for r in group], np.array([r[4] == r[1] for r in group]), [np.frombuffer(r[5], np.uint64) for r in group], matched([r[6] for r in group], depth), threshold, group[0][1] != group[0][2])
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.binary()), pa.array([r[1] for r in made], pa.int64()), pa.array([r[2] for r in made], pa.binary())], names=["key", "links", "root"])

    verified = checkpoint(dealt.mapInArrow(releasing(check), "key binary, links long, root binary"))
    joined = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = verified.groupBy("key").agg(F.sum("links").alias("n_links"))
    linked = linked.join(joined.select(F.col("a").alias("key"), F.col("b").alias("head")), "key", "left").withColumn("head", F.coalesce("head", "key"))
    linked = linked.join(classes.select("key", "rep"), "key")
    heads = linked.groupBy("head").agg(F.min("rep").alias("class_id"))
    return linked.join(heads, "head").select("key", "class_id", "n_links"), rows.join(classes.select("key", "rep"), "key")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row (id, class_id, n_links) for every row of docs: documents with equal or linked texts share a class.

    class_id is the least id of the class (null if all its ids are null). See `join` for words, links and edge cases.
    """
    linked, rows = join(docs, threshold, n, text_col, id_col)
    out = rows.join(linked, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs without near duplicates: of each class, one row with the least id stays.

    Texts without a word are each other's copies only if equal. Among rows of equal least id and text, one stays.
    A class whose ids are all null keeps one row.
    """
    linked, rows = join(docs, threshold, n, text_col, id_col)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key_name = free_name(docs, "key")
    keyed = docs.withColumn(key_name, F.unhex(F.md5(text.cast("binary"))))
    # the text that keeps a row: the class's text with the least (id, key)
    reps = rows.select("key", "rep").distinct().join(linked.select("key", "class_id"), "key", "left")
    heads = reps.withColumn("class", F.when(F.col("class_id").isNotNull(), F.struct(F.col("class_id"), F.lit(None).cast("binary").alias("k"))).otherwise(F.struct(F.col("rep").alias("class_id"), F.col("key").alias("k"))))
    chosen = heads.groupBy("class").agg(F.min(F.struct(F.col("rep").isNull().alias("no"), F.col("rep"), F.col("key"))).alias("h")).select(F.col("h.key").alias("kept_key"), F.col("h.rep").alias("kept_id"))
    met = keyed.join(chosen, (F.col(key_name) == F.col("kept_key")) & F.col(f"`{id_col}`").eqNullSafe(F.col("kept_id")), "left_semi")
    if not rows.groupBy("id", "key").count().filter("count > 1").isEmpty():
        met = met.dropDuplicates([key_name, id_col])
    return met.drop(key_name)
