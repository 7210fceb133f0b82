"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, the hashes of K consecutive words are combined, and every window of consecutive K-grams keeps its least
hash; two texts that share a span of as many words as a window covers share that window's fingerprint, so no
span of that length is missed. Fingerprints of the distinct training texts are joined with those of the test
items. Only the windows of a text whose fingerprint was met are then extended: their words are compared with the
test item's words themselves, and matching windows are merged into hit words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import checkpoint, free_name

#: Words of a window, and of the K-grams that fingerprints are made of.
WINDOW, GRAM = 13, 8
#: Rows of met texts and of their hits that are sent to all tasks; beyond, texts are shuffled by their digest.
BROADCAST_ROWS = 100_000
#: Everything in ASCII but digits and letters parts words; a character beyond ASCII belongs to one.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. Null gives an empty array."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often body names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paired(a: Column, n: int, f) -> Column:
    """f(a[i], a[i + n]) for every i that has both."""

    def zipped(x):
        left = F.greatest(F.size(x) - n, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), left), F.slice(x, F.lit(n + 1), left), f)

    return let(a, zipped)


def gram_size(width: int) -> int:
    return min(GRAM, width)


def fingerprints(words: Column, width: int) -> Column:
    """The least hash of the K-grams of each window of `width` words, one for each start of a window.

    Hashes of runs and least values of windows are both built up by doubling.
    """
    out, k = F.transform(words, lambda w: F.xxhash64(w)), gram_size(width)
    for size, f in ((k, lambda a, b: F.xxhash64(a, b)), (width - k + 1, lambda a, b: F.least(a, b))):
        have = 1
        while have < size:
            by = min(have, size - have)
            out, have = paired(out, by, f), have + by
    return out


def all_fingerprints(widths: list[int]):
    """From words: (width, print) of the distinct prints of every width."""

    def one(words, width):
        return F.transform(F.array_distinct(fingerprints(words, width)), lambda p: F.struct(F.lit(width).alias("width"), p.alias("print")))

    return lambda words: F.concat(*[one(words, w) for w in widths])


def spans(width: int, chosen=None):
    """From words: the windows of that width as (width, at, print, span); with `chosen`, those whose print it accepts."""

    def of(words):
        placed = let(fingerprints(words, width), lambda prints: F.transform(prints, lambda p, i: F.struct(i.alias("at"), p.alias("print"))))
        placed = F.filter(placed, chosen) if chosen else placed
        return F.transform(placed, lambda x: F.struct(F.lit(width).alias("width"), x["at"].alias("at"), x["print"].alias("print"), F.concat_ws(" ", F.slice(words, x["at"] + 1, F.lit(width))).alias("span")))

    return of


def join_small(large: DataFrame, small: DataFrame, key: str, how: str) -> DataFrame:
    """Joins by the key; `small` is written first and sent to all tasks if it has at most BROADCAST_ROWS rows."""
    small = checkpoint(small)
    return large.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, key, how)


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Appends to every row of `docs`: n_words, n_hit, hit_items (sorted distinct item ids as text) and contaminated.

    A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. A word inside any
    occurrence of a window is hit; a row is contaminated if it has a hit and 20 * n_hit >= n_words. Null and empty
    texts have no words and no hit; items without words, and an empty table of either kind, hit nothing. Items with a null id
    hit words but are not listed; an id that occurs twice is listed once. Rows repeat as given; result columns replace
    input columns of the same name.
    """
    result = ["n_words", "n_hit", "hit_items", "contaminated"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in result])
    tests = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
    tests = tests.withColumn("n", F.size("words")).filter(F.col("n") > 0).withColumn("width", F.least(F.col("n"), F.lit(WINDOW)))
    widths = sorted(r["width"] for r in tests.select("width").distinct().collect())  # 13 rows at most

    # everything goes by a digest of the text
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = free_name(docs, "key_")
    keyed = docs.withColumn(key, F.sha2(text, 256)).withColumn("n_words", F.size(words_of(text)).cast("long"))
    if not widths:
        return keyed.drop(key).withColumn("n_hit", F.lit(0).cast("long")).withColumn("hit_items", F.array().cast("array<string>")).withColumn("contaminated", F.lit(False))

    # outer generators: an inner one would have its array computed a second time, as a filter on its size
    windows = F.when(F.col("width") == widths[0], let(F.col("words"), spans(widths[0])))
    for w in widths[1:]:
        windows = windows.when(F.col("width") == w, let(F.col("words"), spans(w)))
    windows = tests.select("item", F.inline_outer(windows.alias("w"))).select("item", "width", "print", "span").distinct()
    base = docs.select(F.sha2(text, 256).alias("key_"), text.alias("text_"))
    printed = base.select("key_", F.inline_outer(let(words_of(F.col("text_")), all_fingerprints(widths))))
    met = printed.join(windows.select("width", "print").distinct(), ["width", "print"], "left_semi").groupBy("key_").agg(F.collect_set(F.struct("width", "print")).alias("met"))  # at most the prints of one text
    # extend: only the texts that were met, copies put together, and of them only the windows that were met, word by word
    texts = join_small(base, met, "key_", "inner").groupBy("key_").agg(F.first("text_").alias("text_"), F.first("met").alias("met"))
    chosen = lambda w: lambda x: F.exists("met", lambda m: (m["width"] == w) & (m["print"] == x["print"]))
    found = texts.select("key_", F.inline_outer(let(words_of(F.col("text_")), lambda words: F.concat(*[spans(w, chosen(w))(words) for w in widths]))))
    hits = found.join(windows, ["width", "print", "span"]).select("key_", "at", "width", "item")
    per_text = hits.groupBy("key_").agg(F.array_sort(F.collect_set(F.struct("at", "width"))).alias("runs"), F.array_sort(F.collect_set("item")).alias("hit_items"))
    # the union of the sorted runs: what each adds beyond the furthest end so far
    union = F.aggregate("runs", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), lambda acc, r: F.struct(F.greatest(acc["end"], r["at"] + r["width"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), r["at"] + r["width"] - F.greatest(acc["end"], r["at"]))).alias("hit")), lambda acc: acc["hit"])
    per_text = per_text.select(F.col("key_").alias(key), union.cast("long").alias("n_hit"), "hit_items")
    out = join_small(keyed, per_text, key, "left").drop(key)
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("hit_items", F.coalesce("hit_items", F.array().cast("array<string>")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words")))
