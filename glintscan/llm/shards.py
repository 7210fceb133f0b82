"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every linked document starts in a shard of its own hash; in each round the documents
of a group vote with their shards, a group larger than a shard for as many shards as it needs, and its members move towards
the winners. A shard takes at most as many as its quota leaves: where more ask, a share of the groups that ask is let in,
and those refused ask for another shard with room, until no group moves.
At the end rows over quota are released, and the unlinked and released rows fill every shard to its exact count. Links
go through the group's counts, never through pairs of its members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glintscan.llm.common import checkpoint

SHARDS, ROUNDS = 40, 3
#: So many rounds without a move end the propagation: in one alone the draws may refuse all.
IDLE = 3
#: Rows of a ranking bucket: places are counted bucket by bucket, so that no task ranks a whole shard.
BUCKET_ROWS = 20_000


def capacities(rows: int, shards: int) -> list[int]:
    """Counts at most one apart."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def at(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def ranked(df: DataFrame, groups: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Appends the place of each row within its groups, from 0: the rows of earlier buckets and the place in the bucket."""
    df = df.withColumn("bucket_", bucket)
    counts = df.groupBy(*groups, "bucket_").agg(F.count("*").alias("n_"))
    before = W.partitionBy(*groups).orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*groups, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    inside = F.row_number().over(W.partitionBy(*groups, "bucket_").orderBy(*order)) - 1
    return df.withColumn("inside_", inside).join(offsets, [*groups, "bucket_"]).withColumn(name, F.col("inside_") + F.col("before_")).drop("bucket_", "inside_", "before_")


def propagate(linked: DataFrame, room: list[int], rounds: int) -> DataFrame:
    """Rows (uid, group, total, shard) after that number of rounds and as many more as it takes until no group moves.

    A group that is still in several shards after the first round asks for one with room for all of it, drawn anew each
    round. After `rounds` rounds a shard lets in only what fits beside all its rows, so that it can't grow over its room.
    """
    shards, most = len(room), max(1, max(room))
    roomy = [True] * shards
    linked = linked.withColumn("moved", F.lit(0))
    turn = idle = 0
    while True:
        held, moved = [0] * shards, 0
        for r in linked.groupBy("shard").agg(F.count("*").alias("n"), F.sum("moved").alias("moved")).collect():  # a row a shard
            held[r["shard"]] = r["n"]
            moved += r["moved"]
        idle = 0 if moved else idle + 1
        if turn >= rounds and idle == IDLE:
            return linked.drop("moved")
        left = [c - h for c, h in zip(room, held, strict=True)]
        votes = linked.groupBy("group", "total", "shard").agg(F.count("*").alias("votes"))
        seats = (F.ceil(F.col("total") / most) + F.when(F.col("total") > most, min(turn, rounds - 1)).otherwise(0)).cast("int")
        # the group's shards by votes (ties: by hash); at most `shards` entries a group
        listed = votes.groupBy("group", "total").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", F.xxhash64("group", "shard").alias("tie"), "shard")), asc=False), F.lit(1), F.lit(shards)).alias("v"))
        voted = F.transform(F.slice("v", F.lit(1), F.least(seats, F.size("v"))), lambda x: x["shard"])
        if turn:
            fits = F.filter(F.array(*[F.lit(k) for k in range(shards)]), lambda k: at(left, k) >= F.col("total"))
            drawn = F.slice(fits, F.pmod(F.xxhash64("group", F.lit(turn)), F.greatest(F.size(fits), F.lit(1))).cast("int") + 1, F.lit(1))
            voted = F.when((F.col("total") <= most) & (F.size("v") > 1), drawn).otherwise(voted)
        homes = listed.select("group", voted.alias("homes"))
        open_ = F.when(F.col("total") > most, F.filter("homes", lambda h: at(roomy, h))).otherwise(F.col("homes"))
        to = F.get(open_, F.pmod(F.xxhash64("uid", F.lit(turn)), F.greatest(F.size(open_), F.lit(1))).cast("int"))
        asked = linked.join(homes, "group").withColumn("to", F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(F.coalesce(to, "shard")))
        asked = checkpoint(asked.select("uid", "group", "total", "shard", "to"))
        stay, come = [0] * shards, [0] * shards
        for r in asked.groupBy("to", (F.col("to") == F.col("shard")).alias("stays")).agg(F.count("*").alias("n")).collect():  # two rows a shard
            (stay if r["stays"] else come)[r["to"]] += r["n"]
        if turn >= rounds and not any(come):
            return linked.drop("moved")
        if turn < rounds:
            quota = [min(1.0, max(0, c - s) / n) if n else 1.0 for c, s, n in zip(room, stay, come, strict=True)]
        else:  # half the share where not all fit, since it holds on average only; the rest ask again
            quota = [1.0 if n <= max(0, f) else max(0, f) / n / 2 for f, n in zip(left, come, strict=True)]
        roomy = [q >= 1 for q in quota]
        # rows of a group are let in together: the draw is the group's, or the row's if the group is larger than a shard
        draw = F.pmod(F.when(F.col("total") > most, F.xxhash64("uid", F.lit(9 + turn))).otherwise(F.xxhash64("group", F.lit(turn), F.lit(9))), F.lit(1 << 20)) / F.lit(float(1 << 20))
        enters = (F.col("to") != F.col("shard")) & (draw < at(quota, F.col("to")))
        linked = asked.select("uid", "group", "total", F.when(enters, F.col("to")).otherwise(F.col("shard")).alias("shard"), enters.cast("int").alias("moved"))
        turn += 1


def assign(df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row (id, size, text_crc32, shard, slot) for every row of df, by the law that counts are at most one apart.

    size is the text's UTF-8 bytes (null: none) plus 16. slot counts from 0 in each shard without a gap. Rows of equal
    texts share a shard as far as quotas allow; null texts are equal to each other and not to empty ones. Repeated
    rows, null ids and ties are rows like others; an empty table gives an empty table.
    """
    text = F.col(f"`{text_col}`").cast("string")
    group = F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary")))
    base = df.select(F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), group.alias("group"))
    base = checkpoint(base.withColumn("uid", F.monotonically_increasing_id()))  # written, so that the numbers stay
    rows = base.count()
    room = capacities(rows, shards)
    totals = base.groupBy("group").agg(F.count("*").alias("total")).filter(F.col("total") > 1)
    linked = base.select("uid", "group").join(totals, "group").withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    linked = propagate(checkpoint(linked), room, rounds)

    buckets = max(1, rows // shards // BUCKET_ROWS)
    # a group's rows lie together, so that a cut parts few groups; those of a very large group are spread
    place = F.pmod(F.when(F.col("total") > BUCKET_ROWS, F.xxhash64("uid")).otherwise(F.xxhash64("group")), F.lit(buckets))
    placed = checkpoint(ranked(linked, ["shard"], place, ["group", "uid"], "slot").filter(F.col("slot") < at(room, F.col("shard"))).select("uid", "shard", "slot"))
    held = [0] * shards
    for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect():  # a row a shard
        held[r["shard"]] = r["n"]
    free = base.select("uid").join(placed, "uid", "left_anti").withColumn("one", F.lit(0))
    free = ranked(free, ["one"], F.pmod(F.xxhash64("uid"), F.lit(max(1, rows // BUCKET_ROWS))), ["uid"], "n")
    ends, total = [], 0
    for c, h in zip(room, held, strict=True):
        total += c - h
        ends.append(total)
    to = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("n")))
    begins = [e - (c - h) for e, c, h in zip(ends, room, held, strict=True)]
    filled = free.withColumn("shard", to).select("uid", "shard", (F.col("n") - at(begins, F.col("shard")) + at(held, F.col("shard"))).alias("slot"))
    out = base.join(placed.unionByName(filled), "uid")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
