"""Dealing documents to shards by balanced label propagation.

Documents with equal texts are linked. Linked documents start in hashed shards and move,
round by round, to the shard that most of their neighbours are in, as far as its quota
has room; those that find none try the shards that still have room in the next round.
Linked documents move first, and the others, which cut no edge wherever they are, fill
every shard up to its quota. So a group is cut only where a shard is full, and the shards
hold equal numbers of rows, the first ones one more if the number does not divide evenly.

Neighbours are those of the same text, so a document's neighbourhood is summed up by the
counts of its text in each shard; no pairs of documents are made. Ranks, which quotas and
slots need, are counted in two levels, by hash bucket and within it, so no group or shard
passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchrank.session import materialize

SHARDS = 8
BUCKET = 20_000  # rows ranked in one window


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its columns but the text, and size, text_crc32, shard and slot.

    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` their unsigned CRC (no
    bytes for a null text). ``shard`` runs from 0, ``slot`` numbers the rows of a shard
    from 0 without gaps. The numbers of rows of two shards differ by one at most. A null
    text is linked to nothing; an empty one is a text like others; repeated rows are rows
    of their own. Columns named like an added one are replaced.
    """
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    passed = [c for c in docs.columns if c != text_col]
    bytes_ = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = materialize(docs.select(
        *passed, (F.octet_length(bytes_) + F.lit(1)).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"), F.md5(text_col).alias("_key")
    ).withColumn("_row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]

    groups = rows.where("_key IS NOT NULL").groupBy("_key").count().where("count > 1")
    linked = materialize(rows.select("_row", "_key").join(groups.select("_key"), "_key").withColumn(
        "shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")), "linked")
    placed, left = None, linked.count()
    used = [0] * shards
    while left:
        moved = materialize(_move(linked, [r - u for r, u in zip(room, used, strict=True)], used), "moved")
        done = moved.where("slot IS NOT NULL").select("_row", "shard", "slot")
        placed = done if placed is None else placed.unionByName(done)
        for shard, n in done.groupBy("shard").count().collect():  # one row per shard
            used[shard] += n
        linked = moved.where("slot IS NULL").select("_row", "_key", "shard")
        left = linked.count()

    alone = rows.select("_row")
    if placed is not None:
        alone = alone.join(placed.select("_row"), "_row", "left_anti")
    filled = _fill(alone, total, room, used)
    every = filled if placed is None else placed.unionByName(filled)
    return rows.join(every, "_row").select(*passed, "size", "text_crc32", "shard", "slot")


def _rank(rows: DataFrame, keys: list[str], order: str, most: int, weight: Column | None = None) -> DataFrame:
    """``rows`` with ``_before``: the weights (1 each) of the rows of the same keys that come earlier.

    Rows are ordered by a hash bucket of ``order`` and by it; ``most`` is the number of rows.
    """
    weight = F.lit(1) if weight is None else weight
    rows = rows.withColumns({"_bucket": F.pmod(F.xxhash64(order), F.lit(most // BUCKET + 1)), "_weight": weight})
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_inner", F.coalesce(F.sum("_weight").over(within), F.lit(0))).join(
        sums, [*keys, "_bucket"])
    return ranked.withColumn("_before", F.col("_base") + F.col("_inner")).drop(
        "_bucket", "_weight", "_base", "_inner")


def _move(linked: DataFrame, room: list[int], used: list[int]) -> DataFrame:
    """``linked`` with the shard its neighbours are in and a slot there, or no slot where there is no room."""
    free = F.array(*[F.lit(r) for r in room])
    widest = max(range(len(room)), key=lambda s: (room[s], -s))
    counts = linked.groupBy("_key", "shard").agg(F.count("_row").alias("n"))
    # most neighbours first, then the lower shard; without a neighbour in a shard with room, the emptiest
    wanted = counts.groupBy("_key").agg(F.sum("n").alias("n"), F.max(F.when(
        F.get(free, F.col("shard")) > 0, F.struct("n", -F.col("shard")))).alias("best"))
    wanted = wanted.select("_key", "n", F.coalesce(-F.col("best.col2"), F.lit(widest)).alias("target"))
    wanted = materialize(wanted, "wanted")
    ranked = _rank(wanted, ["target"], "_key", wanted.count(), F.col("n"))
    quota = ranked.select("_key", "target", F.col("_before").alias("begin"),
                          F.least("n", F.greatest(F.lit(0), F.get(free, F.col("target")) - F.col("_before"))).alias("fits"))
    largest = wanted.agg(F.max("n")).first()[0]
    members = _rank(linked, ["_key"], "_row", largest).join(quota, "_key")
    base = F.get(F.array(*[F.lit(u) for u in used]), F.col("target"))
    fits = F.col("_before") < F.col("fits")
    return members.select("_row", "_key", F.when(fits, F.col("target")).otherwise(F.col("shard")).cast("int").alias("shard"),
                          F.when(fits, base + F.col("begin") + F.col("_before")).cast("long").alias("slot"))


def _fill(alone: DataFrame, total: int, room: list[int], used: list[int]) -> DataFrame:
    """Unlinked rows, dealt to what room is left."""
    ranked = _rank(alone.withColumn("_all", F.lit(0)), ["_all"], "_row", total)
    shard, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s, (most, taken) in enumerate(zip(room, used, strict=True)):
        here = (F.col("_before") >= start) & (F.col("_before") < start + most - taken)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("_before") - start + taken).otherwise(slot)
        start += most - taken
    return ranked.select("_row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
