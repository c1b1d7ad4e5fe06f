"""Mixing sources to target weights by Pfair scheduling (native).

A source's rows, in hash order, form blocks, one a slot of the mix. Block i of a source
with b of the mix's T blocks may start at slot floor(i * T / b) and must be done before
slot ceil((i + 1) * T / b). In every slot the released block with the earliest deadline
goes (ties: the source that sorts first). The weights b / T add up to one, so no slot stays
empty and no deadline is missed: before and after every slot each source is less than one
block from its target, counted in blocks (a source's last block may hold fewer rows). Blocks
have the same size and all sources are scheduled together, however many there are.

Earliest deadline first means that each block, taken by deadline, gets the first slot from
its release that is still free. Which slots the earlier half of the blocks takes follows from
their releases alone: a slot stays free if their queue is empty. So blocks and slots are split
in two, and each half again, until every block has its slot. A level is one running sum and
its minimum, in chunks while a part is larger than a task should hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from arbora.llm.common import ROW, bits_for, field, packed, unpacked, written

ROWS_PER_BUCKET = 4096
#: Blocks (as a power of two) whose slots one task finds; blocks of a source that are listed from one row; rows of a chunk.
PART_BITS, LISTED, CHUNK = 15, 1 << 14, 1 << 18


def natural_targets(counts: DataFrame, max_share: float) -> DataFrame:
    """(source, n, target): rows to take when sources keep their size but none exceeds ``max_share``.

    A source at the limit gets max_share of the mix, the others are taken whole. The
    limit can bind for fewer than 1 / max_share sources, so only so many of the
    largest counts are looked at. If it can't hold (too few sources), none is set.
    """
    top = [r["n"] for r in counts.orderBy(F.desc("n")).limit(math.ceil(1 / max_share) + 1).collect()]
    n = counts.agg(F.sum("n")).first()[0] or 0
    rest, total = n, n
    for k, x in enumerate(top):
        if x <= max_share * total:
            break
        rest -= x
        if rest <= 0 or (k + 1) * max_share >= 1:
            total = n / max_share  # no limit binds
            break
        total = rest / (1 - (k + 1) * max_share)
    return counts.withColumn("target", F.least("n", F.floor(F.lit(max_share * total))))


def weighted_targets(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, n, target) for given (source, weight): the largest mix in which no source runs out.

    Sources without a positive weight get 0 rows; weights of absent sources are left out,
    those of a source that is named twice are added.
    """
    weights = weights.where("weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"))
    w = counts.join(weights, counts["source"].eqNullSafe(weights["source"]), "left").select(
        counts["source"], "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = w.where("weight > 0").agg(F.min(F.col("n") / F.col("weight"))).first()[0] or 0.0
    return w.select("source", "n", F.least("n", F.floor(F.col("weight") * total)).alias("target"))


def deadlines(targets: DataFrame, block_rows: int, total: int) -> DataFrame:
    """(source, index, release, p) of every block; ``p`` numbers the mix's ``total`` blocks from 0 by deadline, then source."""
    t = targets.where("target > 0").select("source", F.ceil(F.col("target") / block_rows).cast("long").alias("blocks"))
    lists = t.select("source", "blocks", F.explode(F.expr(f"sequence(0L, blocks - 1, {LISTED}L)")).alias("first")).repartition("source", "first")
    blocks = lists.select("source", "blocks", F.explode(F.expr(f"sequence(first, least(first + {LISTED}, blocks) - 1)")).alias("index"))
    blocks = blocks.select("source", "index", F.expr(f"(index * {total}L) div blocks").alias("release"),
                           F.expr(f"((index + 1) * {total}L + blocks - 1) div blocks").alias("deadline"))
    blocks = written(blocks.repartitionByRange(total // CHUNK + 1, "deadline", "source").withColumn("chunk", F.spark_partition_id()), "mix-deadlines")
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    starts = blocks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    p = F.row_number().over(Window.partitionBy("chunk").orderBy("deadline", "source")) - 1
    return blocks.withColumn("p", p).join(starts, "chunk").select("source", "index", "release", (F.col("p") + F.col("start")).alias("p"))


def _queue(bit: Column, *group: str) -> tuple[Window, Column]:
    """Order of a part's blocks and slots, and what the earlier half's blocks have come to, less the slots gone by."""
    order = Window.partitionBy(*group, "part").orderBy("at", "p")
    step = F.when(F.col("p").isNull(), -1).when(bit == 0, 1).otherwise(0)
    return order, F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))


def _halved(rows: DataFrame, bit: Column, group: str, start: Column, least: Column) -> DataFrame:
    """Each part in two: blocks by ``bit``, slots by whether the earlier half's blocks take them (0) or leave them free (1).

    A slot stays free if the sum falls below all before it: no block was waiting. ``start`` and
    ``least`` are the sum and its minimum before the group.
    """
    order, come = _queue(bit, group)
    rows = rows.withColumn("come", start + come)
    free = F.col("come") < F.least(least, F.min("come").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("part", F.col("part") * 2 + F.when(F.col("p").isNull(), free.cast("long")).otherwise(bit)).drop("come")


def _halved_in_chunks(rows: DataFrame, bit: Column, chunks: int) -> DataFrame:
    """`_halved` for parts of any size: each chunk of the order starts from what the chunks before it come to."""
    rows = written(rows.repartitionByRange(chunks, "part", "at", "p").withColumn("chunk", F.spark_partition_id()), "mix-halves")
    _, come = _queue(bit, "chunk")
    step = F.when(F.col("p").isNull(), -1).when(bit == 0, 1).otherwise(0)
    sums = rows.withColumn("come", come).groupBy("chunk", "part").agg(F.sum(step).alias("sum"), F.min("come").alias("low"))
    before = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    sums = sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    sums = sums.select("chunk", "part", "start", F.least(F.lit(0), F.min(F.col("start") + F.col("low")).over(before)).alias("least"))
    return _halved(rows.join(sums, ["chunk", "part"]), bit, "chunk", F.col("start"), F.col("least")).select("part", "at", "p")


def schedule(targets: DataFrame, block_rows: int, part_bits: int = PART_BITS) -> DataFrame:
    """(source, index, slot) of every block of the mix of ``targets`` (source, target): earliest deadline first."""
    total = targets.where("target > 0").agg(F.sum(F.ceil(F.col("target") / block_rows).cast("long"))).first()[0] or 0
    blocks = written(deadlines(targets, block_rows, total), "mix-order")
    slots = targets.sparkSession.range(total).select(F.lit(0).cast("long").alias("part"), (F.col("id") * 2 + 1).alias("at"), F.lit(None).cast("long").alias("p"))
    rows = blocks.select(F.lit(0).cast("long").alias("part"), (F.col("release") * 2).alias("at"), "p").unionByName(slots)
    bits = [F.shiftright("p", k).bitwiseAND(1) for k in reversed(range(bits_for(total)))]
    many = max(0, len(bits) - part_bits)
    for bit in bits[:many]:
        rows = _halved_in_chunks(rows, bit, 2 * total // CHUNK + 2)
    rows = rows.withColumn("whole", F.col("part")).repartition("whole")  # the other levels need no shuffle
    for bit in bits[many:]:
        rows = _halved(rows, bit, "whole", F.lit(0), F.lit(0))
    taken = rows.where("p IS NULL").select(F.col("part").alias("p"), F.shiftright("at", 1).alias("slot"))
    return blocks.join(taken, "p").select("source", "index", "slot")


def bucket_slots(rows: DataFrame, targets: DataFrame, blocks: DataFrame, block_rows: int) -> DataFrame:
    """(of, bucket, start, target, slots): rows of the source before the bucket, and the slots of the blocks that its selected rows are in.

    ``of`` is the source in a struct, so that null equals null in a join on it.
    """
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    starts = starts.alias("r").join(targets.alias("p"), F.expr("r.source <=> p.source")).select(
        "r.source", "bucket", "start", "target", F.least(F.col("start") + F.col("r.n"), "target").alias("end"))
    index = F.when(F.col("start") < F.col("end"), F.sequence(F.floor(F.col("start") / block_rows), F.floor((F.col("end") - 1) / block_rows)))
    pieces = starts.select(F.struct("source").alias("of"), "bucket", "start", "target", F.explode_outer(index).alias("index"))
    blocks = blocks.select(F.struct("source").alias("of"), "index", "slot")
    slots = F.sort_array(F.collect_list(F.struct("index", "slot")))["slot"]
    return pieces.join(blocks, ["of", "index"], "left").groupBy("of", "bucket", "start", "target").agg(slots.alias("slots"))


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: DataFrame | None = None,
        max_share: float | None = None, block_rows: int = 16) -> DataFrame:
    """``df`` with mix_selected, mix_slot, mix_offset and mix_target.

    Sorting the selected rows by (mix_slot, mix_offset) gives the mixture. A source's
    first ``mix_target`` rows in hash order of ``key`` are selected; the others keep a
    null slot and offset, so no row is lost. Without ``weights`` (source, weight) sources
    weigh what they hold and all rows are selected; a stated ``max_share`` caps them. Blocks
    hold ``block_rows`` rows (a source's last block may hold fewer). Null is a source of
    its own; of weights that name a source twice the sum counts; rows with equal keys are
    ordered by their other columns; an empty table gives an empty result; clashing input
    names are replaced.
    """
    rows = packed(df).select(ROW, field(source).alias("source"), field(key).alias("key"))
    rows = rows.withColumn("hash", F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))))
    counts = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-sources")
    if weights is not None:
        targets = weighted_targets(counts, weights)
    else:
        targets = counts.withColumn("target", F.col("n")) if max_share is None else natural_targets(counts, max_share)
    targets = written(targets, "mix-targets")
    n = counts.agg(F.sum("n")).first()[0] or 0
    # numbered by hash within buckets of a source, then shifted by the buckets before: no task holds a whole source
    bits = min(32, bits_for(n / ROWS_PER_BUCKET))
    bucket = F.shiftright(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), 32 - bits)
    rows = rows.withColumn("bucket", bucket)
    blocks = written(schedule(targets, block_rows), "mix-blocks")
    slots = bucket_slots(rows, targets, blocks, block_rows).alias("s")
    within = Window.partitionBy("of", "bucket").orderBy("hash", "key", F.xxhash64(ROW))
    ranked = rows.withColumn("of", F.struct("source")).withColumn("at", F.row_number().over(within) - 1).alias("r")
    # the rows meet their slots where they are numbered: merged by the same keys, they aren't shuffled again at any size
    ranked = ranked.join(slots.hint("merge"), F.expr("r.of = s.of and r.bucket = s.bucket")).select(
        ROW, "start", "target", "slots", (F.col("at") + F.col("start")).alias("rank"))
    selected = F.col("rank") < F.col("target")
    slot = F.get("slots", (F.floor(F.col("rank") / block_rows) - F.floor(F.col("start") / block_rows)).cast("int"))
    out = ranked.select(ROW, selected.alias("mix_selected"),
                        F.when(selected, slot).cast("long").alias("mix_slot"),
                        F.when(selected, F.col("rank") % block_rows).cast("int").alias("mix_offset"),
                        F.col("target").cast("long").alias("mix_target"))
    return unpacked(out, df.columns, ["mix_selected", "mix_slot", "mix_offset", "mix_target"])
