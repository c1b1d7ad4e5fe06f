"""Sharding by extendible hashing (native).

Every row has 60 hash bits: 40 of its key, then 20 of its place in the scan, which
only tell apart rows with the same key. The directory is indexed by hash prefix; a
bucket over the byte limit splits on one more bit, the others stay. So a row's
shard is the shortest prefix of its bits whose bucket fits. All depths of the
directory come from one histogram of fine prefixes, not from one job a split. Rows are
then written by shard, one file each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from arbora.llm.common import ROW, bits_for, field, packed, shuffle_partitions, unpacked, written
from arbora.session import scratch_path

KEY_BITS, BITS = 40, 60


def hash_bits(key: Column) -> Column:
    """The first 40 bits of md5 of the key as text (null: the empty text), as a long of 60 bits."""
    h = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 10), 16, 10).cast("long")
    return F.shiftleft(h, BITS - KEY_BITS)


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def _leaves(cells: DataFrame, at: int, least: int, limit: int) -> DataFrame:
    """For each cell (a prefix of ``at`` bits) the smallest depth >= ``least`` whose bucket fits, else null."""
    up = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(least), F.lit(at))).alias("depth"))
    up = up.withColumn("prefix", F.expr(f"shiftright(cell, cast({at} - depth as int))"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"), F.sum("n").alias("rows"))
    fits = sums.where((F.col("total") <= limit) | (F.col("rows") == 1))
    return (up.join(fits, ["depth", "prefix"], "left")
            .groupBy("cell").agg(F.min(F.when(F.col("total").isNotNull(), F.struct("depth", "total", "rows"))).alias("leaf")))


def shard(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``df`` with shard, shard_depth, n_bytes, shard_rows, shard_bytes and oversized.

    ``shard`` is the bucket's bits ('' for the root). ``size`` is a row's bytes (null: 0)
    as an expression over ``df``. Every shard fits ``limit`` but where one row alone
    exceeds it (oversized), or rows with equal 60 bits do. Rows with a null key share
    the key of the empty text and are told apart by their place in the scan. Repeated
    rows are kept; an empty table gives an empty result; clashing names are replaced.
    ``df`` is read several times and must come in the same order each time, as a table does;
    write the result of a shuffle first.
    """
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << (BITS - KEY_BITS)))
    rows = packed(df.withColumn("__bytes", F.coalesce(size, F.lit(0)).cast("long")))
    rows = rows.select(ROW, field("__bytes").alias("n_bytes"), (hash_bits(field(key)) + place).alias("bits"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    least, at, found, open_cells = 0, min(BITS, bits_for(total / limit) + 5), [], None
    while True:
        cells = rows.select(_prefix(F.col("bits"), at).alias("cell"), "n_bytes", *([_prefix(F.col("bits"), least - 1).alias("over")] if found else []))
        if open_cells is not None:  # only what still exceeds the limit goes deeper
            cells = cells.join(open_cells, "over", "left_semi")
        cells = cells.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        leaves = written(_leaves(cells, at, least, limit), "shard-directory")
        found.append((at, leaves))
        deeper = leaves.where("leaf is null")
        if at == BITS or deeper.isEmpty():
            break
        open_cells = deeper.select(F.col("cell").alias("over"))
        least, at = at + 1, min(BITS, at + 8)
    out = rows.withColumn("leaf", F.lit(None).cast(found[0][1].schema["leaf"].dataType))
    for at, leaves in found:
        out = (out.withColumn("cell", _prefix(F.col("bits"), at))
               .join(leaves.select("cell", F.col("leaf").alias("deeper")), "cell", "left")
               .withColumn("leaf", F.coalesce("leaf", "deeper")).drop("cell", "deeper"))
    # rows with equal 60 bits: one bucket of full depth whatever its size
    full = None
    if found[-1][0] == BITS:
        full = found[-1][1].where("leaf is null").select("cell").withColumn("full", F.lit(True))
    depth = F.coalesce(F.col("leaf.depth"), F.lit(BITS))
    out = out.select(ROW, "n_bytes", "bits", depth.cast("int").alias("shard_depth"),
                     F.col("leaf.rows").alias("shard_rows"), F.col("leaf.total").alias("shard_bytes"))
    if full is not None:
        sums = (rows.join(full, rows["bits"] == full["cell"], "left_semi").groupBy("bits")
                .agg(F.count(F.lit(1)).alias("rows60"), F.sum("n_bytes").alias("bytes60")))
        out = out.join(sums, "bits", "left").withColumns({
            "shard_rows": F.coalesce("shard_rows", "rows60"), "shard_bytes": F.coalesce("shard_bytes", "bytes60")})
    text = F.lpad(F.conv(F.col("bits").cast("string"), 10, 2), BITS, "0")
    out = out.withColumns({"shard": F.substring(text, F.lit(1), F.col("shard_depth")),
                           "oversized": F.col("shard_bytes") > limit})
    return unpacked(out, [c for c in df.columns], ["shard", "shard_depth", "n_bytes", "shard_rows", "shard_bytes", "oversized"])


#: The partition column of a sharded table: the shard's bits behind this letter (a folder can't be named by no bits).
FOLDER, LETTER = "__shard", "s"
#: Bytes of rows that one task writes.
TASK_BYTES = 1 << 26


def write_shards(df: DataFrame, key: str, size: Column, limit: int, folder: str) -> None:
    """Writes ``df`` as a Parquet table with one folder, holding one file, for each shard of at most ``limit`` bytes."""
    placed = shard(df, key, size, limit)
    total = placed.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(shuffle_partitions(df.sparkSession), -(-total // TASK_BYTES))
    own = [c for c in df.columns if c.lower() != FOLDER]
    laid = placed.select(*[_own(df, c, placed) for c in own], F.concat(F.lit(LETTER), "shard").alias(FOLDER))
    laid.repartition(tasks, FOLDER).write.partitionBy(FOLDER).parquet(folder)


def _own(df: DataFrame, name: str, placed: DataFrame) -> Column:
    if name.lower() in ("shard", "shard_depth", "n_bytes", "shard_rows", "shard_bytes", "oversized"):
        raise ValueError(f"the rows hold a column {name}: rename it before they are sharded")
    return placed["`" + name.replace("`", "``") + "`"].alias(name)


def read_shards(df: DataFrame, size: Column, limit: int, folder: str) -> DataFrame:
    """The rows of a table of `write_shards`, with the columns of `shard` measured on what is stored.

    ``df`` gives the columns, ``size`` a row's bytes."""
    stored = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField(FOLDER, StringType())])).parquet(folder)
    rows = stored.withColumn("n_bytes", F.coalesce(size, F.lit(0)).cast("long")).withColumn("shard", F.substring(FOLDER, 2, BITS)).drop(FOLDER)
    sums = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("shard_rows"), F.sum("n_bytes").alias("shard_bytes"))
    return rows.join(sums, "shard").select(
        *[rows["`" + c.replace("`", "``") + "`"] for c in df.columns], "shard", F.length("shard").cast("int").alias("shard_depth"), "n_bytes",
        "shard_rows", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def sharded(df: DataFrame, key: str, size: Column, limit: int, folder: str | None = None) -> DataFrame:
    """Writes the shards of ``df`` and reads them back. ``folder``: unset, a fresh one of the checkpoint folder."""
    folder = folder or scratch_path(df.sparkSession, "shards")
    write_shards(df, key, size, limit, folder)
    return read_shards(df, size, limit, folder)
