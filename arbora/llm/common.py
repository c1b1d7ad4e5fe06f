"""Shared helpers: tables written between stages, packed rows, plan sizes."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from arbora.session import scratch_path

ROW = "__row"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage: a lost executor costs at most the stage that was running,
    and every reader sees the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a written table that is sent to every task.
SMALL_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most SMALL_ROWS of them; a larger one is joined by a shuffle."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table


def placed(df: DataFrame, part: str, row: str) -> DataFrame:
    """``df`` with the places of its rows: sorted by (``part``, ``row``) they are as they were written.

    A reread Parquet table hands out its files in any order; the place is the number in a
    row's file name and the row's number in the file. Rows that come from no file are
    numbered as they are handed out.
    """
    try:
        read = df.select("*", F.col("_metadata.file_name").alias(part), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return df.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id())
    return read.withColumn(part, F.regexp_extract(part, "part-([0-9]+)", 1).cast("int"))


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one struct column, so no input name can clash with an operator's own."""
    return df.select(F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias(ROW))


def unpacked(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """Rows of `packed` with ``added`` columns; an input column of the same name is replaced."""
    low = {a.lower() for a in added}
    return df.select(*[F.col(f"{ROW}.{_quoted(c)}").alias(c) for c in columns if c.lower() not in low], *added)


def field(name: str):
    """A column of a packed row."""
    return F.col(f"{ROW}.{_quoted(name)}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def hash_sample(df: DataFrame, key, n: int) -> DataFrame:
    """The ``n`` rows with the least hashes of ``key`` (fewer only if ``df`` has fewer, but for bad luck of 1e-9).

    Rows above a hash that about 4 n rows are below go first, so that no task holds or
    sends n rows of its own.
    """
    share = 1 << 40
    below = min(1.0, (4 * n + 40) / max(1, df.count()))
    place = F.pmod(F.xxhash64(key), F.lit(share))
    return df.where(place < int(below * share)).orderBy(place, key).limit(n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bits_for(n: float) -> int:
    """Bits that number ``n`` cells."""
    return max(0, math.ceil(math.log2(max(1.0, n))))
