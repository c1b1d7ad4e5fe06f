"""Size guards for broadcast joins.

A side is only broadcast after its rows and bytes have been checked against bounds;
beyond the bound the join is left to the planner (sort-merge / shuffle hash),
so nothing that grows with the data is ever shipped whole to every executor.
The checked side is persisted first so the count and the join share one
computation.

Tables derived row-for-row from a checked table (a taxonomy's paths, ordinals
or name lookup have one row per node) may name that table as ``bound``: its
remembered count stands in for a second counting job.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

# Label spaces, host lists, configs and option grids stay far below this.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 << 20
_ROWS_ATTR = "_arbora_checked_rows"
_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist ``df`` until :func:`release`."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> None:
    """Drop what :func:`keep` holds; a result that still needs it is computed anew."""
    while _KEPT:
        _KEPT.pop().unpersist()


def checked_rows(df: DataFrame) -> int:
    """Row count of ``df``, computed once per DataFrame object (kept); a table of more than
    ``BROADCAST_MAX_BYTES`` (as JSON text) counts as larger than any bound on rows."""
    n = getattr(df, _ROWS_ATTR, None)
    if n is None:
        row = keep(df).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
        n = row[0] if (row[1] or 0) <= BROADCAST_MAX_BYTES else max(row[0], BROADCAST_MAX_ROWS + 1)
        setattr(df, _ROWS_ATTR, n)
    return n


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      bound: DataFrame | None = None) -> DataFrame:
    """Return ``df`` with a broadcast hint if it has at most ``max_rows`` rows.

    With ``bound``, ``df`` is known to have no more rows than ``bound`` (it is
    derived from it row for row) and ``bound``'s count is used instead.
    """
    if bound is not None:
        n = checked_rows(bound)
        df = keep(df)
    else:
        n = checked_rows(df)
    if n <= max_rows:
        out = F.broadcast(df)
        setattr(out, _ROWS_ATTR, n)
        return out
    return df
