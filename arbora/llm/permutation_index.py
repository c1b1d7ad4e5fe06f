"""Approximate nearest neighbours by a permutation index.

From a sample of SAMPLE vectors, the first by hash of their id, PIVOTS are chosen as pivots,
each the farthest from those before (copies of one vector so give one pivot). A vector is
represented by its pivots in order of nearness, and posted in the inverted files of its
POSTED nearest pivots. A query reads only the files of its own nearest pivots; files of more
than BLOCK vectors lie in several blocks, so a large group of copies is spread. What is read
is ranked by footrule distance over the query's FIRST pivots, and what is near enough is
ranked anew by the cosine of the stored vectors.

How many files a query reads, and how near is near enough, are measured on the sample: the
fewest files that hold TARGET of the nearest sample vectors of sampled queries, and the least
share of footrule ranks that does so. A query's cut is that quantile of its distances to
the sample, so it is the same in all blocks; whatever is about as near as the best ones
where these are very near (a large group of near copies has many such) stays in, too. Vectors with a
structure are read from few files; directions without any need many.

Every row is indexed, and each dimension by itself. A query that finds fewer rows than there
are, or than it asks for, reads all files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from arbora.llm.common import hash_sample, shuffle_partitions, written
from arbora.llm.vectors import element_type, matrix_of, takes_part, unit_rows

SAMPLE, PIVOTS, POSTED, FIRST, BLOCK = 4096, 256, 2, 32, 8192
#: Share of the nearest sample vectors that files and cut must hold; sampled queries; vectors that a cut lets in at least, of a whole table.
TARGET, ASKED, LEAST = 0.98, 256, 512
#: Vectors within NEAR of the mean footrule distance of sample vectors and within STRETCH times the k-th least count as about as near.
NEAR, STRETCH = 0.4, 2.0
#: Queries that are ranked together.
BATCH = 64


def positions(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each unit row the position of each pivot in its order of nearness (ties: the earlier pivot first)."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable").astype(np.int16)
    out = np.empty_like(order)
    np.put_along_axis(out, order.astype(np.int64), np.arange(len(pivots), dtype=np.int16)[None, :], axis=1)
    return out


def spread_out(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` unit rows of ``x``, each the farthest from those chosen before; fewer if the rest are copies."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    return x[chosen]


@dataclass
class Index:
    """Pivots, positions of the sample, and what was measured on it."""

    pivots: np.ndarray
    sample: np.ndarray
    mean: float          # footrule distance of two sample vectors
    files: int           # that a query reads
    share: float         # of footrule ranks that are ranked anew

    def nearest(self, at: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest pivots of rows with positions ``at``, nearest first."""
        return np.argsort(at, axis=1, kind="stable")[:, :count]

    def footrules(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Footrule distances of rows with positions ``at`` from a query, over the query's first pivots."""
        first = np.argsort(query, kind="stable")[:FIRST]
        return np.abs(at[:, first] - np.arange(len(first), dtype=np.int16)).sum(axis=1, dtype=np.int32)

    def cut(self, query: np.ndarray, k: int) -> float:
        """The footrule distance up to which rows are ranked anew."""
        d = np.sort(self.footrules(self.sample, query))
        share = d[min(len(d) - 1, int(np.ceil(self.share * len(d))))]
        return float(max(share, min(STRETCH * d[min(k, len(d) - 1)], NEAR * self.mean))) if self.share < 1 else np.inf


def measured(sample: np.ndarray, k: int, rows: int) -> Index:
    """An index whose files and cut hold TARGET of the ``k`` nearest sample vectors of sampled queries.

    ``rows``: size of the table; so that a cut lets LEAST of them in, and small tables are read whole.
    """
    x = unit_rows(sample)
    pivots = spread_out(x, PIVOTS)
    at = positions(x, pivots)
    index = Index(pivots, at, 1.0, len(pivots), 1.0)
    asked = np.arange(min(ASKED, len(x)))
    index.mean = float(np.mean([index.footrules(at, at[q]).mean() for q in asked]))
    if rows <= LEAST or len(x) < 2:
        return index
    cosine = x[asked] @ x.T
    cosine[asked, asked] = -2
    wanted = np.argsort(-cosine, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
    # a vector is read once the first of its files is: its least position among the query's pivots
    posted = index.nearest(at, POSTED)
    first_file = np.sort(np.concatenate([at[q][posted[wanted[q]]].min(axis=1) for q in asked]))
    goal = min(len(first_file) - 1, int(np.ceil(TARGET * len(first_file))))
    index.files = int(first_file[goal]) + 1
    ranks = []
    for q in asked:
        d = index.footrules(at, at[q])
        ranks.append((np.searchsorted(np.sort(d), d[wanted[q]], side="right")) / len(d))
    index.share = min(1.0, max(float(np.sort(np.concatenate(ranks))[goal]), LEAST / rows))
    return index


def _posted(rows: DataFrame, index, kind: str) -> DataFrame:
    """Each of (row, id, vec) once for each of its POSTED nearest pivots."""

    def post(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                near = index.value.nearest(positions(unit_rows(matrix_of(batch.column("vec"))), index.value.pivots), POSTED)
                take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                more = batch.take(take)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *more.columns], names=["pivot", "row", "id", "vec"])

    return written(rows.select("row", "id", "vec").mapInArrow(post, f"pivot int, row long, id long, vec {kind}"), "permutation-lists")


def _asked(queries: DataFrame, index, k: int, kind: str, every: bool) -> DataFrame:
    """Each of (id, vec) once for each file that it reads, with its cut."""

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                at = positions(unit_rows(matrix_of(batch.column("vec"))), index.value.pivots)
                near = index.value.nearest(at, at.shape[1] if every else index.value.files)
                cuts = [np.inf if every else index.value.cut(x, k) for x in at]
                more = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *more.columns, pa.array(np.repeat(cuts, near.shape[1]))],
                                                 names=["pivot", "id", "vec", "cut"])

    return queries.select("id", "vec").mapInArrow(ask, f"pivot int, id long, vec {kind}, cut double")


def _answers(lists: DataFrame, queries: DataFrame, index, k: int, kind: str, every: bool) -> DataFrame:
    """(query_id, row, vec_id, score): the ``k`` best rows for each query in each block that it reads."""
    sizes = {r["pivot"]: r["n"] for r in lists.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    parts = F.array(*[F.lit(max(1, -(-sizes.get(p, 0) // BLOCK))) for p in range(max(sizes, default=0) + 1)])
    parts = F.coalesce(F.get(parts, F.col("pivot")), F.lit(0))
    stored = lists.select("pivot", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "row", "id", "vec",
                          F.lit(None).cast("double").alias("cut"))
    asked = _asked(queries, index, k, kind, every).withColumn("parts", parts).where("parts > 0").select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("row"), "id", "vec", "cut")

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = last = None
        for batch in it:
            keys = np.stack([batch.column(c).to_numpy() for c in ("pivot", "part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if tuple(keys[a, :2]) != last:
                    held, block, last = [], None, tuple(keys[a, :2])
                part = batch.slice(a, b - a)
                if keys[a, 2] == 0:
                    held.append(part)
                    continue
                if block is None:
                    if not held:
                        continue  # a file without vectors
                    block = Block(pa.Table.from_batches(held).combine_chunks().to_batches()[0], index.value)
                    held = []
                for start in range(0, part.num_rows, BATCH):
                    yield block.search(part.slice(start, BATCH), k)

    both = stored.unionByName(asked)
    tasks = max(shuffle_partitions(lists.sparkSession), -(-sum(sizes.values()) // BLOCK))
    both = both.repartition(tasks, "pivot", "part").sortWithinPartitions("pivot", "part", "kind")
    return both.mapInArrow(answer, "query_id long, row long, vec_id long, score double")


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows and a vector, each the same whatever rows are beside it."""
    length = lambda v: np.sqrt((v * v).sum(axis=-1))
    return (x * y).sum(axis=1) / (length(x) * length(y))


class Block:
    """The vectors of one block of a file in memory."""

    def __init__(self, batch: pa.RecordBatch, index: Index):
        self.index, self.rows, self.ids = index, batch.column("row").to_numpy(), batch.column("id").to_numpy()
        self.x = matrix_of(batch.column("vec"))
        self.at = positions(unit_rows(self.x), index.pivots)

    def search(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        vecs = matrix_of(queries.column("vec"))
        at, found = positions(unit_rows(vecs), self.index.pivots), []
        for query, cut, vec, mine in zip(queries.column("id").to_pylist(), queries.column("cut").to_pylist(), vecs, at):
            near = np.flatnonzero((self.index.footrules(self.at, mine) <= cut) & (self.ids != query))
            score = _cosines(self.x[near], vec)
            best = np.lexsort((self.ids[near], -score))[:k]
            found.append((np.full(len(best), query), self.rows[near[best]], self.ids[near[best]], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "row", "vec_id", "score"])


def search(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``df`` found for each row of ``queries``, by cosine.

    A query's own id is left out; equal scores go to the smaller id; fewer rows if fewer
    take part. Vectors that are null, zero or hold null or non-finite components, and null
    ids, take no part on either side. Rows that repeat an id are candidates each; a repeated
    query is answered once. Vectors of one dimension are compared with each other only. Empty
    tables give an empty result.
    """
    kind = element_type(df, vector)

    def valid(x: DataFrame) -> DataFrame:
        x = x.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec"))
        return x.where(F.col("id").isNotNull() & takes_part(F.col("vec")))

    rows = written(valid(df).select(F.monotonically_increasing_id().alias("row"), "id", "vec"), "permutation-vectors")
    asked = written(valid(queries).dropDuplicates(["id"]), "permutation-queries")
    dims = sorted(r[0] for r in rows.join(asked.select(F.size("vec").alias("dim")).distinct(), F.size("vec") == F.col("dim"), "left_semi")
                  .select(F.size("vec").alias("dim")).distinct().collect())
    out = None
    for dim in dims:
        part = _nearest(rows.where(F.size("vec") == dim), asked.where(F.size("vec") == dim), k, kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the rows found in all blocks; a row that was read from two files counts once."""
    once = found.groupBy("query_id", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(rows: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """`search` among vectors of one dimension."""
    n = rows.count()
    sample = hash_sample(rows, F.col("id"), SAMPLE).select("vec").collect()  # SAMPLE rows
    index = rows.sparkSession.sparkContext.broadcast(measured(np.array([r["vec"] for r in sample], dtype=np.float64), k, n))
    lists = _posted(rows, index, kind)
    found = written(_ranked(_answers(lists, asked, index, k, kind, False), k), "permutation-found")
    # queries that found fewer than k rows read all files
    few = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    few = written(few, "permutation-few")
    if few.isEmpty():
        return found
    again = _ranked(_answers(lists, few, index, k, kind, True), k)
    return found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
