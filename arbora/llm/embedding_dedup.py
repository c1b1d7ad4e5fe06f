"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe.

A hash rotates a vector (three times: random signs, then the Hadamard transform) and
takes the nearest of the 2d signed axes. A table joins k hashes to a bucket; a vector
also looks into the PROBES next likely buckets (NEXT - 1 if k = 1, as a hash has only NEXT
likely axes). k follows the number of vectors, and as
many tables are made as bring the chance to miss a pair at the threshold below MISS,
by a simulation with vectors of the same dimension.

Exact copies are one entry. Entries that share a bucket with many others and lie within
RADIUS degrees of its centroid become one ball: twice the radius is below the threshold's
angle, so all pairs in a ball are linked without a look at them. Two balls are decided by
the angle of their centres and their radii where that suffices; else their members are
compared. So a large group of near copies costs its balls' pairs. Entries outside of balls are
compared in blocks of a bucket; a block returns how many links each entry has and one row
an entry that connects it, so a crowd that forms no ball writes rows by its members and blocks,
not by its pairs. A pair that meets in several buckets is counted in the first. Only links with balls
are listed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arbora.llm.common import written
from arbora.llm.components import components
from arbora.llm.vectors import by_group, column_array, element_type, list_column, matrix_of, rows_of, takes_part, unit_rows

PROBES, NEXT, MISS = 5, 4, 1e-4
#: Entries of a cell from which on balls are formed; entries of a side of a block.
DENSE, BLOCK = 8, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotation_signs(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(3, dim))


def vertices(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The NEXT nearest signed axes of each rotated row, and how much farther each is than the first."""
    for signs in rotation_signs(x.shape[1], seed):
        x = hadamard(x * signs)
    size = np.abs(x)
    n = min(NEXT, x.shape[1])
    near = np.argpartition(-size, n - 1, axis=1)[:, :n] if n < x.shape[1] else np.tile(np.arange(n), (len(x), 1))
    order = np.argsort(-np.take_along_axis(size, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    value = np.take_along_axis(x, near, 1)
    return near * 2 + (value < 0), (np.abs(value[:, :1]) - np.abs(value)) ** 2


def table_buckets(x: np.ndarray, k: int, table: int, probes: int) -> np.ndarray:
    """Bucket keys of one table: the own bucket first, then the next likely ones."""
    found = [vertices(x, table * 64 + j) for j in range(k)]
    combos = np.array(list(itertools.product(range(found[0][0].shape[1]), repeat=k)))
    cost = sum(found[j][1][:, combos[:, j]] for j in range(k))
    best = np.argsort(cost, axis=1, kind="stable")[:, :1 + probes]
    key = np.full(best.shape, (table << 32) + x.shape[1], dtype=np.uint64)
    for j in range(k):
        code = np.take_along_axis(found[j][0], combos[best, j], 1).astype(np.uint64)
        key = (key * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(1))
        key ^= key >> np.uint64(29)
    return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def padded(x: np.ndarray) -> np.ndarray:
    """Unit rows filled with zeros up to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(unit_rows(x), ((0, 0), (0, n - x.shape[1])))


def collision_rate(dim: int, k: int, cosine: float, pairs: int = 2000) -> float:
    """How often one table brings together two random unit vectors at this cosine, by simulation."""
    rng = np.random.default_rng(7)
    a = unit_rows(rng.normal(size=(pairs, dim)))
    z = rng.normal(size=(pairs, dim))
    z = unit_rows(z - np.sum(z * a, axis=1, keepdims=True) * a)
    b = cosine * a + math.sqrt(1 - cosine * cosine) * z
    x, y = (table_buckets(padded(v), k, 0, PROBES) for v in (a, b))
    return float(np.mean((x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)))


def plan(n: int, dim: int, cosine: float) -> tuple[int, int]:
    """Hashes of a table and number of tables for ``n`` vectors."""
    width = 2 << max(1, (dim - 1).bit_length())
    k = min(4, max(1, round(math.log(max(2, n)) / math.log(width))))
    rate = min(0.9999, max(0.01, collision_rate(max(2, dim), k, cosine) - 0.02))
    return k, math.ceil(math.log(MISS) / math.log(1 - rate))


def _hashed(entries: DataFrame, kind: str, k: int, tables: int) -> DataFrame:
    """Entries (id, vec, size) with their cell and buckets: ``per`` of each table, the own first."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = rows_of(batch.column("vec"))
            buckets, per = [None] * len(rows), [0] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                x = padded(np.stack([rows[i] for i in at]).astype(np.float64))
                found = np.concatenate([table_buckets(x, k, t, PROBES) for t in range(tables)], axis=1)
                for i, b in zip(at, found ^ (dim * 0x9E3779B97F4A7C15 & (1 << 63) - 1)):  # other dimensions, other buckets
                    buckets[i], per[i] = b, found.shape[1] // tables
            own = [int(b[0]) for b in buckets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), batch.column("size"), pa.array(own, pa.int64()), pa.array(buckets, pa.list_(pa.int64())),
                 pa.array(per, pa.int32())],
                names=["id", "vec", "size", "cell", "buckets", "per"])

    return entries.mapInArrow(batches, f"id long, vec {kind}, size long, cell long, buckets array<long>, per int")


def _centroids(members: DataFrame, kind: str) -> DataFrame:
    """(cell, centre): unit centroid of each cell; sums are made by batch and then merged, one row a batch and cell."""

    def merged(cells: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(cells, kind="stable")
        cells, starts = np.unique(cells[order], return_index=True)
        return cells, np.add.reduceat(sums[order], starts, axis=0)

    def partial(it):
        for batch in it:
            rows = rows_of(batch.column("vec"))
            for dim in {len(r) for r in rows}:
                at = np.array([i for i, r in enumerate(rows) if len(r) == dim])
                x = unit_rows(np.stack([rows[i] for i in at]).astype(np.float64))
                cells, sums = merged(batch.column("cell").to_numpy()[at], x)
                yield pa.RecordBatch.from_arrays([pa.array(cells), list_column(sums, pa.float64())], names=["cell", "sums"])

    def total(it):
        def one(t: pa.Table):
            s = matrix_of(column_array(t, "sums")).sum(axis=0, keepdims=True)
            if not np.linalg.norm(s) > 1e-9:
                return None
            return pa.RecordBatch.from_arrays([t.column("cell").slice(0, 1).combine_chunks(), list_column(unit_rows(s), element)], names=["cell", "centre"])
        return by_group(it, 1, one)

    element = pa.float32() if kind == "array<float>" else pa.float64()
    sums = members.mapInArrow(partial, "cell long, sums array<double>")
    return sums.repartition("cell").sortWithinPartitions("cell").mapInArrow(total, f"cell long, centre {kind}")


def _within(members: DataFrame, degrees: float) -> DataFrame:
    """(id, cell, size, angle) of the members within an angle of their cell's centre."""

    def batches(it):
        for batch in it:
            pairs = list(zip(rows_of(batch.column("vec")), rows_of(batch.column("centre"))))
            angle = np.array([_angle(np.dot(v, c) / (np.linalg.norm(v) * np.linalg.norm(c)))
                              for v, c in ((v.astype(np.float64), c.astype(np.float64)) for v, c in pairs)])
            keep = pa.array(angle <= math.radians(degrees))
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "cell", "size")] + [pa.array(angle)], names=["id", "cell", "size", "angle"])
            yield out.filter(keep)

    return members.mapInArrow(batches, "id long, cell long, size long, angle double")


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _block_rows(keyed: DataFrame) -> DataFrame:
    """Rows (key, group, n, ...) spread over blocks: (key, i, j) holds sides i and j of a group cut into sides of BLOCK rows."""
    sides = F.ceil(F.col("n") / BLOCK).cast("int")
    out = keyed.withColumn("side", F.pmod(F.xxhash64("id"), sides).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    return out.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})


#: What a block returns: listed pairs with a ball, numbers of links, rows that connect entries.
PAIR, COUNT, CONNECT = 0, 1, 2
_DECIDED = "kind int, a long, b long, sure boolean, n long"
#: Pairs whose buckets are looked at together.
PAIRS = 1 << 18


def first_meetings(left: np.ndarray, right: np.ndarray, key: int, per: int) -> np.ndarray:
    """Which pairs of rows of bucket keys (``per`` a table, the own first) meet in bucket ``key`` first.

    Two entries meet in a bucket that one of them owns and the other has; the order is that
    of tables, then of keys.
    """
    first = np.ones(len(left), dtype=bool)
    if not len(left):
        return first
    table = int(np.argmax(left[0] == key)) // per
    for t in range(table + 1):
        x, y = (b[:, t * per:(t + 1) * per] for b in (left, right))
        for own, other in ((x[:, :1], y), (y[:, :1], x)):
            met = (own == other).any(axis=1)
            first &= ~(met & (own[:, 0] < key)) if t == table else ~met
    return first


def least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the entries 0 to n - 1 that each reaches over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
    return label


def _compared(blocks: DataFrame, cosine: float) -> DataFrame:
    """Links of the blocks of buckets: between entries by number, with balls as pairs (sure, or open until their members are compared)."""
    limit = math.acos(cosine)

    def rows_out(kind: int, a: np.ndarray, b: np.ndarray, sure: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(sure), pa.array(n)],
                                          names=["kind", "a", "b", "sure", "n"])

    def block(t: pa.Table):
        dims = np.array([len(r) for r in rows_of(column_array(t, "vec"))])
        t = t.filter(pa.array(dims == dims[0]))  # a bucket key holds one dimension; another one can only meet it by a clash of hashes
        sides, own = t.column("side").to_numpy(), t.column("own").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        if t.num_rows < 2 or not own.any():
            return None
        ids, radius, size = (t.column(c).to_numpy() for c in ("id", "radius", "size"))
        x = unit_rows(matrix_of(column_array(t, "vec")))
        left, right = np.flatnonzero(sides == i), np.flatnonzero(sides == j)
        c = x[left] @ x[right].T
        near = own[left][:, None] | own[right][None, :]
        if i == j:
            near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        reach = radius[left][:, None] + radius[right][None, :]
        out = []
        if reach.any():
            angle = _angle(c)
            sure = (reach > 0) & (angle + reach <= limit - 1e-7)
            open_ = (reach > 0) & ~sure & (angle - reach <= limit + 1e-7)
            a, b = np.nonzero(near & (sure | open_))
            out.append(rows_out(PAIR, np.minimum(ids[left[a]], ids[right[b]]), np.maximum(ids[left[a]], ids[right[b]]), sure[a, b], np.zeros(len(a), dtype=np.int64)))
            near &= reach == 0
        a, b = np.nonzero(near & (c >= cosine))
        if len(a):
            a, b = left[a], right[b]
            per = t.column("per")[int(np.flatnonzero(radius == 0)[0])].as_py()
            width = max(len(r) for r in rows_of(column_array(t, "buckets")))
            buckets = np.zeros((len(ids), width), dtype=np.int64)
            for k, r in enumerate(rows_of(column_array(t, "buckets"))):
                buckets[k, :len(r)] = r
            key, links = t.column("key")[0].as_py(), np.zeros(len(ids))
            for start in range(0, len(a), PAIRS):
                p, q = a[start:start + PAIRS], b[start:start + PAIRS]
                first = first_meetings(buckets[p], buckets[q], key, per)
                links += np.bincount(p[first], weights=size[q[first]], minlength=len(ids)) + np.bincount(q[first], weights=size[p[first]], minlength=len(ids))
            some = np.flatnonzero(links)
            out.append(rows_out(COUNT, ids[some], ids[some], np.ones(len(some), dtype=bool), links[some].astype(np.int64)))
            label = least_connected(len(ids), a, b)
            some = np.flatnonzero(label != np.arange(len(ids)))
            out.append(rows_out(CONNECT, ids[some], ids[label[some]], np.ones(len(some), dtype=bool), np.zeros(len(some), dtype=np.int64)))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(o.num_rows for o in out) else None

    return blocks.mapInArrow(lambda it: by_group(it, 3, block), _DECIDED)


def _member_links(blocks: DataFrame, cosine: float) -> DataFrame:
    """(a, b, id, n): for each member of two compared balls the links to the other ball."""

    def block(t: pa.Table):
        first = t.column("first").to_numpy()
        sides, i, j = t.column("side").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ids, size = t.column("id").to_numpy(), t.column("size").to_numpy()
        x = unit_rows(matrix_of(column_array(t, "vec")))
        out = []
        for p, q in {(i, j), (j, i)}:  # side p of the first ball with side q of the second
            left, right = np.flatnonzero(first & (sides == p)), np.flatnonzero(~first & (sides == q))
            linked = x[left] @ x[right].T >= cosine
            out += [(ids[left], linked @ size[right]), (ids[right], size[left] @ linked)]
        who, n = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        keep = n > 0
        if not keep.any():
            return None
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        return pa.RecordBatch.from_arrays([pa.array([a] * int(keep.sum())), pa.array([b] * int(keep.sum())), pa.array(who[keep]),
                                           pa.array(n[keep].astype(np.int64))], names=["a", "b", "id", "n"])

    return blocks.mapInArrow(lambda it: by_group(it, 4, block), "a long, b long, id long, n long")


def near_duplicates(df: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked at a cosine of ``cosine`` or more, in doubles.

    One row for each input row; every row is a vector, also one that repeats another.
    Vectors that are null, zero or hold null or non-finite components, and rows with a null
    id, link with nothing (a null id has a null component and kept true). Vectors of different
    dimensions aren't compared. An empty table gives an empty result.
    """
    kind = element_type(df, vector)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vec"))
    rows = rows.withColumn("vec", F.when(F.col("vec_id").isNotNull() & takes_part(F.col("vec")), F.col("vec")))
    entries = written(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")), "vectors")
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    k, tables = plan(facts["n"], facts["dim"] or 2, cosine)
    hashed = written(_hashed(entries, kind, k, tables), "vector-buckets")
    # balls
    degrees = math.degrees(math.acos(cosine)) / 2 - 0.05
    dense = hashed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DENSE).select("cell")
    members = written(hashed.select("id", "vec", "size", "cell").join(dense, "cell"), "vector-cells")
    centres = written(_centroids(members, kind), "vector-centres")
    inside = written(_within(members.join(centres, "cell"), degrees), "vector-members")
    balls = inside.groupBy("cell").agg(F.min("id").alias("ball"), F.max("angle").alias("radius"), F.sum("size").alias("ball_size"),
                                       F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    balls = written(balls.join(centres, "cell"), "vector-balls")
    of = inside.join(balls.select("cell", "ball"), "cell").select("id", "ball")
    hashed = written(hashed.join(of, "id", "left").withColumn("unit", F.coalesce("ball", "id")), "vector-units")
    units = hashed.where("ball is null").select("id", "vec", "size", F.lit(0.0).alias("radius"), "buckets", "per").unionByName(
        balls.select(F.col("ball").alias("id"), F.col("centre").alias("vec"), F.col("ball_size").alias("size"), (F.col("radius") + 1e-6).alias("radius"),
                     F.array().cast("array<long>").alias("buckets"), F.lit(0).alias("per")))
    # buckets
    posted = hashed.select(F.col("unit").alias("id"), "per", F.posexplode("buckets").alias("at", "key"))
    posted = posted.groupBy("key", "id").agg(F.max(F.col("at") % F.col("per") == 0).alias("own"))
    posted = written(posted, "vector-postings")
    crowded = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 and any").drop("any")
    blocks = _block_rows(posted.join(crowded, "key")).join(units, "id").select("key", "i", "j", "side", "id", "own", "radius", "size", "per", "buckets", "vec")
    compared = written(_compared(blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), cosine), "vector-compared")
    decided = written(compared.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.max("sure").alias("sure")), "vector-links")
    # what centres and radii leave open
    sizes = units.select("id", "size")
    within = hashed.select(F.col("id"), "unit", "vec", "size")
    open_ = decided.where("not sure").select("a", "b")
    sided = open_.select("a", "b", F.col("a").alias("unit"), F.lit(True).alias("first")).unionByName(
        open_.select("a", "b", F.col("b").alias("unit"), F.lit(False).alias("first")))
    counts = within.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    pairs = sided.join(counts, "unit")
    most = pairs.groupBy("a", "b").agg(F.max("n").alias("n"))
    wide = _block_rows(sided.join(most, ["a", "b"]).join(within, "unit")).select("a", "b", "i", "j", "side", "first", "id", "size", "vec")
    extra = written(_member_links(wide.repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j"), cosine), "vector-member-links")
    # counts and components
    sure = decided.where("sure").select("a", "b")
    both = sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = compared.where(F.col("kind") == COUNT).select(F.col("a").alias("unit"), F.col("n").alias("size"))
    unit_links = both.join(sizes.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("unit"), "size").unionByName(counted) \
                     .groupBy("unit").agg(F.sum("size").alias("linked"))
    connected = sure.unionByName(compared.where(F.col("kind") == CONNECT).select("a", "b"))
    member_links = extra.groupBy("id").agg(F.sum("n").alias("extra"))
    labels = components(connected.unionByName(extra.select("a", "b").distinct()), "vector-components").withColumnRenamed("id", "unit")
    known = (hashed.select("id", "unit").join(sizes.withColumnRenamed("id", "unit"), "unit")
             .join(unit_links, "unit", "left").join(labels, "unit", "left").join(member_links, "id", "left")
             .select("id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "unit").alias("component_id")))
    by_vector = entries.join(known, "id").select("vec", "n_links", "component_id")
    out = rows.join(by_vector, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
