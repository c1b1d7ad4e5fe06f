"""MinHash near-dedup: fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup): in round i every shingle is thrown into one
of t bins with a value in [i, i + 1); a bin keeps its least value, so a later round
only matters to bins that are still empty. From round t on, round t + j puts all
shingles into bin j, so every bin fills. Equal bins of two documents happen with
probability J and are concentrated as in independent hashing.

Documents with equal shingle sets are one class. Class representatives meet in the
buckets of their bands; buckets with the same members count once. Bands are worked
off in rounds: a bucket is verified on full shingle sets in blocks of bounded size,
each block returns a spanning forest of its links, and buckets whose members are
connected by then drop out. Pairs that met in an earlier band are not verified again.

A crowd costs no pairs of its own: members of large buckets are first verified against two pivots
of the bucket, and what that connects counts as one. From then on a bucket's largest
connected part is only compared with the rest of the bucket, so its word lists are copied
as often as the rest needs, not as the crowd is large. Blocks are bounded by documents
and by words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from arbora.llm.common import written
from arbora.llm.components import components

#: Bands and rows of a band. At similarity 0.8 a pair is missed with probability (1 - 0.8^7)^40 = 8e-5, at 0.85 under 3e-7.
BANDS, ROWS = 40, 7
#: Bands of each round of verification.
ROUNDS = ((0, 4), (4, 12), (12, BANDS))
#: Documents, and about the words, of a side of a block; members from which on a bucket gets two pivots.
BLOCK, BLOCK_WORDS, CROWD = 512, 1 << 20, 64
WORD_CACHE = 1 << 18
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """Hashes of the words of a text: A-Z lower-cased, cut at ASCII white space."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; of all words if there are fewer; empty without words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(_GOLDEN) + words[k:k + n])
    return np.unique(h)


def fast_sketch(shingles: np.ndarray, t: int, seeds: np.ndarray) -> np.ndarray:
    """The t coordinates of a non-empty set: (round, value) of the least item in each bin."""
    n, out = len(shingles), np.zeros(t, dtype=np.uint64)
    empty, start = np.ones(t, dtype=bool), 0
    while start < 2 * t and empty.any():
        rounds = min(max(1, 4 * t // n), (t if start < t else 2 * t) - start, max(1, 65_536 // n))
        at = np.arange(start, start + rounds)
        h = _mix(shingles[None, :] ^ seeds[at][:, None])
        if start < t:
            bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        else:
            bins = np.broadcast_to((at - t).astype(np.uint64)[:, None], h.shape)
        value = _mix(h) >> np.uint64(28)  # 36 bits
        key = np.sort(((bins << np.uint64(52)) | (at.astype(np.uint64)[:, None] << np.uint64(36)) | value).ravel())
        which = (key >> np.uint64(52)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        first = first[empty[which[first]]]
        out[which[first]] = key[first]
        empty[which[first]] = False
        start += rounds
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    for column in sketch.reshape(bands, rows).T:
        h = _mix(h * np.uint64(_GOLDEN) + column)
    return h.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands) of (doc_id, text); fingerprint and bands are null without shingles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        seeds = _mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(_GOLDEN))
        for batch in it:
            sizes, f1, f2, bands = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(word_hashes(text.as_py(), cache), width)
                sizes.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                f1.append(d and int.from_bytes(d[:8], "little", signed=True))
                f2.append(d and int.from_bytes(d[8:], "little", signed=True))
                bands.append(band_keys(fast_sketch(s, BANDS * ROWS, seeds), BANDS, ROWS) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return docs.mapInArrow(batches, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def _word_lists(docs: DataFrame) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in it:
            words = [word_hashes(x.as_py(), cache).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.list_(pa.int64())), batch.column("bands")],
                                             names=["id", "words", "bands"])

    return docs.mapInArrow(batches, "id long, words array<long>, bands array<long>")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of slices of the incidence matrix."""
    items, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(where, kind="stable")
    where, row = where[order], row[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 4096
    cuts = np.searchsorted(where, np.arange(0, len(items) + step, step))
    for a, b in zip(cuts[:-1], cuts[1:]):
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[row[a:b], where[a:b] % step] = 1
        total += m[left] @ m[right].T
    return total


def block_links(ids: np.ndarray, sides: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], bands: np.ndarray,
                band: int, i: int, j: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sides i and j of a block that earlier bands haven't looked at."""
    left, right = np.flatnonzero(sides == i), np.flatnonzero(sides == j)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    open_ = labels[left][:, None] != labels[right][None, :]
    small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    open_ &= 100 * small >= percent * large
    for k in range(band):
        open_ &= bands[left, k][:, None] != bands[right, k][None, :]
    if i == j:
        open_ &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    parent = {x: x for x in set(labels.tolist())}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    todo = np.argwhere(open_)
    overlap = _overlaps(sets, left, right).astype(np.int64) if len(todo) > 4000 else None
    if overlap is not None:
        todo = todo[100 * overlap[todo[:, 0], todo[:, 1]] >= percent * (size[left[todo[:, 0]]] + size[right[todo[:, 1]]] - overlap[todo[:, 0], todo[:, 1]])]
    out = []
    for x, y in todo:
        a, b = left[x], right[y]
        ra, rb = root(int(labels[a])), root(int(labels[b]))
        if ra == rb:
            continue
        if overlap is None:
            s, l = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            common = int(np.count_nonzero(l[np.minimum(np.searchsorted(l, s), len(l) - 1)] == s))
            if 100 * common < percent * (len(s) + len(l) - common):
                continue
        parent[ra] = rb
        out.append((int(ids[a]), int(ids[b])))
    return out


def _verified(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of sorted rows (key, i, j, side, band, id, label, words, bands), one block after the other."""

    def block(rows: list) -> list[tuple[int, int]]:
        _, i, j, _, band = rows[0][:5]
        if len(rows) < 2:
            return []
        ids, sides, labels = (np.array([r[k] for r in rows], dtype=np.int64) for k in (5, 3, 6))
        sets = [shingle_set(r[7].view(np.uint64), width) for r in rows]
        return block_links(ids, sides, labels, sets, np.stack([r[8] for r in rows]), band, i, j, percent)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in it:
            head = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "band", "id", "label"))))
            lists = [[x.values.to_numpy() for x in batch.column(c)] for c in ("words", "bands")]
            found = []
            for r, words, bands in zip(head, *lists):
                if r[:3] != at:
                    found += block(held) if held else []
                    held, at = [], r[:3]
                held.append((*r, words, bands))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = block(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(batches, "a long, b long")


def _sides(n, words):
    """Sides of a group of ``n`` documents that hold ``words`` words."""
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(words / BLOCK_WORDS)).cast("int")


def _pivot_blocks(crowds: DataFrame) -> DataFrame:
    """Members of large buckets in sides of bounded size, each with the bucket's pivots as side -1."""
    place = F.struct(F.xxhash64("id"), F.col("id"))
    ranked = crowds.groupBy("key").agg(F.sum("words").alias("all_words"), F.min(place).alias("p0"), F.max(place).alias("p1"))
    sided = crowds.join(ranked, "key").withColumn("sides", _sides(F.col("size"), F.col("all_words")))
    is_pivot = (F.col("id") == F.col("p0.id")) | (F.col("id") == F.col("p1.id"))
    side = F.pmod(F.xxhash64("id"), F.col("sides")).cast("int")
    rows = sided.select("key", "band", "id", F.col("id").alias("label"), side.alias("j"), side.alias("side"))
    pivots = sided.where(is_pivot).select("key", "band", "id", F.col("id").alias("label"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("j"),
                                          F.lit(-1).alias("side"))
    return rows.unionByName(pivots).withColumn("i", F.lit(-1))


def _rest_blocks(part: DataFrame) -> DataFrame:
    """Buckets that hold more than one connected part, in blocks: all others against each other and against the largest part.

    The largest part's sides come behind those of the others, and meet only those.
    """
    parts = part.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    buckets = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max(F.struct("n", "label", "words")).alias("most"))
    buckets = buckets.where("n > most.n").select(
        "key", F.col("most.label").alias("largest"), _sides(F.col("n") - F.col("most.n"), F.col("words") - F.col("most.words")).alias("rest"),
        _sides(F.col("most.n"), F.col("most.words")).alias("main"))
    x = part.join(buckets, "key").withColumn("is_main", F.col("label") == F.col("largest"))
    h = F.xxhash64("id")
    side = F.when(F.col("is_main"), F.col("rest") + F.pmod(h, F.col("main"))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    others = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("main") - 1))
    x = x.withColumn("side", side).withColumn("other", F.explode(others))
    return x.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "band", "id", "label")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked at a Jaccard similarity of ``percent`` / 100 or more.

    One row for each input row. Documents without words link with nothing; those with
    fewer than ``width`` words have their whole sequence as one shingle. ``component_id``
    is the smallest id reached, ``kept`` is doc_id = component_id. Ids identify texts:
    rows that repeat an id are one document. Rows with a null id link with nothing and
    have a null component and kept true. An empty table gives an empty result.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(signatures(docs, width), "minhash-signatures")
    classes = signed.where("f1 is not null and doc_id is not null").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # documents without words have no fingerprint, rows without an id no class: they don't meet in the join
    classed = signed.where("f1 is not null").join(classes, ["f1", "f2"], "left").unionByName(
        signed.where("f1 is null").withColumns({"rep": F.lit(None).cast("long"), "copies": F.lit(None).cast("long")}))
    members = written(classed.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), "copies",
        F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "minhash-members")
    heads = members.where("bands is not null")
    heads = heads.where("copies = 1").unionByName(heads.where("copies > 1").dropDuplicates(["rep"])).select("rep", "n_shingles", "bands")
    postings = heads.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = (postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("band").alias("band"),
        F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2")).where("size > 1")
        .groupBy("size", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("k")).select("size", "k.key"))
    met = written(postings.join(buckets, "key").withColumnRenamed("n_shingles", "words"), "minhash-buckets")
    wanted = met.groupBy("rep").agg(F.lit(1).alias("one")).join(heads, "rep").select("rep", "bands")
    texts = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select(F.col("rep").alias("id"), "text", "bands")
    pool = written(_word_lists(texts), "minhash-words")
    links, labels = None, None
    for first, last in ((0, ROUNDS[0][1]), *ROUNDS):
        part = met.where((F.col("band") >= first) & (F.col("band") < last)).withColumnRenamed("rep", "id")
        if labels is None:
            blocks = _pivot_blocks(part.where(F.col("size") >= CROWD))
        else:
            part = part.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
            blocks = _rest_blocks(part)
        blocks = blocks.join(pool, "id").select("key", "i", "j", "side", "band", "id", "label", "words", "bands")
        found = _verified(blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), width, percent)
        found = written(found if links is None else found.unionByName(links), "minhash-links")
        labels = written(components(found, "minhash-components"), "minhash-labels")
        links = labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    out = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` with one document of each group of near duplicates; rows with a null id stay."""
    kept = near_duplicates(df, width, percent, key, text).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = df.join(kept.withColumnRenamed("doc_id", "__kept"), F.col(key) == F.col("__kept"), "left_semi")
    return rows.dropDuplicates([key]).unionByName(df.where(F.col(key).isNull()))
