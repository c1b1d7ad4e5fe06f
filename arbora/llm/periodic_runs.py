"""Periodic run detection by block convolution.

A run is a stretch of words with smallest period p and a length of at least
max(12, 2 p) that can't be extended. At scale B (2, 4, 8, ...) the periods from 2 B - 1 to
4 B - 2 are looked for (below 7 at scale 2): the words that equal the word p further on
form a stretch of at least 2 B - 1, so it holds a whole block [k B, (k + 1) B) whose
next occurrence is p away. The squared differences of a block and all places of the
window behind it are the sum of two sums of squares less twice a correlation, which
number-theoretic transforms give exactly: as many primes are used as the largest possible
sum asks for, so a sum is zero just if it is zero modulo all of them. Each zero is a seed
(place, distance), grown word by word to both sides.

Scales ascend, so a run is known when the multiples of its period come up: blocks whose
window lies in a known run of period at most B occur at multiples of it only and are left
out, as are seeds within a run that divides them. Blocks are also left out if one of their
words has no equal in its part of the window. All three tests are exact.

Only one document is in memory at a time, transforms run on batches of 2^18 numbers (or one
block's), and a document's work grows as n log^2 n of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words of the shortest run.
SHORTEST = 12
#: Primes k 2^m + 1 with primitive root 3.
PRIMES = (998_244_353, 469_762_049, 167_772_161)
BATCH = 1 << 18


@lru_cache(maxsize=64)
def _twiddles(half: int, prime: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order 2 ``half``."""
    root = pow(3, (prime - 1) // (2 * half), prime)
    root = pow(root, -1, prime) if inverse else root
    out = np.ones(half, dtype=np.uint64)
    step, have = root, 1
    while have < half:
        out[have:2 * have] = out[:have] * np.uint64(step) % np.uint64(prime)
        step, have = step * step % prime, 2 * have
    return out


def _forward(rows: np.ndarray, prime: int) -> np.ndarray:
    """Transforms of the rows (a power of two long), in bit-reversed order."""
    p, n = np.uint64(prime), rows.shape[1]
    size = n
    while size > 1:
        half = size // 2
        v = rows.reshape(-1, n // size, 2, half)
        total, gap = v[:, :, 0] + v[:, :, 1], v[:, :, 0] + (p - v[:, :, 1])
        v[:, :, 0] = total % p
        v[:, :, 1] = gap % p * _twiddles(half, prime, False) % p
        size = half
    return rows


def _backward(rows: np.ndarray, prime: int) -> np.ndarray:
    """Undoes `_forward`."""
    p, n = np.uint64(prime), rows.shape[1]
    size = 2
    while size <= n:
        half = size // 2
        v = rows.reshape(-1, n // size, 2, half)
        low, high = v[:, :, 0].copy(), v[:, :, 1] * _twiddles(half, prime, True) % p
        v[:, :, 0] = (low + high) % p
        v[:, :, 1] = (low + (p - high)) % p
        size *= 2
    return rows * np.uint64(pow(n, -1, prime)) % p


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray, places: int, top: int) -> np.ndarray:
    """Where the squared differences of each block and the ``places`` first places of its window are zero.

    Values are whole numbers from 0 to ``top``; a window has ``places`` - 1 + B values.
    """
    m, b = blocks.shape
    n = 1 << (windows.shape[1] - 1).bit_length()
    out = np.ones((m, places), dtype=bool)
    bound, room = b * top * top, 1
    for prime in PRIMES:
        if room > bound:
            break
        room *= prime
        p = np.uint64(prime)
        x, y = np.zeros((m, n), dtype=np.uint64), np.zeros((m, n), dtype=np.uint64)
        x[:, (-np.arange(b)) % n] = blocks.astype(np.uint64) % p
        y[:, :windows.shape[1]] = windows.astype(np.uint64) % p
        squares = np.concatenate([np.zeros((m, 1), dtype=np.uint64), np.cumsum(y[:, :windows.shape[1]] ** 2 % p, axis=1)], axis=1)
        own = (x ** 2 % p).sum(axis=1, keepdims=True)
        both = (own + squares[:, b:b + places] - squares[:, :places]) % p
        shared = _backward(_forward(x, prime) * _forward(y, prime) % p, prime)[:, :places]
        out &= both == shared * np.uint64(2) % p
    if room <= bound:
        raise ValueError(f"sums of up to {bound} need more primes")
    return out


def _grown(w: np.ndarray, at: int, to: int, d: int) -> tuple[int, int]:
    """The longest stretch around [at, to) of words that equal the word ``d`` further on."""
    step = 32
    while to + d < len(w):
        other = np.flatnonzero(w[to:to + step][:len(w) - d - to] != w[to + d:to + d + step])
        if len(other):
            to += int(other[0])
            break
        to, step = min(to + step, len(w) - d), 2 * step
    step = 32
    while at > 0:
        low = max(0, at - step)
        other = np.flatnonzero(w[low:at] != w[low + d:at + d])
        if len(other):
            at = low + int(other[-1]) + 1
            break
        at, step = low, 2 * step
    return at, to


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of ids 0, 1, ..., by start, then period."""
    n = len(w)
    if n < SHORTEST:
        return []
    top = int(w.max()) + 1
    w = w.astype(np.int64)
    order = np.sort(w * n + np.arange(n))  # occurrences by word, then place
    found: dict[tuple[int, int], int] = {}
    end, period = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)  # of the known run that reaches furthest
    b = 2
    while (least := 2 * b - 1 if b > 2 else 1) <= n // 2:
        most = 4 * b - 2
        at = np.arange(0, n - b - least + 1, b)
        at = at[~((end[at] >= np.minimum(at + most + b, n)) & (period[at] <= b))]
        for k in range(b):
            if not len(at):
                break
            key = w[at + k] * n + at + k
            nearest = np.searchsorted(order, key + least)  # the word's first place from the least distance on
            gap = order[np.minimum(nearest, n - 1)] - key  # of another word: beyond the end of the text
            at = at[(nearest < n) & (gap <= np.minimum(most, n - 1 - at - k))]
        padded = np.concatenate([w, np.full(most + b, top)]) if len(at) else w
        seeds = []
        for some in np.array_split(at, max(1, -(-len(at) * 4 * b // BATCH))):
            if len(some):
                places = most - least + 1
                blocks = padded[some[:, None] + np.arange(b)]
                windows = padded[some[:, None] + least + np.arange(places - 1 + b)]
                row, place = np.nonzero(zero_mismatches(blocks, windows, places, top))
                seeds.append((some[row], place + least))
        if seeds:
            spot, d = (np.concatenate(x) for x in zip(*seeds))
            new = ~((end[spot] >= spot + d + b) & (d % period[spot] == 0))
            spot, d = spot[new], d[new]
            rank = np.lexsort((spot, d))
            spot, d = spot[rank], d[rank]
            first = np.r_[True, (d[1:] != d[:-1]) | (spot[1:] != spot[:-1] + b)][:len(d)]
            upto, last = 0, -1
            for s, q in zip(spot[first].tolist(), d[first].tolist()):
                if q == last and s < upto:
                    continue
                low, upto = _grown(w, s, s + b, q)
                last, length = q, upto - low + q
                if length >= max(SHORTEST, 2 * q) and (low, length) not in found:
                    found[low, length] = q
                    reach = end[low:low + length]
                    further = reach < low + length
                    reach[further] = low + length
                    period[low:low + length][further] = q
        b *= 2
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def words_and_ids(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words between ASCII white space and an id for each distinct one."""
    words, ids = text.split(), {}
    return words, np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return b" ".join([x for x, g in zip(words, gone.tolist()) if not g] if found else words)


def collapse(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``docs`` (doc_id, text; other columns are left out).

    ``runs`` are the (start, length, period) of all runs of the whole text by start, then
    period; ``collapsed`` is the text with each run cut down to its first period and words
    joined by one space. Null and empty texts have no runs and collapse to the empty
    text; rows that repeat an id are done one by one; an empty table gives no rows.
    ``edit`` may change a row's words beforehand.
    """
    schema = StructType([docs.schema["doc_id"],
                         *StructType.fromDDL("runs array<struct<start:long,length:long,period:long>>, collapsed string").fields])
    arrow = to_arrow_schema(schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(0, batch.num_rows, 512):
                part, all_runs, texts = batch.slice(k, 512), [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary())):
                    words, ids = words_and_ids(text.as_py() or b"")
                    if edit:
                        changed = edit(doc, words)
                        words, ids = words_and_ids(b" ".join(changed)) if changed is not words else (words, ids)
                    found = runs(ids)
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(collapsed(words, found).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(all_runs, arrow.field("runs").type), pa.array(texts, pa.string())], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(batches, schema)


def planted_tail(doc: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a periodic tail for a tenth of the ids, for measuring detection.

    With h = crc32 of the decimal id, g = h // 10 and h % 10 = 0, each word i from a = g % n
    on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null id changes nothing.
    """
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(found: DataFrame) -> DataFrame:
    """One row per row of `collapse`: the number of runs, the longest one and digests of all runs and of the collapsed text.

    The longest run is the first in (length descending, start, period); without runs its columns are null.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length DIV -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
