"""Language identification by rank-order profiles of n-grams.

A text's n-grams of one to five letters, taken inside words with one blank on either side,
are ranked by frequency (ties by their 64-bit hash). Its 300 most frequent ones are
compared with the 300 of each language: an n-gram costs the distance of its two ranks,
one that the language's profile lacks 300. The least sum wins, ties go to the name that
sorts first. Letters are lower-cased; all other characters only end words.

Profiles are learned from whole texts of at most ``SAMPLE`` distinct texts of a language, those
with the least hashes. Predictions count whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arbora.llm.common import field, packed, unpacked

#: Length of a profile, longest n-gram, documents of a language to learn from.
PROFILE, LONGEST, SAMPLE = 300, 5, 2000
#: Languages x profile length that are shipped to the tasks at most.
MAX_RANKS = 4_000_000
UNKNOWN = "und"
#: Hashes of texts are spread over so many places.
SHARE = 1 << 40
#: Places of a text whose n-grams are counted at a time.
CHUNK = 1 << 18
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, one 0 between words and at either end; empty without letters."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(_letters()[code], code, np.uint32(0))
    code = np.concatenate([np.zeros(1, dtype=np.uint32), code, np.zeros(1, dtype=np.uint32)])
    keep = np.r_[True, (code[1:] > 0) | (code[:-1] > 0)]
    code = code[keep]
    return code if len(code) > 1 else code[:0]


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][:len(grams)])
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of `letters` and how often they occur."""
    parts = []
    for start in range(0, len(code), CHUNK):
        view = code[start:start + CHUNK + LONGEST - 1]
        places = min(CHUNK, len(view))
        blank, wide = view == 0, view.astype(np.uint64)
        h, grams = np.zeros(places, dtype=np.uint64), []
        whole = np.ones(places, dtype=bool)  # no blank inside
        for k in range(LONGEST):
            m = min(places, len(view) - k)
            h, whole = h[:m], whole[:m]
            if k > 1:
                whole = whole & ~blank[k - 1:k - 1 + m]
            h = (h + wide[k:k + m] + np.uint64(1)) * _FACTOR
            x = h[whole & ~blank[:m]] if k == 0 else h[whole]
            grams.append((x ^ (x >> np.uint64(29))) * _MIX)
        parts.append(np.unique(np.concatenate(grams), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return _merged(np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts]))


def ranked(grams: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent n-grams, most frequent first."""
    if len(counts) > n:
        enough = counts >= np.partition(counts, len(counts) - n)[len(counts) - n]
        grams, counts = grams[enough], counts[enough]
    return grams[np.lexsort((grams, -counts))[:n]]


class Profiles:
    """Profiles of languages, and the distance of a text from each."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *profiles.values()]))
        self.rank = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 less the share of the greatest possible distance."""
        grams, counts = gram_counts(letters(text))
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        mine = ranked(grams, counts)
        at = np.searchsorted(self.grams, mine)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != mine] = len(self.grams)
        rank = self.rank[at]
        apart = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.names[best], 1.0 - float(apart[best]) / (PROFILE * len(mine))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages of (lang, text); rows whose lang is null are not learned from.

    Equal texts of a language are learned from once; a language with more than ``sample``
    distinct ones from those with the least hashes.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL") \
                   .withColumn("place", F.pmod(F.xxhash64("text"), F.lit(SHARE)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()}
    if len(sizes) * PROFILE > MAX_RANKS:
        raise ValueError(f"{len(sizes)} languages; profiles of at most {MAX_RANKS // PROFILE} are shipped to the tasks")
    # some four times the texts that are needed are ranked, whatever a language's share; one row a language, of which there are few
    below = spark.createDataFrame([(k, min(SHARE, SHARE * (4 * sample + 40) // max(1, n))) for k, n in sizes.items()], "lang string, below long")
    near = rows.join(F.broadcast(below), "lang").where("place < below")
    order = Window.partitionBy("lang").orderBy("place")
    chosen = near.groupBy("lang", "place").agg(F.first("text").alias("text")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                held: dict[str, list] = {}
                for lang, text in zip(batch.column("lang").slice(at, 64).to_pylist(), batch.column("text").slice(at, 64)):
                    held.setdefault(lang, []).append(gram_counts(letters(text.as_py())))
                for lang, parts in held.items():
                    grams, counts = _merged(np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts]))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)),
                                                      pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    counts = chosen.repartition("place").select("lang", "text").mapInArrow(counted, "lang string, gram long, n long") \
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # as `ranked`: by count, then by the hash as an unsigned number
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list] = {}
    for r in sorted(top.select("lang", "gram", "rank").collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in profiles.items()})


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1); columns of these names are replaced.

    Only the whole text counts. Null texts and texts without a letter get ``und`` and 0, as
    all do if there are no profiles; an empty table gives no rows.
    """
    columns = docs.columns
    rows = packed(docs).select("*", field(text).cast("string").alias("__text"))
    schema = StructType([rows.schema[0], *StructType.fromDDL("lang_pred string, score double").fields])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [shared.value.predict(t.as_py()) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())], schema=arrow)

    return unpacked(rows.mapInArrow(batches, schema), columns, ["lang_pred", "score"])


def fold(key: str, folds: int = 5) -> Column:
    """The fold of a row: crc32 of its key as text; null without a key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
