"""Schema unification and stratified splits.

The split rule: classes (``path_list`` values) with fewer than two rows go to
train; of the rest, ``T = ceil(frac * n)`` rows go to test, class ``c`` getting
``floor(n_c * T / n)`` plus one for the ``T - sum`` classes with the largest
remainders (ties by class name). Inside a class, rows are taken in the order of
``md5(seed|id)``.

A class is never sorted and rows are never moved: a histogram of the first four hex
digits of the hashes gives each class the bucket in which its quota ends, only the hashes
of that bucket are ranked, and what comes out is one (hash, id) per class and
stage up to which rows are taken. Stages take consecutive stretches of the same hash
order, so 64/16/20 is two cuts. The rows themselves are read once, against the broadcast cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from arbora.operators.guards import checked_broadcast

UNIFIED = ["title", "description", "brand", "category", "path_list"]
# source layouts: which raw columns make up the unified ones
SOURCES = ("icecat", "rakuten", "wdc_ziqi", "webdatacommons")


# ---------------------------------------------------------------- P1-P6

def unify(df: DataFrame, source: str, null_literal: str | None = None) -> DataFrame:
    """Map one raw source layout to ``title, description, brand, category,
    path_list`` (+ ``source``). Unknown sources raise ``ValueError``.

    ``null_literal='nan'`` reproduces stringified missing values.
    """
    c = F.col
    if source == "icecat":
        # concat (not concat_ws): NULL if either part is missing, no separator
        out = df.select(c("Title").alias("title"),
                        F.concat(c("`Description.LongDesc`"),
                                 c("`SummaryDescription.LongSummaryDescription`")).alias("description"),
                        c("Brand").alias("brand"), c("`Category.Name.Value`").alias("category"),
                        c("pathlist_names").alias("path_list"))
    elif source == "rakuten":
        out = df.select(c("title").alias("title"), F.lit(None).cast("string").alias("description"),
                        F.lit(None).cast("string").alias("brand"), c("CategoryID").alias("category"),
                        c("pathlist").alias("path_list"))
    elif source == "wdc_ziqi":
        # concat, not concat_ws: a missing level makes the path NULL
        out = df.select(c("Name").alias("title"), c("Description").alias("description"),
                        F.lit(None).cast("string").alias("brand"), c("lvl3").alias("category"),
                        F.concat(c("lvl1"), F.lit(">"), c("lvl2"), F.lit(">"), c("lvl3")).alias("path_list"))
    elif source == "webdatacommons":
        out = df.select(c("title").alias("title"), c("desc").alias("description"),
                        F.lit(None).cast("string").alias("brand"), c("CategoryName").alias("category"),
                        c("pathlist_names").alias("path_list"))
    else:
        raise ValueError(f"no unified schema for source {source!r}")
    out = out.select(*[F.col(x).cast("string").alias(x) for x in UNIFIED])
    if null_literal is not None:
        out = out.select(*[F.coalesce(F.col(x), F.lit(null_literal)).alias(x) for x in UNIFIED])
    return out.withColumn("source", F.lit(source))


def unify_all(frames: dict[str, DataFrame]) -> DataFrame:
    """Unify every source and union by name."""
    out = None
    for source, df in frames.items():
        u = unify(df, source)
        out = u if out is None else out.unionByName(u, allowMissingColumns=True)
    return out


def normalise_label(col) -> F.Column:
    """Spaces in labels become underscores."""
    return F.replace(F.col(col) if isinstance(col, str) else col, F.lit(" "), F.lit("_"))


def model_text(title: str = "title", description: str = "description", with_description: bool = True):
    """``title`` or ``title - description`` (NULL if the description is NULL)."""
    if not with_description:
        return F.col(title)
    return F.concat(F.col(title), F.lit(" - "), F.col(description))


# ---------------------------------------------------------------- F6

def class_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_c"))


def rare_class_rows(df: DataFrame, by: str = "path_list", min_count: int = 2,
                    complement: bool = False) -> DataFrame:
    """rows whose class has fewer than ``min_count`` rows (or, with
    ``complement``, the others). Counts come from a partially aggregated groupBy."""
    rare = class_counts(df, by).where(F.col("n_c") < min_count).select(by)
    return df.join(rare, by, "left_anti" if complement else "left_semi")


# ---------------------------------------------------------------- W6 / W7

def _quotas(classes: DataFrame, fracs: list[float]) -> DataFrame:
    """(cls_, end_0, end_1, ...): how many rows of a class the stages up to each have taken.

    Each stage takes ``frac`` of what the stages before left, by largest remainder over the
    classes with two such rows or more (the class table is small)."""
    everywhere = Window.partitionBy()
    c = classes.withColumn("taken", F.lit(0).cast("long"))
    for k, frac in enumerate(fracs):
        left = F.col("n_c") - F.col("taken")
        c = c.withColumn("left", F.when(left >= 2, left).otherwise(0)).withColumn("n", F.sum("left").over(everywhere))
        c = c.withColumn("t", F.ceil(F.lit(frac) * F.col("n")).cast("long"))
        c = c.withColumn("q", F.coalesce(F.floor(F.try_divide(F.col("left") * F.col("t"), F.col("n"))).cast("long"), F.lit(0))) \
             .withColumn("rem", F.when(F.col("n") > 0, (F.col("left") * F.col("t")) % F.greatest(F.col("n"), F.lit(1))))
        by_remainder = Window.orderBy((F.col("left") > 0).desc(), F.col("rem").desc(), F.col("cls_"))
        c = c.withColumn("more", (F.row_number().over(by_remainder) <= F.col("t") - F.sum("q").over(everywhere)) & (F.col("left") > 0))
        c = c.withColumn("taken", F.col("taken") + F.col("q") + F.col("more").cast("long")).withColumn(f"end_{k}", F.col("taken"))
    return c.select("cls_", *[f"end_{k}" for k in range(len(fracs))])


def _cuts(keys: DataFrame, fracs: list[float]) -> DataFrame:
    """(cls_, cut_0, cut_1, ...): the last (hash, id) that each stage takes of a class, null if none, from
    (cls_, h_, id_). One row a class."""
    keys = keys.withColumn("b_", F.conv(F.substring("h_", 1, 4), 16, 10).cast("int"))
    histogram = keys.groupBy("cls_", "b_").agg(F.count("*").alias("nb"))
    quotas = _quotas(histogram.groupBy("cls_").agg(F.sum("nb").alias("n_c")), fracs)
    upto = Window.partitionBy("cls_").orderBy("b_").rowsBetween(Window.unboundedPreceding, 0)
    filled = histogram.withColumn("cum", F.sum("nb").over(upto)).join(quotas, "cls_")
    ends = filled.select("cls_", "b_", "nb", "cum", F.posexplode(F.array(*[f"end_{k}" for k in range(len(fracs))])).alias("stage", "end"))
    boundary = checked_broadcast(ends.where((F.col("cum") >= F.col("end")) & (F.col("cum") - F.col("nb") < F.col("end"))).select(
        "cls_", "b_", "stage", (F.col("end") - F.col("cum") + F.col("nb")).alias("need")))
    at_boundary = keys.join(boundary, ["cls_", "b_"])
    rank = F.row_number().over(Window.partitionBy("cls_", "b_", "stage").orderBy("h_", "id_"))
    last = at_boundary.withColumn("rank", rank).where(F.col("rank") == F.col("need"))
    return last.groupBy("cls_").agg(*[F.max(F.when(F.col("stage") == k, F.struct("h_", "id_"))).alias(f"cut_{k}") for k in range(len(fracs))])


def _staged(df: DataFrame, by: str, fracs: list[float], seed: int, id_col: str) -> tuple[DataFrame, list]:
    """``df`` with the cuts of its classes, and for each stage whether it has taken a row by then."""
    cls = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))      # NULL is a class of its own
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    cuts = checked_broadcast(_cuts(df.select(cls.alias("cls_"), h.alias("h_"), F.col(id_col).alias("id_")), fracs))
    rows = df.withColumn("cls_", cls).join(cuts, "cls_", "left")
    place = F.struct(h.alias("h_"), F.col(id_col).alias("id_"))
    # a stage that took none of a class ends where the one before ended
    return rows, [F.coalesce(place <= F.coalesce(*[F.col(f"cut_{j}") for j in range(k, -1, -1)]), F.lit(False)) for k in range(len(fracs))]


def stratified_split(df: DataFrame, by: str = "path_list", frac: float = 0.2, seed: int = 42,
                     id_col: str = "offer_id", out: str = "is_test") -> DataFrame:
    """Flag ``frac`` of the rows as test, stratified by ``by`` (see module doc)."""
    rows, (taken,) = _staged(df, by, [frac], seed, id_col)
    return rows.select(*df.columns, taken.alias(out))


def train_validate_test(df: DataFrame, by: str = "path_list", seed: int = 42,
                        id_col: str = "offer_id", presplit: str | None = None) -> DataFrame:
    """80/20 train/test, then train 80/20 train/validate (64/16/20): both stages from one histogram.

    ``presplit`` names a column already holding 'train'/'test' (sources that come
    split skip the first stage)."""
    if presplit is not None:
        first = df.withColumn("split", F.col(presplit))
        rows, (validate,) = _staged(first.where(F.col("split") == "train"), by, [0.2], seed, id_col)
        second = rows.select(*[c for c in first.columns if c != "split"], F.when(validate, "validate").otherwise("train").alias("split"))
        return second.unionByName(first.where(~F.col("split").eqNullSafe("train")))
    rows, (test, held) = _staged(df, by, [0.2, 0.2], seed, id_col)
    return rows.select(*[c for c in df.columns if c != "split"], F.when(test, "test").when(held, "validate").otherwise("train").alias("split"))


def splits(df: DataFrame, names: list[str], split: str = "split") -> DataFrame:
    """The rows of some splits of a split table (one table, no file per split)."""
    return df.where(F.col(split).isin(*names))
