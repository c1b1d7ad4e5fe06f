"""Language-model corpora from offers.

Corpus lines are column expressions over offer rows (``explode`` of the lines a
row yields), so building a corpus is one projection per variant. Token packing
(L5) never concatenates a batch in one place: every text is cut into the pieces
that fall into each fixed-length block, and blocks are assembled by a group-by
on (batch, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arbora.functions import text as tf
from arbora.operators.guards import checked_broadcast

# ---------------------------------------------------------------- fixed values
FLAG_ORDER = ["category", "category_reverse", "description", "multiple_rows", "additional_ds"]
MASK_TOKEN = "<mask>"
DEFAULT_CONFIG = {"category": True, "category_reverse": False, "description": True,
                  "multiple_rows": True, "additional_ds": True}


def variant_name(config: dict, suffix: str | None = None) -> str:
    """L3: ``title`` followed by every enabled flag (and the extra corpus suffix)."""
    name = "title"
    for k in FLAG_ORDER:
        if config.get(k):
            name = f"{name}_{k}"
    if suffix is not None and config.get("additional_ds"):
        name = f"{name}_{suffix}"
    return name


def _join_line(line: Column, part: Column) -> Column:
    return F.concat(line, F.lit(" - "), part)


def _categories(cats: Column, reverse: bool) -> Column:
    return tf.reverse_join(cats, " ", reverse)


def _lines_from_parts(t: Column, cats: Column, desc: Column, config: dict) -> list[Column]:
    """L1 line layout from already-cleaned parts (title, category array, description)."""
    lines = []
    line = t
    if config.get("category"):
        new = _join_line(line, _categories(cats, config.get("category_reverse", False)))
        if config.get("multiple_rows"):
            lines.append(new)
        else:
            line = new
    if config.get("description"):
        new = _join_line(line, desc)
        if config.get("multiple_rows"):
            lines.append(new)
        else:
            line = new
    if not config.get("multiple_rows"):
        lines.append(line)
    return lines


def _extra_lines_from_parts(t: Column, cats: Column, has_desc: Column, desc: Column, config: dict) -> list[Column]:
    lines = []
    line = t
    if config.get("category"):
        new = F.when(F.size(cats) > 0, _join_line(line, _categories(cats, config.get("category_reverse", False))))
        if config.get("multiple_rows"):
            lines.append(new)
        else:
            line = F.coalesce(new, line)
    if config.get("description"):
        new = F.when(has_desc, _join_line(line, desc))
        if config.get("multiple_rows"):
            lines.append(new)
        else:
            line = F.coalesce(new, line)
    lines.append(line)
    return lines


def _extra_parts(extra: DataFrame) -> DataFrame:
    def present(c):
        return F.when(F.length(F.col(c)) > 0, F.col(c))
    return extra.select(
        tf.preprocess(F.col("Title")).alias("t_"),
        F.filter(F.array(present("Category"), present("Breadcrumb"), present("BreadcrumbList")),
                 lambda x: x.isNotNull()).alias("cats_"),
        present("Description").isNotNull().alias("has_desc_"),
        tf.clean_sentences(F.col("Description")).alias("desc_"))


def corpus(offers: DataFrame, configs: list[dict], extra: DataFrame | None = None,
           split: str = "split", suffix: str | None = None, title: str = "title",
           path_list: str = "path_list", description: str = "description",
           compat_labels: bool = False) -> DataFrame:
    """L1-L4: ``(split, variant, line)`` for every config; the additional corpus is
    added once to the train split of variants that ask for it (an absent table
    adds nothing).

    Title, categories and description are cleaned once per offer; every
    variant's lines are then concatenations of those columns, emitted by one
    explode, so adding variants does not repeat the text cleaning."""
    parts = offers.select(
        F.col(split).alias("split"), tf.preprocess(F.col(title)).alias("t_"),
        F.transform(tf.path_labels(F.col(path_list), compat_labels), lambda x: tf.preprocess(x)).alias("cats_"),
        tf.clean_sentences(F.col(description)).alias("desc_"))
    t, cats, desc = F.col("t_"), F.col("cats_"), F.col("desc_")
    entries = [F.struct(F.lit(variant_name(cfg, suffix)).alias("variant"), ln.alias("line"))
               for cfg in configs for ln in _lines_from_parts(t, cats, desc, cfg)]
    out = parts.select("split", F.inline(F.array(*entries))).where(F.col("line").isNotNull())
    extra_cfgs = [cfg for cfg in configs if cfg.get("additional_ds")]
    if extra is not None and extra_cfgs:
        ep = _extra_parts(extra)
        e_entries = [F.struct(F.lit(variant_name(cfg, suffix)).alias("variant"), ln.alias("line"))
                     for cfg in extra_cfgs
                     for ln in _extra_lines_from_parts(F.col("t_"), F.col("cats_"), F.col("has_desc_"),
                                                       F.col("desc_"), cfg)]
        out = out.unionByName(ep.select(F.lit("train").alias("split"), F.inline(F.array(*e_entries)))
                              .where(F.col("line").isNotNull()))
    return out


# ---------------------------------------------------------------- L5 / L6 / F8

#: Rows that are numbered in one task, and tokens that one task of a packing holds.
INDEX_ROWS, PACK_TOKENS = 1 << 20, 1 << 22


def row_index(df: DataFrame, order: str, rows_per_bucket: int = INDEX_ROWS) -> DataFrame:
    """Dense 0-based position of every row under a numeric, unique ``order`` key,
    without a single-task sort.

    The rows are counted, and approximate quantiles of the key (one for every
    ``rows_per_bucket`` rows, the only thing brought to the driver) cut them into ordered
    buckets of about that size; the small per-bucket count table gives every bucket its
    prefix offset, and rows are numbered inside their bucket. Bucket boundaries come from the
    data, not from physical partitions, so the result does not depend on how a stage was split.
    """
    from pyspark.ml.feature import Bucketizer
    buckets = -(-df.count() // rows_per_bucket)
    probs = [i / buckets for i in range(1, buckets)]
    key = F.col(order).cast("double")
    qs = (df.select(F.percentile_approx(key, probs, 10 * buckets)).first()[0] or []) if probs else []
    splits = [float("-inf")] + sorted(set(q for q in qs if q is not None)) + [float("inf")]
    b = df.withColumn("k_", key)
    b = (Bucketizer(splits=splits, inputCol="k_", outputCol="bkt_", handleInvalid="keep").transform(b) if len(splits) > 2
         else b.withColumn("bkt_", F.lit(0.0)))
    counts = b.groupBy("bkt_").agg(F.count("*").alias("c_"))
    offsets = counts.select("bkt_", F.coalesce(F.sum("c_").over(Window.orderBy("bkt_").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("off_"))
    b = b.join(checked_broadcast(offsets), "bkt_")
    rn = F.row_number().over(Window.partitionBy("bkt_").orderBy(order))
    return b.withColumn("idx", (F.col("off_") + rn - 1).cast("long")).drop("bkt_", "off_", "k_")


def pack_tokens(df: DataFrame, order: str, tokens: str = "tokens", block: int = 128,
                batch: int = 1000, tokens_per_task: int = PACK_TOKENS, rows_per_bucket: int = INDEX_ROWS) -> DataFrame:
    """Concatenate the token lists of every ``batch`` consecutive texts, cut
    into blocks of ``block`` tokens, drop each batch's remainder.

    Returns ``(batch, block, tokens)``; each text contributes the slice of its
    tokens that lands in each block it overlaps. ``order`` is unique.

    Texts are numbered and their offsets summed up on their lengths alone. Token lists move
    twice, to their places and to their blocks, dealt by hash to as many tasks as leave
    each about ``tokens_per_task`` tokens (a longer text is one task's).
    """
    texts = df.select(order, tokens)
    lengths = texts.select(order, F.size(tokens).alias("n_"))
    total = lengths.agg(F.sum(F.greatest("n_", F.lit(0)))).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // tokens_per_task))
    x = row_index(lengths, order, rows_per_bucket).withColumn("batch", F.floor(F.col("idx") / batch))
    w = Window.partitionBy("batch").orderBy("idx")
    x = x.withColumn("off_", F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
         .withColumn("tot_", F.sum("n_").over(Window.partitionBy("batch")))
    full = F.floor(F.col("tot_") / block) * block           # tokens kept in this batch
    x = x.withColumn("full_", full).where((F.col("off_") < F.col("full_")) & (F.col("n_") > 0)).drop("tot_")
    first_b = F.floor(F.col("off_") / block)
    last_b = F.floor((F.least(F.col("off_") + F.col("n_"), F.col("full_")) - 1) / block)
    x = texts.repartition(tasks, order).join(x.repartition(tasks, order), order).withColumn("blk", F.explode(F.sequence(first_b, last_b)))
    start = F.greatest(F.col("blk") * block, F.col("off_"))
    end = F.least((F.col("blk") + 1) * block, F.col("off_") + F.col("n_"))
    pieces = x.select("batch", "blk", "idx",
                      F.slice(tokens, (start - F.col("off_") + 1).cast("int"), (end - start).cast("int")).alias("piece"))
    return (pieces.repartition(tasks, "batch", "blk").groupBy("batch", "blk")
                  .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("idx", "piece"))),
                                             lambda s: s["piece"])).alias("tokens"))
                  .withColumnRenamed("blk", "block"))


def nonblank_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """F8: one row per non-blank line of a text, with its line number."""
    return (df.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
              .where(F.length(F.regexp_replace(F.col("line"), r"\s", "")) > 0))


def truncate_tokens(line: Column, max_tokens: int) -> Column:
    """Whitespace tokens of a line, cut to ``max_tokens``."""
    toks = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    return F.slice(toks, 1, max_tokens)


def mask_tokens(tokens: Column, row_id: Column, p: float = 0.15, seed: int = 42) -> tuple[Column, Column]:
    """Replace each token with ``<mask>`` with probability ``p`` (decided by
    md5 of ``seed|row|position``, so it is reproducible anywhere); returns the
    masked tokens and the labels (the original token where masked, else NULL)."""
    below = round(p * 16 ** 4)

    def masked(i):
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"), i.cast("string")))
        return F.conv(F.substring(h, 1, 4), 16, 10).cast("int") < below
    toks = F.transform(tokens, lambda t, i: F.when(masked(i), F.lit(MASK_TOKEN)).otherwise(t))
    labels = F.transform(tokens, lambda t, i: F.when(masked(i), t))
    return toks, labels


def labelled_text(title: Column, label: Column) -> Column:
    """fastText-style line ``title __label__<label with underscores>``."""
    return F.concat_ws(" ", title, F.concat(F.lit("__label__"), F.replace(label, F.lit(" "), F.lit("_"))))
