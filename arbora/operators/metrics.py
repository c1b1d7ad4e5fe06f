"""Flat, per-level and hierarchical scores of predictions.

Input is an item table with a truth node id and a predicted node id per row
(plus optional grouping keys such as run, seed or split). Items never leave the
executors: every item contributes a handful of counter rows that are summed with
map-side partial aggregation into at most ``(levels + 2) x labels`` rows per key,
and only those small count tables go through the closing formulas.

Conventions follow the usual weighted/macro definitions over the union of truth
and predicted labels, with 0 wherever a denominator is 0:
P = tp/np, R = tp/sup, F1 = 2tp/(np+sup); weighted = sum(sup * x) / sum(sup).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arbora.operators.guards import checked_broadcast, keep
from arbora.operators.taxonomy import depth_of, scorer_path, with_paths

# Fixed metric names of the bundle (values must match the reference's report keys).
LEAF_METRICS = ["leaf_weighted_prec", "leaf_weighted_rec", "leaf_weighted_f1", "leaf_macro_f1"]
H_METRIC = "h_f1"
LEVEL_METRIC = "{avg}_{m}_lvl_{k}"          # e.g. weighted_prec_lvl_1
AVERAGE_METRIC = "average_{avg}_{m}"         # e.g. average_macro_f1

_COUNT = "struct<scope:string,label:int,tp:bigint,sup:bigint,np:bigint>"


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _contrib(scope: Column, label: Column, tp: Column, sup: Column, np_: Column) -> Column:
    return F.struct(scope.alias("scope"), label.cast("int").alias("label"),
                    tp.cast("long").alias("tp"), sup.cast("long").alias("sup"),
                    np_.cast("long").alias("np"))


# ---------------------------------------------------------------- M1 / M2 / U5

def confusion(df: DataFrame, label: str, pred: str, keys: list[str] | tuple = ()) -> DataFrame:
    """Per label (truth ∪ prediction) the counts tp, sup and np."""
    k = list(keys)
    rows = df.select(*k, F.inline(F.array(
        F.struct(F.col(label).alias("l"), (F.col(label) == F.col(pred)).cast("long").alias("tp"),
                 F.lit(1).cast("long").alias("sup"), F.lit(0).cast("long").alias("np")),
        F.struct(F.col(pred).alias("l"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("sup"), F.lit(1).cast("long").alias("np")))))
    return (rows.groupBy(*k, "l").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"),
                                      F.sum("np").alias("np"))
                .withColumnRenamed("l", "label"))


def per_label(counts: DataFrame) -> DataFrame:
    """Per-label precision, recall and F1 from confusion counts."""
    return counts.select(
        "*",
        _safe_div(F.col("tp"), F.col("np")).alias("prec"),
        _safe_div(F.col("tp"), F.col("sup")).alias("rec"),
        _safe_div(2 * F.col("tp"), F.col("np") + F.col("sup")).alias("f1"))


def prf(counts: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """M2/M3: weighted and macro P/R/F1 per key from confusion counts."""
    pl = per_label(counts)
    sup = F.sum("sup")
    return pl.groupBy(*keys).agg(
        _safe_div(F.sum(F.col("sup") * F.col("prec")), sup).alias("weighted_prec"),
        _safe_div(F.sum("tp"), sup).alias("weighted_rec"),
        _safe_div(F.sum(F.col("sup") * F.col("f1")), sup).alias("weighted_f1"),
        F.avg("prec").alias("macro_prec"),
        F.avg("rec").alias("macro_rec"),
        F.avg("f1").alias("macro_f1"),
        F.count("*").cast("long").alias("n_labels"))


# ---------------------------------------------------------------- paths

def attach_paths(items: DataFrame, nodes: DataFrame, label: str = "label_id",
                 pred: str = "pred_id") -> DataFrame:
    """Add ``label_path`` / ``pred_path`` (scorer variant: root -> [root])
    through two broadcast lookups of the (size-checked) path table."""
    paths = checked_broadcast(with_paths(nodes).select("id", "path"), bound=nodes)
    lp = paths.select(F.col("id").alias(label), F.col("path").alias("label_path"))
    pp = paths.select(F.col("id").alias(pred), F.col("path").alias("pred_path"))
    out = items.join(lp, label, "left").join(pp, pred, "left")
    # unknown ids have no path: a level path of their own, and an empty hierarchical set
    out = out.withColumns({"label_known": F.col("label_path").isNotNull(), "pred_known": F.col("pred_path").isNotNull()})
    return (out.withColumn("label_path", scorer_path(F.coalesce("label_path", F.array().cast("array<int>")), F.col(label)))
               .withColumn("pred_path", scorer_path(F.coalesce("pred_path", F.array().cast("array<int>")), F.col(pred))))


def _h_set(path: Column, compat: bool) -> Column:
    """Ancestor-augmented label set for hF1 (root and unknown -> empty).

    A scorer path holds the root (0) only as the single-element out-of-category
    path, so dropping it needs no element-wise function."""
    clean = F.when((F.size(path) == 1) & (F.element_at(path, 1) <= 0),
                   F.array().cast("array<int>")).otherwise(path)
    if compat:
        # Q1: the first top-level node (id 1) merges with the root, so it is never
        # an ancestor of another node; as a label of its own it still counts.
        n = F.size(clean)
        clean = F.filter(clean, lambda x, i: (x != 1) | (i == n - 1))
    return clean


def level_counts(items: DataFrame, nodes: DataFrame, keys: list[str] | tuple = (),
                 label: str = "label_id", pred: str = "pred_id",
                 compat: bool = False) -> DataFrame:
    """Counter rows for leaf, per-level and hierarchical scopes, summed per
    (keys, scope, label).

    Every metric is a function of the (truth, prediction) pair, so items are
    first reduced to distinct pairs with a count (a partially aggregated
    group-by on integers); paths are attached to pairs, not items. Each pair then
    yields ``3 + 2 * depth`` counter rows by exploding a constant index array and
    selecting fields with ``CASE`` expressions, which keeps the pass inside
    whole-stage code generation (the tree depth comes from the small node table).
    """
    k = list(keys)
    n_nodes = nodes.select(F.count("*").cast("int")).scalar()
    max_depth = depth_of(nodes) or 1
    pairs = items.groupBy(*k, label, pred).agg(F.count("*").alias("n_"))
    withp = attach_paths(pairs, nodes, label, pred).withColumn("dummy_", (n_nodes + F.lit(1)).cast("int"))
    lab, prd, w = F.col(label), F.col(pred), F.col("n_")
    lpath, ppath = F.col("label_path"), F.col("pred_path")
    lt, lp_ = F.size(lpath), F.size(ppath)
    n = F.greatest(lt, lp_)
    none = F.array().cast("array<int>")
    ht = F.when(F.col("label_known"), _h_set(lpath, compat)).otherwise(none)
    hp = F.when(F.col("pred_known"), _h_set(ppath, compat)).otherwise(none)
    i = F.col("i_")
    # index layout: 0 leaf truth, 1 leaf prediction, 2 hierarchical, then per level (truth, prediction)
    lvl = F.floor((i - 3) / 2) + 1
    is_pred = ((i - 3) % 2) == 1
    lab_k = F.when(lvl <= lt, F.element_at(lpath, lvl.cast("int"))).otherwise(F.col("dummy_"))
    prd_k = F.when(lvl <= lp_, F.element_at(ppath, lvl.cast("int"))).otherwise(F.col("dummy_"))
    code = (F.when(i <= 1, F.lit(0)).when(i == 2, F.lit(-1))
             .when(lvl <= n, lvl.cast("int")))                 # NULL: level not reached
    lab_out = (F.when(i == 0, lab).when(i == 1, prd).when(i == 2, F.lit(-1))
                .when(is_pred, prd_k).otherwise(lab_k))
    hit = F.when(i <= 1, lab == prd).otherwise(lab_k == prd_k).cast("long")
    truth_row = (i == 0) | ((i >= 3) & ~is_pred)
    tp = (F.when(i == 2, F.size(F.array_intersect(ht, hp)).cast("long"))
           .when(truth_row, hit).otherwise(F.lit(0).cast("long"))) * w
    sup = (F.when(i == 2, F.size(ht).cast("long")).when(truth_row, F.lit(1).cast("long"))
            .otherwise(F.lit(0).cast("long"))) * w
    np_ = (F.when(i == 2, F.size(hp).cast("long")).when(truth_row, F.lit(0).cast("long"))
            .otherwise(F.lit(1).cast("long"))) * w
    idx = F.explode(F.array(*[F.lit(x) for x in range(3 + 2 * max_depth)]))
    rows = (withp.select(*k, label, pred, "label_path", "pred_path", "label_known", "pred_known", "dummy_", "n_", idx.alias("i_"))
                 .select(*k, code.alias("code"), lab_out.cast("int").alias("label"), tp.alias("tp"),
                         sup.alias("sup"), np_.alias("np"))
                 .where(F.col("code").isNotNull()))
    counted = rows.groupBy(*k, "code", "label").agg(
        F.sum("tp").alias("tp"), F.sum("sup").alias("sup"), F.sum("np").alias("np"))
    scope = (F.when(F.col("code") == 0, F.lit("leaf")).when(F.col("code") == -1, F.lit("h"))
              .otherwise(F.concat(F.lit("lvl_"), F.col("code").cast("string"))))
    return counted.select(*k, scope.alias("scope"), "label", "tp", "sup", "np")


def hierarchical_f(counts: DataFrame, keys: list[str] | tuple = (), beta: float = 1.0) -> DataFrame:
    """M4/M5: micro hierarchical precision, recall and F-beta from the ``h`` scope."""
    h = counts.where(F.col("scope") == "h").groupBy(*keys).agg(
        _safe_div(F.sum("tp"), F.sum("np")).alias("h_prec"),
        _safe_div(F.sum("tp"), F.sum("sup")).alias("h_rec"))
    b2 = beta * beta
    return h.withColumn("h_fbeta", _safe_div((1 + b2) * F.col("h_prec") * F.col("h_rec"),
                                             b2 * F.col("h_prec") + F.col("h_rec")))


def bundle(items: DataFrame, nodes: DataFrame, keys: list[str] | tuple = (),
           label: str = "label_id", pred: str = "pred_id", compat: bool = False) -> DataFrame:
    """The full metric bundle as long rows ``(keys..., metric, value)``.

    The only pass over the items is :func:`level_counts`; its result has at most
    ``(levels + 2) x labels`` rows per key and is persisted, so every metric
    below is computed from that small table.
    """
    k = list(keys)
    counts = keep(level_counts(items, nodes, k, label, pred, compat))  # one pass over the items, read by every metric
    scored = prf(counts.where(F.col("scope") != "h"), k + ["scope"])
    hier = hierarchical_f(counts, k)
    metric_cols = [f"{avg}_{m}" for avg in ("weighted", "macro") for m in ("prec", "rec", "f1")]

    leaf = scored.where(F.col("scope") == "leaf").select(*k, F.inline(F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value"))
          for n, c in zip(LEAF_METRICS, ["weighted_prec", "weighted_rec", "weighted_f1", "macro_f1"])])))
    h = hier.select(*k, F.lit(H_METRIC).alias("metric"), F.col("h_fbeta").alias("value"))
    lv = scored.where(F.col("scope") != "leaf")
    level_rows = lv.select(*k, F.inline(F.array(*[
        F.struct(F.concat(F.lit(c + "_"), F.col("scope")).alias("metric"), F.col(c).alias("value"))
        for c in metric_cols])))
    avg_rows = lv.groupBy(*k).agg(*[F.avg(c).alias(c) for c in metric_cols]).select(
        *k, F.inline(F.array(*[
            F.struct(F.lit(AVERAGE_METRIC.format(avg=c.split("_")[0], m=c.split("_")[1])).alias("metric"),
                     F.col(c).alias("value")) for c in metric_cols])))
    return leaf.unionByName(h).unionByName(level_rows).unionByName(avg_rows)


def leaf_scores(items: DataFrame, label: str, pred: str, keys: list[str] | tuple = ()) -> DataFrame:
    """M2 on name or id labels without a taxonomy: weighted P/R/F1 and macro F1."""
    return prf(confusion(items, label, pred, keys), keys)


def drop_padding(df: DataFrame, label: str = "label", fill: int = -1) -> DataFrame:
    """drop padding labels before scoring a level."""
    return df.where(F.col(label) != fill)


# ---------------------------------------------------------------- A8

def loss_summary(scored: DataFrame, p: str = "p", keys: list[str] | tuple = (),
                 alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Mean cross-entropy, focal loss and perplexity over a table holding the
    probability ``p`` assigned to the true class of every item. An item whose true class
    got probability 0 has an infinite loss, and so has its table."""
    nll = F.when(F.col(p) == 0, F.lit(float("inf"))).otherwise(-F.ln(F.col(p)))
    return scored.groupBy(*keys).agg(
        F.avg(nll).alias("mean_loss"),
        F.avg(F.lit(alpha) * F.pow(1 - F.col(p), F.lit(gamma)) * nll).alias("focal_loss"),
        F.exp(F.avg(nll)).alias("perplexity"),
        F.count("*").cast("long").alias("n_items"))


# ---------------------------------------------------------------- M10

def level_columns(items: DataFrame, nodes: DataFrame, levels: int, label: str = "label_id",
                  pred: str = "pred_id") -> DataFrame:
    """Per-level label and prediction columns plus correctness flags."""
    withp = attach_paths(items, nodes, label, pred)
    cols = []
    for k in range(1, levels + 1):
        lk = F.try_element_at("label_path", F.lit(k))
        pk = F.try_element_at("pred_path", F.lit(k))
        cols += [lk.alias(f"label_lvl_{k}"), pk.alias(f"pred_lvl_{k}"),
                 F.coalesce(lk == pk, F.lit(False)).alias(f"correct_{k}")]
    return withp.select(*[c for c in items.columns], *cols)
