"""Metric queries over lineitem predictions on the T2 taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import metrics as m
from arbora.operators import taxonomy as tx
from arbora.plans import standins as st
from arbora.plans.q_taxonomy import _SQL_DEEP, _deep_edges
from arbora.plans.registry import query
from arbora.session import table

R = 6  # decimals kept for double results on both sides


def _r(c):
    return F.round(F.col(c), R).alias(c)


_PRED_BASE = "WITH RECURSIVE " + st.SQL_T2_NODES + "," + st.SQL_PREDICTIONS

_WITHP = """,
withp AS (
  SELECT i.*,
         CASE WHEN coalesce(len(pl.path), 0) = 0 THEN [i.label_id] ELSE pl.path END AS lp,
         CASE WHEN coalesce(len(pp.path), 0) = 0 THEN [i.pred_id] ELSE pp.path END AS pp
  FROM items i LEFT JOIN t2_paths pl ON pl.id = i.label_id LEFT JOIN t2_paths pp ON pp.id = i.pred_id
)"""

_COUNTS = _WITHP + """,
lv AS (
  SELECT k, coalesce(lp[k], (SELECT count(*) FROM t2_nodes) + 1) AS lab,
            coalesce(pp[k], (SELECT count(*) FROM t2_nodes) + 1) AS prd
  FROM (SELECT unnest(range(1, greatest(len(lp), len(pp)) + 1)) AS k, lp, pp FROM withp)
),
hs AS (
  SELECT list_filter(lp, lambda x: x > 0) AS ht, list_filter(pp, lambda x: x > 0) AS hp FROM withp
),
contrib AS (
  SELECT 'leaf' AS scope, label_id AS label, CAST(label_id = pred_id AS BIGINT) AS tp,
         CAST(1 AS BIGINT) AS sup, CAST(0 AS BIGINT) AS np FROM withp
  UNION ALL SELECT 'leaf', pred_id, 0, 0, 1 FROM withp
  UNION ALL SELECT 'h', -1, len(list_intersect(ht, hp)), len(ht), len(hp) FROM hs
  UNION ALL SELECT 'lvl_' || CAST(k AS VARCHAR), lab, CAST(lab = prd AS BIGINT), 1, 0 FROM lv
  UNION ALL SELECT 'lvl_' || CAST(k AS VARCHAR), prd, 0, 0, 1 FROM lv
),
counts AS (
  SELECT scope, label, sum(tp) AS tp, sum(sup) AS sup, sum(np) AS np FROM contrib GROUP BY scope, label
),
pl AS (
  SELECT *, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS prec,
            CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS rec,
            CASE WHEN np + sup = 0 THEN 0.0 ELSE 2 * tp / (np + sup) END AS f1
  FROM counts WHERE scope <> 'h'
),
scored AS (
  SELECT scope,
         sum(sup * prec) / sum(sup) AS weighted_prec, sum(tp) / sum(sup) AS weighted_rec,
         sum(sup * f1) / sum(sup) AS weighted_f1,
         avg(prec) AS macro_prec, avg(rec) AS macro_rec, avg(f1) AS macro_f1
  FROM pl GROUP BY scope
),
hier AS (
  SELECT sum(tp) / sum(np) AS h_prec, sum(tp) / sum(sup) AS h_rec FROM counts WHERE scope = 'h'
)"""


@query("metrics_bundle_t2", _PRED_BASE + _COUNTS + """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'leaf_weighted_prec' AS metric, weighted_prec AS value FROM scored WHERE scope = 'leaf'
  UNION ALL SELECT 'leaf_weighted_rec', weighted_rec FROM scored WHERE scope = 'leaf'
  UNION ALL SELECT 'leaf_weighted_f1', weighted_f1 FROM scored WHERE scope = 'leaf'
  UNION ALL SELECT 'leaf_macro_f1', macro_f1 FROM scored WHERE scope = 'leaf'
  UNION ALL SELECT 'h_f1', CASE WHEN h_prec + h_rec = 0 THEN 0.0
                                ELSE 2 * h_prec * h_rec / (h_prec + h_rec) END FROM hier
  UNION ALL SELECT 'weighted_prec_' || scope, weighted_prec FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'weighted_rec_' || scope, weighted_rec FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'weighted_f1_' || scope, weighted_f1 FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'macro_prec_' || scope, macro_prec FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'macro_rec_' || scope, macro_rec FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'macro_f1_' || scope, macro_f1 FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'average_weighted_prec', avg(weighted_prec) FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'average_weighted_rec', avg(weighted_rec) FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'average_weighted_f1', avg(weighted_f1) FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'average_macro_prec', avg(macro_prec) FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'average_macro_rec', avg(macro_rec) FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT 'average_macro_f1', avg(macro_f1) FROM scored WHERE scope <> 'leaf'
)
""")
def metrics_bundle_t2(spark, sf):
    """M9: the full leaf / hierarchical / per-level / average bundle."""
    nodes = st.t2_nodes(spark, sf)
    items = st.lineitem_predictions(spark, sf, nodes)
    return m.bundle(items, nodes).select("metric", _r("value"))


@query("metrics_level_counts_t2", _PRED_BASE + _COUNTS + """
SELECT scope, CAST(label AS INTEGER) AS label, CAST(tp AS BIGINT) AS tp, CAST(sup AS BIGINT) AS sup,
       CAST(np AS BIGINT) AS np FROM counts
""")
def metrics_level_counts_t2(spark, sf):
    """Confusion counts per scope (leaf, lvl_k, h) and label."""
    nodes = st.t2_nodes(spark, sf)
    items = st.lineitem_predictions(spark, sf, nodes)
    return m.level_counts(items, nodes).select("scope", "label", "tp", "sup", "np")


@query("metrics_prf_by_scope_t2", _PRED_BASE + _COUNTS + """
SELECT scope, round(weighted_prec, 6) AS weighted_prec, round(weighted_rec, 6) AS weighted_rec,
       round(weighted_f1, 6) AS weighted_f1, round(macro_prec, 6) AS macro_prec,
       round(macro_rec, 6) AS macro_rec, round(macro_f1, 6) AS macro_f1
FROM scored
""")
def metrics_prf_by_scope_t2(spark, sf):
    """M2/M3/M7: weighted and macro P/R/F1 per scope."""
    nodes = st.t2_nodes(spark, sf)
    items = st.lineitem_predictions(spark, sf, nodes)
    c = m.level_counts(items, nodes).where(F.col("scope") != "h")
    s = m.prf(c, ["scope"])
    return s.select("scope", *[_r(x) for x in ["weighted_prec", "weighted_rec", "weighted_f1",
                                                "macro_prec", "macro_rec", "macro_f1"]])


@query("metrics_hierarchical_t2", _PRED_BASE + _WITHP + """,
hs AS (SELECT list_filter(lp, lambda x: x > 0) AS ht, list_filter(pp, lambda x: x > 0) AS hp FROM withp),
cnt AS (SELECT sum(len(list_intersect(ht, hp))) AS tp, sum(len(ht)) AS sup, sum(len(hp)) AS np FROM hs),
pr AS (SELECT tp / np AS h_prec, tp / sup AS h_rec, tp, sup, np FROM cnt)
SELECT CAST(tp AS BIGINT) AS tp, CAST(sup AS BIGINT) AS n_true, CAST(np AS BIGINT) AS n_pred,
       round(h_prec, 6) AS h_prec, round(h_rec, 6) AS h_rec,
       round(CASE WHEN h_prec + h_rec = 0 THEN 0.0 ELSE 2 * h_prec * h_rec / (h_prec + h_rec) END, 6) AS h_f1
FROM pr
""")
def metrics_hierarchical_t2(spark, sf):
    """M4/M5: micro hierarchical precision / recall / F1 via path intersection."""
    nodes = st.t2_nodes(spark, sf)
    items = st.lineitem_predictions(spark, sf, nodes)
    c = m.level_counts(items, nodes).where(F.col("scope") == "h")
    tot = c.agg(F.sum("tp").cast("long").alias("tp"), F.sum("sup").cast("long").alias("n_true"),
                F.sum("np").cast("long").alias("n_pred"))
    hp = F.try_divide(F.col("tp").cast("double"), F.col("n_pred"))
    hr = F.try_divide(F.col("tp").cast("double"), F.col("n_true"))
    return tot.select("tp", "n_true", "n_pred", F.round(hp, R).alias("h_prec"), F.round(hr, R).alias("h_rec"),
                      F.round(F.coalesce(F.try_divide(2 * hp * hr, hp + hr), F.lit(0.0)), R).alias("h_f1"))


@query("metrics_level_columns_t2", _PRED_BASE + _WITHP + """
SELECT l_orderkey, l_linenumber, label_id, pred_id,
       lp[1] AS label_lvl_1, pp[1] AS pred_lvl_1, coalesce(lp[1] = pp[1], false) AS correct_1,
       lp[2] AS label_lvl_2, pp[2] AS pred_lvl_2, coalesce(lp[2] = pp[2], false) AS correct_2,
       lp[3] AS label_lvl_3, pp[3] AS pred_lvl_3, coalesce(lp[3] = pp[3], false) AS correct_3
FROM withp
""")
def metrics_level_columns_t2(spark, sf):
    """Wide per-level label/prediction columns and correctness flags."""
    nodes = st.t2_nodes(spark, sf)
    items = st.lineitem_predictions(spark, sf, nodes).select(
        "l_orderkey", "l_linenumber", "label_id", "pred_id")
    return m.level_columns(items, nodes, 3)


@query("metrics_loss_summary", """
WITH s AS (SELECT l_returnflag, 1 / (1 + exp(-(l_quantity - 25) / 10)) AS p FROM lineitem)
SELECT l_returnflag,
       round(avg(-ln(p)), 6) AS mean_loss,
       round(avg(0.25 * pow(1 - p, 2) * -ln(p)), 6) AS focal_loss,
       round(exp(avg(-ln(p))), 6) AS perplexity,
       CAST(count(*) AS BIGINT) AS n_items
FROM s GROUP BY l_returnflag
""")
def metrics_loss_summary(spark, sf):
    """Mean loss, focal loss (alpha .25, gamma 2) and perplexity; the true-class
    probability is a sigmoid of the line quantity."""
    li = table(spark, sf, "lineitem")
    s = li.select("l_returnflag",
                  (1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 10))).alias("p"))
    out = m.loss_summary(s, "p", ["l_returnflag"])
    return out.select("l_returnflag", _r("mean_loss"), _r("focal_loss"), _r("perplexity"), "n_items")


METRIC_NAMES = (m.LEAF_METRICS + [m.H_METRIC]
                + [f"{a}_{x}_lvl_{k}" for k in (1, 2, 3) for a in ("weighted", "macro") for x in ("prec", "rec", "f1")]
                + [m.AVERAGE_METRIC.format(avg=a, m=x) for a in ("weighted", "macro") for x in ("prec", "rec", "f1")])


def bundle_sql(keys: list[str], nodes: str = "t2_nodes", paths: str = "t2_paths") -> str:
    """CTEs computing the metric bundle per ``keys`` from a CTE
    ``items(keys..., label_id, pred_id)``; ends with ``bundle_long``."""
    k = ", ".join(keys)
    return f""",
withp AS (
  SELECT i.*,
         CASE WHEN coalesce(len(pl.path), 0) = 0 THEN [i.label_id] ELSE pl.path END AS lp,
         CASE WHEN coalesce(len(pp.path), 0) = 0 THEN [i.pred_id] ELSE pp.path END AS pp
  FROM items i LEFT JOIN {paths} pl ON pl.id = i.label_id LEFT JOIN {paths} pp ON pp.id = i.pred_id
),
nn AS (SELECT count(*) + 1 AS dummy FROM {nodes}),
lv AS (
  SELECT {k}, k, coalesce(lp[k], dummy) AS lab, coalesce(pp[k], dummy) AS prd
  FROM (SELECT {k}, unnest(range(1, greatest(len(lp), len(pp)) + 1)) AS k, lp, pp FROM withp), nn
),
hs AS (SELECT {k}, list_filter(lp, lambda x: x > 0) AS ht, list_filter(pp, lambda x: x > 0) AS hp FROM withp),
contrib AS (
  SELECT {k}, 'leaf' AS scope, label_id AS label, CAST(label_id = pred_id AS BIGINT) AS tp,
         CAST(1 AS BIGINT) AS sup, CAST(0 AS BIGINT) AS np FROM withp
  UNION ALL SELECT {k}, 'leaf', pred_id, 0, 0, 1 FROM withp
  UNION ALL SELECT {k}, 'h', -1, len(list_intersect(ht, hp)), len(ht), len(hp) FROM hs
  UNION ALL SELECT {k}, 'lvl_' || CAST(k AS VARCHAR), lab, CAST(lab = prd AS BIGINT), 1, 0 FROM lv
  UNION ALL SELECT {k}, 'lvl_' || CAST(k AS VARCHAR), prd, 0, 0, 1 FROM lv
),
counts AS (SELECT {k}, scope, label, sum(tp) AS tp, sum(sup) AS sup, sum(np) AS np FROM contrib GROUP BY {k}, scope, label),
pl AS (
  SELECT *, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS prec, CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS rec,
            CASE WHEN np + sup = 0 THEN 0.0 ELSE 2 * tp / (np + sup) END AS f1
  FROM counts WHERE scope <> 'h'
),
scored AS (
  SELECT {k}, scope, sum(sup * prec) / sum(sup) AS weighted_prec, sum(tp) / sum(sup) AS weighted_rec,
         sum(sup * f1) / sum(sup) AS weighted_f1, avg(prec) AS macro_prec, avg(rec) AS macro_rec, avg(f1) AS macro_f1
  FROM pl GROUP BY {k}, scope
),
hier AS (SELECT {k}, sum(tp) / sum(np) AS h_prec, sum(tp) / sum(sup) AS h_rec FROM counts WHERE scope = 'h' GROUP BY {k}),
bundle_long AS (
  SELECT {k}, 'leaf_weighted_prec' AS metric, weighted_prec AS value FROM scored WHERE scope = 'leaf'
  UNION ALL SELECT {k}, 'leaf_weighted_rec', weighted_rec FROM scored WHERE scope = 'leaf'
  UNION ALL SELECT {k}, 'leaf_weighted_f1', weighted_f1 FROM scored WHERE scope = 'leaf'
  UNION ALL SELECT {k}, 'leaf_macro_f1', macro_f1 FROM scored WHERE scope = 'leaf'
  UNION ALL SELECT {k}, 'h_f1', CASE WHEN h_prec + h_rec = 0 THEN 0.0 ELSE 2 * h_prec * h_rec / (h_prec + h_rec) END FROM hier
  UNION ALL SELECT {k}, 'weighted_prec_' || scope, weighted_prec FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT {k}, 'weighted_rec_' || scope, weighted_rec FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT {k}, 'weighted_f1_' || scope, weighted_f1 FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT {k}, 'macro_prec_' || scope, macro_prec FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT {k}, 'macro_rec_' || scope, macro_rec FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT {k}, 'macro_f1_' || scope, macro_f1 FROM scored WHERE scope <> 'leaf'
  UNION ALL SELECT {k}, 'average_weighted_prec', avg(weighted_prec) FROM scored WHERE scope <> 'leaf' GROUP BY {k}
  UNION ALL SELECT {k}, 'average_weighted_rec', avg(weighted_rec) FROM scored WHERE scope <> 'leaf' GROUP BY {k}
  UNION ALL SELECT {k}, 'average_weighted_f1', avg(weighted_f1) FROM scored WHERE scope <> 'leaf' GROUP BY {k}
  UNION ALL SELECT {k}, 'average_macro_prec', avg(macro_prec) FROM scored WHERE scope <> 'leaf' GROUP BY {k}
  UNION ALL SELECT {k}, 'average_macro_rec', avg(macro_rec) FROM scored WHERE scope <> 'leaf' GROUP BY {k}
  UNION ALL SELECT {k}, 'average_macro_f1', avg(macro_f1) FROM scored WHERE scope <> 'leaf' GROUP BY {k}
)"""


#: Levels of the ragged part tree that are scored; items whose path ends above are padded there.
PADDED_LEVELS = (1, 15, 30, 45)


@query("metrics_padded_levels_parts", "WITH RECURSIVE " + _SQL_DEEP + f""",
it AS (SELECT l_partkey + 1 AS label_id, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) + 1 AS pred_id FROM lineitem),
lv AS (SELECT k AS level, l.path[k] AS label, coalesce(p.path[k], -1) AS pred
       FROM it JOIN deep_walk l ON l.id = label_id JOIN deep_walk p ON p.id = pred_id, (SELECT unnest({list(PADDED_LEVELS)}) AS k)
       WHERE len(l.path) >= k),
c AS (SELECT level, label, sum(tp) AS tp, sum(sup) AS sup, sum(np) AS np FROM (
        SELECT level, label, CAST(label = pred AS BIGINT) AS tp, 1 AS sup, 0 AS np FROM lv
        UNION ALL SELECT level, pred, 0, 0, 1 FROM lv) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS p, CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS r,
              CASE WHEN np + sup = 0 THEN 0.0 ELSE 2 * tp / (np + sup) END AS f FROM c)
SELECT CAST(level AS INTEGER) AS level, round(sum(sup * p) / sum(sup), 6) AS weighted_prec, round(sum(tp) / sum(sup), 6) AS weighted_rec,
       round(sum(sup * f) / sum(sup), 6) AS weighted_f1, round(avg(f), 6) AS macro_f1
FROM pr GROUP BY level
""")
def metrics_padded_levels_parts(spark, sf):
    """Levels of a ragged tree scored without the items that are padded there."""
    nodes = tx.taxonomy_from_edges(_deep_edges(spark, sf))
    # of a path only the scored levels travel with the pairs
    at = F.array(*[F.coalesce(F.try_element_at("path", F.lit(k)), F.lit(-1)) for k in PADDED_LEVELS])
    nodes = nodes.select("id", at.alias("at"))
    n = table(spark, sf, "part").select(F.count("*")).scalar()
    items = table(spark, sf, "lineitem").select((F.col("l_partkey") + 1).alias("label_id"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n + 1).alias("pred_id"))
    # items are reduced to distinct pairs of nodes with a count before paths are attached
    pairs = items.groupBy("label_id", "pred_id").agg(F.count("*").alias("n"))
    withp = pairs.join(nodes.select(F.col("id").alias("label_id"), F.col("at").alias("lp")).hint("merge"), "label_id") \
                 .join(nodes.select(F.col("id").alias("pred_id"), F.col("at").alias("pp")).hint("merge"), "pred_id")
    lv = withp.select("n", F.inline(F.array(*[
        F.struct(F.lit(k).alias("level"), F.col("lp")[i].alias("label"), F.col("pp")[i].alias("pred")) for i, k in enumerate(PADDED_LEVELS)])))
    lv = m.drop_padding(lv, "label", -1).groupBy("level", "label", "pred").agg(F.sum("n").alias("n"))
    counts = lv.select("level", F.inline(F.array(
        F.struct(F.col("label"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("np")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("np")))))
    counts = counts.groupBy("level", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "sup", "np")])
    return m.prf(counts, ["level"]).select("level", *[_r(c) for c in ("weighted_prec", "weighted_rec", "weighted_f1", "macro_f1")])

