"""Many-run queries: seeded runs, significance, reports, configs, checks
(A4, A5, J7, M11, G2-G4, M12, J6, J8, S8, X23, X24)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from arbora.functions import text as tf
from arbora.operators import metrics as m
from arbora.operators import runs as rn
from arbora.operators import significance as sg
from arbora.operators.guards import keep
from arbora.plans import standins as st
from arbora.plans.q_metrics import METRIC_NAMES, bundle_sql
from arbora.plans.registry import query
from arbora.session import table

# Seeded stand-in runs: model -> (partkey multiplier, suppkey multiplier); seeds as in the reference grid.
MODELS = [("a", 7, 1), ("b", 3, 5)]
SEEDS = [9, 13, 42]
ITEM = st.ITEM_KEY
LEVELS = (1, 2, 3)


def seed_run_items(spark, sf, nodes, keep=(*ITEM, "l_returnflag")):
    """Columns ``keep`` of items x (model, seed): prediction = T2 leaf of part
    ``(l_partkey * x + l_suppkey * y + seed) % count(part)``.

    A model's seeds are looked up together: their leaves stand in one row under what all seeds
    add to (see :func:`_seed_leaves`), so an item is shuffled once a model, and its runs become
    rows only after the last join. That one is by ``l_partkey``, by which the rows stay
    partitioned: grouping them by item needs no shuffle of its own.
    """
    li = table(spark, sf, "lineitem")
    n_parts = max(1, table(spark, sf, "part").count())
    pl = st.part_leaf(spark, sf, nodes)
    lab = pl.select(F.col("partkey").alias("l_partkey"), F.col("leaf_id").alias("label_id"))
    sums = F.array(*[F.struct(F.lit(mo).alias("model"), _seed_base(F.col("l_partkey") * x + F.col("l_suppkey") * y, n_parts).alias("base"))
                     for mo, x, y in MODELS])
    columns = list(dict.fromkeys([*keep, "l_partkey"]))
    runs = li.select(*columns, F.inline(sums)).join(_seed_leaves(pl, n_parts), "base").drop("base")
    runs = runs.join(lab, "l_partkey")
    seeds = F.inline(F.filter(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"leaf_{s}").alias("pred_id")) for s in SEEDS]),
                              lambda r: r["pred_id"].isNotNull()))
    return runs.select(*keep, "label_id", "model", seeds).withColumn("pred_id", F.when(F.col("pred_id") != NO_LEAF, F.col("pred_id")))


#: Leaf of a part whose label the taxonomy lacks, while NULL means that there is no such part.
NO_LEAF = -1


def _seed_base(total, n):
    """The number in ``(-n - max(SEEDS), n)`` that may stand for ``total``: with any seed added both leave the same remainder by ``n``."""
    top = max(SEEDS)
    return F.when(total >= 0, total % n).when(total > -top, total).otherwise((total + top) % n - top)


def _seed_leaves(pl, n):
    """(base, leaf_<seed>...): for each result of :func:`_seed_base` the leaves of the parts ``(base + seed) % n``.
    Parts that share a key get further rows of the base; a seed without a part there is NULL."""
    turns = max(SEEDS) // n + 2
    seed, base = F.col("seed"), F.col("base")
    rows = pl.select("partkey", F.coalesce("leaf_id", F.lit(NO_LEAF)).alias("leaf"), F.explode(F.array(*map(F.lit, SEEDS))).alias("seed"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(-turns), F.lit(turns))).alias("turn")).withColumn("base", F.col("partkey") - seed + F.col("turn") * n)
    rows = rows.where((_seed_base(base, n) == base) & ((base + seed) % n == F.col("partkey")))
    # the k-th part of each seed goes into the k-th row of its base
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("base", "seed").orderBy("leaf")))
    return rows.groupBy("base", "k").agg(*[F.max(F.when(seed == s, F.col("leaf"))).alias(f"leaf_{s}") for s in SEEDS]).drop("k")


_SQL_RUNS = "WITH RECURSIVE " + st.SQL_T2_NODES + "," + st.SQL_PREDICTIONS.split("items AS")[0].rstrip().rstrip(",") + """,
grid AS (SELECT * FROM (VALUES """ + ", ".join(f"('{mo}', {x}, {y}, {s})" for mo, x, y in MODELS for s in SEEDS) + """) v(model, x, y, seed)),
items AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_returnflag, g.model, g.seed,
         a.leaf_id AS label_id, b.leaf_id AS pred_id
  FROM lineitem l CROSS JOIN grid g
  JOIN part_leaf a ON a.partkey = l.l_partkey
  JOIN part_leaf b ON b.partkey = (l.l_partkey * g.x + l.l_suppkey * g.y + g.seed) % (SELECT count(*) FROM part)
)"""

_SQL_VOTES = _SQL_RUNS + """,
withp AS (SELECT i.*, pl.path AS lp, pp.path AS pp FROM items i JOIN t2_paths pl ON pl.id = i.label_id JOIN t2_paths pp ON pp.id = i.pred_id),
lvls AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, model, seed, CAST(k AS INTEGER) AS level,
                coalesce(lp[k] = pp[k], false) AS correct
         FROM withp, range(1, 4) t(k)),
maj AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, level, model,
               sum(CAST(correct AS INTEGER)) * 2 > count(*) AS majority_correct
        FROM lvls GROUP BY ALL),
cont AS (
  SELECT CAST(count(*) FILTER (WHERE a.majority_correct AND b.majority_correct) AS BIGINT) AS n11,
         CAST(count(*) FILTER (WHERE a.majority_correct AND NOT b.majority_correct) AS BIGINT) AS n10,
         CAST(count(*) FILTER (WHERE NOT a.majority_correct AND b.majority_correct) AS BIGINT) AS n01,
         CAST(count(*) FILTER (WHERE NOT a.majority_correct AND NOT b.majority_correct) AS BIGINT) AS n00
  FROM (SELECT * FROM maj WHERE model = 'a') a
  JOIN (SELECT * FROM maj WHERE model = 'b') b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, level)
)"""


def _level_runs(spark, sf):
    """(item, model, seed, correct_1..3) for every seeded run."""
    nodes = st.t2_nodes(spark, sf)
    wide = m.level_columns(seed_run_items(spark, sf, nodes, ITEM), nodes, len(LEVELS))
    return wide.select(*ITEM, "model", "seed", *[f"correct_{k}" for k in LEVELS])


def _votes(spark, sf):
    """One group for each item and model, with sums for each level."""
    return sg.majority_vote(_level_runs(spark, sf), ITEM + ["model"], {k: f"correct_{k}" for k in LEVELS}).select(
        *ITEM, "level", "model", "majority_correct")


@query("significance_majority_votes", _SQL_VOTES + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, level, model, majority_correct FROM maj
""")
def significance_majority_votes(spark, sf):
    """Per item, level and model, the majority verdict of three seeded runs."""
    return _votes(spark, sf)


def _contingency(spark, sf):
    """Both models' runs grouped by item once, with sums for each level: votes and alignment
    in one shuffle of one row per run."""
    nodes = st.t2_nodes(spark, sf)
    wide = m.level_columns(seed_run_items(spark, sf, nodes, ITEM), nodes, len(LEVELS))
    return sg.paired_contingency_wide(wide, ITEM, {k: f"correct_{k}" for k in LEVELS}, "model", "a", "b")


@query("significance_contingency", _SQL_VOTES + """
SELECT n11, n10, n01, n00 FROM cont
""")
def significance_contingency(spark, sf):
    """Majority verdicts of two models aligned by (item, level), 2x2 table."""
    return _contingency(spark, sf)


def _d_erfc(z):
    poly = str(sg.ERFC_COEFFS[-1])
    for c in reversed(sg.ERFC_COEFFS[:-1]):
        poly = f"({c} + t * {poly})"
    return f"(SELECT t * exp(-zz * zz + {poly}) FROM (SELECT 1 / (1 + 0.5 * zz) AS t, zz FROM (SELECT {z} AS zz)))"


@query("significance_mcnemar", _SQL_VOTES + """,
ex AS (SELECT *, n10 + n01 AS n, least(n10, n01) AS k, -(n10 + n01) * ln(2) AS lt0 FROM cont),
terms AS (SELECT i, ln(n - i + 1) - ln(i) AS d FROM ex, range(1, ex.k + 1) t(i)),
cum AS (SELECT i, sum(d) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS cd FROM terms),
st AS (
  SELECT ex.*,
    CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * (exp(lt0) + coalesce((SELECT sum(exp(lt0 + cd)) FROM cum), 0))) END AS p_exact,
    CASE WHEN n = 0 THEN 0.0 ELSE pow(abs(n10 - n01) - 1, 2) / n END AS stat_chi2
  FROM ex
),
st2 AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE """ + _d_erfc("sqrt(stat_chi2 / 2)") + """ END AS p_chi2 FROM st),
modes AS (SELECT 'auto' AS mode, n <= 25 AS exact, * FROM st2 UNION ALL SELECT 'exact', true, * FROM st2
          UNION ALL SELECT 'chi2', false, * FROM st2)
SELECT mode, n11, n10, n01, n00, k AS stat_exact, round(stat_chi2, 6) AS stat_chi2, CASE WHEN exact THEN round(p_exact, 6) END AS p_exact,
       round(p_chi2, 6) AS p_chi2, exact, round(CASE WHEN exact THEN p_exact ELSE p_chi2 END, 6) AS p_value,
       CASE WHEN exact THEN p_exact ELSE p_chi2 END <= 0.05 AS reject_005,
       CASE WHEN exact THEN p_exact ELSE p_chi2 END <= 0.01 AS reject_001
FROM modes
""")
def significance_mcnemar(spark, sf):
    """McNemar test (rule-based, always exact, always chi-square) with
    verdicts at alpha .05 and .01."""
    t = keep(_contingency(spark, sf))
    out = None
    for mode, exact in (("auto", None), ("exact", True), ("chi2", False)):
        r = sg.mcnemar(t, exact).select(F.lit(mode).alias("mode"), "*")
        out = r if out is None else out.unionByName(r)
    return out.select("mode", "n11", "n10", "n01", "n00", "stat_exact", F.round("stat_chi2", 6).alias("stat_chi2"),
                      F.round("p_exact", 6).alias("p_exact"), F.round("p_chi2", 6).alias("p_chi2"), "exact",
                      F.round("p_value", 6).alias("p_value"), "reject_005", "reject_001")


_SPLIT_SQL = "CASE l_returnflag WHEN 'R' THEN 'test' WHEN 'A' THEN 'validate' ELSE 'train' END"


def _split_col():
    return (F.when(F.col("l_returnflag") == "R", "test").when(F.col("l_returnflag") == "A", "validate")
             .otherwise("train"))


@query("runs_metric_report", _SQL_RUNS.replace("items AS (", "items0 AS (") + """,
items AS (SELECT model || '_' || CAST(seed AS VARCHAR) AS experiment, """ + _SPLIT_SQL + """ AS split, label_id, pred_id
          FROM items0)""" + bundle_sql(["experiment", "split"]) + """,
keyed AS (SELECT CASE WHEN split = 'train' THEN experiment ELSE experiment || '+' || split END AS run_key, metric, value
          FROM bundle_long)
SELECT CASE WHEN strpos(run_key, '+') > 0 THEN split_part(run_key, '+', 1) ELSE run_key END AS experiment,
       CASE WHEN strpos(run_key, '+') > 0 THEN split_part(run_key, '+', 2) ELSE 'all' END AS split,
       """ + ",\n       ".join(f"round(max(CASE WHEN metric = '{n}' THEN value END), 6) AS {n}" for n in METRIC_NAMES) + """
FROM keyed GROUP BY run_key
""")
def runs_metric_report(spark, sf):
    """The metric bundle of six seeded runs x three splits in one
    pass, keyed as ``exp+split`` (train runs unsuffixed), parsed back and pivoted
    into one wide row per run."""
    nodes = st.t2_nodes(spark, sf)
    items = seed_run_items(spark, sf, nodes, ["l_returnflag"]).select(
        F.concat_ws("_", "model", F.col("seed").cast("string")).alias("experiment"),
        _split_col().alias("split"), "label_id", "pred_id")
    long = m.bundle(items, nodes, ["experiment", "split"])
    keyed = long.select(F.when(F.col("split") == "train", F.col("experiment"))
                         .otherwise(F.concat_ws("+", "experiment", "split")).alias("run_key"), "metric", "value")
    parsed = rn.run_keys(keyed, "run_key").drop("run_key")
    wide = rn.report(parsed, ["experiment", "split"], names=METRIC_NAMES)
    return wide.select("experiment", "split", *[F.round(n, 6).alias(n) for n in METRIC_NAMES])


CORPORA = ["title", "title_category", "title_description", "title_category_description",
           "title_category_category_reverse", "title_category_description_multiple_rows",
           "title_category_description_multiple_rows_additional_ds", "title_category_category_reverse_description"]
INPUTS = ["title", "title_description"]
HEADS = ["flat", "hierarchical"]
# which planned cell each stand-in model fills
MODEL_CELLS = {"a": ("title_category_description_multiple_rows", "title", "flat"),
               "b": ("title_category_description_multiple_rows", "title_description", "hierarchical")}


@query("runs_study_matrix", _SQL_RUNS.replace("items AS (", "items0 AS (") + """,
items AS (SELECT model, seed, label_id, pred_id FROM items0),
acc AS (SELECT model, seed, avg(CAST(label_id = pred_id AS DOUBLE)) AS accuracy FROM items GROUP BY model, seed),
cells AS (SELECT * FROM (VALUES """ + ", ".join(f"('{mo}', '{c}', '{i}', '{h}')" for mo, (c, i, h) in MODEL_CELLS.items()) + """) v(model, corpus, input, head)),
res AS (SELECT corpus, input, head, CAST(count(*) AS BIGINT) AS n_runs, round(avg(accuracy), 6) AS mean_accuracy
        FROM acc JOIN cells USING (model) GROUP BY corpus, input, head),
plan AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}')" for c in CORPORA) + """) c(corpus),
                       (VALUES """ + ", ".join(f"('{i}')" for i in INPUTS) + """) i(input),
                       (VALUES """ + ", ".join(f"('{h}')" for h in HEADS) + """) h(head))
SELECT p.corpus, p.input, p.head, r.n_runs, r.mean_accuracy FROM plan p LEFT JOIN res r USING (corpus, input, head)
""")
def runs_study_matrix(spark, sf):
    """The 8 x 2 x 2 planned study grid with the results of the runs that exist."""
    nodes = st.t2_nodes(spark, sf)
    items = seed_run_items(spark, sf, nodes)
    acc = items.groupBy("model", "seed").agg(F.avg((F.col("label_id") == F.col("pred_id")).cast("double")).alias("accuracy"))
    cells = F.create_map(*[x for mo, (c, i, h) in MODEL_CELLS.items()
                           for x in (F.lit(mo), F.struct(F.lit(c).alias("corpus"), F.lit(i).alias("input"),
                                                         F.lit(h).alias("head")))])
    res = (acc.withColumn("cell", F.element_at(cells, F.col("model"))).select("cell.*", "accuracy")
              .groupBy("corpus", "input", "head")
              .agg(F.count("*").cast("long").alias("n_runs"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy")))
    plan = rn.study_matrix({"corpus": CORPORA, "input": INPUTS, "head": HEADS})
    return rn.missing_runs(plan, res, ["corpus", "input", "head"]).select(
        "corpus", "input", "head", "n_runs", "mean_accuracy")


@query("runs_key_checks", """
SELECT 'lineitem_duplicate_key' AS "check", CAST(count(*) AS BIGINT) AS n
FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL
SELECT 'lineitem_duplicate_payload', CAST(count(*) AS BIGINT)
FROM (SELECT l_partkey, l_suppkey, l_quantity FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1)
UNION ALL
SELECT 'lineitem_orphan', CAST(count(*) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
""")
def runs_key_checks(spark, sf):
    """Unique key, duplicate payload and orphan reference checks."""
    li = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    out = rn.key_checks(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"],
                        ref=orders, ref_key=["o_orderkey"], name="lineitem")
    return out


_CONFIG_SQL = """
WITH cfg AS (
  SELECT 'exp_' || CAST(event_id AS VARCHAR) AS experiment, 'ds_' || CAST(user_id % 4 AS VARCHAR) AS dataset,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type = 'view' THEN 'exp_' || CAST(event_id - 1 AS VARCHAR) END AS original_experiment,
         CASE WHEN event_type = 'view' THEN 'ds_' || CAST((user_id + 1) % 4 AS VARCHAR) END AS original_dataset,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'True' ELSE 'false' END AS flag_text
  FROM events
)"""


def _configs(spark, sf):
    e = table(spark, sf, "events")
    parsed = F.from_json("props", "k INT")   # S8: nested JSON with an explicit schema
    is_eval = F.col("event_type") == "view"
    return e.select(
        F.concat(F.lit("exp_"), F.col("event_id").cast("string")).alias("experiment"),
        F.concat(F.lit("ds_"), (F.col("user_id") % 4).cast("string")).alias("dataset"),
        parsed["k"].alias("k"),
        F.when(is_eval, F.concat(F.lit("exp_"), (F.col("event_id") - 1).cast("string"))).alias("original_experiment"),
        F.when(is_eval, F.concat(F.lit("ds_"), ((F.col("user_id") + 1) % 4).cast("string"))).alias("original_dataset"),
        F.when(parsed["k"] % 2 == 0, "True").otherwise("false").alias("flag_text"))


@query("runs_configs_with_originals", _CONFIG_SQL + """
SELECT c.experiment, c.dataset, c.k, lower(c.flag_text) = 'true' AS flag, o.k AS original_k
FROM cfg c LEFT JOIN cfg o ON o.experiment = c.original_experiment AND o.dataset = c.original_dataset
""")
def runs_configs_with_originals(spark, sf):
    """Configs parsed from JSON, boolean strings normalised, and each
    evaluation run joined to the configuration of its original experiment."""
    cfg = _configs(spark, sf)
    j = rn.with_config(cfg.select("experiment", "dataset"), cfg, ["experiment", "dataset"],
                       {"original_experiment": "experiment", "original_dataset": "dataset"})
    return j.select("experiment", "dataset", F.col("cfg_k").alias("k"),
                    tf.to_bool(F.col("cfg_flag_text")).alias("flag"), F.col("orig_k").alias("original_k"))


@query("runs_orphan_evaluations", _CONFIG_SQL + """
SELECT c.experiment, c.original_experiment FROM cfg c
WHERE c.original_experiment IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM cfg o WHERE o.experiment = c.original_experiment AND o.dataset = c.original_dataset)
""")
def runs_orphan_evaluations(spark, sf):
    """Evaluation configs whose original experiment does not exist."""
    cfg = _configs(spark, sf)
    return rn.orphan_evaluations(cfg, ["dataset", "experiment"]).select("experiment", "original_experiment")
