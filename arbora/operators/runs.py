"""Many-run bookkeeping: reports, configs, key checks, study matrix
(G2-G4, M12, J6, J8, S7, S8, X23, X24, U1-U3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arbora.functions import text as tf

REPORT_KEYS = ["experiment", "dataset", "split"]


def report(metrics: DataFrame, keys: list[str] = REPORT_KEYS, metric: str = "metric",
           value: str = "value", names: list[str] | None = None) -> DataFrame:
    """Long metric rows -> one wide row per key, columns pivoted by
    metric *name* (so runs with other metric sets cannot shift columns)."""
    g = metrics.groupBy(*keys)
    g = g.pivot(metric, names) if names is not None else g.pivot(metric)
    return g.agg(F.first(value))


def run_keys(df: DataFrame, key: str = "run_key") -> DataFrame:
    """Split ``'exp+split'`` result keys into experiment and split ('all')."""
    exp, split = tf.split_run_key(F.col(key))
    return df.withColumn("experiment", exp).withColumn("split", split)


def key_checks(df: DataFrame, key: list[str], payload: list[str] | None = None,
               ref: DataFrame | None = None, ref_key: list[str] | None = None, name: str = "table") -> DataFrame:
    """Rows of ``(check, n)``: duplicate keys, duplicate payloads and, with a
    reference table, orphan rows whose key is missing there (a left-anti join). Every
    check has its row, with n = 0 for a clean table."""
    def repeated(columns: list[str], check: str) -> DataFrame:
        groups = df.groupBy(*columns).agg(F.count("*").alias("n_"))
        return groups.agg(F.count_if(F.col("n_") > 1).cast("long").alias("n")).select(F.lit(f"{name}_{check}").alias("check"), "n")

    agg = repeated(key, "duplicate_key")
    if payload:
        agg = agg.unionByName(repeated(payload, "duplicate_payload"))
    if ref is not None:
        rk = ref_key or key
        ref_cols = key[:len(rk)]
        orphans = df.join(ref.select(*[F.col(a).alias(b) for a, b in zip(rk, ref_cols)]), ref_cols, "left_anti")
        agg = agg.unionByName(orphans.agg(F.count("*").cast("long").alias("n"))
                              .select(F.lit(f"{name}_orphan").alias("check"), "n"))
    return agg


def with_config(results: DataFrame, configs: DataFrame, on: list[str],
                originals: dict[str, str] | None = None) -> DataFrame:
    """Attach each result's configuration (``cfg_*`` columns); with
    ``originals`` (config column -> key column, e.g. ``original_experiment ->
    experiment``) evaluation runs also get the configuration of the original
    experiment they evaluate (``orig_*``). Two left joins."""
    cfg = configs.select(*on, *[F.col(c).alias(f"cfg_{c}") for c in configs.columns if c not in on])
    first = results.join(cfg, on, "left")
    if not originals:
        return first
    orig = configs.select(*[F.col(k).alias(f"cfg_{c}") for c, k in originals.items()],
                          *[F.col(c).alias(f"orig_{c}") for c in configs.columns if c not in on])
    return first.join(orig, [f"cfg_{c}" for c in originals], "left")


def orphan_evaluations(configs: DataFrame, on: list[str],
                       original_on: tuple[str, str] = ("original_dataset", "original_experiment")) -> DataFrame:
    """Evaluation configs whose original experiment does not exist."""
    od, oe = original_on
    evals = configs.where(F.col(oe).isNotNull())
    return evals.join(configs.select(F.col(on[0]).alias(od), F.col(on[1]).alias(oe)), [od, oe], "left_anti")


def study_matrix(axes: dict[str, list[str]]) -> DataFrame:
    """The full grid of planned runs, built by successive explodes."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.range(1).select()
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def missing_runs(plan: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Every planned run with its result (NULL where the run is missing)."""
    return plan.join(results, on, "left")
