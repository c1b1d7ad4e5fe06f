"""The driver contract: every query runs; SQL twins agree on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tools.oracle_check import TABLES, compare

from small_tables import SF_SMALL

FAST = ["metrics_bundle_t2", "taxonomy_level_paths_t2", "text_preprocess_documents", "offers_fold_events",
        "classify_dictionary_parts", "corpus_pack_tokens", "significance_mcnemar", "split_stratified_customers",
        "runs_metric_report", "sources_offer_files_events", "streaming_offers_events",
        "classify_path_product", "classify_sweep_documents", "text_lemmatized_documents"]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 29 and set(df.columns) == {"metric", "value"}


def test_oracle_keys_are_queries():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql_twin(spark, duck, name):
    r = compare(spark, duck, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], SF_SMALL)
    assert r["status"] == "ok", r
