"""Split and unification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import splits as sp
from arbora.plans import standins as st
from arbora.plans.registry import query
from arbora.session import table


def _sql_split(src: str, out: str, seed: int = 42, frac: float = 0.2) -> str:
    """SQL twin of W6 over CTE ``src(id, cls)`` producing ``out(id, cls, is_test)``."""
    return f"""
{out}_cnt AS (SELECT cls, count(*) AS n_c FROM {src} GROUP BY cls),
{out}_big AS (SELECT * FROM {out}_cnt WHERE n_c >= 2),
{out}_tot AS (SELECT sum(n_c) AS n, CAST(ceil({frac} * sum(n_c)) AS BIGINT) AS t FROM {out}_big),
{out}_q AS (SELECT cls, CAST(floor(n_c * t / n) AS BIGINT) AS q, (n_c * t) % n AS rem, t FROM {out}_big, {out}_tot),
{out}_q2 AS (SELECT cls, q + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= t - sum(q) OVER () THEN 1 ELSE 0 END AS quota
             FROM {out}_q),
{out}_r AS (SELECT s.*, row_number() OVER (PARTITION BY s.cls ORDER BY md5('{seed}|' || CAST(s.id AS VARCHAR)), s.id) AS rn
            FROM {src} s),
{out} AS (SELECT r.id, r.cls, coalesce(r.rn <= q2.quota, false) AS is_test
          FROM {out}_r r LEFT JOIN {out}_q2 q2 ON r.cls = q2.cls)"""


@query("split_stratified_customers", "WITH src AS (SELECT c_custkey AS id, c_mktsegment AS cls FROM customer),"
       + _sql_split("src", "res") + """
SELECT id AS c_custkey, cls AS c_mktsegment, is_test FROM res
""")
def split_stratified_customers(spark, sf):
    """Stratified 80/20 split of customers by market segment."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    s = sp.stratified_split(c, "c_mktsegment", 0.2, 42, "c_custkey")
    return s.select("c_custkey", "c_mktsegment", "is_test")


@query("split_train_validate_test_documents", """
WITH src AS (SELECT doc_id AS id, lang || '>' || source AS cls FROM documents),"""
       + _sql_split("src", "s1") + """,
train1 AS (SELECT id, cls FROM s1 WHERE NOT is_test),""" + _sql_split("train1", "s2") + """
SELECT id AS doc_id, CASE WHEN is_test THEN 'validate' ELSE 'train' END AS split FROM s2
UNION ALL SELECT id, 'test' FROM s1 WHERE is_test
""")
def split_train_validate_test_documents(spark, sf):
    """64/16/20 train/validate/test over documents stratified by lang>source."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("lang"), F.lit(">"), F.col("source")).alias("cls"))
    s = sp.train_validate_test(d, "cls", 42, "doc_id")
    return s.select("doc_id", "split")


@query("split_train_validate_test_parts", "WITH RECURSIVE " + st.SQL_T2_NODES + """,
src AS (SELECT p_partkey AS id, p_type || '>' || p_type || '/' || p_brand || '>' || p_type || '/' || p_brand || '/'
               || split_part(p_name, ' ', 2) AS cls FROM part),""" + _sql_split("src", "s1") + """,
train1 AS (SELECT id, cls FROM s1 WHERE NOT is_test),""" + _sql_split("train1", "s2") + """
SELECT id AS offer_id, CASE WHEN is_test THEN 'validate' ELSE 'train' END AS split FROM s2
UNION ALL SELECT id, 'test' FROM s1 WHERE is_test
""")
def split_train_validate_test_parts(spark, sf):
    """W7 over part offers stratified by T2 path (many singleton classes go to train)."""
    o = st.t2_offers(spark, sf).select("offer_id", "path_list")
    return sp.train_validate_test(o, "path_list", 42, "offer_id").select("offer_id", "split")


@query("split_rare_classes_parts", """
WITH o AS (SELECT p_partkey AS offer_id, p_type || '>' || p_type || '/' || p_brand || '>' || p_type || '/' || p_brand
                  || '/' || split_part(p_name, ' ', 2) AS path_list FROM part),
c AS (SELECT path_list, count(*) AS n FROM o GROUP BY path_list)
SELECT offer_id, path_list FROM o JOIN c USING (path_list) WHERE n < 2
""")
def split_rare_classes_parts(spark, sf):
    """offers whose class occurs once."""
    o = st.t2_offers(spark, sf).select("offer_id", "path_list")
    return sp.rare_class_rows(o, "path_list")


@query("unify_sources", """
SELECT p_name AS title, p_type AS description, CAST(NULL AS VARCHAR) AS brand,
       p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2) AS category,
       p_type || '>' || p_type || '/' || p_brand || '>' || p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2) AS path_list,
       'wdc_ziqi' AS source FROM part
UNION ALL
SELECT split_part(text, chr(10), 1), text || source, lang, lang, lang || '>' || source, 'icecat' FROM documents
UNION ALL
SELECT c_name, NULL, NULL, c_mktsegment, 'segment>' || c_mktsegment, 'rakuten' FROM customer
UNION ALL
SELECT url, html, NULL, split_part(url, '/', 4), split_part(url, '/', 3) || '>' || split_part(url, '/', 4),
       'webdatacommons' FROM pages
""")
def unify_sources(spark, sf):
    """Four raw layouts (built from the tables) unified and unioned."""
    part = table(spark, sf, "part")
    gs1 = part.select(F.col("p_name").alias("Name"), F.col("p_type").alias("Description"),
                      F.col("p_type").alias("lvl1"),
                      F.concat_ws("/", "p_type", "p_brand").alias("lvl2"),
                      F.concat_ws("/", "p_type", "p_brand", st.noun(F.col("p_name"))).alias("lvl3"))
    docs = table(spark, sf, "documents")
    icecat = docs.select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("Title"),
                         F.col("text").alias("Description.LongDesc"),
                         F.col("source").alias("SummaryDescription.LongSummaryDescription"),
                         F.col("lang").alias("Brand"), F.col("lang").alias("Category.Name.Value"),
                         F.concat_ws(">", "lang", "source").alias("pathlist_names"))
    cust = table(spark, sf, "customer")
    rakuten = cust.select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("CategoryID"),
                          F.concat(F.lit("segment>"), F.col("c_mktsegment")).alias("pathlist"))
    pages = table(spark, sf, "pages")
    wdc = pages.select(F.col("url").alias("title"), F.col("html").alias("desc"),
                       F.split_part("url", F.lit("/"), F.lit(4)).alias("CategoryName"),
                       F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(">"),
                                F.split_part("url", F.lit("/"), F.lit(4))).alias("pathlist_names"))
    return sp.unify_all({"wdc_ziqi": gs1, "icecat": icecat, "rakuten": rakuten, "webdatacommons": wdc})


@query("unify_model_text_parts", """
SELECT p_partkey AS offer_id, p_name || ' - ' || p_type AS text,
       replace(p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2), ' ', '_') AS label
FROM part
""")
def unify_model_text_parts(spark, sf):
    """Model input text ``title - description`` and underscore labels."""
    o = st.t2_offers(spark, sf).withColumn("description", F.col("lvl1"))
    return o.select("offer_id", sp.model_text("title", "description").alias("text"),
                    sp.normalise_label("lvl3").alias("label"))
