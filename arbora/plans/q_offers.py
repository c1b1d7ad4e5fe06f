"""Offer extraction and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import text as tf
from arbora.operators import offers as of
from arbora.plans import standins as st
from arbora.plans.q_text import d_preprocess, d_strip
from arbora.plans.registry import query
from arbora.session import scratch_path, table

ORDER = ["Category", "Breadcrumb", "BreadcrumbList", "Description"]


def d_preprocess_value(x):
    v = f"split_part({x}, '@', 1)"
    for s in tf.VALUE_JUNK:
        v = f"replace({v}, '{s}', '')"
    return d_preprocess(v)


_RUNS = """
runs AS (
  SELECT *, sum(chg) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, coalesce(CAST(lag(url) OVER (PARTITION BY file ORDER BY line_no) <> url AS INTEGER), 1) AS chg
        FROM quads)
)"""

_ROUTED = f"""
vals AS (
  SELECT *, {d_preprocess_value('object')} AS v FROM runs
),
vals2 AS (
  SELECT *, {d_strip("regexp_replace(v, '^home', '')")} AS v_home, regexp_replace(v, '^home', '') AS v_home_raw,
         lower(predicate) AS pl FROM vals
),
flags AS (
  SELECT *,
    predicate = '{of.NAME_PREDICATE}' AND strpos(object, '@en') > 0 AS is_name,
    strpos(object, '{of.BLANK_NODE}') > 0 AS blank
  FROM vals2
),
br AS (
  SELECT *,
    CASE WHEN is_name THEN 1
         WHEN predicate = '{of.DESCRIPTION_PREDICATE}' THEN 2
         WHEN strpos(pl, 'category') > 0 THEN 3
         WHEN predicate = '{of.BREADCRUMB_PREDICATE}' THEN 4
         WHEN strpos(pl, 'breadcrumblist') > 0 THEN 5
         WHEN strpos(pl, 'breadcrumb') > 0 AND predicate NOT IN ('{of.BREADCRUMB_EXCLUDED[0]}', '{of.BREADCRUMB_EXCLUDED[1]}') THEN 6
         ELSE 0 END AS b
  FROM flags
),
routed AS (
  SELECT file, line_no, run, url, predicate,
    CASE WHEN b = 1 AND length(v) > 0 AND v <> 'null' THEN 'Title'
         WHEN b = 2 AND length(v) > 0 AND v <> 'null' AND v NOT IN ({", ".join("'" + x + "'" for x in tf.DESCRIPTION_STOP_VALUES)}) THEN 'Description'
         WHEN b = 3 AND length(v) > 0 AND v <> 'null' AND v <> '{tf.CATEGORY_STOP_VALUES[0]}' THEN 'Category'
         WHEN b = 4 AND NOT blank AND length(v_home) > 0 AND v_home <> 'null' THEN 'Breadcrumb'
         WHEN b = 5 AND NOT blank AND length(v_home) > 0 AND v_home <> 'null' THEN 'BreadcrumbList'
         WHEN b = 6 AND length(v_home_raw) > 0 AND v_home_raw <> 'null' THEN 'Breadcrumb'
    END AS slot,
    CASE WHEN b IN (4, 5) THEN v_home WHEN b = 6 THEN v_home_raw ELSE v END AS value
  FROM br
)"""

_FOLD = """
folded AS (
  SELECT file, run, arg_max(url, line_no) AS URL,
    coalesce(arg_max(value, line_no) FILTER (WHERE slot = 'Title'), '') AS Title,
    coalesce(arg_max(value, line_no) FILTER (WHERE slot = 'Description'), '') AS Description,
    list_reduce(list_prepend('', coalesce(list(value ORDER BY line_no) FILTER (WHERE slot = 'Category'), [])),
      lambda acc, x: CASE WHEN strpos(acc, x) > 0 THEN acc ELSE ltrim(acc || ' ' || x) END) AS Category,
    list_reduce(list_prepend({'bc': '', 'bcp': ''},
        coalesce(list({'bc': value, 'bcp': predicate} ORDER BY line_no) FILTER (WHERE slot = 'Breadcrumb'), [])),
      lambda acc, x: CASE WHEN strpos(acc.bc, x.bc) > 0 THEN acc
                          ELSE {'bc': ltrim(acc.bc || ' ' || x.bc), 'bcp': ltrim(acc.bcp || ' ' || x.bcp)} END) AS bcs,
    list_reduce(list_prepend('', coalesce(list(value ORDER BY line_no) FILTER (WHERE slot = 'BreadcrumbList'), [])),
      lambda acc, x: ltrim(acc || ' ' || x)) AS BreadcrumbList
  FROM routed GROUP BY file, run
),
offers AS (
  SELECT file, run, Title, Description, Category, bcs.bc AS Breadcrumb, BreadcrumbList,
         bcs.bcp AS Breadcrumb_Predicate, URL,
         replace(split_part(split_part(replace(replace(replace(URL, '<', ''), 'https://', ''), 'http://', ''), '/', 1), '?', 1), 'www.', '') AS Host
  FROM folded
  WHERE length(Title) > 0
    AND (length(Category) > 0 OR length(bcs.bc) > 0 OR length(Description) > 0 OR length(BreadcrumbList) > 0)
    AND strpos(URL, '.') > 0
)"""


@query("offers_runs_events", "WITH " + st.SQL_QUADS + "," + _RUNS + """
SELECT file, line_no, CAST(run AS BIGINT) AS run FROM runs
""")
def offers_runs_events(spark, sf):
    """Run ids of consecutive equal URLs, chunked and stitched."""
    q = st.quads_from_events(spark, sf)
    return of.run_ids(q).select("file", "line_no", "run")


@query("offers_fold_events", "WITH " + st.SQL_QUADS + "," + _RUNS + "," + _ROUTED + "," + _FOLD + """
SELECT file, CAST(run AS BIGINT) AS run, Title, Description, Category, Breadcrumb, BreadcrumbList,
       Breadcrumb_Predicate, URL, Host FROM offers
""")
def offers_fold_events(spark, sf):
    """Quads folded into offers, one per URL run."""
    q = st.quads_from_events(spark, sf)
    return of.fold_offers(q).select(
        "file", "run", "Title", "Description", "Category", "Breadcrumb", "BreadcrumbList",
        "Breadcrumb_Predicate", "URL", "Host")


_DEDUPE_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY Title ORDER BY Category ASC NULLS LAST, Breadcrumb ASC NULLS LAST,
                                 BreadcrumbList ASC NULLS LAST, Description ASC NULLS LAST, offer_id) AS rn
  FROM doc_offers
),
dedup AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)"""


@query("offers_dedupe_documents", "WITH " + st.SQL_DOC_OFFERS + "," + _DEDUPE_SQL + """
SELECT offer_id, Host, Category, Description FROM dedup
""")
def offers_dedupe_documents(spark, sf):
    """Keep-first dedupe by Title under (Category, Breadcrumb, BreadcrumbList,
    Description), NULLs last."""
    o = st.offers_from_documents(spark, sf)
    return of.dedupe_keep_first(o, "Title", ORDER, empty="last").select(
        "offer_id", "Host", "Category", "Description")


@query("offers_cap_per_host", "WITH " + st.SQL_DOC_OFFERS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY Host ORDER BY md5('42|' || CAST(offer_id AS VARCHAR)), offer_id) AS rn
      FROM doc_offers)
SELECT offer_id, Host FROM r WHERE rn <= 20
""")
def offers_cap_per_host(spark, sf):
    """Hosts with more than 20 offers keep 20 pseudo-random ones."""
    o = st.offers_from_documents(spark, sf)
    return of.cap_per_group(o, "Host", 20, seed=42).select("offer_id", "Host")


@query("offers_cap_heavy_hosts", "WITH " + st.SQL_DOC_OFFERS + """,
c AS (SELECT *, count(*) OVER (PARTITION BY Host) AS cnt,
             row_number() OVER (PARTITION BY Host ORDER BY md5('7|' || CAST(offer_id AS VARCHAR)), offer_id) AS rn
      FROM doc_offers)
SELECT offer_id, Host FROM c WHERE cnt <= 40 OR rn <= 10
""")
def offers_cap_heavy_hosts(spark, sf):
    """Hosts with more than 40 offers are reduced to 10; others kept whole."""
    o = st.offers_from_documents(spark, sf)
    return of.cap_heavy_groups(o, "Host", 40, 10, seed=7).select("offer_id", "Host")


@query("offers_aggregate_job", "WITH " + st.SQL_DOC_OFFERS + """,
d1 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY file, Title ORDER BY Category ASC NULLS LAST, Breadcrumb ASC NULLS LAST,
                                   BreadcrumbList ASC NULLS LAST, Description ASC NULLS LAST, offer_id) AS rn
    FROM doc_offers) WHERE rn = 1
),
c1 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY file, Host ORDER BY md5('42|' || CAST(offer_id AS VARCHAR)), offer_id) AS rn
    FROM d1) WHERE rn <= 15
),
h1 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY file ORDER BY Category ASC NULLS LAST, Breadcrumb ASC NULLS LAST,
                                   BreadcrumbList ASC NULLS LAST, Description ASC NULLS LAST, offer_id) AS rn
    FROM c1) WHERE rn <= 150
),
d2 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY Title ORDER BY Category ASC NULLS LAST, Breadcrumb ASC NULLS LAST,
                                   BreadcrumbList ASC NULLS LAST, Description ASC NULLS LAST, offer_id) AS rn
    FROM h1) WHERE rn = 1
),
c2 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY Host ORDER BY md5('42|' || CAST(offer_id AS VARCHAR)), offer_id) AS rn
    FROM d2) WHERE rn <= 15
)
SELECT offer_id, file, Host FROM c2
""")
def offers_aggregate_job(spark, sf):
    """E2 step 3: per file W2 -> W3 -> T2 (head 150), then global W2 -> W3."""
    o = st.offers_from_documents(spark, sf)
    per_file = of.dedupe_keep_first(o, ["file", "Title"], ORDER, empty="last")
    per_file = of.cap_per_group(per_file, ["file", "Host"], 15)
    per_file = of.head_per_group(per_file, "file", ORDER, 150)
    merged = of.dedupe_keep_first(per_file, "Title", ORDER, empty="last")
    return of.cap_per_group(merged, "Host", 15).select("offer_id", "file", "Host")


@query("offers_sorted_documents", "WITH " + st.SQL_DOC_OFFERS + """
SELECT offer_id, Category, Breadcrumb, Description FROM doc_offers
ORDER BY Category ASC NULLS LAST, Breadcrumb ASC NULLS LAST, BreadcrumbList ASC NULLS LAST,
         Description ASC NULLS LAST, offer_id
""")
def offers_sorted_documents(spark, sf):
    """Multi-key sort with NULLs last (a range-partitioned global sort)."""
    o = st.offers_from_documents(spark, sf)
    return of.sorted_offers(o, ORDER).select("offer_id", "Category", "Breadcrumb", "Description")


_PAGE_OFFERS_SQL = """
page_offers AS (
  SELECT page_id AS offer_id,
    replace(split_part(split_part(replace(replace(replace(url, '<', ''), 'https://', ''), 'http://', ''), '/', 1), '?', 1), 'www.', '') AS Host,
    url AS URL
  FROM pages
),
patterns AS (SELECT DISTINCT split_part(Host, '.', 1) AS host FROM page_offers)"""
# the searched-host filter (F1) looks for a subset of the hosts
_SEARCHED_SQL = _PAGE_OFFERS_SQL.replace("FROM page_offers)", "FROM page_offers WHERE strpos(URL, '/en/') > 0)")


def _page_offers(spark, sf):
    p = table(spark, sf, "pages")
    o = p.select(F.col("page_id").alias("offer_id"), tf.extract_host("url").alias("Host"),
                 F.col("url").alias("URL"))
    return o, _patterns(o)


def _patterns(o):
    return o.select(F.split_part("Host", F.lit("."), F.lit(1)).alias("host")).distinct()


def _searched(o):
    return _patterns(o.where(F.contains("URL", F.lit("/en/"))))


@query("offers_sample_for_hosts", "WITH " + _PAGE_OFFERS_SQL + """,
m AS (SELECT o.offer_id, o.Host, p.host AS pattern,
             row_number() OVER (PARTITION BY p.host ORDER BY md5('42|' || CAST(o.offer_id AS VARCHAR)), o.offer_id) AS rn
      FROM page_offers o JOIN patterns p ON strpos(o.Host, p.host) > 0)
SELECT offer_id, Host, pattern FROM m WHERE rn <= 3
""")
def offers_sample_for_hosts(spark, sf):
    """Up to 3 offers per host pattern (substring theta join)."""
    o, pats = _page_offers(spark, sf)
    return of.sample_for_hosts(o, pats, 3).select("offer_id", "Host", "pattern")


@query("offers_sample_for_hosts_regex", "WITH " + _PAGE_OFFERS_SQL + """,
m AS (SELECT o.offer_id, o.Host, p.host AS pattern,
             row_number() OVER (PARTITION BY p.host ORDER BY md5('42|' || CAST(o.offer_id AS VARCHAR)), o.offer_id) AS rn
      FROM page_offers o JOIN patterns p ON regexp_matches(o.Host, '^' || p.host || '\\.'))
SELECT offer_id, Host, pattern FROM m WHERE rn <= 3
""")
def offers_sample_for_hosts_regex(spark, sf):
    """J2 (regex quirk): patterns are regular expressions."""
    o, pats = _page_offers(spark, sf)
    pats = pats.select(F.concat(F.lit("^"), F.col("host"), F.lit("\\.")).alias("host"),
                       F.col("host").alias("plain"))
    out = of.sample_for_hosts(o, pats, 3, regex=True)
    return out.select("offer_id", "Host", F.regexp_replace(F.regexp_replace("pattern", r"^\^", ""),
                                                          r"\\\.$", "").alias("pattern"))


@query("offers_host_summary", "WITH " + _PAGE_OFFERS_SQL + """,
m AS (SELECT o.offer_id, p.host AS pattern,
             row_number() OVER (PARTITION BY p.host ORDER BY md5('42|' || CAST(o.offer_id AS VARCHAR)), o.offer_id) AS rn
      FROM page_offers o JOIN patterns p ON strpos(o.Host, p.host) > 0),
s AS (SELECT * FROM m WHERE rn <= 3)
SELECT CAST(count(*) AS BIGINT) AS n_offers, round(count(*) / (SELECT count(DISTINCT host) FROM patterns), 6) AS mean_per_host
FROM s
""")
def offers_host_summary(spark, sf):
    """Corpus size and mean offers per host after sampling."""
    o, pats = _page_offers(spark, sf)
    s = of.sample_for_hosts(o, pats, 3)
    return of.host_summary(s, pats).select("n_offers", F.round("mean_per_host", 6).alias("mean_per_host"))


@query("offers_searched_hosts", "WITH " + _SEARCHED_SQL + """
SELECT o.offer_id, o.URL FROM page_offers o
WHERE EXISTS (SELECT 1 FROM patterns p WHERE strpos(o.URL, p.host) > 0)
""")
def offers_searched_hosts(spark, sf):
    """Rows whose URL contains any searched host."""
    o, _ = _page_offers(spark, sf)
    return of.searched_host_filter(o, _searched(o), url="URL").select("offer_id", "URL")


@query("offers_distinct_hosts", """
SELECT CAST(count(DISTINCT replace(split_part(split_part(replace(replace(replace(url, '<', ''), 'https://', ''),
       'http://', ''), '/', 1), '?', 1), 'www.', '')) AS BIGINT) AS n_hosts FROM pages
""")
def offers_distinct_hosts(spark, sf):
    """A2: distinct hosts of all pages."""
    return of.distinct_hosts(table(spark, sf, "pages"), url="url")


@query("offers_host_sketches", """
WITH h AS (
  SELECT 'documents' AS run, replace(split_part(split_part(replace(replace(replace('http://www.' || source || '.example.com/', '<', ''), 'https://', ''),
         'http://', ''), '/', 1), '?', 1), 'www.', '') AS host FROM documents
  UNION ALL
  SELECT 'pages', replace(split_part(split_part(replace(replace(replace(url, '<', ''), 'https://', ''), 'http://', ''), '/', 1), '?', 1), 'www.', '') FROM pages
)
SELECT run, CAST(count(DISTINCT host) AS BIGINT) AS n_exact, true AS within_error FROM h GROUP BY run
UNION ALL SELECT 'both', CAST(count(DISTINCT host) AS BIGINT), true FROM h
""")
def offers_host_sketches(spark, sf):
    """A2: host sketches of one run, stored, read back and merged with those of the next, against exact counts."""
    docs = st.offers_from_documents(spark, sf).select("file", "URL")
    pages = table(spark, sf, "pages").select(F.split_part("url", F.lit("/"), F.lit(4)).alias("file"), F.col("url").alias("URL"))
    path = scratch_path(spark, "host-sketches")
    of.host_sketches(docs, "file").select(F.lit("documents").alias("run"), "sketch").write.parquet(path)
    sketches = spark.read.parquet(path).unionByName(of.host_sketches(pages, "file").select(F.lit("pages").alias("run"), "sketch"))
    estimates = of.merged_hosts(sketches, ["run"]).unionByName(of.merged_hosts(sketches).select(F.lit("both").alias("run"), "n_hosts"))
    exact = {"documents": docs, "pages": pages, "both": docs.unionByName(pages)}
    counts = None
    for run, rows in exact.items():
        one = of.distinct_hosts(rows).select(F.lit(run).alias("run"), F.col("n_hosts").alias("n_exact"))
        counts = one if counts is None else counts.unionByName(one)
    near = F.abs(F.col("n_hosts") - F.col("n_exact")) <= 4 * of.SKETCH_ERROR * F.col("n_exact")
    return counts.join(estimates, "run").select("run", "n_exact", near.alias("within_error"))


@query("offers_list_keys", """
WITH a AS (
  SELECT l_orderkey AS o_id, '[' || string_agg('''' || CAST(l_partkey AS VARCHAR) || '''', ', ' ORDER BY l_linenumber) || ']' AS gtins
  FROM lineitem GROUP BY l_orderkey
), k AS (
  SELECT o_id, CAST(unnest(regexp_extract_all(gtins, '(\\d+)', 1)) AS BIGINT) AS key FROM a
), b AS (
  SELECT p_partkey, arg_min(p_name, p_retailprice * 1e6 + p_partkey) AS p_name, min(p_retailprice) AS p_retailprice
  FROM part GROUP BY p_partkey
)
SELECT k.o_id, k.key, b.p_partkey, b.p_name, b.p_retailprice FROM k JOIN b ON k.key = b.p_partkey
""")
def offers_list_keys(spark, sf):
    """List-string keys of an order matched to parts, first part per key."""
    li = table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("o_id")).agg(
        F.concat(F.lit("["), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
            lambda x: F.concat(F.lit("'"), x["l_partkey"].cast("string"), F.lit("'"))), ", "),
            F.lit("]")).alias("gtins"))
    b = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    out = of.match_list_keys(a, "gtins", b, "p_partkey", "o_id", "p_retailprice")
    return out.select("o_id", "key", "p_partkey", "p_name", "p_retailprice")


@query("offers_duplicate_audit", """
WITH g AS (
  SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS key, count(text) AS n, count(DISTINCT lang) AS n_splits
  FROM documents GROUP BY 1
)
SELECT CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS dup_gt_1,
       CAST(count(*) FILTER (WHERE n > 2) AS BIGINT) AS dup_gt_2,
       CAST(count(*) FILTER (WHERE n > 3) AS BIGINT) AS dup_gt_3,
       CAST(count(*) FILTER (WHERE n_splits > 1) AS BIGINT) AS cross_split_keys
FROM g
""")
def offers_duplicate_audit(spark, sf):
    """Duplicate title keys above 1/2/3 copies and cross-tag keys."""
    d = table(spark, sf, "documents")
    return of.duplicate_audit(d, title="text", split="lang")


@query("offers_count_per_host", "WITH " + st.SQL_DOC_OFFERS + """
SELECT Host, CAST(count(Title) AS BIGINT) AS n_titles, CAST(count(Description) AS BIGINT) AS n_descriptions
FROM doc_offers GROUP BY Host
""")
def offers_count_per_host(spark, sf):
    """A1: non-null counts per group."""
    o = st.offers_from_documents(spark, sf)
    return o.groupBy("Host").agg(F.count("Title").cast("long").alias("n_titles"),
                                 F.count("Description").cast("long").alias("n_descriptions"))
