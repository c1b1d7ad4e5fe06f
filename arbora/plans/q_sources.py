"""File source/sink round trips and the streaming extraction (S1-S15, streaming).

Each query writes a table derived from the given tables into a fresh folder of
the shared checkpoint area (``spark.checkpoint.dir``), reads it back through the
library reader and returns the result, so the check compares what survived the
file layout with the same rows computed directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from arbora.operators import offers as of
from arbora.operators import splits as sp
from arbora.operators.guards import keep
from arbora.operators import taxonomy as tx
from arbora.plans import q_offers as qo
from arbora.plans import q_runs as qr
from arbora.plans import standins as st
from arbora.plans.q_splits import _sql_split
from arbora.plans.registry import query
from arbora.session import scratch_path, table
from arbora.sources import files as fs
from arbora.streaming import quads as sq


@query("sources_quoted_csv_documents", """
SELECT doc_id, text, lang FROM documents
""")
def sources_quoted_csv_documents(spark, sf):
    """Multi-line texts through a fully quoted CSV and back."""
    path = scratch_path(spark, "quoted-csv")
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fs.write_quoted_csv(d, path)
    back = fs.read_quoted_csv(spark, path, fs.string_schema(["doc_id", "text", "lang"]))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


_NULLIF = ", ".join(f"NULLIF({c}, '') AS {c}" for c in of.OFFER_COLUMNS)


@query("sources_offer_files_events", "WITH " + st.SQL_QUADS + "," + qo._RUNS + "," + qo._ROUTED + "," + qo._FOLD + f"""
SELECT {_NULLIF} FROM offers
""")
def sources_offer_files_events(spark, sf):
    """Folded offers written as ``;`` files (several parts) and re-read."""
    path = scratch_path(spark, "offer-files")
    offers = of.fold_offers(st.quads_from_events(spark, sf))
    fs.write_offer_files(offers, path)
    back = fs.read_offer_files(spark, path)
    return back.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in of.OFFER_COLUMNS])


_GS1_SCHEMA = fs.string_schema(["Name", "Description", "URL", "lvl1", "lvl2", "lvl3"])


@query("sources_json_lines_parts", """
SELECT p_name AS title, p_type AS description, CAST(NULL AS VARCHAR) AS brand,
       p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2) AS category,
       p_type || '>' || p_type || '/' || p_brand || '>' || p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2) AS path_list,
       'wdc_ziqi' AS source
FROM part
""")
def sources_json_lines_parts(spark, sf):
    """GS1-layout JSON lines written, read back with a schema, unified."""
    path = scratch_path(spark, "json-lines")
    o = st.t2_offers(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("offer_id"), "p_type")
    raw = o.join(p, "offer_id").select(
        F.col("title").alias("Name"), F.col("p_type").alias("Description"),
        F.concat(F.lit("http://parts.example.com/"), F.col("offer_id").cast("string")).alias("URL"),
        "lvl1", "lvl2", "lvl3")
    raw.write.mode("overwrite").json(path)
    return sp.unify(fs.read_json_lines(spark, path, _GS1_SCHEMA), "wdc_ziqi")


@query("sources_hierarchy_tsv", """
WITH RECURSIVE o AS (
  SELECT c_custkey AS rid, CAST(r_regionkey AS VARCHAR) || '_' || r_name AS l1,
         CAST(n_nationkey AS VARCHAR) || '_' || n_name AS l2,
         CAST(c_nationkey AS VARCHAR) || '_' || c_mktsegment AS l3
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), ent AS (
  SELECT rid, 1 AS depth, replace(l1, ' ', '_') AS name, 'Root' AS parent FROM o
  UNION ALL SELECT rid, 2, replace(l2, ' ', '_'), replace(l1, ' ', '_') FROM o
  UNION ALL SELECT rid, 3, replace(l3, ' ', '_'), replace(l2, ' ', '_') FROM o
), f AS (
  SELECT name, min(rid * 8 + depth) AS k, arg_min(parent, rid * 8 + depth) AS parent,
         arg_min(depth, rid * 8 + depth) AS depth FROM ent GROUP BY name
), num AS (SELECT name, parent, depth, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS id FROM f)
SELECT 0 AS id, 'Root' AS name, CAST(NULL AS INTEGER) AS parent_id, 0 AS depth
UNION ALL
SELECT n.id, n.name, CASE WHEN n.parent = 'Root' THEN 0 ELSE p.id END, n.depth
FROM num n LEFT JOIN num p ON n.parent = p.name
""")
def sources_hierarchy_tsv(spark, sf):
    """code/name hierarchy rows (distinct, in the order of their first customer)
    written as one TSV file, bounded by the label space, and read back; the tree follows
    file order."""
    path = scratch_path(spark, "hierarchy-tsv")
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    rows = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .select("c_custkey", F.col("r_regionkey").cast("string").alias("code1"), F.col("r_name").alias("name1"),
                     F.col("n_nationkey").cast("string").alias("code2"), F.col("n_name").alias("name2"),
                     F.col("c_nationkey").cast("string").alias("code3"), F.col("c_mktsegment").alias("name3")))
    codes = [c for c in rows.columns if c != "c_custkey"]
    rows = rows.groupBy(*codes).agg(F.min("c_custkey").alias("first_")).coalesce(1).sortWithinPartitions("first_").select(*codes)
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    back = fs.read_hierarchy_tsv(spark, path).withColumn("row", F.monotonically_increasing_id())
    return tx.taxonomy_from_codes(back, [("code1", "name1"), ("code2", "name2"), ("code3", "name3")], "row")


@query("sources_host_list_pages", "WITH " + qo._SEARCHED_SQL + """
SELECT o.offer_id FROM page_offers o WHERE EXISTS (SELECT 1 FROM patterns p WHERE strpos(o.URL, p.host) > 0)
""")
def sources_host_list_pages(spark, sf):
    """A host list file (padded lines, blank lines) read back and used as
    the searched-host filter."""
    path = scratch_path(spark, "host-list")
    o, _ = qo._page_offers(spark, sf)
    padded = qo._searched(o).select(F.concat(F.lit("  "), F.col("host"), F.lit(" \n")).alias("value"))
    padded.coalesce(1).write.mode("overwrite").text(path)
    hosts = fs.read_host_list(spark, path)
    return of.searched_host_filter(o, hosts, url="URL").select("offer_id")


@query("sources_result_reports", qr._SQL_RUNS + """,
acc AS (SELECT model, model || '_' || CAST(seed AS VARCHAR) AS experiment, """ + qr._SPLIT_SQL + """ AS split,
               round(avg(CAST(label_id = pred_id AS DOUBLE)), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n_items
        FROM items GROUP BY ALL)
SELECT experiment, split, accuracy, CASE WHEN model = 'a' THEN n_items END AS n_items FROM acc
""")
def sources_result_reports(spark, sf):
    """Per-run reports of two layouts written as ``;`` CSV, an
    aggregated file beside them; the scan skips the aggregate and unions the
    layouts by name."""
    base = scratch_path(spark, "reports")
    nodes = st.t2_nodes(spark, sf)
    items = qr.seed_run_items(spark, sf, nodes)
    acc = keep(items.groupBy("model", F.concat_ws("_", "model", F.col("seed").cast("string")).alias("experiment"),
                        qr._split_col().alias("split")).agg(
        F.round(F.avg((F.col("label_id") == F.col("pred_id")).cast("double")), 6).alias("accuracy"),
        F.count("*").cast("long").alias("n_items")))
    fs.write_report(acc.where(F.col("model") == "a").drop("model"), f"{base}/layout_a")
    fs.write_report(acc.where(F.col("model") == "b").select("experiment", "split", "accuracy"), f"{base}/layout_b")
    fs.write_report(acc.drop("model"), f"{base}/layout_a_aggregated")
    a_schema = T.StructType([T.StructField("experiment", T.StringType()), T.StructField("split", T.StringType()),
                             T.StructField("accuracy", T.DoubleType()), T.StructField("n_items", T.LongType())])
    b_schema = T.StructType(a_schema.fields[:3])
    out = fs.read_results(spark, {"a": (f"{base}/layout_a*", a_schema), "b": (f"{base}/layout_b", b_schema)})
    return out.select("experiment", "split", "accuracy", "n_items")


@query("sources_split_dataset_documents", """
WITH src AS (SELECT doc_id AS id, lang || '>' || source AS cls FROM documents),""" + _sql_split("src", "s1") + """,
train1 AS (SELECT id, cls FROM s1 WHERE NOT is_test),""" + _sql_split("train1", "s2") + """
SELECT id AS doc_id, CASE WHEN is_test THEN 'validate' ELSE 'train' END AS split FROM s2
""")
def sources_split_dataset_documents(spark, sf):
    """The split table written partitioned by (dataset, split); train and
    validate read back with partition pruning."""
    path = scratch_path(spark, "split-dataset")
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("lang"), F.lit(">"), F.col("source")).alias("cls"))
    s = sp.train_validate_test(d, "cls", 42, "doc_id").withColumn("dataset", F.lit("documents"))
    fs.write_split_dataset(s, path)
    return fs.read_split_dataset(spark, path, "documents", ["train", "validate"]).select("doc_id", "split")


_CFG_SCHEMA = T.StructType([
    T.StructField("experiment_name", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("parameter", T.ArrayType(T.StructType([
        T.StructField("synonyms", T.BooleanType()), T.StructField("lemmatizing", T.BooleanType()),
        T.StructField("fallback", T.BooleanType())])))])


_CONFIGS_A_FILE = 20_000


@query("sources_configs_json", """
WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT 'exp_' || CAST(event_id AS VARCHAR) AS experiment_name, 'ds_' || CAST(user_id % 4 AS VARCHAR) AS dataset,
       'dict' AS type, CAST(o AS INTEGER) AS option,
       CASE WHEN o = 0 THEN k % 2 = 0 ELSE k % 2 = 1 END AS synonyms, k % 3 = 0 AS lemmatizing,
       CASE WHEN o = 0 THEN false ELSE k % 5 = 0 END AS fallback
FROM e, range(0, 2) t(o)
""")
def sources_configs_json(spark, sf):
    """Whole-file JSON configs (JSON arrays of at most ``_CONFIGS_A_FILE`` configs of a
    dataset) with an array ``parameter``, read with a schema and exploded to one row per option."""
    path = scratch_path(spark, "configs")
    e = table(spark, sf, "events")
    k = F.from_json("props", "k INT")["k"]
    cfg = e.select(
        F.concat(F.lit("exp_"), F.col("event_id").cast("string")).alias("experiment_name"),
        F.concat(F.lit("ds_"), (F.col("user_id") % 4).cast("string")).alias("dataset"),
        F.lit("dict").alias("type"),
        F.array(F.struct((k % 2 == 0).alias("synonyms"), (k % 3 == 0).alias("lemmatizing"), F.lit(False).alias("fallback")),
                F.struct((k % 2 == 1).alias("synonyms"), (k % 3 == 0).alias("lemmatizing"), (k % 5 == 0).alias("fallback"))
                ).alias("parameter"))
    cfg = cfg.withColumn("part", F.floor(F.substring("experiment_name", 5, 20).cast("long") / _CONFIGS_A_FILE))
    docs = cfg.groupBy("dataset", "part").agg(
        F.to_json(F.collect_list(F.struct(*[c for c in cfg.columns if c != "part"]))).alias("value"))
    docs.select("part", F.concat("dataset", F.lit("-"), "part").alias("file"), "value").write.mode("overwrite").partitionBy("part", "file").text(path)
    back = fs.read_configs(spark, path, _CFG_SCHEMA)
    return back.select("experiment_name", "dataset", "type", F.col("option").cast("int").alias("option"),
                       "synonyms", "lemmatizing", "fallback")


@query("sources_quad_lines_events", "WITH " + st.SQL_QUADS + """
SELECT subject, predicate, object, '<' || url || '>' AS url FROM quads
""")
def sources_quad_lines_events(spark, sf):
    """N-Quads lines written as gz text beside malformed ones (four fields, no graph,
    blank), read back: only whole quads come through."""
    path = scratch_path(spark, "quad-lines")
    q = st.quads_from_events(spark, sf)
    graph = F.concat(F.lit("<"), F.col("url"), F.lit(">"))
    good = F.concat_ws(" ", "subject", "predicate", "object", graph, F.lit("."))
    bad = F.when(F.col("line_no") % 7 == 0, F.concat_ws(" ", "subject", "predicate", F.lit('"cut"'), F.lit("."))) \
           .when(F.col("line_no") % 7 == 1, F.concat_ws(" ", "subject", "predicate", F.lit("<o>"), graph)) \
           .when(F.col("line_no") % 7 == 2, F.lit("")).when(F.col("line_no") % 7 == 3, F.lit("junk"))
    lines = q.select(F.explode(F.array(good, bad)).alias("value")).where("value is not null")
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
    return of.read_quads(spark, path).select("subject", "predicate", "object", "url")


@query("sources_labelled_lines_parts", """
SELECT concat_ws(' ', p_name, '__label__' || replace(p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2), ' ', '_')) AS line,
       p_type
FROM part
""")
def sources_labelled_lines_parts(spark, sf):
    """Labelled text lines written per type partition and read back."""
    from arbora.operators import corpus as cp
    path = scratch_path(spark, "labelled-lines")
    o = st.t2_offers(spark, sf).select(cp.labelled_text(F.col("title"), F.col("lvl3")).alias("line"),
                                       F.col("lvl1").alias("p_type"))
    fs.write_lines(o, "line", path, partition_by=["p_type"])
    back = fs.read_lines(spark, path)
    return back.select(F.col("value").alias("line"), "p_type")


@query("streaming_offers_events", "WITH " + st.SQL_QUADS + "," + qo._RUNS + "," + qo._ROUTED + "," + qo._FOLD + """
SELECT CAST(run AS BIGINT) AS run, Title, Description, Category, Breadcrumb, BreadcrumbList, Breadcrumb_Predicate, Host FROM offers
""")
def streaming_offers_events(spark, sf):
    """Streaming: the events quads written as an N-Quads file, folded by the file
    stream (foreachBatch, checkpointed, idempotent per batch), output read back."""
    base = scratch_path(spark, "quad-stream")
    q = st.quads_from_events(spark, sf).orderBy("line_no")
    lines = q.select(F.concat_ws(" ", "subject", "predicate", "object",
                                 F.concat(F.lit("<"), F.col("url"), F.lit(">")), F.lit(".")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(f"{base}/in")
    run = sq.start_offer_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", available_now=True)
    run.awaitTermination(600)
    out = spark.read.parquet(f"{base}/out")
    return out.select("run", "Title", "Description", "Category", "Breadcrumb", "BreadcrumbList",
                      "Breadcrumb_Predicate", "Host")
