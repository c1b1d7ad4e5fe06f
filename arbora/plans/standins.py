"""Stand-in inputs derived from the given test tables (see FIXTURES.md §4).

Every registered query reads the given tables through these builders, so its
work grows with the tables.

* T1 taxonomy: region > nation > nation_segment, built from customers.
* T2 taxonomy: type > type/brand > type/brand/noun, built from parts
  (path-qualified names, so no label collides across parents).
* Predictions: a lineitem's truth is the T2 leaf of its part; its prediction is
  the leaf of part ``(l_partkey * 7 + l_suppkey) % count(part)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arbora.operators import taxonomy as tx
from arbora.operators.guards import keep
from arbora.session import table

T_LEVELS = ["lvl1", "lvl2", "lvl3"]
# (l_orderkey, l_linenumber) repeats in the test data; these columns identify a line
ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def noun(p_name: Column) -> Column:
    """Second word of an ``adjective noun`` part name."""
    return F.split_part(p_name, F.lit(" "), F.lit(2))


def t1_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as offers labelled region > nation > nation_segment."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    # nation/region are dimension tables of fixed size; let the planner broadcast them
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return (c.join(geo, c.c_nationkey == geo.n_nationkey)
             .select(F.col("c_custkey").alias("offer_id"), F.col("c_name").alias("title"),
                     F.col("r_name").alias("lvl1"), F.col("n_name").alias("lvl2"),
                     F.concat(F.col("n_name"), F.lit("_"), F.col("c_mktsegment")).alias("lvl3"),
                     F.col("c_mktsegment").alias("segment")))


def t2_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as offers: title = p_name, labels type > type/brand > type/brand/noun."""
    p = table(spark, sf, "part")
    l1 = F.col("p_type")
    l2 = F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand"))
    l3 = F.concat(l2, F.lit("/"), noun(F.col("p_name")))
    return p.select(F.col("p_partkey").alias("offer_id"), F.col("p_name").alias("title"),
                    l1.alias("lvl1"), l2.alias("lvl2"), l3.alias("lvl3"),
                    F.concat_ws(">", l1, l2, l3).alias("path_list"),
                    F.replace(l3, F.lit(" "), F.lit("_")).alias("category"))


def t1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    # the node table is bounded by the label space; keep it once it is built
    return keep(tx.taxonomy_from_levels(t1_offers(spark, sf), T_LEVELS, "offer_id"))


def t2_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return keep(tx.taxonomy_from_levels(t2_offers(spark, sf), T_LEVELS, "offer_id"))


def part_leaf(spark: SparkSession, sf: str, nodes: DataFrame) -> DataFrame:
    """(partkey, leaf_id): every part's T2 leaf node (J4 lookup)."""
    o = t2_offers(spark, sf).select(F.col("offer_id").alias("partkey"), F.col("category").alias("name"))
    return tx.encode_names(o, "name", nodes, "leaf_id").select("partkey", "leaf_id")


#: Items of a task that expands each into its candidates.
ITEMS_PER_TASK = 1 << 18


#: Parts of a task in which each part costs much, as where its title is scanned.
PARTS_PER_TASK = 1 << 14


def spread_parts(spark: SparkSession, sf: str, df: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of parts (offer_id, ...) dealt to tasks by their number, ``most`` tasks at most: the file of a
    million parts has a few megabytes, by which the planner would give them to one or two tasks."""
    n = table(spark, sf, "part").count() // PARTS_PER_TASK
    n = n if most is None else min(n, most)
    return df.repartition(n, "offer_id") if n > 1 else df


def lineitem_predictions(spark: SparkSession, sf: str, nodes: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """Items keyed by ``ITEM_KEY`` with (label_id, pred_id) over T2.

    With ``spread`` they are dealt by ``l_partkey`` to tasks of about ITEMS_PER_TASK and stay so, and
    rows that are made of an item can be grouped by ``ITEM_KEY`` without a shuffle of their own.
    """
    nodes = nodes if nodes is not None else t2_nodes(spark, sf)
    li = table(spark, sf, "lineitem")
    n_parts = table(spark, sf, "part").select(F.count("*")).scalar()
    pl = part_leaf(spark, sf, nodes)
    items = li.select(*ITEM_KEY,
                      ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n_parts).alias("pred_partkey"))
    # part grows with the data: these are plain joins the planner sizes itself
    lab = pl.select(F.col("partkey").alias("l_partkey"), F.col("leaf_id").alias("label_id"))
    prd = pl.select(F.col("partkey").alias("pred_partkey"), F.col("leaf_id").alias("pred_id"))
    items = items.join(prd, "pred_partkey").drop("pred_partkey")
    if spread:
        items = items.repartition(max(spark.sparkContext.defaultParallelism, li.count() // ITEMS_PER_TASK), "l_partkey")
    return items.join(lab, "l_partkey").select(*ITEM_KEY, "label_id", "pred_id")


# ------------------------------------------------------------------ SQL twins
# DuckDB fragments that rebuild the same stand-ins from the registered views.

SQL_T2_NODES = """
t2_offers AS (
  SELECT p_partkey AS offer_id, p_name AS title, p_type AS lvl1,
         p_type || '/' || p_brand AS lvl2,
         p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2) AS lvl3
  FROM part
),
t2_ent AS (
  SELECT offer_id AS rid, 1 AS depth, replace(lvl1, ' ', '_') AS name, 'Root' AS parent FROM t2_offers
  UNION ALL SELECT offer_id, 2, replace(lvl2, ' ', '_'), replace(lvl1, ' ', '_') FROM t2_offers
  UNION ALL SELECT offer_id, 3, replace(lvl3, ' ', '_'), replace(lvl2, ' ', '_') FROM t2_offers
),
t2_first AS (
  SELECT name, min(rid * 8 + depth) AS k, arg_min(parent, rid * 8 + depth) AS parent,
         arg_min(depth, rid * 8 + depth) AS depth
  FROM t2_ent GROUP BY name
),
t2_num AS (SELECT name, parent, depth, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS id FROM t2_first),
t2_nodes AS (
  SELECT 0 AS id, 'Root' AS name, CAST(NULL AS INTEGER) AS parent_id, 0 AS depth
  UNION ALL
  SELECT n.id, n.name, CASE WHEN n.parent = 'Root' THEN 0 ELSE p.id END, n.depth
  FROM t2_num n LEFT JOIN t2_num p ON n.parent = p.name
),
t2_walk(id, path, opath) AS (
  SELECT id, CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM t2_nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT c.id, list_append(w.path, c.id), list_append(w.opath, c.pord)
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY id) AS INTEGER) AS pord
        FROM t2_nodes) c JOIN t2_walk w ON c.parent_id = w.id
),
t2_paths AS (SELECT n.*, w.path, w.opath FROM t2_nodes n JOIN t2_walk w USING (id))
"""

SQL_T1_NODES = """
t1_offers AS (
  SELECT c_custkey AS offer_id, r_name AS lvl1, n_name AS lvl2, n_name || '_' || c_mktsegment AS lvl3
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
t1_ent AS (
  SELECT offer_id AS rid, 1 AS depth, replace(lvl1, ' ', '_') AS name, 'Root' AS parent FROM t1_offers
  UNION ALL SELECT offer_id, 2, replace(lvl2, ' ', '_'), replace(lvl1, ' ', '_') FROM t1_offers
  UNION ALL SELECT offer_id, 3, replace(lvl3, ' ', '_'), replace(lvl2, ' ', '_') FROM t1_offers
),
t1_first AS (
  SELECT name, min(rid * 8 + depth) AS k, arg_min(parent, rid * 8 + depth) AS parent,
         arg_min(depth, rid * 8 + depth) AS depth
  FROM t1_ent GROUP BY name
),
t1_num AS (SELECT name, parent, depth, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS id FROM t1_first),
t1_nodes AS (
  SELECT 0 AS id, 'Root' AS name, CAST(NULL AS INTEGER) AS parent_id, 0 AS depth
  UNION ALL
  SELECT n.id, n.name, CASE WHEN n.parent = 'Root' THEN 0 ELSE p.id END, n.depth
  FROM t1_num n LEFT JOIN t1_num p ON n.parent = p.name
),
t1_walk(id, path, opath) AS (
  SELECT id, CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM t1_nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT c.id, list_append(w.path, c.id), list_append(w.opath, c.pord)
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY id) AS INTEGER) AS pord
        FROM t1_nodes) c JOIN t1_walk w ON c.parent_id = w.id
),
t1_paths AS (SELECT n.*, w.path, w.opath FROM t1_nodes n JOIN t1_walk w USING (id))
"""

SQL_PREDICTIONS = """
part_leaf AS (
  SELECT p_partkey AS partkey, t2_nodes.id AS leaf_id
  FROM part JOIN t2_nodes
    ON t2_nodes.name = replace(p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2), ' ', '_')
),
items AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, a.leaf_id AS label_id, b.leaf_id AS pred_id
  FROM lineitem l
  JOIN part_leaf a ON a.partkey = l.l_partkey
  JOIN part_leaf b ON b.partkey = (l.l_partkey * 7 + l.l_suppkey) % (SELECT count(*) FROM part)
)
"""


# ------------------------------------------------------------------ quads / offers

def quads_from_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as one crawl file of quads in event order (FIXTURES.md §4).

    url = shop ``user_id % 3``; predicate and object are derived from the event
    type so every routing branch of the fold is exercised.
    """
    e = table(spark, sf, "events")
    et, props, uid, eid = F.col("event_type"), F.col("props"), F.col("user_id"), F.col("event_id")
    q = F.lit('"')
    even = (eid % 2) == 0
    predicate = (F.when(et == "view", "<http://schema.org/Product/name>")
                  .when(et == "click", "<http://schema.org/Product/description>")
                  .when(et == "purchase", "<http://schema.org/Product/category>")
                  .when((et == "error") & even, "<http://schema.org/Product/breadcrumb>")
                  .when(et == "error", "<http://schema.org/Breadcrumb/name>")
                  .when(even, "<http://schema.org/BreadcrumbList/itemListElement>")
                  .otherwise("<http://schema.org/Breadcrumb/url>"))
    obj = (F.when(et == "view", F.concat(q, F.lit("item "), props, q, F.lit("@en")))
            .when(et == "click", F.concat(q, F.lit("about "), props, F.lit(" for user "),
                                          uid.cast("string"), q, F.lit("@en")))
            .when((et == "error") & ((uid % 5) == 0), F.concat(F.lit("_:node"), eid.cast("string")))
            .when(et == "error", F.concat(q, F.lit("home "), props, q))
            .otherwise(F.concat(q, props, q)))
    url = F.concat(F.lit("http://www.shop"), (uid % 3).cast("string"), F.lit(".example.com/item"))
    return e.select(F.lit("events").alias("file"), eid.alias("line_no"),
                    F.concat(F.lit("_:node"), uid.cast("string")).alias("subject"),
                    predicate.alias("predicate"), obj.alias("object"), url.alias("url"))


def offers_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as extracted offers: Title = text, Host = source, Category = lang."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("offer_id"), F.col("text").alias("Title"),
        F.when((F.col("n_chars") % 3) == 0, F.lit(None).cast("string"))
         .otherwise(F.col("n_chars").cast("string")).alias("Description"),
        F.col("lang").alias("Category"), F.col("source").alias("Breadcrumb"),
        F.lit(None).cast("string").alias("BreadcrumbList"),
        F.concat(F.lit("http://www."), F.col("source"), F.lit(".example.com/"),
                 F.col("doc_id").cast("string")).alias("URL"),
        F.col("source").alias("Host"), F.col("lang").alias("file"))


SQL_QUADS = """
quads AS (
  SELECT 'events' AS file, event_id AS line_no, '_:node' || CAST(user_id AS VARCHAR) AS subject,
    CASE WHEN event_type = 'view' THEN '<http://schema.org/Product/name>'
         WHEN event_type = 'click' THEN '<http://schema.org/Product/description>'
         WHEN event_type = 'purchase' THEN '<http://schema.org/Product/category>'
         WHEN event_type = 'error' AND event_id % 2 = 0 THEN '<http://schema.org/Product/breadcrumb>'
         WHEN event_type = 'error' THEN '<http://schema.org/Breadcrumb/name>'
         WHEN event_id % 2 = 0 THEN '<http://schema.org/BreadcrumbList/itemListElement>'
         ELSE '<http://schema.org/Breadcrumb/url>' END AS predicate,
    CASE WHEN event_type = 'view' THEN '"item ' || props || '"@en'
         WHEN event_type = 'click' THEN '"about ' || props || ' for user ' || CAST(user_id AS VARCHAR) || '"@en'
         WHEN event_type = 'error' AND user_id % 5 = 0 THEN '_:node' || CAST(event_id AS VARCHAR)
         WHEN event_type = 'error' THEN '"home ' || props || '"'
         ELSE '"' || props || '"' END AS object,
    'http://www.shop' || CAST(user_id % 3 AS VARCHAR) || '.example.com/item' AS url
  FROM events
)
"""

SQL_DOC_OFFERS = """
doc_offers AS (
  SELECT doc_id AS offer_id, text AS Title,
         CASE WHEN n_chars % 3 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS Description,
         lang AS Category, source AS Breadcrumb, CAST(NULL AS VARCHAR) AS BreadcrumbList,
         'http://www.' || source || '.example.com/' || CAST(doc_id AS VARCHAR) AS URL,
         source AS Host, lang AS file
  FROM documents
)
"""
