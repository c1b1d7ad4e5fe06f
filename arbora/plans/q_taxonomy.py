"""Taxonomy queries over the T1 (customer) and T2 (part) trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import taxonomy as tx
from arbora.plans import standins as st
from arbora.plans.registry import query
from arbora.session import table

_T1 = "WITH RECURSIVE " + st.SQL_T1_NODES
_T2 = "WITH RECURSIVE " + st.SQL_T2_NODES


def _s(c, sep=","):
    return F.array_join(F.col(c), sep)


@query("taxonomy_nodes_t1", _T1 + """
SELECT id, name, parent_id, depth FROM t1_nodes
""")
def taxonomy_nodes_t1(spark, sf):
    """H1 (+P7): region > nation > nation_segment tree, first-seen ids."""
    return st.t1_nodes(spark, sf)


@query("taxonomy_nodes_t2", _T2 + """
SELECT id, name, parent_id, depth FROM t2_nodes
""")
def taxonomy_nodes_t2(spark, sf):
    """H1 over 1,000s of part labels (path-qualified names)."""
    return st.t2_nodes(spark, sf)


@query("taxonomy_codes_t1", """
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
def taxonomy_codes_t1(spark, sf):
    """H2: tree from (code, name) level pairs, labels ``code_name``."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return tx.taxonomy_from_codes(rows, [("r_regionkey", "r_name"), ("n_nationkey", "n_name"),
                                         ("c_nationkey", "c_mktsegment")], "c_custkey")


@query("taxonomy_paths_t2", _T2 + """
SELECT id, depth, array_to_string(path, ',') AS path, array_to_string(opath, ',') AS opath FROM t2_paths
""")
def taxonomy_paths_t2(spark, sf):
    """Root-to-node id paths and per-parent ordinal paths."""
    p = tx.with_paths(st.t2_nodes(spark, sf))
    return p.select("id", "depth", _s("path").alias("path"), _s("opath").alias("opath"))


@query("taxonomy_closure_t1", _T1 + """
SELECT id, CAST(anc_id AS INTEGER) AS anc_id, CAST(pos AS INTEGER) AS anc_depth
FROM (SELECT id, unnest(path) AS anc_id, unnest(range(1, len(path) + 1)) AS pos FROM t1_paths)
""")
def taxonomy_closure_t1(spark, sf):
    """Ancestor closure (every non-root ancestor and self)."""
    return tx.closure(st.t1_nodes(spark, sf))


@query("taxonomy_level_ordinals_t2", _T2 + """
SELECT id, depth, CAST(row_number() OVER (PARTITION BY depth ORDER BY opath) AS INTEGER) AS level_ord,
       CAST(opath[len(opath)] AS INTEGER) AS pord
FROM t2_paths WHERE depth > 0
""")
def taxonomy_level_ordinals_t2(spark, sf):
    """Ordinal within level (breadth-first order) and within parent."""
    lo = tx.level_ordinals(st.t2_nodes(spark, sf)).where(F.col("depth") > 0)
    return lo.select("id", "depth", "level_ord", "pord")


_LEAVES_T2 = """,
leaves AS (SELECT * FROM t2_paths WHERE depth > 0 AND id NOT IN (SELECT parent_id FROM t2_nodes WHERE parent_id IS NOT NULL))"""


@query("taxonomy_leaves_dfs_t2", _T2 + _LEAVES_T2 + """
SELECT id, name, CAST(row_number() OVER (ORDER BY opath DESC) AS INTEGER) AS dfs_pos FROM leaves
""")
def taxonomy_leaves_dfs_t2(spark, sf):
    """H4/H7: leaves in stack-walk (depth-first, last child first) order."""
    return tx.leaves_depth_first(st.t2_nodes(spark, sf)).select("id", "name", "dfs_pos")


@query("taxonomy_encode_flat_t2", _T2 + _LEAVES_T2 + """
SELECT id, name, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS code FROM leaves
""")
def taxonomy_encode_flat_t2(spark, sf):
    """H8: flat leaf codes 1..n (0 = out of category)."""
    return tx.encode_flat(st.t2_nodes(spark, sf))


@query("taxonomy_encode_path_t1", "WITH RECURSIVE " + st.SQL_T1_NODES + """,
leaves AS (SELECT * FROM t1_paths WHERE depth > 0 AND id NOT IN (SELECT parent_id FROM t1_nodes WHERE parent_id IS NOT NULL)),
mx AS (SELECT max(len(opath)) AS m, (SELECT count(*) FROM t1_nodes) AS fill FROM leaves)
SELECT id, name, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS code,
       array_to_string(list_concat(opath, list_transform(range(len(opath), m), lambda i: fill)), ',') AS code_path
FROM leaves, mx
""")
def taxonomy_encode_path_t1(spark, sf):
    """H9: path codes with per-parent ordinals, padded with the node count."""
    e = tx.encode_path(st.t1_nodes(spark, sf), per_parent=True)
    return e.select("id", "name", "code", _s("code_path").alias("code_path"))


@query("taxonomy_level_paths_t2", _T2 + _LEAVES_T2 + """,
lo AS (SELECT id, row_number() OVER (PARTITION BY depth ORDER BY opath) AS level_ord FROM t2_paths),
lp AS (
  SELECT l.id AS leaf_id, l.name, list(lo.level_ord ORDER BY x.pos) AS level_path
  FROM leaves l, LATERAL (SELECT unnest(l.path) AS anc, unnest(range(1, len(l.path) + 1)) AS pos) x
  JOIN lo ON lo.id = x.anc
  GROUP BY l.id, l.name
)
SELECT 0 AS leaf_id, 'Root' AS name, '0,0,0' AS level_path
UNION ALL SELECT leaf_id, name, array_to_string(level_path, ',') FROM lp
""")
def taxonomy_level_paths_t2(spark, sf):
    """Level-normalised leaf paths plus the out-of-category path."""
    lp = tx.level_paths(st.t2_nodes(spark, sf))
    return lp.orderBy("level_path").select("leaf_id", "name", _s("level_path").alias("level_path"))


@query("taxonomy_successors_t2", _T2 + """,
lo AS (SELECT id, parent_id, depth, row_number() OVER (PARTITION BY depth ORDER BY opath) AS level_ord
       FROM t2_paths WHERE depth > 0)
SELECT p.depth, CAST(p.level_ord AS INTEGER) AS level_ord,
       array_to_string(list_sort(list(c.level_ord)), ',') AS child_ords
FROM lo p JOIN lo c ON c.parent_id = p.id
GROUP BY p.depth, p.level_ord
""")
def taxonomy_successors_t2(spark, sf):
    """Children of every node as level ordinals."""
    s = tx.successors(st.t2_nodes(spark, sf))
    return s.select("depth", "level_ord", _s("child_ords").alias("child_ords"))


@query("taxonomy_nodes_per_level_t1", _T1 + """
SELECT depth, CAST(count(*) + 1 AS BIGINT) AS num_labels FROM t1_nodes WHERE depth > 0 GROUP BY depth
""")
def taxonomy_nodes_per_level_t1(spark, sf):
    """Labels per level (+1 out of category)."""
    return tx.nodes_per_level(st.t1_nodes(spark, sf))


@query("taxonomy_prefixes_t2", _T2 + _LEAVES_T2 + """
SELECT DISTINCT CAST(k AS INTEGER) AS level, array_to_string(path[1:k], ',') AS prefix
FROM (SELECT path, unnest(range(1, len(path) + 1)) AS k FROM leaves)
""")
def taxonomy_prefixes_t2(spark, sf):
    """U4: distinct path prefixes per level of the leaf paths."""
    nodes = st.t2_nodes(spark, sf)
    p = tx.with_paths(nodes).join(tx.leaves(nodes).select("id"), "id", "left_semi").where(F.col("depth") > 0)
    u = tx.prefixes_per_level(p)
    return u.select(F.col("level").cast("int").alias("level"), _s("prefix").alias("prefix"))


@query("taxonomy_reid_bfs_t1", _T1 + """,
bfs AS (SELECT p.id AS old_id, n.parent_id AS old_parent, replace(p.name, ' ', '_') AS name, p.depth,
               CAST(row_number() OVER (ORDER BY p.depth, p.opath) - 1 AS INTEGER) AS id
        FROM t1_paths p JOIN t1_nodes n ON n.id = p.id)
SELECT b.id, b.name, b.depth, p.id AS parent_id FROM bfs b LEFT JOIN bfs p ON p.old_id = b.old_parent
""")
def taxonomy_reid_bfs_t1(spark, sf):
    """H3: breadth-first re-numbering (parent ids re-mapped alongside)."""
    return tx.reid_breadth_first(st.t1_nodes(spark, sf)).select("id", "name", "depth", "parent_id")


@query("taxonomy_padded_leaf_t2", _T2 + _LEAVES_T2 + """
SELECT id, path[2] AS label_lvl_2,
       coalesce(list_filter(list_concat(path, [fill]), lambda x: x <> fill)[-1], 0) AS derived_leaf
FROM leaves, (SELECT CAST(count(*) AS INTEGER) AS fill FROM t2_nodes)
""")
def taxonomy_padded_leaf_t2(spark, sf):
    """Leaf of a fill-padded path and the label at level 2."""
    nodes = st.t2_nodes(spark, sf)
    n = nodes.count()
    p = tx.with_paths(nodes).join(tx.leaves(nodes).select("id"), "id", "left_semi").where(F.col("depth") > 0)
    padded = F.concat(F.col("path"), F.array(F.lit(n).cast("int")))
    return p.select("id", tx.label_at_level(F.col("path"), 2).alias("label_lvl_2"),
                    tx.leaf_of_padded(padded, n).alias("derived_leaf"))


@query("taxonomy_diff_t2", """
WITH a AS (
  SELECT DISTINCT p_type || '>' || p_type || '/' || p_brand || '>' || p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2) AS p3,
                  p_type || '>' || p_type || '/' || p_brand AS p2, p_type AS p1
  FROM part
), b AS (
  SELECT DISTINCT p_type || '>' || p_type || '/' || p_brand || '>' || p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2) AS p3,
                  p_type || '>' || p_type || '/' || p_brand AS p2, p_type AS p1
  FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
), pa AS (SELECT p1 AS np FROM a UNION SELECT p2 FROM a UNION SELECT p3 FROM a),
   pb AS (SELECT p1 AS np FROM b UNION SELECT p2 FROM b UNION SELECT p3 FROM b)
SELECT coalesce(pa.np, pb.np) AS name_path,
       CASE WHEN pa.np IS NULL THEN 'only_b' WHEN pb.np IS NULL THEN 'only_a' ELSE 'both' END AS status
FROM pa FULL OUTER JOIN pb ON pa.np = pb.np
""")
def taxonomy_diff_t2(spark, sf):
    """Diff of the part tree against the tree of parts on returned lines."""
    a = st.t2_nodes(spark, sf)
    returned = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("offer_id"))
    b_offers = st.t2_offers(spark, sf).join(returned, "offer_id", "left_semi")
    b = tx.taxonomy_from_levels(b_offers, st.T_LEVELS, "offer_id")
    return tx.diff(a, b).select("name_path", "status")


#: Parts as a ragged tree: blocks of 150 parts, each the child of one of the three before it (the first of a block is a child of the root).
_SQL_DEEP = """
deep AS (
  SELECT 0 AS id, 'Root' AS name, CAST(NULL AS BIGINT) AS parent_id
  UNION ALL
  SELECT p_partkey + 1, p_name, CASE WHEN p_partkey % 150 = 0 THEN 0
         ELSE greatest(p_partkey - p_partkey % 150 + 1, p_partkey - p_size % 3) END FROM part
),
deep_walk(id, path, opath) AS (
  SELECT id, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM deep WHERE parent_id IS NULL
  UNION ALL
  SELECT c.id, list_append(w.path, c.id), list_append(w.opath, c.pord)
  FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS pord FROM deep) c JOIN deep_walk w ON c.parent_id = w.id
)"""


def _deep_edges(spark, sf):
    k, first = F.col("p_partkey"), F.col("p_partkey") - F.col("p_partkey") % 150
    parent = F.when(k % 150 == 0, 0).otherwise(F.greatest(first + 1, k - F.col("p_size") % 3))
    root = spark.range(1).select(F.lit(0).alias("id"), F.lit("Root").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    return root.unionByName(table(spark, sf, "part").select((k + 1).cast("int").alias("id"), F.col("p_name").alias("name"), parent.cast("int").alias("parent_id")))


@query("taxonomy_deep_edges_parts", "WITH RECURSIVE " + _SQL_DEEP + """
SELECT d.id, d.parent_id, len(path) AS depth, array_to_string(path, ',') AS path, array_to_string(opath, ',') AS opath,
       d.parent_id IS NULL AS is_root, d.id NOT IN (SELECT parent_id FROM deep WHERE parent_id IS NOT NULL) AS is_leaf
FROM deep d JOIN deep_walk USING (id)
""")
def taxonomy_deep_edges_parts(spark, sf):
    """Paths of a ragged tree of unknown depth (more than 50 levels), from its edges alone."""
    nodes = tx.taxonomy_from_edges(_deep_edges(spark, sf))
    roots, leaves = tx.roots(nodes).select("id", F.lit(True).alias("is_root")), tx.leaves(nodes).select("id", F.lit(True).alias("is_leaf"))
    no = F.lit(False)
    return nodes.join(roots.hint("merge"), "id", "left").join(leaves.hint("merge"), "id", "left").select(
        "id", "parent_id", "depth", _s("path").alias("path"), _s("opath").alias("opath"),
        F.coalesce("is_root", no).alias("is_root"), F.coalesce("is_leaf", no).alias("is_leaf"))


@query("taxonomy_unknown_names_t2", _T2 + """
SELECT offer_id, lvl2 || '/' || title AS name FROM t2_offers
WHERE lvl2 || '/' || title NOT IN (SELECT name FROM t2_nodes) UNION ALL
SELECT offer_id, lvl3 FROM t2_offers WHERE lvl3 NOT IN (SELECT name FROM t2_nodes)
""")
def taxonomy_unknown_names_t2(spark, sf):
    """Offer labels (whole titles and nouns under the brand) that the taxonomy lacks."""
    o = st.t2_offers(spark, sf)
    names = o.select("offer_id", F.explode(F.array(F.concat("lvl2", F.lit("/"), "title"), "lvl3")).alias("name"))
    return tx.unknown_names(names, "name", st.t2_nodes(spark, sf)).select("offer_id", "name")
