"""Label taxonomies as tables.

A taxonomy is the node table ``(id INT, name STRING, parent_id INT, depth INT)``
with one root: id 0, parent NULL, depth 0. Ids follow first-seen order of the
offers it was built from. Child order (the order a graph would list a node's
successors) is id order.

The node table is bounded by the label space, not by the data volume: it is
built with a distributed aggregate over all offers, then numbered. Every join of
items against it goes through :func:`arbora.operators.guards.checked_broadcast`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

ROOT_NAME = "Root"
NODE_COLS = ["id", "name", "parent_id", "depth"]


# ---------------------------------------------------------------- building

def taxonomy_from_levels(df: DataFrame, levels: list[str], order: str,
                         key: str = "name", underscore: bool = True) -> DataFrame:
    """H1: build the node table from offers carrying one label column per level.

    ``order`` is a column giving the row order in which offers are "seen"; a node
    id is the rank of its first occurrence (row, level). With ``key='name'`` a
    name that occurs under two parents keeps the parent of its first occurrence.
    ``key='path'`` names every node by its ``>``-joined path, so equal labels
    under different parents stay distinct. ``underscore`` applies P7.
    """
    labels = [F.col(c).cast("string") for c in levels]
    if underscore:
        labels = [F.replace(c, F.lit(" "), F.lit("_")) for c in labels]
    if key == "path":
        # concat (not concat_ws): a null level makes the whole key null
        labels = [F.concat(*[x for j, c in enumerate(labels[: i + 1])
                             for x in ((F.lit(">"), c) if j else (c,))])
                  for i in range(len(labels))]
    elif key != "name":
        raise ValueError(f"unknown key {key!r}")

    entries = F.array(*[
        F.struct(
            F.lit(i + 1).alias("depth"),
            labels[i].alias("name"),
            (labels[i - 1] if i else F.lit(ROOT_NAME)).alias("parent"),
        )
        for i in range(len(levels))
    ])
    seen = (df.select(F.col(order).cast("long").alias("row_"), F.inline(entries))
              .where(F.col("name").isNotNull()))
    # Partial aggregation per task, then one row per distinct label.
    first = (seen.groupBy("name")
                 .agg(F.min(F.struct("row_", "depth", "parent")).alias("f"))
                 .select("name", "f.row_", "f.depth", "f.parent"))
    # Numbering a table bounded by the label space; a single ordered window here
    # sorts only distinct labels, never offers.
    numbered = first.withColumn(
        "id", F.row_number().over(Window.orderBy("row_", "depth")).cast("int"))
    parents = numbered.select(F.col("name").alias("parent"), F.col("id").alias("parent_id"))
    root_row = numbered.sparkSession.range(1).select(
        F.lit(0).cast("int").alias("id"), F.lit(ROOT_NAME).alias("name"),
        F.lit(None).cast("int").alias("parent_id"), F.lit(0).cast("int").alias("depth"))
    body = (numbered.join(parents, "parent", "left")
                    .select("id", "name",
                            F.when(F.col("parent") == ROOT_NAME, F.lit(0))
                             .otherwise(F.col("parent_id")).cast("int").alias("parent_id"),
                            F.col("depth").cast("int").alias("depth")))
    return root_row.unionByName(body)


def taxonomy_from_codes(df: DataFrame, code_name_pairs: list[tuple[str, str]],
                        order: str, underscore: bool = True) -> DataFrame:
    """H2: hierarchy rows of (code_k, name_k) pairs; node label is ``code_name``."""
    labelled = df.select(
        F.col(order),
        *[F.concat_ws("_", F.col(c), F.col(n)).alias(f"lvl{i + 1}")
          for i, (c, n) in enumerate(code_name_pairs)])
    return taxonomy_from_levels(labelled, [f"lvl{i + 1}" for i in range(len(code_name_pairs))],
                                order, underscore=underscore)


# ---------------------------------------------------------------- structure

def roots(nodes: DataFrame) -> DataFrame:
    """H4: nodes with no incoming edge."""
    return nodes.where(F.col("parent_id").isNull())


def leaves(nodes: DataFrame) -> DataFrame:
    """H4: nodes with no outgoing edge (root excluded unless it is alone)."""
    parents = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"))
    return nodes.join(parents, "id", "left_anti")


def _climbed(nodes: DataFrame, max_depth: int | None) -> DataFrame:
    """``nodes`` (id, name, parent_id, ...) with ``pord``, ``path`` and ``opath`` by pointer doubling.

    Every node holds the upper end of the stretch of its path that is known and a pointer
    to the node above; a join with the table itself doubles all stretches, so a tree of
    depth D takes log2(D + 1) joins. Without ``max_depth`` each round asks whether any pointer
    is left; more rounds than the number of nodes allows mean a cycle. Such a tree may be as long
    as the data and its paths as its depth, so it is joined by a merge, never by a broadcast.
    """
    from arbora.operators.guards import checked_broadcast, checked_rows
    from arbora.session import cut_lineage
    pord = F.row_number().over(Window.partitionBy("parent_id").orderBy("id")).cast("int")
    is_root = F.col("parent_id").isNull()
    empty = F.array().cast("array<int>")
    cur = nodes.withColumn("pord", pord).select(
        *nodes.columns, "pord", F.when(is_root, empty).otherwise(F.array(F.col("id").cast("int"))).alias("path"),
        F.when(is_root, empty).otherwise(F.array("pord")).alias("opath"), F.col("parent_id").alias("next_"))
    rounds = math.ceil(math.log2((max_depth if max_depth is not None else checked_rows(nodes)) + 1))
    for k in range(rounds + (max_depth is None)):
        if max_depth is None:
            cur = cut_lineage(cur)  # a plan that joins itself would double each round
            if cur.where("next_ IS NOT NULL").isEmpty():
                break
            if k == rounds:
                raise ValueError("the edges hold a cycle")
        up = cur.select(F.col("id").alias("a_id"), F.col("path").alias("a_path"), F.col("opath").alias("a_opath"), F.col("next_").alias("a_next"))
        up = up.hint("merge") if max_depth is None else checked_broadcast(up, bound=nodes)
        # a node whose parent isn't in the table ends there
        cur = cur.join(up, cur["next_"] == up["a_id"], "left").select(
            *nodes.columns, "pord", F.coalesce(F.concat("a_path", "path"), "path").alias("path"),
            F.coalesce(F.concat("a_opath", "opath"), "opath").alias("opath"), F.col("a_next").alias("next_"))
    return cur.drop("next_")


def with_paths(nodes: DataFrame) -> DataFrame:
    """Add ``path`` (node ids root->node, root excluded) and ``opath``
    (the same path as per-parent child ordinals, 1-based), by pointer doubling
    against the (size-checked, broadcast) node table."""
    return _climbed(nodes.select(*NODE_COLS), depth_of(nodes))


def taxonomy_from_edges(edges: DataFrame) -> DataFrame:
    """Node table with paths from ``(id, name, parent_id)`` rows of any depth, for trees
    that are read without one: ``depth`` is the length of the path. Ragged trees and several
    roots (parent NULL) are fine; a cycle is an error."""
    return _climbed(edges.select("id", "name", "parent_id"), None).withColumn("depth", F.size("path").cast("int"))


def depth_of(nodes: DataFrame) -> int:
    """Maximum depth of a node table (one small job, remembered on the object)."""
    d = getattr(nodes, "_arbora_max_depth", None)
    if d is None:
        d = nodes.agg(F.max("depth")).first()[0] or 0
        nodes._arbora_max_depth = d
    return d


def scorer_path(path: Column, node_id: Column) -> Column:
    """H5 scorer variant: a root (empty path) maps to ``[root]`` (out of category)."""
    return F.when(F.size(path) == 0, F.array(node_id)).otherwise(path)


def closure(nodes: DataFrame) -> DataFrame:
    """Ancestor closure ``(id, anc_id, anc_depth)``: every non-root ancestor and self."""
    p = with_paths(nodes)
    return p.select("id", F.posexplode("path").alias("pos", "anc_id")).select(
        "id", "anc_id", (F.col("pos") + 1).cast("int").alias("anc_depth"))


def level_ordinals(nodes: DataFrame) -> DataFrame:
    """Ordinal of a node within its level (breadth-first listing order,
    1-based) and within its parent."""
    p = with_paths(nodes)
    w = Window.partitionBy("depth").orderBy("opath")
    return p.withColumn("level_ord", F.row_number().over(w).cast("int"))


def reid_breadth_first(nodes: DataFrame) -> DataFrame:
    """H3: renumber nodes in breadth-first order (root 0); names underscored."""
    p = with_paths(nodes)
    newid = p.withColumn(
        "new_id", (F.row_number().over(Window.orderBy("depth", "opath")) - 1).cast("int"))
    par = newid.select(F.col("id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    return (newid.join(par, "parent_id", "left")
                 .select(F.col("new_id").alias("id"),
                         F.replace(F.col("name"), F.lit(" "), F.lit("_")).alias("name"),
                         F.col("new_parent").alias("parent_id"), "depth"))


def leaves_depth_first(nodes: DataFrame) -> DataFrame:
    """H7: leaves in the order a stack walk from the root pops them (last child
    first): descending lexicographic order of the per-parent ordinal path."""
    p = with_paths(nodes)
    lv = p.join(leaves(nodes).select("id"), "id", "left_semi").where(F.col("depth") > 0)
    return lv.withColumn(
        "dfs_pos", F.row_number().over(Window.orderBy(F.col("opath").desc())).cast("int"))


def nodes_per_level(nodes: DataFrame) -> DataFrame:
    """Number of labels per level (+1 for out-of-category)."""
    return (nodes.where(F.col("depth") > 0).groupBy("depth")
                 .agg((F.count("*") + 1).cast("long").alias("num_labels")))


# ---------------------------------------------------------------- encodings

def encode_flat(nodes: DataFrame) -> DataFrame:
    """H8: leaves get codes 1..n in id order; 0 is reserved for out of category."""
    lv = leaves(nodes).where(F.col("depth") > 0)
    return lv.select("id", "name", F.row_number().over(Window.orderBy("id")).cast("int").alias("code"))


def encode_path(nodes: DataFrame, per_parent: bool = False) -> DataFrame:
    """H9: leaf code 0..n-1 in id order and its label path (node ids, or per-parent
    ordinals), right-padded to the longest leaf path with fill = node count."""
    p = with_paths(nodes)
    lv = p.join(leaves(nodes).select("id"), "id", "left_semi").where(F.col("depth") > 0)
    n_nodes = nodes.select(F.count("*").cast("int")).scalar()
    longest = lv.select(F.max(F.size("path"))).scalar()
    src = F.col("opath") if per_parent else F.col("path")
    padded = F.concat(src, F.array_repeat(n_nodes, longest - F.size(src)))
    return lv.select("id", "name",
                     (F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("code"),
                     padded.alias("code_path"))


def level_paths(nodes: DataFrame) -> DataFrame:
    """Leaf paths as per-level ordinals plus the out-of-category path
    (zeros), sorted ascending (arrays compare lexicographically)."""
    lo = level_ordinals(nodes)
    lv = lo.join(leaves(nodes).select("id"), "id", "left_semi").where(F.col("depth") > 0)
    # ordinal of every ancestor at its own level
    anc = lo.select(F.col("id").alias("anc_id"), F.col("level_ord"))
    exploded = lv.select(F.col("id").alias("leaf_id"), "name",
                         F.posexplode("path").alias("pos", "anc_id"))
    lpath = (exploded.join(anc, "anc_id")
                     .groupBy("leaf_id", "name")
                     .agg(F.sort_array(F.collect_list(F.struct("pos", "level_ord"))).alias("s"))
                     .select("leaf_id", "name",
                             F.transform("s", lambda x: x["level_ord"]).alias("level_path")))
    depth = nodes.select(F.max("depth")).scalar()
    ooc = nodes.sparkSession.range(1).select(
        F.lit(0).cast("int").alias("leaf_id"), F.lit(ROOT_NAME).alias("name"),
        F.array_repeat(F.lit(0), depth).alias("level_path"))
    return ooc.unionByName(lpath)


def successors(nodes: DataFrame) -> DataFrame:
    """For each node (by level ordinal) the sorted level ordinals of its children."""
    lo = level_ordinals(nodes).where(F.col("depth") > 0)
    kids = lo.select(F.col("parent_id").alias("id"), F.col("level_ord").alias("child_ord"))
    return (lo.select("id", "depth", "level_ord").join(kids, "id")
              .groupBy("depth", "level_ord")
              .agg(F.sort_array(F.collect_list("child_ord")).alias("child_ords")))


def leaf_of_padded(path: Column, fill: Column | int) -> Column:
    """Last element of a padded path that is not the fill value, else 0."""
    fill_c = fill if isinstance(fill, Column) else F.lit(fill)
    kept = F.filter(path, lambda x: x != fill_c)
    return F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0))


def label_at_level(path: Column, k: int) -> Column:
    """Label at level k (1-based) along a path, NULL if the path is shorter."""
    return F.try_element_at(path, F.lit(k))


def prefixes_per_level(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """U4: distinct path prefixes of every length."""
    return (paths.select(F.col(path_col).alias("p"))
                 .select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("level"))
                 .select("level", F.slice("p", 1, F.col("level")).alias("prefix"))
                 .distinct())


# ---------------------------------------------------------------- lookups / diffs

def encode_names(df: DataFrame, name_col: str, nodes: DataFrame, out_col: str = "node_id",
                 how: str = "left") -> DataFrame:
    """Name -> id lookup against a (checked, broadcast) node table. Labels that the
    taxonomy lacks keep their rows with a NULL id; :func:`unknown_names` lists them."""
    from arbora.operators.guards import checked_broadcast
    lookup = checked_broadcast(nodes.select(F.col("name").alias(name_col),
                                            F.col("id").alias(out_col)), bound=nodes)
    return df.join(lookup, name_col, how)


def unknown_names(df: DataFrame, name_col: str, nodes: DataFrame) -> DataFrame:
    """Labels that do not exist in the taxonomy (the reference raises on them)."""
    return df.join(nodes.select(F.col("name").alias(name_col)), name_col, "left_anti")


def named_paths(nodes: DataFrame) -> DataFrame:
    """Every node with its ``>``-joined path of names (root excluded)."""
    p = with_paths(nodes)
    names = p.select(F.col("id").alias("anc_id"), F.col("name").alias("anc_name"))
    ex = p.select("id", F.posexplode("path").alias("pos", "anc_id"))
    return (ex.join(names, "anc_id")
              .groupBy("id")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "anc_name"))),
                                            lambda x: x["anc_name"]), ">").alias("name_path")))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compare two taxonomies by named path: ``both``, ``only_a``, ``only_b``."""
    pa = named_paths(a).select("name_path", F.col("id").alias("id_a"))
    pb = named_paths(b).select("name_path", F.col("id").alias("id_b"))
    return (pa.join(pb, "name_path", "full_outer")
              .select("name_path", "id_a", "id_b",
                      F.when(F.col("id_a").isNull(), "only_b")
                       .when(F.col("id_b").isNull(), "only_a")
                       .otherwise("both").alias("status")))
