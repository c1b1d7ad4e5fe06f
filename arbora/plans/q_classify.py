"""Classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import classify as cl
from arbora.operators import metrics as m
from arbora.operators import splits as sp
from arbora.operators import taxonomy as tx
from arbora.operators.guards import checked_broadcast
from arbora.plans import standins as st
from arbora.plans.q_splits import _sql_split
from arbora.plans.registry import query
from arbora.session import scratch_path, table

T2_WORDS = r"[\s_/]+"   # T2 leaf names are path-qualified with '/'


def _part_titles(spark, sf):
    o = st.t2_offers(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("offer_id"), "p_type", "p_brand")
    return st.spread_parts(spark, sf, o.join(p, "offer_id").select(
        "offer_id", F.concat_ws(" ", "title", F.lower("p_type"), F.lower("p_brand")).alias("title"),
        "category"))


def _t2_leaf_vocab(spark, sf):
    nodes = st.t2_nodes(spark, sf)
    leaves = tx.leaves(nodes).where(F.col("depth") > 0)
    return cl.class_vocabulary(leaves, "name", "id", word_split=T2_WORDS)


_SQL_DICT_PARTS = "WITH RECURSIVE " + st.SQL_T2_NODES + r""",
leaves AS (SELECT * FROM t2_nodes WHERE depth > 0 AND id NOT IN (SELECT parent_id FROM t2_nodes WHERE parent_id IS NOT NULL)),
cls AS (SELECT id AS ord, name, list_distinct(list_filter(string_split_regex(lower(name), '[\s_/]+'), lambda x: x <> '')) AS words
        FROM leaves),
titles AS (SELECT p_partkey AS offer_id, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS title,
                  replace(p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2), ' ', '_') AS category FROM part),
dflt AS (SELECT category AS d FROM (SELECT category, count(*) AS n FROM titles GROUP BY category) ORDER BY n DESC, category LIMIT 1),
sc AS (
  SELECT t.offer_id, c.ord, c.name,
         list_sum(list_transform(c.words, lambda w: (length(t.title) - length(replace(t.title, w, ''))) // length(w))) / len(c.words) AS score
  FROM titles t, cls c
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY score DESC, ord) AS rn FROM sc) WHERE rn = 1),
pred AS (SELECT b.offer_id, t.category, CASE WHEN b.score > 0 THEN b.name ELSE (SELECT d FROM dflt) END AS prediction, b.score
         FROM best b JOIN titles t USING (offer_id))"""


@query("classify_dictionary_parts", _SQL_DICT_PARTS + """
SELECT offer_id, prediction, round(score, 6) AS score FROM pred
""")
def classify_dictionary_parts(spark, sf):
    """Dictionary classifier of part titles into T2 leaves, most
    frequent leaf as the zero-score fallback."""
    titles = _part_titles(spark, sf)
    out = cl.dictionary_classify(titles, "title", _t2_leaf_vocab(spark, sf),
                                 default=cl.most_frequent(titles, "category"))
    return out.select("offer_id", "prediction", F.round("score", 6).alias("score"))


@query("classify_dictionary_parts_scores", _SQL_DICT_PARTS + """,
lab AS (SELECT category AS l FROM pred UNION SELECT prediction FROM pred),
pl AS (
  SELECT l, (SELECT count(*) FROM pred WHERE category = l AND prediction = l) AS tp,
         (SELECT count(*) FROM pred WHERE category = l) AS sup, (SELECT count(*) FROM pred WHERE prediction = l) AS np
  FROM lab
),
pr AS (SELECT *, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS p, CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS r,
              CASE WHEN np + sup = 0 THEN 0.0 ELSE 2 * tp / (np + sup) END AS f FROM pl)
SELECT round(sum(sup * p) / sum(sup), 6) AS weighted_prec, round(sum(tp) / sum(sup), 6) AS weighted_rec,
       round(sum(sup * f) / sum(sup), 6) AS weighted_f1, round(avg(f), 6) AS macro_f1
FROM pr
""")
def classify_dictionary_parts_scores(spark, sf):
    """C2 + M2: leaf weighted P/R/F1 and macro F1 of the dictionary classifier."""
    titles = _part_titles(spark, sf)
    out = cl.dictionary_classify(titles, "title", _t2_leaf_vocab(spark, sf),
                                 default=cl.most_frequent(titles, "category"))
    s = m.leaf_scores(out, "category", "prediction")
    return s.select(*[F.round(c, 6).alias(c) for c in ["weighted_prec", "weighted_rec", "weighted_f1", "macro_f1"]])


def _noun_options(spark, sf):
    part = table(spark, sf, "part")
    noun = st.noun(F.col("p_name"))
    nouns = part.groupBy(noun.alias("name")).agg(F.min("p_partkey").alias("id"))
    syn = (part.select(noun.alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("synonym"))
               .unionByName(nouns.select("name", F.concat("name", F.lit("s")).alias("synonym"))).distinct())
    lem = nouns.select(F.concat("name", F.lit("s")).alias("form"), F.col("name").alias("lemma")).distinct()
    opts = {
        "plain": cl.class_vocabulary(nouns),
        "synonyms": cl.class_vocabulary(nouns, synonyms=syn),
        "lemmas": cl.class_vocabulary(nouns, lemmas=lem),
        "synonyms_lemmas": cl.class_vocabulary(nouns, synonyms=syn, lemmas=lem),
    }
    default = cl.most_frequent(part.select(noun.alias("n")), "n")
    return opts, default


#: Characters of the pieces on which the fallback model is trained, so that texts of any words speak to it (C4, V3).
FALLBACK_GRAMS = 3

#: The fallback model: naive Bayes over character pieces of part titles (C5), applied to the texts that some option can't score.
_SQL_FALLBACK = f"""
train AS (SELECT split_part(p_name, ' ', 2) AS cls, lower(p_name || ' ' || p_brand) AS t FROM part),
tok AS (SELECT cls, substr(t, CAST(unnest(range(1, length(t) - {FALLBACK_GRAMS} + 2)) AS BIGINT), {FALLBACK_GRAMS}) AS w FROM train),
cw AS (SELECT cls, w, count(*) AS n FROM tok GROUP BY ALL),
ct AS (SELECT cls, sum(n) AS t FROM cw GROUP BY cls),
voc AS (SELECT DISTINCT w FROM cw), v AS (SELECT count(*) AS v FROM voc),
prior AS (SELECT cls, ln(count(*) + 1.0) - ln((SELECT count(*) FROM train) + (SELECT count(DISTINCT cls) FROM train)) AS pi FROM train GROUP BY cls),
unscored AS (SELECT doc_id, lower(text) AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM best WHERE score = 0)),
dtok AS (SELECT doc_id, substr(t, CAST(unnest(range(1, length(t) - {FALLBACK_GRAMS} + 2)) AS BIGINT), {FALLBACK_GRAMS}) AS w FROM unscored),
tf AS (SELECT doc_id, w, count(*) AS f FROM dtok JOIN voc USING (w) GROUP BY ALL),
like_ AS (SELECT tf.doc_id, p.cls, sum(f * (ln(coalesce(cw.n, 0) + 1.0) - ln(ct.t + v.v))) AS l
          FROM tf CROSS JOIN prior p JOIN ct ON ct.cls = p.cls CROSS JOIN v LEFT JOIN cw ON cw.cls = p.cls AND cw.w = tf.w GROUP BY ALL),
model AS (SELECT u.doc_id, arg_max(p.cls, p.pi + coalesce(l.l, 0)) AS cls
          FROM unscored u CROSS JOIN prior p LEFT JOIN like_ l ON l.doc_id = u.doc_id AND l.cls = p.cls GROUP BY u.doc_id)"""


@query("classify_sweep_documents", r"""
WITH nouns AS (SELECT split_part(p_name, ' ', 2) AS name, min(p_partkey) AS ord FROM part GROUP BY 1),
syn AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name, split_part(p_name, ' ', 1) AS s FROM part
        UNION SELECT name, name || 's' FROM nouns),
synw AS (SELECT name, list(DISTINCT lower(s)) AS sw FROM syn GROUP BY name),
lem AS (SELECT DISTINCT name || 's' AS form, name AS lemma FROM nouns),
base AS (SELECT ord, name, list_distinct(list_filter(string_split_regex(lower(name), '[\s_]+'), lambda x: x <> '')) AS w FROM nouns),
withsyn AS (SELECT b.ord, b.name, list_distinct(list_concat(b.w, coalesce(s.sw, []))) AS w FROM base b LEFT JOIN synw s USING (name)),
lemmed AS (SELECT ord, name, list(coalesce(lemma, x)) AS w FROM (SELECT ord, name, unnest(w) AS x FROM base) LEFT JOIN lem ON form = x GROUP BY ord, name),
synlem AS (SELECT ord, name, list(coalesce(lemma, x)) AS w FROM (SELECT ord, name, unnest(w) AS x FROM withsyn) LEFT JOIN lem ON form = x GROUP BY ord, name),
opts AS (SELECT 'plain' AS option, * FROM base UNION ALL SELECT 'synonyms', * FROM withsyn
         UNION ALL SELECT 'lemmas', * FROM lemmed UNION ALL SELECT 'synonyms_lemmas', * FROM synlem),
dflt AS (SELECT name AS d FROM (SELECT split_part(p_name, ' ', 2) AS name, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, name LIMIT 1),
sc AS (
  SELECT d.doc_id, o.option, o.ord, o.name,
         list_sum(list_transform(o.w, lambda x: (length(d.text) - length(replace(d.text, x, ''))) // length(x))) / len(o.w) AS score
  FROM documents d, opts o
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, option ORDER BY score DESC, ord) AS rn FROM sc) WHERE rn = 1),
""" + _SQL_FALLBACK + """
SELECT doc_id, option, CASE WHEN score > 0 THEN name ELSE (SELECT d FROM dflt) END AS prediction, round(score, 6) AS score
FROM best
UNION ALL
SELECT doc_id, option || '_fallback', CASE WHEN score > 0 THEN name ELSE model.cls END, round(score, 6)
FROM best LEFT JOIN model USING (doc_id)
""")
def classify_sweep_documents(spark, sf):
    """Whole documents scored under eight options: four vocabularies
    (synonyms x lemmas), scanned in one pass, each with the most frequent class or a
    fallback model for rows that no class fits; classes are the part nouns. The model is
    trained on part titles, saved and loaded."""
    opts, default = _noun_options(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", "text")
    train = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("text"), st.noun(F.col("p_name")).alias("class"))
    model = cl.fit_naive_bayes(train, "text", "class", grams=FALLBACK_GRAMS)
    model = cl.load_model(cl.save_model(model, scratch_path(spark, "fallback")))
    out = cl.sweep_with_fallback(d, "text", opts, default, model)
    return out.select("doc_id", "option", "prediction", F.round("score", 6).alias("score"))


_SQL_PATHS = "WITH RECURSIVE " + st.SQL_T2_NODES + "," + st.SQL_PREDICTIONS + """,
withp AS (
  SELECT i.*, pl.path AS lp, pp.path AS pp FROM items i JOIN t2_paths pl ON pl.id = i.label_id JOIN t2_paths pp ON pp.id = i.pred_id
)"""


def _node_scores(spark, sf):
    nodes = st.t2_nodes(spark, sf)
    items = st.lineitem_predictions(spark, sf, nodes, spread=True)
    withp = m.attach_paths(items, nodes)
    s = withp.select(*st.ITEM_KEY,
                     F.explode(F.array_distinct(F.concat("label_path", "pred_path"))).alias("node_id"))
    # node logits in about -7..7 without equal sums (a term of their own for each node)
    s = s.withColumn("logit", ((F.col("l_orderkey") * 31 + F.col("node_id") * 17) % 97 - 48) / 7.0 + F.col("node_id") / 1e5)
    return nodes, withp, s


@query("classify_path_product", _SQL_PATHS + """,
sc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, unnest(list_distinct(list_concat(lp, pp))) AS node_id FROM withp),
sc2 AS (SELECT *, CAST((l_orderkey * 31 + node_id * 17) % 97 - 48 AS DOUBLE) / 7.0 + CAST(node_id AS DOUBLE) / 1e5 AS logit FROM sc),
leaves AS (SELECT * FROM t2_paths WHERE depth > 0 AND id NOT IN (SELECT parent_id FROM t2_nodes WHERE parent_id IS NOT NULL)),
clo AS (SELECT id AS leaf_id, path[lvl] AS anc, lvl, len(path) AS leaf_depth FROM (SELECT *, unnest(range(1, len(path) + 1)) AS lvl FROM leaves)),
pl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, leaf_id,
              list_reduce(list(CASE WHEN logit >= 0 THEN -ln(1 + exp(-logit)) ELSE logit - ln(1 + exp(logit)) END ORDER BY lvl), lambda a, b: a + b) AS score
       FROM sc2 JOIN clo ON clo.anc = sc2.node_id
       GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, leaf_id, leaf_depth HAVING count(*) = leaf_depth),
best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ORDER BY score DESC, leaf_id) AS rn FROM pl)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, leaf_id, round(exp(score), 6) AS score, round(score, 6) AS log_score FROM best WHERE rn = 1
""")
def classify_path_product(spark, sf):
    """Leaf score = product of node sigmoids along its path; argmax leaf."""
    nodes, _, s = _node_scores(spark, sf)
    out = cl.path_product(s, nodes, st.ITEM_KEY)
    return out.select(*st.ITEM_KEY, "leaf_id", F.round("score", 6).alias("score"),
                      F.round("log_score", 6).alias("log_score"))


@query("classify_greedy_decode", _SQL_PATHS + """,
fill AS (SELECT CAST(count(*) AS INTEGER) AS f FROM t2_nodes),
cand AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(k AS INTEGER) AS level, lp[k] AS node_id FROM (SELECT *, unnest(range(1, 4)) AS k FROM withp)
  UNION SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(k AS INTEGER), pp[k] FROM (SELECT *, unnest(range(1, 4)) AS k FROM withp)
  UNION SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(k AS INTEGER), (SELECT f FROM fill) FROM (SELECT *, unnest(range(1, 4)) AS k FROM withp)
),
sc AS (SELECT *, ((l_orderkey * 13 + level * 7 + node_id * 3) % 89) / 10.0 AS logit FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, level ORDER BY logit DESC, node_id) AS rn FROM sc) WHERE rn = 1),
paths AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, list(node_id ORDER BY level) AS path FROM best GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, array_to_string(path, ',') AS path,
       coalesce(list_filter(path, lambda x: x <> f)[-1], 0) AS leaf_id
FROM paths, fill
""")
def classify_greedy_decode(spark, sf):
    """Per-level argmax over candidates (incl. the fill label), leaf =
    last non-fill node of the decoded path."""
    nodes, withp, _ = _node_scores(spark, sf)
    fill = nodes.count()
    lv = withp.select(*st.ITEM_KEY, "label_path", "pred_path",
                      F.explode(F.sequence(F.lit(1), F.lit(3))).alias("level"))
    cand = lv.select(*st.ITEM_KEY, F.col("level").cast("int").alias("level"), F.explode(F.array_distinct(
        F.array(F.element_at("label_path", F.col("level")), F.element_at("pred_path", F.col("level")),
                F.lit(fill).cast("int")))).alias("node_id"))
    cand = cand.withColumn("logit", ((F.col("l_orderkey") * 13 + F.col("level") * 7 + F.col("node_id") * 3) % 89) / 10.0)
    out = cl.greedy_decode(cand, [*st.ITEM_KEY], "level", "node_id", "logit", fill)
    return out.select(*st.ITEM_KEY, "path", "leaf_id")


@query("classify_decode_level_ordinals", _SQL_PATHS + """,
lo AS (SELECT id, depth, row_number() OVER (PARTITION BY depth ORDER BY opath) AS level_ord FROM t2_paths WHERE depth > 0),
pred AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(k AS INTEGER) AS level,
                CASE WHEN (l_orderkey + k) % 11 = 0 THEN 0 ELSE lo.level_ord END AS ordinal
         FROM (SELECT *, unnest(range(1, 4)) AS k FROM withp) w JOIN lo ON lo.id = w.pp[w.k])
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, p.l_quantity, p.level, CAST(p.ordinal AS INTEGER) AS ordinal,
       CASE WHEN p.ordinal = 0 THEN 0 ELSE lo.id END AS node_id
FROM pred p LEFT JOIN lo ON lo.depth = p.level AND lo.level_ord = p.ordinal
""")
def classify_decode_level_ordinals(spark, sf):
    """C11: per-level ordinal predictions decoded to node ids (0 = out of category)."""
    nodes, withp, _ = _node_scores(spark, sf)
    lo = tx.level_ordinals(nodes).where(F.col("depth") > 0).select("id", "level_ord")
    lv = withp.select(*st.ITEM_KEY, F.posexplode("pred_path").alias("pos", "id"))
    pred = lv.join(lo, "id").select(
        *st.ITEM_KEY, (F.col("pos") + 1).cast("int").alias("level"),
        F.when((F.col("l_orderkey") + F.col("pos") + 1) % 11 == 0, F.lit(0))
         .otherwise(F.col("level_ord")).cast("int").alias("ordinal"))
    out = cl.decode_level_ordinals(pred, nodes)
    return out.select(*st.ITEM_KEY, "level", "ordinal", "node_id")


#: Probability above which a level's label restricts the next level.
CERTAINTY = 0.5


def _sql_masked(k: int) -> str:
    """Level ``k`` of the constrained decode: the free and the masked argmax."""
    return f"""
w{k} AS (SELECT c.*, b.label, b.path, b.leaf, b.total, b.forced,
                b.logp <= ln({CERTAINTY}) OR c.ordinal = 0 OR (b.label <> 0 AND coalesce(c.above, -1) = b.label) AS allowed
         FROM c JOIN b{k - 1} b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) WHERE c.level = {k}),
g{k} AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, any_value(path) AS path, any_value(leaf) AS leaf,
                any_value(total) AS total, any_value(forced) AS forced,
                max({{'p': logp, 'n': -ordinal, 'id': node_id}}) AS free,
                coalesce(max({{'p': logp, 'n': -ordinal, 'id': node_id}}) FILTER (allowed), max({{'p': logp, 'n': -ordinal, 'id': node_id}})) AS best
         FROM w{k} GROUP BY ALL),
b{k} AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, -best.n AS label, best.p AS logp, path || [-best.n] AS path,
                CASE WHEN best.n <> 0 THEN best.id ELSE leaf END AS leaf, total + best.p AS total,
                forced + CASE WHEN best.n <> free.n THEN 1 ELSE 0 END AS forced FROM g{k})"""


@query("classify_successor_decode", _SQL_PATHS + """,
lo AS (SELECT id, parent_id, depth, row_number() OVER (PARTITION BY depth ORDER BY opath) AS level_ord FROM t2_paths WHERE depth > 0),
lab AS (SELECT a.id, a.depth, a.level_ord, p.level_ord AS above FROM lo a LEFT JOIN lo p ON p.id = a.parent_id),
cand AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, k AS level, lp[k] AS node_id FROM (SELECT *, unnest(range(1, 4)) AS k FROM withp)
  UNION SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, k, pp[k] FROM (SELECT *, unnest(range(1, 4)) AS k FROM withp)
  UNION SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, k, 0 FROM (SELECT *, unnest(range(1, 4)) AS k FROM withp)
),
c AS (SELECT cand.*, coalesce(lab.level_ord, 0) AS ordinal, above,
             ln(((l_orderkey * 13 + level * 7 + coalesce(lab.level_ord, 0) * 3) % 89 + 1) / 90.0) AS logp
      FROM cand LEFT JOIN lab ON lab.id = cand.node_id),
b0 AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 0 AS label, CAST(-1000 AS DOUBLE) AS logp,
              CAST([] AS BIGINT[]) AS path, 0 AS leaf, CAST(0 AS DOUBLE) AS total, 0 AS forced FROM withp),""" + ",".join(_sql_masked(k) for k in (1, 2, 3)) + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, array_to_string(path, ',') AS path, leaf AS leaf_id,
       round(total, 6) AS log_score, forced AS n_forced FROM b3
""")
def classify_successor_decode(spark, sf):
    """Top-down decoding of all items; a sure label admits only its children and 0."""
    nodes, withp, _ = _node_scores(spark, sf)
    lo = tx.level_ordinals(nodes).where(F.col("depth") > 0).select(F.col("id").alias("node_id"), F.col("level_ord").alias("ordinal"))
    lv = withp.select(*st.ITEM_KEY, "label_path", "pred_path", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("level"))
    cand = lv.select(*st.ITEM_KEY, "level", F.explode(F.array_distinct(F.array(
        F.element_at("label_path", F.col("level")), F.element_at("pred_path", F.col("level")), F.lit(0)))).alias("node_id"))
    cand = cand.join(checked_broadcast(lo, bound=nodes), "node_id", "left").select(*st.ITEM_KEY, "level", F.coalesce("ordinal", F.lit(0)).alias("ordinal"))
    place = (F.col("l_orderkey") * 13 + F.col("level") * 7 + F.col("ordinal") * 3) % 89 + 1
    out = cl.successor_decode(cand.withColumn("logp", F.log(place / 90.0)), nodes, st.ITEM_KEY, CERTAINTY)
    return out.select(*st.ITEM_KEY, "path", "leaf_id", F.round("log_score", 6).alias("log_score"), "n_forced")


def _labelled_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    x = d.join(lab, "doc_id")
    return sp.stratified_split(x, "quality", 0.2, 42, "doc_id")


@query("classify_naive_bayes_documents", "WITH src AS (SELECT doc_id AS id, CAST(quality AS VARCHAR) AS cls FROM labels JOIN documents USING (doc_id)),"
       + _sql_split("src", "s") + r""",
tok AS (SELECT s.id, s.cls, s.is_test, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM s JOIN documents ON doc_id = s.id),
cw AS (SELECT cls, w, count(*) AS n FROM tok WHERE NOT is_test GROUP BY ALL),
ct AS (SELECT cls, sum(n) AS t FROM cw GROUP BY cls),
voc AS (SELECT DISTINCT w FROM cw), v AS (SELECT count(*) AS v FROM voc),
prior AS (SELECT cls, ln(count(*) + 1.0) - ln((SELECT count(*) FROM s WHERE NOT is_test) + (SELECT count(DISTINCT cls) FROM s WHERE NOT is_test)) AS pi
          FROM s WHERE NOT is_test GROUP BY cls),
tf AS (SELECT id, w, count(*) AS f FROM tok JOIN voc USING (w) WHERE is_test GROUP BY ALL),
like_ AS (SELECT tf.id, p.cls, sum(f * (ln(coalesce(cw.n, 0) + 1.0) - ln(ct.t + v.v))) AS l
          FROM tf CROSS JOIN prior p JOIN ct ON ct.cls = p.cls CROSS JOIN v LEFT JOIN cw ON cw.cls = p.cls AND cw.w = tf.w GROUP BY ALL),
best AS (SELECT s.id, arg_max(p.cls, p.pi + coalesce(l.l, 0)) AS predicted
         FROM s CROSS JOIN prior p LEFT JOIN like_ l ON l.id = s.id AND l.cls = p.cls WHERE s.is_test GROUP BY s.id)
SELECT id AS doc_id, cls AS quality, predicted FROM s JOIN best USING (id)
""".replace(chr(92) * 2, chr(92)))
def classify_naive_bayes_documents(spark, sf):
    """Bag-of-words naive Bayes on document quality; the fitted model is saved,
    loaded again and applied to the test split."""
    x = _labelled_docs(spark, sf)
    model = cl.fit_naive_bayes(x.where(~F.col("is_test")), "text", "quality")
    model = cl.load_model(cl.save_model(model, scratch_path(spark, "naive-bayes")))
    out = cl.decode_predictions(model.transform(x.where(F.col("is_test"))), model)
    return out.select("doc_id", "quality", F.col("prediction_label").alias("predicted"))


def _labelled_parts(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("offer_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.col("p_type").alias("label"))
    return _spread_for_fit(spark, sf, sp.stratified_split(p, "label", 0.2, 42, "offer_id"))


def _spread_for_fit(spark, sf, x):
    """Training rows for every core, in not many more parts: each part sums the statistics of all nodes by itself."""
    return st.spread_parts(spark, sf, x, 2 * spark.sparkContext.defaultParallelism)


@query("classify_forest_parts", note="Spark ML fit; rows-only check")
def classify_forest_parts(spark, sf):
    """Preprocessed bag of words + random forest, part titles -> type."""
    x = _labelled_parts(spark, sf)
    model = cl.fit_forest(x.where(~F.col("is_test")), "title", "label")
    out = cl.decode_predictions(model.transform(x.where(F.col("is_test"))), model)
    return out.select("offer_id", "label", F.col("prediction_label").alias("predicted"))


@query("classify_ngram_linear_parts", note="Spark ML fit; rows-only check")
def classify_ngram_linear_parts(spark, sf):
    """Word + character n-gram linear classifier, part titles -> type."""
    x = _labelled_parts(spark, sf)
    model = cl.fit_ngram_linear(x.where(~F.col("is_test")), "title", "label")
    out = cl.decode_predictions(model.transform(x.where(F.col("is_test"))), model)
    return out.select("offer_id", "label", F.col("prediction_label").alias("predicted"))


@query("classify_learned_accuracy_parts", "WITH src AS (SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS cls FROM part),"
       + _sql_split("src", "s") + """,
t AS (SELECT cls, count(*) AS n FROM s WHERE is_test GROUP BY cls)
SELECT model, CAST((SELECT sum(n) FROM t) AS BIGINT) AS n_test, round((SELECT max(n) / sum(n) FROM t), 6) AS majority_share, true AS above_majority
FROM (SELECT unnest(['forest', 'ngram_linear', 'naive_bayes']) AS model)
""")
def classify_learned_accuracy_parts(spark, sf):
    """Each learned baseline, fitted on the train split of part titles (class: the noun), saved
    and loaded, must beat the share of the largest class on the test split."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("offer_id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"),
                                        st.noun(F.col("p_name")).alias("label"))
    x = _spread_for_fit(spark, sf, sp.stratified_split(p, "label", 0.2, 42, "offer_id"))
    train, test = x.where(~F.col("is_test")), x.where("is_test")
    out = None
    for name, fit in (("forest", cl.fit_forest), ("ngram_linear", cl.fit_ngram_linear), ("naive_bayes", cl.fit_naive_bayes)):
        model = cl.load_model(cl.save_model(fit(train, "title", "label"), scratch_path(spark, name)))
        right = cl.decode_predictions(model.transform(test), model).groupBy("label").agg(
            F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction_label")).alias("right"))
        row = right.agg(F.sum("n").alias("n_test"), (F.max("n") / F.sum("n")).alias("share"), (F.sum("right") / F.sum("n")).alias("accuracy")).select(
            F.lit(name).alias("model"), "n_test", F.round("share", 6).alias("majority_share"), (F.col("accuracy") > F.col("share")).alias("above_majority"))
        out = row if out is None else out.unionByName(row)
    return out
