"""Hand-computed rows for inputs that the test tables do not hold."""

import gzip
import math
import os

import pytest
from pyspark.sql import functions as F

from arbora.functions import text as tf
from arbora.operators import classify as cl
from arbora.operators import corpus as cp
from arbora.operators import metrics as m
from arbora.operators import offers as of
from arbora.operators import runs as rn
from arbora.operators import significance as sg
from arbora.operators import splits as sp
from arbora.operators import taxonomy as tx
from arbora.sources import files as fs

NODES = "id int, name string, parent_id int, depth int"


@pytest.fixture(scope="module")
def tree(spark):
    """Root, two inner nodes, three leaves; one leaf with a large id."""
    return spark.createDataFrame([(0, "Root", None, 0), (1, "a", 0, 1), (2, "ax", 1, 2), (3, "b", 0, 1), (4, "bx", 3, 2),
                                  (5_000_000, "ay", 1, 2)], NODES)


@pytest.mark.parametrize("logits, leaf", [
    ({1: -16.0, 2: -16.0, 3: -15.0, 4: -15.0}, 4),
    ({1: -11.0, 2: -11.0, 3: -11.0, 4: -10.9}, 4),
    ({1: -700.0, 2: -700.0, 3: -700.0, 4: -699.0}, 4),
    ({1: 2.0, 2: -9.0, 5_000_000: 1.0, 3: -9.0, 4: 9.0}, 5_000_000),
    ({1: 0.5, 2: 0.5, 5_000_000: 0.5}, 2),          # a tie goes to the lowest id
    ({2: 9.0, 3: -30.0, 4: -30.0}, 4),              # leaf 2 lacks the score of its parent
])
def test_path_product_ranks_unrounded(spark, tree, logits, leaf):
    scores = spark.createDataFrame([(7, n, x) for n, x in logits.items()], "item int, node_id int, logit double")
    r = cl.path_product(scores, tree, ["item"]).collect()
    assert [x.leaf_id for x in r] == [leaf]
    path = {2: (1, 2), 4: (3, 4), 5_000_000: (1, 5_000_000)}[leaf]
    expected = sum(-math.log1p(math.exp(-logits[n])) if logits[n] >= 0 else logits[n] - math.log1p(math.exp(logits[n])) for n in path)
    assert r[0].log_score == pytest.approx(expected, rel=1e-12)


TEXTS = [
    (tf.remove_html, "caf&eacute;&nbsp;table &quot;x&quot;", "café table \"x\""),
    (tf.remove_html, "&#233;&#xE9;&amp;lt; a &lt b &unknown; R&D &copy2", "éé&lt; a < b &unknown; R&D &copy2"),
    (tf.remove_html, "<p>a &notin; &CounterClockwiseContourIntegral;</p> &#0; 😀&#128512;", "a ∉ ∳ � 😀😀"),
    (tf.remove_hyperlinks, "see http://a.b/c word www.x.y end", "see  word  end"),
    (tf.remove_special_characters, "foo bar_-baz　!", "foo barbaz　"),
    (tf.remove_whitespace, "  a  b  ", "a b"),
    (tf.remove_line_breaks, " a\nb ", "ab"),
    (tf.preprocess_nils, "A&nbsp;&quot;B&quot; C", "a b c"),
    (tf.strip, "\x1c\u0085 x  ", "x"),
]


@pytest.mark.parametrize("fn, given, expected", TEXTS)
def test_text_in_unicode(spark, fn, given, expected):
    assert spark.createDataFrame([(given,)], "t string").select(fn("t").alias("r")).first().r == expected


def test_parsing_of_odd_values(spark):
    df = spark.createDataFrame([("['9999999999999999999', '12', 'x']", "yes"), ("[]", "TRUE"), (None, "False")], "l string, b string")
    rows = df.select(tf.parse_int_list("l").alias("l"), tf.to_bool("b").alias("b")).collect()
    assert [r.l for r in rows] == [[None, 12], [], None] and [r.b for r in rows] == [None, True, False]


OFFERS = [('say "hi"', "two\nlines", "a;b", " lead", "trail ", "p", "u1", "h1"), ("", None, "c\\", '"', '""', ";", "u2", "h2"),
          ("plain", "d", "e", "f", "g", "p", "u3", "h3")]


def test_offer_files_keep_every_row(spark, tmp_path):
    df = spark.createDataFrame(OFFERS, ", ".join(f"{c} string" for c in of.OFFER_COLUMNS))
    fs.write_offer_files(df, f"{tmp_path}/o")
    back = sorted(tuple(r) for r in fs.read_offer_files(spark, f"{tmp_path}/o").select(of.OFFER_COLUMNS).fillna("").collect())
    assert back == sorted(tuple(x or "" for x in r) for r in OFFERS)
    os.makedirs(f"{tmp_path}/bad")
    with open(f"{tmp_path}/bad/x.csv", "w") as f:
        f.write(";".join(fs.OFFER_FILE_HEADER) + "\na;b\n1;2;3;4;5;6;7;8\n")
    assert fs.read_offer_files(spark, f"{tmp_path}/bad").count() == 1
    assert fs.dropped_offer_rows(spark, f"{tmp_path}/bad").first().n_dropped == 1


def test_quoted_csv_keeps_blanks(spark, tmp_path):
    rows = [("1", "  a "), ("2", 'b "c"\n d')]
    fs.write_quoted_csv(spark.createDataFrame(rows, "i string, t string"), f"{tmp_path}/q")
    assert sorted(map(tuple, fs.read_quoted_csv(spark, f"{tmp_path}/q", fs.string_schema(["i", "t"])).collect())) == rows


def test_results_below_an_aggregated_folder(spark, tmp_path):
    base = f"{tmp_path}/aggregated_runs"
    schema = fs.string_schema(["experiment", "value"])
    for name in ("r1", "r1_aggregated"):
        fs.write_report(spark.createDataFrame([(name, "1")], "experiment string, value string"), f"{base}/{name}")
    assert [r.experiment for r in fs.read_results(spark, {"g": (f"{base}/r1*", schema)}).collect()] == ["r1"]


def test_configs_without_parameters_stay(spark, tmp_path):
    from arbora.plans.q_sources import _CFG_SCHEMA
    with open(f"{tmp_path}/c.json", "w") as f:
        f.write('[{"experiment_name": "a", "parameter": []}, {"experiment_name": "b"}, {"experiment_name": "c", "parameter": [{"synonyms": true}, {}]}]')
    got = sorted((r.experiment_name, r.option, r.synonyms) for r in fs.read_configs(spark, str(tmp_path), _CFG_SCHEMA).collect())
    assert got == [("a", None, None), ("b", None, None), ("c", 0, True), ("c", 1, None)]


def test_quads_need_graph_and_dot(spark, tmp_path):
    lines = ['_:n <p> "a \\"b\\" c"@en <http://x> .', "<s> <p> <o> <g>  .", '<s> <p> "o" .', "<s> <p> <o> <g>", "", "junk"]
    with gzip.open(f"{tmp_path}/q.nq.gz", "wt") as f:
        f.write("\n".join(lines))
    got = [(r.object, r.url) for r in of.read_quads(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [('"a \\"b\\" c"@en', "<http://x>"), ("<o>", "<g>")]


def test_unknown_labels_are_empty_sets(spark, tree):
    items = spark.createDataFrame([(2, 2), (2, 77), (2, None), (77, 4), (None, 4)], "label_id int, pred_id int")
    h = m.level_counts(items, tree).where("scope = 'h'").agg(F.sum("tp"), F.sum("sup"), F.sum("np")).first()
    assert tuple(h) == (2, 6, 6)   # truth 2 three times, prediction 2 once and 4 twice, two nodes each
    out = tx.encode_names(spark.createDataFrame([("ax",), ("nope",)], "name string"), "name", tree).collect()
    assert {r.name: r.node_id for r in out} == {"ax": 2, "nope": None}


def test_null_groups(spark):
    rows = spark.createDataFrame([(i, "f" if i < 8 else None, None if i < 5 else "h") for i in range(12)], "offer_id int, file string, Host string")
    assert of.cap_per_group(rows, ["file", "Host"], 1).count() == 5 + 1 + 4
    classes = spark.createDataFrame([(i, "a" if i < 10 else None) for i in range(20)], "offer_id int, path_list string")
    split = sp.stratified_split(classes).where("is_test").groupBy("path_list").count().collect()
    assert {r.path_list: r["count"] for r in split} == {"a": 2, None: 2}


def test_clean_table_has_its_check_rows(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert {(r.check, r.n) for r in rn.key_checks(t, ["k"], ["v"], ref=t, ref_key=["k"]).collect()} == {
        ("table_duplicate_key", 0), ("table_duplicate_payload", 0), ("table_orphan", 0)}


@pytest.mark.parametrize("b, c, p", [(3_000_000_000, 3_000_000_000, 1.0), (3_000_000_000, 3_000_200_000, 0.00982),
                                     (5000, 5200, 0.0487), (0, 5, 0.0625), (0, 0, 1.0), (3000, 3000, 1.0)])
def test_exact_mcnemar_for_many_pairs(spark, b, c, p):
    t = spark.createDataFrame([(0, b, c, 0)], "n11 long, n10 long, n01 long, n00 long")
    got = sg.mcnemar(t, exact=True).first().p_value
    assert got == pytest.approx(p, abs=2e-4)
    n, k = b + c, min(b, c)
    if 0 < n < 20_000:   # exact rational sum
        tail = sum(math.comb(n, i) for i in range(k + 1))
        assert got == pytest.approx(min(1.0, float(2 * tail / (1 << n)) if n < 1000 else 2 * tail / (1 << n)), rel=1e-9)


def test_masks_at_the_ends_of_the_range(spark):
    toks = spark.createDataFrame([(1, ["t"] * 1000)], "i int, toks array<string>")
    for p, n in ((1.0, 1000), (0.0, 0)):
        masked, _ = cp.mask_tokens(F.col("toks"), F.col("i"), p)
        assert toks.select(masked.alias("x")).first().x.count(cp.MASK_TOKEN) == n


def test_dictionary_rows_are_kept_as_they_are(spark):
    vocab = cl.class_vocabulary(spark.createDataFrame([(1, "red shoe"), (2, "hat")], "id int, name string"))
    rows = spark.createDataFrame([(1, "a red hat"), (1, "red shoe red"), (None, None), (3, "none")], "offer_id int, title string")
    got = [(r.offer_id, r.title, r.prediction, r.score) for r in cl.dictionary_classify(rows, "title", vocab, "dflt").collect()]
    assert sorted(got, key=str) == sorted([(1, "a red hat", "hat", 1.0), (1, "red shoe red", "red shoe", 1.5), (None, None, "dflt", 0.0),
                                           (3, "none", "dflt", 0.0)], key=str)


def test_searched_hosts(spark):
    rows = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://c.d/a.b"), (3, None), (4, "http://e")], "i int, url string")
    hosts = spark.createDataFrame([("a.b",), (None,)], "host string")
    assert sorted(r.i for r in of.searched_host_filter(rows, hosts).collect()) == [1, 2]
    assert of.searched_host_filter(rows, hosts.limit(0)).count() == 0


#: tree: level 1 has a = 1, b = 2; level 2 has ax = 1, ay = 2 (children of a) and bx = 3 (child of b).
@pytest.mark.parametrize("scores, expected", [
    ({1: {1: .9, 2: .1}, 2: {3: .8, 1: .15, 0: .05}}, ("1,1", 2, 1)),        # a sure: bx is masked
    ({1: {1: .4, 2: .3, 0: .3}, 2: {3: .8, 1: .2}}, ("1,3", 4, 0)),          # a unsure: the argmax is free
    ({1: {0: .9, 1: .1}, 2: {3: .6, 0: .4}}, ("0,0", 0, 1)),                 # surely out of category
    ({1: {1: .9, 2: .1}, 2: {3: 1.0}}, ("1,3", 4, 0)),                       # no child of a is scored
    ({1: {1: .5, 2: .5}, 2: {1: .25, 2: .25, 3: .25, 0: .25}}, ("1,0", 1, 0)),   # ties; .5 isn't above the threshold
    ({1: {1: .9, 2: .1}, 2: {1: .5, 2: .5, 9: .0}}, ("1,1", 2, 0)),          # an ordinal that the tree lacks
])
def test_successor_decode(spark, tree, scores, expected):
    rows = [("x", k, o, math.log(p) if p else -99.0) for k, level in scores.items() for o, p in level.items()]
    df = spark.createDataFrame([*rows, ("x", 1, 2, None)], "item string, level int, ordinal int, logp double")
    r = cl.successor_decode(df, tree, ["item"], 0.5).first()
    assert (r.path, r.leaf_id, r.n_forced) == expected


def test_successor_decode_of_no_scores(spark, tree):
    none = spark.createDataFrame([], "item string, level int, ordinal int, logp double")
    assert cl.successor_decode(none, tree, ["item"], 0.5).count() == 0


def test_trees_of_unknown_depth(spark):
    chain = [(0, "Root", None), *[(i, f"n{i}", i - 1) for i in range(1, 60)], (100, "x", 3), (200, "other root", None), (201, "y", 200), (300, "lost", 999)]
    out = {r.id: r for r in tx.taxonomy_from_edges(spark.createDataFrame(chain, "id int, name string, parent_id int")).collect()}
    assert len(out) == len(chain) and all(list(out[i].path) == list(range(1, i + 1)) and out[i].depth == i for i in range(60))
    assert list(out[100].path) == [1, 2, 3, 100] and list(out[100].opath) == [1, 1, 1, 2]
    assert out[200].depth == 0 and list(out[201].path) == [201] and list(out[300].path) == [300]
    with pytest.raises(ValueError):
        tx.taxonomy_from_edges(spark.createDataFrame([(0, "Root", None), (1, "a", 2), (2, "b", 1)], "id int, name string, parent_id int")).count()


def test_padding_is_dropped(spark):
    df = spark.createDataFrame([(1, 1), (-1, 2), (3, -1)], "label int, pred int")
    assert [(r.label, r.pred) for r in m.drop_padding(df).orderBy("label").collect()] == [(1, 1), (3, -1)]


def test_host_sketches_merge(spark):
    df = spark.range(20000).selectExpr("id % 7 AS file", "concat('http://www.h', id % 9000, '.org/x') AS URL")
    n = of.merged_hosts(of.host_sketches(df, "file")).first().n_hosts
    assert abs(n - 9000) <= 4 * of.SKETCH_ERROR * 9000 and of.distinct_hosts(df).first().n_hosts == 9000
    assert of.merged_hosts(of.host_sketches(df.limit(0), "file")).first().n_hosts in (0, None)


def test_lemma_tables_are_checked(spark, monkeypatch):
    lemmas = spark.createDataFrame([("apples", "apple")], "form string, lemma string")
    assert spark.range(1).select(tf.lemma_map_of(lemmas).alias("m")).first().m == {"apples": "apple"}
    monkeypatch.setattr(tf, "LEMMA_MAX_BYTES", 5)
    with pytest.raises(ValueError):
        tf.lemma_map_of(lemmas)


def test_all_corpus_variants():
    from arbora.plans.q_corpus import CONFIGS
    assert len(CONFIGS) == len({cp.variant_name(c, "x") for c in CONFIGS}) == 24


def test_searched_hosts_beyond_the_shipped_size(spark, monkeypatch):
    df = spark.createDataFrame([("http://a.org/x",), ("http://bb.org/y",), (None,), ("http://c.org",), ("http://a.org/x",)], "URL string")
    hosts = spark.createDataFrame([("a.org",), ("c",), (None,)], "host string")
    small = sorted(r.URL for r in of.searched_host_filter(df, hosts, url="URL").collect())
    monkeypatch.setattr(of, "HOSTS_MAX_BYTES", 1)
    assert sorted(r.URL for r in of.searched_host_filter(df, hosts, url="URL").collect()) == small == ["http://a.org/x"] * 2 + ["http://c.org"]


def test_unified_paths_of_missing_levels(spark):
    gs1 = spark.createDataFrame([("n", "d", "a", "b", "c"), ("n2", None, "a", None, "c")], "Name string, Description string, lvl1 string, lvl2 string, lvl3 string")
    rows = {r.title: r for r in sp.unify(gs1, "wdc_ziqi").collect()}
    assert rows["n"].path_list == "a>b>c" and rows["n2"].path_list is None and rows["n2"].category == "c"
    assert {r.title: r.path_list for r in sp.unify(gs1, "wdc_ziqi", null_literal="nan").collect()}["n2"] == "nan"


def test_rare_classes_and_their_complement(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c"), (6, "c")], "offer_id int, path_list string")
    ids = lambda x: sorted(r.offer_id for r in x.collect())
    assert ids(sp.rare_class_rows(df)) == [3] and ids(sp.rare_class_rows(df, complement=True)) == [1, 2, 4, 5, 6]
    assert ids(sp.rare_class_rows(df, min_count=3)) == [1, 2, 3]


def test_losses_of_an_impossible_class(spark):
    r = m.loss_summary(spark.createDataFrame([(0.0,), (1.0,)], "p double")).first()
    assert r.n_items == 2 and r.mean_loss == r.focal_loss == r.perplexity == float("inf")


def test_taxonomy_by_path_and_path_codes(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", None)], "k int, l1 string, l2 string")
    names = {r.name: r for r in tx.taxonomy_from_levels(df, ["l1", "l2"], "k", key="path").collect()}
    assert set(names) == {"Root", "a", "b", "a>x", "b>x"} and names["b>x"].parent_id == names["b"].id
    nodes = tx.taxonomy_from_levels(df, ["l1", "l2"], "k", key="path")
    codes = {r.name: list(r.code_path) for r in tx.encode_path(nodes).collect()}
    ordinals = {r.name: list(r.code_path) for r in tx.encode_path(nodes, per_parent=True).collect()}
    assert codes["a>x"] == [names["a"].id, names["a>x"].id] and ordinals["b>x"] == [2, 1]
    with pytest.raises(ValueError):
        tx.taxonomy_from_levels(df, ["l1"], "k", key="other")


def test_dictionary_beyond_the_shipped_size_is_scanned_in_parts(spark, monkeypatch):
    classes = spark.createDataFrame([(i, n) for i, n in enumerate(["red", "red_bike", "bike", "blue_car", "car", "a_b_c_d", "zoo"])], "id int, name string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["red bike", "car", "bluecar car", "a b", "nothing here", "", None, "zoo bike red"])], "k int, t string")
    ask = lambda: sorted(((r.k, r.prediction, r.score) for r in cl.dictionary_classify(df, "t", cl.class_vocabulary(classes)).collect()))
    whole = ask()
    monkeypatch.setattr(cl, "INDEX_MAX_BYTES", 200)
    assert cl._index_bytes(cl._inverted_index(cl.class_vocabulary(classes))) > 600 and ask() == whole and len(whole) == 8
