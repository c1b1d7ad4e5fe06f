"""Invariants of splits, caps, dedupe, folds, corpus and significance."""

import pytest
from pyspark.sql import functions as F

from arbora.operators import corpus as cp
from arbora.operators import offers as of
from arbora.operators import runs as rn
from arbora.operators import significance as sg
from arbora.operators import splits as sp
from arbora.session import table

from small_tables import SF_SMALL


def test_unknown_source_raises(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        sp.unify(df, "no_such_source")


def test_stratified_split_is_disjoint_complete_and_quota_exact(spark):
    c = table(spark, "/root/testdata/sf0.01", "customer").select("c_custkey", "c_mktsegment")
    s = sp.stratified_split(c, "c_mktsegment", 0.2, 42, "c_custkey").persist()
    assert s.count() == c.count()
    assert s.select("c_custkey").distinct().count() == c.count()
    import math
    assert s.where("is_test").count() == math.ceil(0.2 * c.count())


def test_train_validate_test_shares(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", F.col("lang").alias("cls"))
    s = {r.split: r["count"] for r in sp.train_validate_test(d, "cls", 42, "doc_id").groupBy("split").count().collect()}
    assert s == {"test": 200, "validate": 160, "train": 640}


def test_cap_never_exceeds_n_and_dedupe_keys_unique(spark):
    o = table(spark, SF_SMALL, "documents").select(
        F.col("doc_id").alias("offer_id"), F.col("text").alias("Title"), F.col("source").alias("Host"),
        F.col("lang").alias("Category"), F.lit(None).cast("string").alias("Breadcrumb"),
        F.lit(None).cast("string").alias("BreadcrumbList"), F.lit(None).cast("string").alias("Description"))
    capped = of.cap_per_group(o, "Host", 3)
    assert capped.groupBy("Host").count().agg(F.max("count")).first()[0] <= 3
    d = of.dedupe_keep_first(o, "Title", ["Category", "Breadcrumb", "BreadcrumbList", "Description"])
    assert d.count() == d.select("Title").distinct().count() == o.select("Title").distinct().count()


def test_fold_appends_unless_substring(spark):
    q = spark.createDataFrame([
        ("f", 0, "s", "<http://schema.org/Product/name>", '"Red Shoe"@en', "http://www.a.com/1"),
        ("f", 1, "s", "<http://schema.org/Product/category>", '"shoes"', "http://www.a.com/1"),
        ("f", 2, "s", "<http://schema.org/Product/category>", '"shoe"', "http://www.a.com/1"),
        ("f", 3, "s", "<http://schema.org/Product/category>", '"boots"', "http://www.a.com/1"),
        ("f", 4, "s", "<http://schema.org/Product/breadcrumb>", '"Home Men"', "http://www.a.com/1"),
        ("f", 5, "s", "<http://schema.org/Product/name>", '"Blue Hat"@en', "http://www.b.com/2"),
        ("f", 6, "s", "<http://schema.org/Product/description>", '"A hat."@en', "http://www.b.com/2"),
        ("f", 7, "s", "<http://schema.org/Product/name>", '"no"@de', "http://nodot/3"),
    ], "file string, line_no long, subject string, predicate string, object string, url string")
    out = {r.Title: r for r in of.fold_offers(q).collect()}
    assert out["red shoe"].Category == "shoes boots"
    assert out["red shoe"].Breadcrumb == "men" and out["red shoe"].Host == "a.com"
    assert out["blue hat"].Description == "a hat" and out["blue hat"].Category == ""
    assert len(out) == 2


def test_run_ids_stitch_across_chunks(spark):
    rows = [("f", i, "u" + str(i // 5)) for i in range(23)]
    df = spark.createDataFrame(rows, "file string, line_no long, url string")
    got = [r.run for r in of.run_ids(df, chunk_lines=3).orderBy("line_no").collect()]
    assert got == [i // 5 + 1 for i in range(23)]


def test_token_packing_drops_remainders(spark):
    df = spark.createDataFrame([(i, ["t%d_%d" % (i, j) for j in range(7)]) for i in range(10)],
                               "id long, tokens array<string>")
    p = cp.pack_tokens(df, "id", "tokens", block=4, batch=3).collect()
    # batches of 3 texts x 7 tokens = 21 tokens -> 5 full blocks of 4; last batch 7 -> 1 block
    assert len(p) == 3 * 5 + 1 and all(len(r.tokens) == 4 for r in p)
    first = sorted(p, key=lambda r: (r.batch, r.block))[0]
    assert first.tokens == ["t0_0", "t0_1", "t0_2", "t0_3"]


@pytest.mark.parametrize("b,c,exact,chi", [(6, 14, 0.1153, 0.1175), (40, 70, 0.00545, 0.00569)])
def test_mcnemar_values(spark, b, c, exact, chi):
    t = spark.createDataFrame([(0, b, c, 0)], "n11 long, n10 long, n01 long, n00 long")
    r = sg.mcnemar(t, exact=True).first()
    assert round(r.p_exact, 4 if exact > 0.01 else 5) == exact
    assert (sg.mcnemar(t).first().p_exact is None) == (b + c > sg.EXACT_MAX_DISCORDANT)
    assert round(r.p_chi2, 4 if chi > 0.01 else 5) == chi


def test_report_keys_and_columns(spark):
    metrics = ["weighted_prec", "weighted_rec", "weighted_f1", "macro_f1", "h_f1", "prec_lvl_1", "rec_lvl_1",
               "f1_lvl_1", "prec_lvl_2", "rec_lvl_2", "f1_lvl_2", "prec_lvl_3", "rec_lvl_3", "f1_lvl_3",
               "average_prec", "average_rec", "average_f1"]
    rows = [(k, n, 0.5) for k in ("First Experiment+train", "Second Experiment") for n in metrics]
    long = rn.run_keys(spark.createDataFrame(rows, "run_key string, metric string, value double"), "run_key")
    wide = rn.report(long.withColumn("dataset", F.lit("icecat")), names=metrics)
    got = {r.experiment: r.split for r in wide.collect()}
    assert got == {"First Experiment": "train", "Second Experiment": "all"}
    assert len(wide.columns) == 20


def _fold_by_hand(rows):
    """The fold as one pass over the lines of a file, runs of equal URLs."""
    import itertools
    out = []
    for k, (url, run) in enumerate(itertools.groupby(rows, key=lambda r: r[2]), 1):
        offer = {"Title": "", "Description": "", "Category": "", "Breadcrumb": "", "BreadcrumbList": "", "Breadcrumb_Predicate": ""}
        for predicate, value, _ in run:
            add = lambda field, x: (offer[field] + " " + x).lstrip(" ")
            if predicate == of.NAME_PREDICATE:
                offer["Title"] = value
            elif predicate == of.DESCRIPTION_PREDICATE:
                offer["Description"] = value
            elif "category" in predicate:
                if value not in offer["Category"]:
                    offer["Category"] = add("Category", value)
            elif predicate == of.BREADCRUMB_PREDICATE:
                if value not in offer["Breadcrumb"]:
                    offer["Breadcrumb"], offer["Breadcrumb_Predicate"] = add("Breadcrumb", value), add("Breadcrumb_Predicate", predicate)
            else:
                offer["BreadcrumbList"] = add("BreadcrumbList", value)
        if offer["Title"] and any(offer[c] for c in ("Description", "Category", "Breadcrumb", "BreadcrumbList")):
            out.append((k, *offer.values(), url))
    return sorted(out)


def test_fold_of_runs_over_chunk_borders_equals_one_pass(spark):
    import random
    pick = random.Random(8)
    predicates = [of.NAME_PREDICATE, of.DESCRIPTION_PREDICATE, "<http://schema.org/Product/category>", "<http://schema.org/Product/category>",
                  of.BREADCRUMB_PREDICATE, of.BREADCRUMB_PREDICATE, "<http://schema.org/BreadcrumbList/itemListElement>"]
    # values that are contained in others and across the border of two others
    values = ["a", "b", "a b", "b c", "c", "b a", "c a b", "bb", "a b c"]
    rows = []
    for _ in range(60):
        url = f"http://www.s{pick.randrange(2)}.com/x"
        rows += [(pick.choice(predicates), pick.choice(values), url) for _ in range(pick.choice([1, 2, 5, 30]))]
    df = spark.createDataFrame([("f", i, "_:n", p, f'"{v}"@en', u) for i, (p, v, u) in enumerate(rows)],
                               "file string, line_no long, subject string, predicate string, object string, url string")
    cols = ["run", "Title", "Description", "Category", "Breadcrumb", "BreadcrumbList", "Breadcrumb_Predicate", "URL"]
    want = _fold_by_hand(rows)
    assert len(want) > 10
    for chunk in (1, 3, 16, of.CHUNK_LINES):
        assert sorted(map(tuple, of.fold_offers(df, chunk_lines=chunk).select(cols).collect())) == want, chunk
    runs = [r.run for r in of.run_ids(df, chunk_lines=4).orderBy("line_no").collect()]
    assert runs == [r.run for r in of.run_ids(df).orderBy("line_no").collect()] and max(runs) == sum(1 for i, r in enumerate(rows) if not i or r[2] != rows[i - 1][2])
    hosts = spark.createDataFrame([("s1",)], "host string")
    assert sorted(map(tuple, of.fold_offers(df, hosts, chunk_lines=5).select(cols).collect())) == [w for w in want if "s1" in w[-1]]


def test_fold_reads_and_shuffles_quads_once(spark):
    q = spark.range(1000).selectExpr("'f' AS file", "id AS line_no", "'s' AS subject", "'p' AS predicate", "'o' AS object", "concat('u.', id div 9) AS url")
    plan = of.fold_parts(q)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


HOSTS = ["shop.example.org", "www.shop.com", "a.b", "ab", "x", "", "sh.op", "shopping.net", "ex.am", "b.a.b.c"]


@pytest.mark.parametrize("regex, patterns", [
    (False, ["shop", "example.org", "a", "ab", ".", "", "nothing", "shopping.net.long", "b.a", None]),
    (True, ["^shop", "shop.", r"shop\.", "ex.*org$", "a?b", "b+", "(net|org)$", "[xy]", "^$", "", "s.*h", r"\.c", "zz*", None]),
])
def test_hosts_meet_their_patterns(spark, regex, patterns):
    import re
    hosts = spark.createDataFrame([(h,) for h in [*HOSTS, None]], "host string")
    pats = spark.createDataFrame([(p,) for p in patterns * 2], "pattern string")
    out = of.matching_patterns(hosts, pats, regex)
    want = {(h, p) for h in HOSTS for p in patterns if p is not None and (re.search(p, h) if regex else p in h)}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_text_tokens_stage_is_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from arbora.functions.ml import TextTokens
    df = spark.createDataFrame([("Hi, <b>Dear</b> x World_1!",), ("",), (None,), ("é😀a",)], "t string")
    stages = [TextTokens(inputCol="t", outputCol="words"), TextTokens(inputCol="t", outputCol="clean", steps=["preprocess"]),
              TextTokens(inputCol="t", outputCol="grams", grams=2)]
    model = Pipeline(stages=stages).fit(df)
    model.write().overwrite().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m")
    rows = loaded.transform(df).collect()
    assert rows == model.transform(df).collect() and loaded.stages[1].getOrDefault("steps") == ["preprocess"]
    assert rows[0].words == ["hi", "dear", "world_1"] and rows[1].words == rows[2].words == rows[2].grams == []
    assert rows[3].grams == ["é😀", "😀a"] and "b" not in rows[0].clean
    with pytest.raises(ValueError):
        TextTokens(inputCol="t", outputCol="x", steps=["no such step"])


def test_trained_fallback_predicts_zero_scores_only(spark, tmp_path):
    from arbora.operators import classify as cl
    train = spark.createDataFrame([("red apple fruit", "food"), ("green pear fruit", "food"), ("steel hammer tool", "tools"),
                                   ("claw hammer", "tools")] * 3, "title string, class string")
    model = cl.load_model(cl.save_model(cl.fit_naive_bayes(train, "title", "class"), f"{tmp_path}/nb"))
    vocab = cl.class_vocabulary(spark.createDataFrame([(1, "food"), (2, "tools")], "id int, name string"))
    rows = spark.createDataFrame([(1, "food with a hammer"), (2, "a hammer"), (3, "pear"), (4, "zzz"), (5, None)], "k int, title string")
    scored = cl.dictionary_classify(rows, "title", vocab)
    out = {r.k: r for r in cl.with_fallback(scored, "title", model).collect()}
    assert {k: r.prediction for k, r in out.items() if k < 4} == {1: "food", 2: "tools", 3: "food"}
    assert out[4].prediction in ("food", "tools") and out[5].prediction == out[4].prediction and out[5].title is None
    both = cl.sweep_with_fallback(rows, "title", {"a": vocab, "b": vocab}, "none", model)
    got = {(r.k, r.option): r.prediction for r in both.collect()}
    assert len(got) == 20 and got[2, "a"] == "none" and got[2, "b_fallback"] == "tools" and got[1, "a_fallback"] == "food"
    assert set(both.columns) == {"k", "title", "option", "prediction", "score"}


def test_token_packing_does_not_depend_on_tasks(spark):
    rows = [(i * 7 % 101, ["t%d_%d" % (i, j) for j in range(i % 9)]) for i in range(101)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    small, large = ({(r.batch, r.block): r.tokens for r in cp.pack_tokens(df, "id", block=4, batch=10, tokens_per_task=n, rows_per_bucket=m).collect()}
                    for n, m in ((3, 4), (1 << 22, 1 << 20)))
    by_id, want = sorted(rows), {}
    for b in range(0, 101, 10):
        stream = [t for _, ts in by_id[b:b + 10] for t in ts]
        want |= {(b // 10, k): stream[4 * k:4 * k + 4] for k in range(len(stream) // 4)}
    assert small == large == want
    assert cp.pack_tokens(df.limit(0), "id").count() == 0


def test_dedupe_moves_one_row_of_a_key_and_task(spark):
    import random
    pick = random.Random(1)
    rows = [(i, pick.choice(["t" * 50, "u", "", None]), pick.choice(["b", "a", None, ""]), pick.choice([None, "x"])) for i in range(300)]
    df = spark.createDataFrame(rows, "offer_id long, Title string, Category string, Breadcrumb string")
    for empty in ("last", "first"):
        out = of.dedupe_keep_first(df, "Title", ["Category", "Breadcrumb"], empty)
        rank = lambda x: ((x is None) == (empty == "last"), x or "")
        want = {}
        for r in sorted(rows, key=lambda r: (rank(r[2]), rank(r[3]), r[0])):
            want.setdefault(r[1], r)
        assert {tuple(r) for r in out.collect()} == set(want.values()) and out.columns == df.columns
    plan = of.dedupe_keep_first(df, "Title", ["Category"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1


def test_heavy_groups_are_cut_without_moving_rows(spark):
    rows = [(i, "hot" if i % 2 else f"h{i % 5}" if i % 11 else None, "x" * 100) for i in range(400)]
    df = spark.createDataFrame(rows, "offer_id long, Host string, Title string")
    out = of.cap_heavy_groups(df, "Host", 50, 7)
    got = {}
    for r in out.collect():
        got.setdefault(r.Host, []).append(r.offer_id)
    sizes = {h: sum(r[1] == h for r in rows) for h in got}
    assert sizes["hot"] == 200 and {h: len(x) for h, x in got.items()} == {h: 7 if n > 50 and h else n for h, n in sizes.items()}
    import hashlib
    best = sorted((hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0]) for r in rows if r[1] == "hot")[:7]
    assert sorted(got["hot"]) == sorted(i for _, i in best)
    assert of.cap_heavy_groups(df, "Host", 50, 0).where("Host = 'hot'").count() == 0


def test_split_of_hot_and_rare_classes_in_one_histogram(spark):
    import hashlib
    rows = [(i, "hot" if i < 700 else None if i < 720 else f"c{i % 90}") for i in range(900)]
    df = spark.createDataFrame(rows, "offer_id long, path_list string")
    got = {r.offer_id: r.split for r in sp.train_validate_test(df).collect()}
    assert len(got) == 900
    order = sorted((i for i, c in rows if c == "hot"), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
    labels = [got[i] for i in order]
    assert labels == sorted(labels, key=["test", "validate", "train"].index)     # consecutive stretches of one order
    assert 139 <= labels.count("test") <= 141 and 111 <= labels.count("validate") <= 113
    single = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "offer_id long, path_list string")
    assert {r.split for r in sp.train_validate_test(single).where("path_list = 'a'").collect()} == {"train"}
    pre = df.withColumn("given", F.expr("CASE WHEN offer_id % 4 = 0 THEN 'test' WHEN offer_id = 1 THEN NULL ELSE 'train' END"))
    out = {r.offer_id: r.split for r in sp.train_validate_test(pre, presplit="given").collect()}
    assert len(out) == 900 and all(out[i] == "test" for i in range(0, 900, 4)) and out[1] is None and "validate" in out.values()
    assert sp.stratified_split(df.limit(0)).count() == 0
