"""Steps that have to hold on large tables: what is broadcast, shuffled or given to one task."""

from collections import Counter

import pytest

from arbora.operators import classify as cl, guards, significance as sg, taxonomy as tx
from arbora.plans import q_classify, q_metrics, q_runs, standins as st


@pytest.fixture
def no_broadcasts(spark):
    """Joins as they are planned for large sides."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def write_tables(spark, folder, parts, lines=()):
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    if lines:
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"
                              ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_paths_of_unknown_depth_are_never_broadcast(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("broadcast")
    monkeypatch.setattr(guards, "checked_broadcast", refuse)
    edges = [(0, "Root", None), *[(i, f"n{i}", i - 1 if i % 20 else 0) for i in range(1, 100)], (200, "other", None), (201, "lost", 999)]
    out = {r.id: r for r in tx.taxonomy_from_edges(spark.createDataFrame(edges, "id int, name string, parent_id int")).collect()}
    assert out[19].path == list(range(1, 20)) and out[99].path == list(range(80, 100)) and out[201].path == [201]
    assert len(out) == len(edges) and out[0].depth == out[200].depth == 0 and out[80].opath == [5]


def test_padded_levels_broadcast_nothing_that_grows(spark, tmp_path):
    parts = [(k, f"a n{k}", "b", "t", k) for k in range(400)]
    sf = write_tables(spark, tmp_path, parts, [(i, 1, i * 7 % 400, i % 13, 1.0, "R") for i in range(900)])
    df = q_metrics.metrics_padded_levels_parts(spark, sf)
    assert "BroadcastExchange" not in final_plan(df)
    assert {r.level for r in df.collect()} == {1, 15, 30, 45}


def _runs_by_hand(parts, lines, leaf):
    """(orderkey, model, seed, label, prediction) as the joins by part key give them."""
    n, of = len(parts), {}
    for p in parts:
        of.setdefault(p[0], []).append(leaf(p))
    out = Counter()
    for order, _, part, supp, *_ in lines:
        if part is None or supp is None:
            continue
        for model, x, y in q_runs.MODELS:
            for seed in q_runs.SEEDS:
                total = part * x + supp * y + seed
                for label in of.get(part, []):
                    for pred in of.get(abs(total) % n * (1 if total >= 0 else -1), []):
                        out[order, model, seed, label, pred] += 1
    return out


def test_seeded_runs_of_odd_keys(spark, tmp_path):
    """Keys that are null, negative, missing or come twice, and a part without a label."""
    for n in (7, 61):
        keys = [None, 3, 3, -2, *range(n - 4)]
        parts = [(k, f"a n{i % 3}", "b", "t" if i != 5 else None, 1) for i, k in enumerate(keys)]
        lines = [(i, 1, None if i == 4 else i % 9 - 3, None if i == 5 else i % 11 - 8, 1.0, "R") for i in range(80)]
        sf = write_tables(spark, tmp_path / str(n), parts, lines)
        nodes = st.t2_nodes(spark, sf)
        ids = {r.name: r.id for r in nodes.collect()}
        out = q_runs.seed_run_items(spark, sf, nodes, ["l_orderkey"])
        assert out.columns == ["l_orderkey", "label_id", "model", "seed", "pred_id"]
        got = Counter((r.l_orderkey, r.model, r.seed, r.label_id, r.pred_id) for r in out.collect())
        assert got == _runs_by_hand(parts, lines, lambda p: p[3] and ids[f"t/b/{p[1].split()[1]}"]) and got


@pytest.mark.parametrize("query", [q_runs.significance_majority_votes, q_runs.significance_contingency, q_runs.significance_mcnemar])
def test_runs_are_grouped_by_item_where_they_are_joined(spark, tmp_path, no_broadcasts, query):
    parts = [(k, f"a n{k % 5}", "b", "t", 1) for k in range(50)]
    sf = write_tables(spark, tmp_path, parts, [(i, 1, i * 7 % 50, i % 13, 1.0, "R") for i in range(300)])
    plan = final_plan(query(spark, sf))
    assert "hashpartitioning(l_orderkey" not in plan and plan.count("hashpartitioning(pred_partkey") == 0


def test_votes_of_levels_in_columns(spark):
    runs = spark.createDataFrame([(1, True, False), (1, True, True), (1, False, False), (2, False, True)], "item int, c1 boolean, c2 boolean")
    out = sg.majority_vote(runs, ["item"], {1: "c1", 2: "c2"})
    assert {(r.item, r.level, r.majority_correct) for r in out.collect()} == {(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, True)}


@pytest.mark.parametrize("query", [q_classify.classify_path_product, q_classify.classify_greedy_decode, q_classify.classify_successor_decode])
def test_candidates_are_grouped_by_item_where_they_are_made(spark, tmp_path, no_broadcasts, query):
    parts = [(k, f"a n{k % 5}", "b", "t", 1) for k in range(50)]
    sf = write_tables(spark, tmp_path, parts, [(i, 1, i * 7 % 50, i % 13, 1.0, "R") for i in range(300)])
    df = query(spark, sf)
    assert "hashpartitioning(l_orderkey" not in final_plan(df) and df.count() == 300


def test_parts_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "PARTS_PER_TASK", 10)
    sf = write_tables(spark, tmp_path, [(k, f"a n{k % 3}", "b", f"t{k % 2}", 1) for k in range(205)])
    assert q_classify._part_titles(spark, sf).rdd.getNumPartitions() == 20
    x = q_classify._labelled_parts(spark, sf)
    assert x.rdd.getNumPartitions() == min(20, 2 * spark.sparkContext.defaultParallelism) and x.count() == 205
    monkeypatch.setattr(st, "PARTS_PER_TASK", 1000)
    assert q_classify._part_titles(spark, sf).count() == 205


def test_ngram_regression_holds_only_buckets_that_vary(spark):
    train = spark.createDataFrame([("red steel bolt", "a"), ("red brass nut", "b"), ("blue steel bolt", "a"), ("blue brass nut", "b")], "t string, l string")
    model = cl.fit_ngram_linear(train, "t", "l")
    assert model.stages[-1].numFeatures < 200
    assert [r.prediction_label for r in cl.decode_predictions(model.transform(train), model).collect()] == ["a", "b", "a", "b"]
    same = spark.createDataFrame([("red steel bolt", "a"), ("red steel bolt", "b"), ("red steel bolt", "b")], "t string, l string")
    model = cl.fit_ngram_linear(same, "t", "l")
    assert {r.prediction_label for r in cl.decode_predictions(model.transform(same), model).collect()} == {"b"}


def test_many_classes_of_one_word_are_scored_at_once(spark):
    """Dense and sparse sums against the definition, with ties."""
    classes = [(i, f"steel w{i} x{i % 7}") for i in range(300)]
    vocab = cl.class_vocabulary(spark.createDataFrame(classes, "id int, name string"))
    texts = ["steel", "a w5 b", "x3x3 w17 w17", "none", None, "w299 x5 steel steel", "x2"]
    out = cl.dictionary_classify(spark.createDataFrame([(t,) for t in texts], "t string"), "t", vocab).collect()
    for r in out:
        scores = [sum((r.t or "").count(w) for w in n.split()) / len(n.split()) for _, n in classes]
        best = max(range(300), key=lambda i: (scores[i], -i))
        assert (r.prediction, r.score) == ((classes[best][1], scores[best]) if scores[best] else (None, 0.0))
