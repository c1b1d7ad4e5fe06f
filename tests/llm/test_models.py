"""Toxicity, nearest neighbours and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arbora.llm import bpe, minhash, mixing, permutation_index, toxicity
from arbora.llm.queries import MIX, vocabulary_path

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = {(r.toxic, r.rejected): r["count"] for r in held.groupBy("toxic", "rejected").count().collect()}
    assert n[(1, True)] / (n[(1, True)] + n[(1, False)]) > 0.85
    assert n.get((0, True), 0) / (n[(0, False)] + n.get((0, True), 0)) < 0.01


def test_toxicity_of_odd_rows(frame):
    docs = frame([(i, "you idiot fool" if i % 2 else "fine words here", "x") for i in range(60)] + [(None, None, "x"), (61, "", "x"), (1, "you idiot", "y"), (62, "word " * 50000, "x")],
                 "doc_id long, text string, p_toxic string")
    labels = frame([(i, 1, i % 2) for i in range(60)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    out = toxicity.score(docs, chain).collect()
    assert len(out) == 64 and all(r.rejected == (r.doc_id % 2 == 1) for r in out if r.doc_id is not None and r.doc_id < 60)
    assert not any(r.rejected for r in out if r.doc_id is None or r.doc_id > 60)
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == 33
    none = toxicity.train(docs, labels.limit(0))
    assert not any(r.rejected for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), chain).count() == 0


def nearest(x, ids, queries, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = unit @ unit[i]
        s[ids == q] = -9
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    local = rows.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in local]), np.array([r.embedding for r in local])
    truth = nearest(x, ids, [int(i) for i in ids if i % 50 == 0])
    got = {}
    for r in permutation_index.search(rows, rows.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    recall = np.mean([len({a for a, _ in truth[q]} & {a for a, _ in got[q]}) / 5 for q in truth])
    assert recall >= 0.95 and all(len(v) == 5 for v in got.values())
    for q in truth:
        for a, s in got[q]:
            i, j = np.flatnonzero(ids == q)[0], np.flatnonzero(ids == a)[0]
            assert abs(s - x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j]))) < 1e-12


def test_neighbours_with_ties_and_odd_rows(frame, monkeypatch):
    monkeypatch.setattr(permutation_index, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 8)), 3).astype(np.float32)
    x[100:250] = x[0]  # half are copies of the first
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (550, [0.0] * 8), (600, [float("nan")] * 8), (None, x[0].tolist())]
    df = frame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in permutation_index.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    truth = nearest(x.astype(np.float64), np.arange(300), range(0, 300, 50))
    assert set(got) == set(range(0, 300, 50))
    assert got[0] == [100, 101, 102, 103, 104] and got[100] == [0, 101, 102, 103, 104]
    assert np.mean([len(set(got[q]) & {a for a, _ in truth[q]}) / 5 for q in truth]) >= 0.9
    two = df.where("vec_id in (50, 51)")
    assert [r.vec_id for r in permutation_index.search(two, two.where("vec_id = 50")).collect()] == [51]
    assert permutation_index.search(df.limit(0), df).count() == 0


def test_neighbours_of_each_dimension_by_itself(frame):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    alone = frame(rows, "vec_id long, embedding array<double>")
    mixed = frame(rows + [(1000, [1.0, 0.0]), (1050, [1.0, 0.1]), (1001, [0.0, 1.0]), (1100, [3.0])], "vec_id long, embedding array<double>")
    ask = lambda df: sorted(map(tuple, permutation_index.search(df, df.where("vec_id % 50 = 0"), k=3).collect()))
    one, both = ask(alone), ask(mixed)
    assert [r for r in both if r[0] < 1000] == one and len(one) == 9
    assert [r[:3] for r in both if r[0] >= 1000] == [(1000, 1, 1050), (1000, 2, 1001), (1050, 1, 1000), (1050, 2, 1001)]


def test_files_that_are_read_follow_the_structure(frame):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 1500)] + 0.05 * rng.normal(size=(1500, 24))
    index = permutation_index.measured(x, 5, 1_000_000)
    loose = permutation_index.measured(rng.normal(size=(1500, 24)), 5, 1_000_000)
    assert index.files <= 40 < loose.files < len(loose.pivots) and index.share < 0.2
    df = frame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, truth = {}, nearest(x, np.arange(1500), range(0, 1500, 50))
    for r in permutation_index.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[q] & {a for a, _ in truth[q]}) / 5 for q in truth]) >= 0.9


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = stage(spark, docs, SF).cache()
        docs = outs[name]
        if name != "bpe":
            assert docs.columns == before.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = before.join(outs["toxicity"], "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 2 and outs["toxicity"].join(labels.where("toxic = 1"), "doc_id").count() <= 8
    # near duplicates: by all pairs of what toxicity kept
    sets = {}
    for r in outs["toxicity"].collect():
        words = r.text.encode().lower().split()
        n = min(5, len(words))
        sets[r.doc_id] = frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()
    ids = sorted(sets)
    drop = set()
    groups = {}
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                groups.setdefault(a, a)
                groups[b] = min(groups.get(b, b), groups[a])
                drop.add(b)
    assert {r.doc_id for r in outs["minhash"].select("doc_id").collect()} == set(ids) - drop
    mixed = mixing.mix(outs["minhash"], **MIX).where("mix_selected").select("doc_id").collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in outs["mixing"].select("doc_id").collect()}
    vocabulary = bpe.Vocabulary(vocabulary_path())
    tokens = {r.doc_id: r.ids for r in outs["bpe"].select("doc_id", "ids").collect()}
    for r in outs["mixing"].limit(50).collect():
        assert tokens[r.doc_id] == [i for part in vocabulary.encode(r.text) for i in part]
    assert len(tokens) == outs["mixing"].count()
