"""Near-dedup of documents and vectors against brute force, with odd rows and crowded groups."""

import random

import numpy as np
import pytest

from arbora.llm import components, embedding_dedup, minhash


def reach(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(frame):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 400)] + [(rng.randint(500, 900), rng.randint(500, 900)) for _ in range(250)]
    rng.shuffle(links)
    links += [(7, 7), (3, 2), (2, 3)]
    out = {r.id: r.component for r in components.components(frame(links, "a long, b long")).collect()}
    truth = reach({x for l in links for x in l}, links)
    assert out == {i: c for i, c in truth.items() if any(i in l and l[0] != l[1] for l in links)}
    assert components.components(frame([], "a long, b long")).count() == 0


def shingles(text, width):
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def documents():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = [(0, None), (1, ""), (2, " \t"), (3, "One"), (4, "oNE"), (5, "one two"), (6, "One Two three"), (7, "ÄB c d e"), (8, "äb c d e")]
    for i in range(10, 300):  # a large group at every distance from its base
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 20])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    out += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 60)))) for i in range(300, 360)]
    out += [(400, " ".join(base * 300)), (401, " ".join(base * 301)), (402, "dup dup dup dup dup dup"), (402, "dup dup dup dup dup dup")]
    return out


@pytest.mark.parametrize("width, block, dense", [(4, 512, False), (5, 32, True)])
def test_documents_match_brute_force(frame, monkeypatch, width, block, dense):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = documents()
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    truth = reach(ids, links)
    df = frame([(i, t, 9) for i, t in rows] + [(None, "One", 9)], "doc_id long, text string, component_id int")
    out = minhash.near_duplicates(df, width, 80).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), truth[r.doc_id], truth[r.doc_id] == r.doc_id), r
    kept = minhash.deduplicated(df, width, 80)
    assert kept.columns == df.columns and kept.count() == len(set(truth.values())) + 1
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    seeds = minhash._mix(np.arange(1, 2 * 280 + 1, dtype=np.uint64))
    for n in (1, 3, 40, 3000):
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        s = minhash.fast_sketch(np.unique(a), 280, seeds)
        assert (s != 0).all()
    common, own = rng.integers(1, 2**63, 800).astype(np.uint64), rng.integers(1, 2**63, 200).astype(np.uint64)
    x, y = (minhash.fast_sketch(np.unique(np.r_[common, o]), 280, seeds) for o in (own[:100], own[100:]))
    assert abs(np.mean(x == y) - 0.8) < 0.1


def vectors(dim, spread, seed):
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(150, dim)))
    for _ in range(3):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(120):
            noise = rng.normal(size=dim)
            rows.append(centre + noise / np.linalg.norm(noise) * rng.choice([0.02, *spread]))
    return [r * rng.uniform(0.1, 9) for r in rows] + [rows[-1]] * 5


@pytest.mark.parametrize("dim, spread, kind", [(16, (0.1, 0.2, 0.3), "float"), (64, (0.05, 0.15, 0.22), "double"), (5, (0.1,), "float")])
def test_vectors_match_brute_force(frame, dim, spread, kind):
    x = np.stack(vectors(dim, spread, dim)).astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit @ unit.T
    links = [(int(a), int(b)) for a, b in np.argwhere(c >= 0.95) if a < b]
    truth, degree = reach(range(len(x)), links), (c >= 0.95).sum(1) - 1
    odd = [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [1.0] * (dim - 1) + [None]), (1004, [float("nan")] + [1.0] * (dim - 1)),
           (1005, [float("inf")] * dim), (None, x[0].tolist()), (1006, [1.0] * (dim + 3))]
    df = frame([(i, v.tolist()) for i, v in enumerate(x)] + odd, f"vec_id long, embedding array<{kind}>")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(out) == len(x) + 8
    found = sum(out[i].n_links for i in range(len(x)))
    assert found <= degree.sum() and found >= 0.995 * degree.sum()
    assert all(out[i].n_links <= degree[i] for i in range(len(x)))
    agree = sum(out[i].component_id == truth[i] for i in range(len(x)))
    assert agree >= 0.995 * len(x)
    for i in range(1000, 1007):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert out[None].component_id is None and out[None].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_dimensions_do_not_meet(frame):
    rows = [(1, [1.0, 2.0, 3.0, 0.5, 1.0]), (2, [1.0, 2.0, 3.0, 0.5, 1.0, 0.0, 0.0, 0.0]), (3, [2.0, 4.0, 6.0, 1.0, 2.0]), (4, [7.0]), (5, [0.1])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame(rows, "vec_id long, embedding array<float>")).collect()}
    assert out == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (1, 4), 5: (1, 4)}


def test_one_hash_a_table_misses_no_pairs(frame, monkeypatch):
    """With k = 1 a table has fewer buckets than with probes; pairs that meet in any own bucket count."""
    k, tables = embedding_dedup.plan(1000, 64, 0.95)
    assert k == 1
    monkeypatch.setattr(embedding_dedup, "plan", lambda *_: (k, tables))
    rng, pairs = np.random.default_rng(5), 4000
    a, z = rng.normal(size=(2, pairs, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= np.sum(z * a, axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * z
    rows = [(2 * i + j, v.tolist()) for i in range(pairs) for j, v in enumerate((a[i], b[i]))]
    out = embedding_dedup.near_duplicates(frame(rows, "vec_id long, embedding array<double>"))
    assert out.where("n_links = 0").count() <= 2


def test_a_crowd_without_balls_writes_rows_by_its_members(frame, monkeypatch):
    """Vectors at cosines about .962 of each other, too far from their centroid for a ball, with a few copies and strangers."""
    rng = np.random.default_rng(8)
    centre = np.zeros(64)
    centre[0] = 1
    noise = rng.normal(size=(900, 64))
    noise[:, 0] = 0
    x = np.sqrt(0.962) * centre + np.sqrt(1 - 0.962) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x[880:] = x[:20]
    x = np.concatenate([x, rng.normal(size=(100, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert near[:900, :900].mean() > 0.5
    monkeypatch.setattr(embedding_dedup, "BLOCK", 256)
    sizes, keep = {}, embedding_dedup.written

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(embedding_dedup, "written", counted)
    df = frame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    truth = reach(range(len(x)), list(zip(*np.nonzero(near))))
    wrong = [i for i in got if got[i][0] != near[i].sum()]
    assert len(wrong) <= 2 and all(abs(got[i][0] - near[i].sum()) <= 1 for i in wrong)   # pairs are missed at 1e-4
    assert {i: c for i, (_, c) in got.items()} == truth
    assert sizes["vector-links"] == 0 and sizes["vector-compared"] < 60 * 900 < near.sum() / 2


def test_pairs_count_in_their_first_bucket():
    left = np.array([[5, 6, 7, 20, 21, 22]] * 4)
    right = np.array([[6, 5, 9, 20, 23, 24], [1, 2, 3, 20, 21, 22], [7, 1, 2, 21, 20, 9], [8, 9, 6, 25, 22, 20]])
    first = lambda key: embedding_dedup.first_meetings(left, right, key, 3).tolist()
    assert first(5) == [True, True, True, True]          # only the first pair meets here; it is asked for pairs that do
    assert first(6)[0] is False                          # that pair has met in bucket 5
    assert first(20) == [False, True, False, True] and first(21)[2] is False
    assert embedding_dedup.least_connected(6, np.array([0, 1, 4]), np.array([1, 2, 5])).tolist() == [0, 0, 0, 3, 4, 4]


def test_a_crowd_of_near_copies_is_copied_by_its_members(frame, monkeypatch):
    """600 near copies of one text and a few documents beside them: word lists move a bounded number of times each."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    half = base[:150] + [rng.choice(vocabulary) for _ in range(150)]
    rows += [(1000 + i, " ".join(half[:-1 - i])) for i in range(5)] + [(2000 + i, " ".join(rng.choice(vocabulary) for _ in range(80))) for i in range(50)]
    monkeypatch.setattr(minhash, "BLOCK", 32)
    blocks = []
    for name in ("_pivot_blocks", "_rest_blocks"):
        real = getattr(minhash, name)
        monkeypatch.setattr(minhash, name, lambda x, real=real: blocks.append(real(x)) or blocks[-1])
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t, 5) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert out == reach(ids, links) and out[599] == 0 and out[1004] == 1000
    moved = [b.count() for b in blocks]
    assert moved[0] >= 600 and sum(moved) < 40 * 600 < len(links) / 4, moved   # all pairs in blocks of 32 would move 19 copies of each in every bucket


def test_blocks_are_bounded_by_words(frame, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_WORDS", 100)
    crowd = frame([(1, 4, 0, i, 90) for i in range(4)], "key long, size long, band int, id long, words long")
    assert minhash._pivot_blocks(crowd).where("side >= 0").select("j").distinct().count() > 1
