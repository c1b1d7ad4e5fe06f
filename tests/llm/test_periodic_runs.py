"""Periodic runs against brute force over all periods."""

import hashlib
import random

import numpy as np

from arbora.llm import periodic_runs as pr

SCHEMA = "doc_id long, text string, runs string, best string"


def brute(w):
    """Every maximal stretch of equal words d apart, at its least d."""
    out = {}
    for d in range(1, len(w) // 2 + 1):
        i = 0
        while i + d < len(w):
            start = i
            while i + d < len(w) and w[i] == w[i + d]:
                i += 1
            if i > start and i - start + d >= max(12, 2 * d):
                out.setdefault((start, i - start + d), d)
            i += i == start
    return sorted(((s, n, d) for (s, n), d in out.items()), key=lambda r: (r[0], r[2]))


def sequence(pick):
    n, letters = pick.randint(0, 200), pick.choice([1, 2, 2, 3, 6, 50])
    w = [pick.randrange(letters) for _ in range(n)]
    for _ in range(pick.randint(0, 3)):
        if n > 14:
            s, p = pick.randrange(n - 12), pick.randint(1, 40)
            for i in range(s + p, min(n, s + pick.randint(12, 150))):
                w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    pick = random.Random(11)
    for _ in range(700):
        w = sequence(pick)
        _, ids = pr.words_and_ids(" ".join(map(str, w)).encode())
        assert pr.runs(ids) == brute(w), w


def test_convolution_is_exact_for_any_number_of_primes():
    rng = np.random.default_rng(4)
    for top in (3, 50_000, 3_000_000_000):
        windows = rng.integers(max(0, top - 2), top, size=(5, 23))
        blocks = windows[:, 7:15].copy()
        got = pr.zero_mismatches(blocks, windows, 16, top)
        want = np.array([[np.array_equal(b, v[d:d + 8]) for d in range(16)] for b, v in zip(blocks, windows)])
        assert got[:, 7].all() and np.array_equal(got, want)
    # a sum of squares that is a multiple of the first prime (4 mod-1 primes are sums of two squares) is not zero
    r, s = next((r, int(s)) for r in range(1, 40_000) if (s := (pr.PRIMES[0] - r * r) ** 0.5) == int(s) and r * r + int(s) ** 2 == pr.PRIMES[0])
    assert not pr.zero_mismatches(np.array([[0, 0]]), np.array([[r, s, r]]), 2, 40_000).any()


def test_long_texts_of_one_word_and_of_two():
    assert pr.runs(np.zeros(50_000, dtype=np.int64)) == [(0, 50_000, 1)]
    assert pr.runs(np.arange(50_001) % 2) == [(0, 50_001, 2)]
    assert pr.runs(np.arange(40_000) % 20_000) == [(0, 40_000, 20_000)]
    assert pr.runs(np.arange(39_999) % 20_000) == []


def test_collapse_of_rows(frame):
    texts = {1: "a b c " * 6, 2: None, 3: "", 4: " \t\n", 5: "one two", 6: "x y z " * 7 + "end", 7: "w " * 11}
    df = frame([(i, t, "own", "own") for i, t in texts.items()] + [(None, "q " * 12, "", ""), (1, "a b c " * 6, "", "")], SCHEMA)
    rows = pr.collapse(df).collect()
    out = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and out[1].collapsed == "a b c" and [tuple(r) for r in out[1].runs] == [(0, 18, 3)]
    assert out[6].collapsed == "x y z end" and [tuple(r) for r in out[6].runs] == [(0, 14, 2)]
    assert all(out[i].collapsed == "" and out[i].runs == [] for i in (2, 3, 4))
    assert out[5].collapsed == "one two" and out[7].collapsed == " ".join("w" * 11) and out[None].collapsed == "q"
    sums = {r.doc_id: r for r in pr.digests(pr.collapse(df)).collect()}
    assert tuple(sums[1])[1:6] == (1, 0, 18, 3, 6000) and tuple(sums[2])[1:6] == (0, None, None, None, None)
    assert sums[1].runs_sha256 == hashlib.sha256(b"0,18,3\n").hexdigest() and sums[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert pr.digests(pr.collapse(df.limit(0))).count() == 0


def test_planted_tails_are_found(frame):
    pick = random.Random(2)
    df = frame([(i, " ".join("w%d" % pick.randrange(3000) for _ in range(400)), "", "") for i in range(200)], SCHEMA)
    found = {r.doc_id: r.n_runs for r in pr.digests(pr.collapse(df, pr.planted_tail)).collect()}
    words = ["w"] * 400
    planted = {i for i in found if pr.planted_tail(i, words) is not words}
    assert 10 < len(planted) < 40 and all(n == 0 for i, n in found.items() if i not in planted)
    assert sum(found[i] > 0 for i in planted) >= len(planted) - 2  # a tail of few words may be shorter than a run
    assert pr.planted_tail(None, words) is words
