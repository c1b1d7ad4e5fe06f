"""Language identification: counts and ranks against brute force, held-out accuracy, odd rows."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from arbora.llm import language_id as li
from arbora.session import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string"


def brute_counts(text):
    """Sizes of the n-gram groups of a text, by counting strings."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        w = f" {w} "
        for n in range(1, li.LONGEST + 1):
            out.update(g for i in range(len(w) - n + 1) if (g := w[i:i + n]) != " ")
    return out


def test_counts_equal_brute_force(monkeypatch):
    texts = ["", "a", "Hello, hello world!", "ÀÉ ß 漢字 a1b2", "x" * 50, "the cat the hat " * 40]
    for chunk in (li.CHUNK, 7):
        monkeypatch.setattr(li, "CHUNK", chunk)
        for t in texts:
            grams, counts = li.gram_counts(li.letters(t))
            assert sorted(counts.tolist()) == sorted(brute_counts(t).values()), t
            assert len(set(grams.tolist())) == len(grams)


def test_distance_by_hand():
    rank = lambda t: li.ranked(*li.gram_counts(li.letters(t)))
    a, b = rank("aaa ab ab ab"), rank("zz zz zy")
    p = li.Profiles({"a": a, "b": b})
    mine = rank("ab ab zz")
    want = [sum(abs(k - prof.tolist().index(g)) if g in prof else li.PROFILE for k, g in enumerate(mine)) for prof in (a, b)]
    name, score = p.predict("ab ab zz")
    assert name == ("a" if want[0] <= want[1] else "b") and score == 1 - min(want) / (li.PROFILE * len(mine))
    assert li.Profiles({"y": a, "x": a}).predict("ab")[0] == "x" and li.Profiles({}).predict("ab") == ("und", 0.0)


def test_held_out_accuracy(spark):
    out = entry_mod.queries()["op12_language_id"](spark, SF)
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    row = out.join(docs, "doc_id").where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"),
                                                         F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert out.count() == docs.count() and 150 < row.n < 250 and row.a >= 0.99 and 0 <= row.lo <= row.hi <= 1


def test_sampled_profiles_and_odd_rows(frame):
    rows = [(i, f"the thing and that {i % 7} thing", "en", "own") for i in range(60)] \
        + [(100 + i, f"der die und das {'ist' * (i % 5)} nicht", "de", "own") for i in range(60)] \
        + [(200, None, "fr", None), (201, "bonjour", None, None), (None, "the", "en", None)]
    df = frame(rows, SCHEMA)
    profiles = li.learn(df, sample=3)
    assert profiles.names == ["de", "en"]  # fr has no text, a null lang isn't learned
    odd = frame([(1, "The thing.", "x", "mine"), (2, None, "x", "mine"), (3, "12 !?", "x", "mine"), (4, "", None, None),
                 (None, "die und das", None, None), (1, "The thing.", "x", "mine"), (5, "und das " * 100_000, "x", None)], SCHEMA)
    out = li.predict(odd, profiles)
    got = [(r.doc_id, r.lang_pred) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "de"), (5, "de")], key=repr)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    none = li.learn(df.limit(0))
    assert li.predict(odd, none).where("lang_pred <> 'und' OR score <> 0").count() == 0 and li.predict(odd.limit(0), profiles).count() == 0
    assert frame([(5,), (None,)], "k long").select(li.fold("k").alias("f")).collect()[1].f is None
