"""Conversation repair against brute force, cut into pieces of any size."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from arbora.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, part string, cost string"
GRAMMAR = re.compile("(s?(ua)+)?")


def brute(kinds, most_inserts=2):
    """The least (cost, audit) over all edits, with up to ``most_inserts`` inserted turns at a place."""
    n, best = len(kinds), None
    inserts = [i for k in range(most_inserts + 1) for i in itertools.product("ua", repeat=k)]
    own = [[("D", "", 3)] + ([] if doomed else [("K", initial, extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)])
           for initial, doomed, extra in kinds]
    for between in itertools.product(inserts, repeat=n + 1):
        for edits in itertools.product(*own):
            roles = audit = ""
            cost = 0
            for k in range(n + 1):
                roles += "".join(between[k])
                audit += "I" * len(between[k])
                cost += 2 * len(between[k])
                if k < n:
                    audit, roles, cost = audit + edits[k][0], roles + edits[k][1], cost + edits[k][2]
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_lightest_derivation_equals_brute_force():
    pick = random.Random(5)
    for _ in range(25):
        kinds = [(pick.choice("suaax "), pick.random() < 0.2, pick.randint(0, 1)) for _ in range(pick.randint(0, 3))]
        assert cv.lightest(kinds, cv.ENDS, (0,))[0] == brute(kinds), kinds


def test_pieces_of_any_size_give_the_same_repairs(spark, frame):
    pick, rows = random.Random(3), []
    for conv in range(12):
        for turn in range(pick.randint(1, 40) if conv else 300):
            rows.append((conv, turn if pick.random() < 0.9 else None, pick.choice(["user", "assistant", "system", "tool"]),
                         pick.choice(["Yes.", "no", " ", "What?", "so %d." % turn]), "own", "own"))
    df = frame(rows, SCHEMA).repartition(3)
    whole, cut = (sorted(map(tuple, cv.summary(cv.repair(df, piece_rows=n)).collect())) for n in (1000, 3))
    assert len(whole) == 12 and whole == cut
    for conv, *_, cost, audit, digest in whole:
        mine = [dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows if r[0] == conv]
        for r in mine:
            r["digest"] = hashlib.sha256(r["text"].encode()).hexdigest()
        mine.sort(key=lambda r: (r["turn"] is not None, r["turn"], r["role"], r["digest"]))
        found = cv.faults(mine, set())
        assert (cost, audit) == cv.lightest(cv._kinds(mine, found), cv.ENDS, (0,))[0]
        turns = cv.edited(mine, audit, 0)
        assert GRAMMAR.fullmatch("".join(t["role"][0] for t in turns))
        assert hashlib.sha256("\n".join(t["role"] + ":" + t["text"] for t in turns).encode()).hexdigest() == digest


def test_hand_computed_rows(frame):
    df = frame([
        (1, 0, "user", "Hi.", "", ""), (1, 1, "assistant", "Hello!", "", ""),                    # sound
        (2, 5, "assistant", "Hello.", "", ""),                                                   # a user turn is missing
        (3, 0, "user", "Hi.", "", ""), (3, 0, "user", "Hi.", "", ""), (3, 2, "assistant", "cut off", "", ""),
        (None, None, None, None, "", ""), (None, 3, "system", "", "", ""),                       # only blanks
        (4, 0, "system", "Be kind.", "", ""), (4, 1, "user", "Hi.", "", ""),                     # no answer
    ], SCHEMA)
    out = {r.conv_id: r for r in cv.summary(cv.repair(df)).collect()}
    row = lambda c: tuple(out[c])[1:8]  # noqa: E731  gaps, blank, duplicate, truncated, illegal, cost, audit
    assert row(1) == (0, 0, 0, 0, 0, 0, "KK") and row(2) == (0, 0, 0, 0, 0, 2, "IK")
    assert row(3) == (1, 0, 1, 1, 1, 4, "KDK") and row(4) == (0, 0, 0, 0, 0, 2, "KKI")
    assert row(None) == (0, 2, 0, 0, 1, 6, "DD")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[2].repaired_sha256 == sha("user:\nassistant:Hello.") and out[None].repaired_sha256 == sha("")


def test_rows_that_are_not_present_and_empty_tables(frame):
    df = frame([(1, 0, "user", "Hi.", "", ""), (2, 0, "user", "Hi.", "", "")], SCHEMA)
    out = {r.conv_id: (r.cost, r.audit) for r in cv.summary(cv.repair(df, present=F.col("conv_id") == 2)).collect()}
    assert out == {1: (0, ""), 2: (2, "KI")}
    assert cv.summary(cv.repair(df.limit(0))).count() == 0
    long = frame([(1, 0, "user", "x" * 200_000, "", "")], SCHEMA)
    assert cv.summary(cv.repair(long)).first().truncated == 1


def test_damage(frame):
    import zlib
    df = frame([(c, t, "assistant", "One. Two!", "", "") for c in range(40) for t in range(3)], SCHEMA)
    out = {}
    for r in cv.damaged(df).collect():
        out.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    for (c, t), got in out.items():
        code = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = {1: "", 2: "One Two"}.get(code, "One. Two!")
        assert got == [("user" if code == 4 else "assistant", text, code != 0)] * (2 if code == 3 else 1)
