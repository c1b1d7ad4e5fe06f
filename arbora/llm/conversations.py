"""Conversation repair: Knuth's lightest-derivation agenda over edits of whole conversations.

An item (i, q) says: the rows from i on can be edited into what the grammar
``(s?(ua)+)?`` of role initials still asks for in state q. Edits are deductions with one
tail each: Keep, Rerole and Delete lead from (i + 1, q') to (i, q), Insert from (i, q').
Items leave the agenda by (cost, rows used, audit). Every deduction raises cost or rows
used, and putting a letter before two audits keeps their order, so the functions are
superior and the first derivation that is popped for an item is its lightest.

Conversations are cut into pieces of bounded size along one range-partitioned sort, so a
conversation with any share of the rows is spread over tasks. One that lies inside a
piece is finished there. Of a longer one each piece gives the lightest derivation
between any two states; pieces combine by the same order (an audit is never a proper
prefix of an equally dear one of the same rows, so joining keeps the order too), and the
chosen states are carried back into the pieces. Only what is one value by its nature, the
audit and the digest, is put together conversation by conversation, in a stream.

Rows: ``conv_id``, ``turn``, ``role``, ``text`` (other columns are left out). Null roles
and texts count as one space, a null conv_id is one conversation, null turns come first;
rows with equal turns are ordered by role and SHA-256 of the text. Repeated rows count as
often as they are there. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arbora.llm.common import written

#: Rows and characters of a piece (a longer row is a piece of its own).
PIECE_ROWS, PIECE_CHARS = 512, 8 << 20
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a. The first and the last may end.
STATES, ENDS = (0, 1, 2, 3), (0, 3)
#: State -> (state before it, role initial between them).
BEFORE = {0: (), 1: ((0, "s"),), 2: ((0, "u"), (1, "u"), (3, "u")), 3: ((2, "a"),)}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"

_STATS = ("blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, distinct_turns long, "
          "first_turn long, last_turn long, first_role string, last_role string")
_PIECE = f"part int, no int, several boolean, cost long, audit string, turns array<struct<role:string,text:string>>, {_STATS}"
_ROWS = "array<struct<turn:long,role:string,text:string,digest:string>>"


def lightest(kinds: list[tuple[str, bool, int]], ends: Iterable[int], goals: Iterable[int]) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) from each goal state before the rows to any of ``ends`` after them.

    A row is (role initial, must be deleted, cost of leaving it in). Goals that can't be
    derived are left out.
    """
    agenda: list[tuple[int, int, str, int, int]] = [(0, 0, "", len(kinds), q) for q in ends]
    final: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str]] = {}
    goals = set(goals)
    while agenda and len(out) < len(goals):
        cost, used, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == 0 and q in goals:
            out[q] = (cost, audit)
        initial, doomed, extra = kinds[i - 1] if i else ("", True, 0)
        for p, c in BEFORE[q]:
            if c in ROLES:
                heapq.heappush(agenda, (cost + INSERT, used, "I" + audit, i, p))
            if not doomed:
                if initial == c:
                    heapq.heappush(agenda, (cost + extra, used + 1, "K" + audit, i - 1, p))
                if c in ROLES:
                    heapq.heappush(agenda, (cost + REROLE + extra, used + 1, "R" + audit, i - 1, p))
        if i:
            heapq.heappush(agenda, (cost + DELETE, used + 1, "D" + audit, i - 1, q))
    return out


def edited(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The rows after the edits of ``audit``, begun in ``state``; the grammar fixes the roles of R and I."""
    out, at = [], 0
    for edit in audit:
        row = None
        if edit != "I":
            row = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "K":
            role, text = row["role"], row["text"]
        else:
            role, text = ROLES["a" if state == 2 else "u"], row["text"] if row else ""
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append({"role": role, "text": text})
    return out


def faults(rows: list[dict], earlier: set[tuple[str, str]]) -> list[str]:
    """The first fault of each row; ``earlier``: (role, digest) of rows before these."""
    seen, out = set(), []
    for r in rows:
        bare, key = r["text"].strip(SPACE), (r["role"], r["text"])
        if not bare:
            out.append("blank")
        elif key in seen or (r["role"], r["digest"]) in earlier:
            out.append("duplicate")
        elif bare[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add(key)
    return out


def _kinds(rows: list[dict], found: list[str]) -> list[tuple[str, bool, int]]:
    return [(r["role"][:1], f in ("blank", "duplicate"), CUT_OFF if f == "truncated" else 0) for r, f in zip(rows, found)]


def _stats(rows: list[dict], found: list[str]) -> dict:
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    return {"blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "least_turn": min(turns, default=None), "most_turn": max(turns, default=None), "distinct_turns": len(set(turns)),
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "first_role": initials[0] if rows else None, "last_role": initials[-1] if rows else None}


def _batches(rows: Iterator[dict], schema: pa.Schema, weight: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 1,000, fewer if the lists in column ``weight`` grow long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + len((row[weight] if weight else None) or ())
        if size >= 1000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _fields(df: DataFrame, ddl: str) -> StructType:
    """The conv_id of ``df`` and then the fields of ``ddl``."""
    return StructType([df.schema["conv_id"], *StructType.fromDDL(ddl).fields])


def pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Sorted rows cut into pieces; those that are a whole conversation are repaired already."""
    schema = _fields(rows, f"{_PIECE}, rows {_ROWS}")
    arrow = to_arrow_schema(schema)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found() -> Iterator[dict]:
            # the first conversation of a task may have begun in the task before, the last may go on in the next
            held, chars, conv, no, several = [], 0, None, 0, True

            def piece(several: bool) -> dict:
                out = dict.fromkeys(arrow.names) | {"conv_id": conv, "part": part, "no": no, "several": several}
                if several:
                    return out | {"rows": held}
                wrong = faults(held, set())
                (cost, audit), = lightest(_kinds(held, wrong), ENDS, (0,)).values()
                return out | {"cost": cost, "audit": audit, "turns": edited(held, audit, 0)} | _stats(held, wrong)

            began = False
            for r in _read(it):
                other = r["conv_id"] != conv
                full = held and (len(held) >= piece_rows or chars + len(r["text"]) > PIECE_CHARS)
                if began and (other or full):
                    several = several or not other
                    yield piece(several)
                    held, chars, no, several = [], 0, no + 1, several and not other
                began, conv = True, r["conv_id"]
                if r["present"]:
                    held.append({k: r[k] for k in ("turn", "role", "text", "digest")})
                    chars += len(r["text"])
            if began:
                yield piece(True)

        yield from _batches(found(), arrow, "rows")

    order = ["conv_id", "turn", "role", "digest", "salt"]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.drop("salt").mapInArrow(cut, schema), "conversation-pieces")


def _with_earlier(several: DataFrame) -> DataFrame:
    """Pieces with the (role, digest) of their rows that an earlier piece of the conversation has."""
    rows = several.select("conv_id", "part", "no", F.explode("rows").alias("r")) \
                  .select("conv_id", "part", "no", "r.role", "r.digest").distinct()
    first = F.min(F.struct("part", "no")).over(Window.partitionBy("conv_id", "role", "digest"))
    again = rows.withColumn("first", first).where(F.struct("part", "no") > F.col("first")) \
                .groupBy("part", "no").agg(F.collect_set(F.struct("role", "digest")).alias("earlier"))
    return several.select("conv_id", "part", "no", "rows").join(again, ["part", "no"], "left")


def _transfers(several: DataFrame) -> DataFrame:
    """Each piece's lightest derivations between any two states."""
    schema = _fields(several, "part int, no int, ways array<struct<before:int,after:int,cost:long,audit:string>>, "
                              "first_turn long, last_turn long, first_role string, last_role string")
    arrow = to_arrow_schema(schema)

    def derived(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for r in _read(it):
                wrong = faults(r["rows"], {(e["role"], e["digest"]) for e in r["earlier"] or ()})
                kinds, stats = _kinds(r["rows"], wrong), _stats(r["rows"], wrong)
                ways = [{"before": q, "after": end, "cost": cost, "audit": audit}
                        for end in STATES for q, (cost, audit) in lightest(kinds, (end,), STATES).items()]
                yield {k: r[k] for k in ("conv_id", "part", "no")} | {"ways": ways} | {k: stats[k] for k in arrow.names[4:]}

        yield from _batches(found(), arrow, "ways")

    return several.mapInArrow(derived, schema)


class Chain:
    """An audit as a chain of pieces, with its cost and the state after its first piece."""

    __slots__ = ("cost", "audit", "after", "rest")

    def __init__(self, cost: int, audit: str, after: int, rest: "Chain | None"):
        self.cost, self.audit, self.after, self.rest = cost, audit, after, rest

    def __lt__(self, other: "Chain") -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        x, y, a, b = self, other, self.audit, other.audit
        while True:
            k = min(len(a), len(b))
            if a[:k] != b[:k]:
                return a[:k] < b[:k]
            a, b = a[k:], b[k:]
            while not a and x.rest:
                x, a = x.rest, x.rest.audit
            while not b and y.rest:
                y, b = y.rest, y.rest.audit
            if (x is y and a == b) or not a or not b:
                return len(a) < len(b)


def _conversations(it: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    """Streams of the pieces of one conversation each, from pieces that are sorted by conversation."""
    rows = _read(it)
    row = next(rows, None)
    while row is not None:
        def same() -> Iterator[dict]:
            nonlocal row
            conv = row["conv_id"]
            while row is not None and row["conv_id"] == conv:
                yield row
                row = next(rows, None)
        yield same()


def _choices(ways: DataFrame) -> DataFrame:
    """The states between which each piece is repaired, and what its border with the next piece adds."""
    schema = StructType.fromDDL("part int, no int, before int, after int, border_illegal long, border_turn long")
    arrow = to_arrow_schema(schema)

    def chosen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for conversation in _conversations(it):
                best = {q: Chain(0, "", q, None) for q in ENDS}
                places, role, turn = [], None, None
                for r in conversation:  # from the last piece to the first
                    new: dict[int, Chain] = {}
                    for w in r["ways"]:
                        if w["after"] in best:
                            c = Chain(w["cost"] + best[w["after"]].cost, w["audit"], w["after"], best[w["after"]])
                            if w["before"] not in new or c < new[w["before"]]:
                                new[w["before"]] = c
                    best = new
                    illegal = int(None not in (role, r["last_role"]) and r["last_role"] + role not in LEGAL)
                    places.append((r["part"], r["no"], illegal, int(turn is not None and turn == r["last_turn"])))
                    role = r["first_role"] if r["first_role"] is not None else role
                    turn = r["first_turn"] if r["first_turn"] is not None else turn
                state, chain = 0, best[0]
                for part, no, illegal, same in reversed(places):
                    yield {"part": part, "no": no, "before": state, "after": chain.after, "border_illegal": illegal, "border_turn": same}
                    state, chain = chain.after, chain.rest

        yield from _batches(found(), arrow)

    return ways.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no")).mapInArrow(chosen, schema)


def _applied(several: DataFrame) -> DataFrame:
    """Pieces of longer conversations, repaired between their chosen states."""
    schema = _fields(several, _PIECE)
    arrow = to_arrow_schema(schema)

    def repaired(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for r in _read(it):
                wrong = faults(r["rows"], {(e["role"], e["digest"]) for e in r["earlier"] or ()})
                cost, audit = lightest(_kinds(r["rows"], wrong), (r["after"],), (r["before"],))[r["before"]]
                stats = _stats(r["rows"], wrong)
                stats["illegal"] += r["border_illegal"]
                stats["distinct_turns"] -= r["border_turn"]
                yield {k: r[k] for k in ("conv_id", "part", "no")} | stats | {
                    "several": True, "cost": cost, "audit": audit, "turns": edited(r["rows"], audit, r["before"])}

        yield from _batches(found(), arrow, "turns")

    return several.mapInArrow(repaired, schema)


def repair(conversations: DataFrame, present: Column | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Repaired conversations in pieces of bounded size, one row each.

    ``turns`` holds the repaired (role, text) pairs, ``audit`` the initials of the edits of
    this piece and ``cost`` what they cost; then the faults found, adjacent role initials
    that the grammar doesn't allow and the figures of turns. Pieces of a conversation are
    ordered by (part, no). Rows for which ``present`` is false name their conversation only:
    without other rows it has one empty piece. ``piece_rows`` bounds a piece, not the result.
    """
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one_space("role").alias("role"),
                                one_space("text").alias("text"), here.alias("present")) \
                        .withColumn("digest", F.sha2("text", 256))
    cut = pieces(rows, piece_rows)
    several = written(_with_earlier(cut.where("several")), "conversation-several")
    ways = written(_transfers(several), "conversation-ways")
    long = several.join(_choices(ways), ["part", "no"])
    done = written(_applied(long), "conversation-long")
    return cut.where("NOT several").drop("rows").unionByName(done)


def summary(repaired: DataFrame) -> DataFrame:
    """One row per conversation from the pieces of `repair`: gaps, faults, cost, audit and digest.

    ``repaired_sha256`` is of the repaired ``role:text`` lines joined by newlines.
    """
    schema = _fields(repaired, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def folded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conversation in _conversations(it):
            total, audits, turns, lines, digest = dict.fromkeys(arrow.names, 0), [], [], 0, hashlib.sha256()
            distinct = 0
            for r in conversation:
                total["conv_id"] = r["conv_id"]
                for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    total[k] += r[k]
                audits.append(r["audit"])
                distinct += r["distinct_turns"]
                turns = [x for x in (*turns, r["least_turn"], r["most_turn"]) if x is not None]
                turns = [min(turns), max(turns)] if turns else []
                for t in r["turns"]:
                    digest.update(("\n" * bool(lines) + t["role"] + ":" + t["text"]).encode())
                    lines += 1
            gaps = turns[1] - turns[0] + 1 - distinct if turns else 0
            total |= {"gaps": gaps, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
            yield pa.RecordBatch.from_pylist([total], arrow)

    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = repaired.where("NOT several").select(
        "conv_id", F.coalesce(F.expr("most_turn - least_turn + 1 - distinct_turns"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    long = repaired.where("several").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return whole.unionByName(long.mapInArrow(folded, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with known faults, for measuring repairs: what happens to a row is fixed by crc32 of ``conv_id:turn``, mod 20.

    0 drops it (the row stays with ``present`` false), 1 empties its text, 2 takes its full
    stops, exclamation and question marks out, 3 repeats it, 4 makes its role user. Nulls
    count as one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    return conversations.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
        (code != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("copy")).drop("copy")
