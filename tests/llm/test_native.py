"""Sharding, mixing and URL rules: invariants, skewed keys and odd rows."""

import heapq
import math
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from arbora.llm import mixing, sharding, url_rules
from arbora.llm.common import written

DOCS = "doc_id long, text string, source string, shard string"


def docs(frame, rows):
    return frame([(i, t, s, "own") for i, t, s in rows], DOCS)


def test_shards_fit_and_cover(frame):
    rows = docs(frame, [(i, "x" * (i % 50), "a") for i in range(3000)])
    out = sharding.shard(rows, "doc_id", F.octet_length("text"), 1000).collect()
    size, depth = Counter(), {}
    for r in out:
        size[r.shard] += r.n_bytes
        depth[r.shard] = (r.shard_bytes, r.shard_rows, r.oversized)
        assert len(r.shard) == r.shard_depth
    assert len(out) == 3000 and all(b <= 1000 for b in size.values())
    assert all(size[s] == b and not o for s, (b, _, o) in depth.items())
    # buckets are prefix-free, and only an oversized bucket was split: a parent exceeds the limit
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for s in names:
        assert sum(b for n, b in size.items() if n.startswith(s[:-1])) > 1000


def test_shards_of_one_hot_key_and_odd_rows(frame):
    rows = docs(frame, [(7, "y" * 100, None)] * 400 + [(None, None, "a"), (1, "", "b"), (2, "z" * 5000, "c")])
    out = sharding.shard(rows, "doc_id", F.octet_length("text"), 1000).collect()
    assert len(out) == 403 and all(r.shard_bytes <= 1000 or (r.oversized and r.shard_rows == 1) for r in out)
    assert sum(r.oversized for r in out) == 1 and set(out[0].asDict()) >= {"doc_id", "text", "source", "shard"}
    assert sharding.shard(rows.limit(0), "doc_id", F.octet_length("text"), 10).count() == 0


def test_shards_are_files_within_the_limit(spark, frame, tmp_path):
    import os
    rows = frame([(i, "x" * (i % 50), None if i % 9 else "a") for i in range(2000)] + [(None, None, "n"), (5, "y" * 3000, "c"), (7, "", "d")],
                 "doc_id long, text string, source string")
    out = sharding.sharded(rows, "doc_id", F.octet_length("text"), 1500, str(tmp_path / "s"))
    got = out.collect()
    assert sorted((r.doc_id or -1, r.text or "", r.source or "") for r in got) == sorted((r.doc_id or -1, r.text or "", r.source or "") for r in rows.collect())
    files = {d: [f for f in os.listdir(tmp_path / "s" / d) if f.endswith(".parquet")] for d in os.listdir(tmp_path / "s") if d.startswith("__shard=")}
    assert {r.shard for r in got} == {d.removeprefix("__shard=s") for d in files} and all(len(f) == 1 for f in files.values())
    size = Counter()
    for r in got:
        size[r.shard] += len(r.text or "")
    assert all((r.shard_bytes, r.shard_depth) == (size[r.shard], len(r.shard)) for r in got)
    assert [r.shard_rows for r in got if r.oversized] == [1] and all(b <= 1500 or b == 3000 for b in size.values())
    same = sharding.shard(rows, "doc_id", F.octet_length("text"), 1500).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("shard").alias("s")).collect()
    assert {(r.doc_id, r.s) for r in same} <= {(r.doc_id, r.shard) for r in got}
    one = sharding.sharded(rows.limit(3), "doc_id", F.octet_length("text"), 1 << 20)
    assert {r.shard for r in one.collect()} == {""} and sharding.sharded(rows.limit(0), "doc_id", F.octet_length("text"), 10).count() == 0


def _deviation(order, shares, cycle):
    """Largest distance of any source from its share, over all prefixes."""
    seen, worst = Counter(), 0.0
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(seen[x] - t * p / cycle) for x, p in shares.items()))
    return worst


def test_schedule_meets_windows_and_deviates_less_than_a_block(frame):
    targets = frame([("a", 500), ("b", 300), ("c", 120), (None, 79), ("e", 1), ("f", 0)], "source string, target long")
    for rows in (1, 7):
        plan = mixing.schedule(targets, rows).collect()
        shares = Counter(r.source for r in plan)
        assert shares == {s: -(-n // rows) for s, n in (("a", 500), ("b", 300), ("c", 120), (None, 79), ("e", 1))}
        order, total = [r.source for r in sorted(plan, key=lambda r: r.slot)], len(plan)
        assert sorted(r.slot for r in plan) == list(range(total)) and _deviation(order, shares, total) < 1
        for r in plan:
            assert r["index"] * total // shares[r.source] <= r.slot < math.ceil((r["index"] + 1) * total / shares[r.source])


def test_mixture_deviates_less_than_a_block_from_targets(spark):
    """Every prefix against the targets, at two sizes and with a hot source."""
    for n in (3000, 12000):
        rows = spark.range(n).selectExpr("id AS doc_id", "if(id % 100 < 29, 'hot', concat('s', id % 19)) AS source")
        out = mixing.mix(rows, block_rows=1).select("source", "mix_slot").collect()
        assert sorted(r.mix_slot for r in out) == list(range(n))
        assert _deviation([r.source for r in sorted(out, key=lambda r: r.mix_slot)], Counter(r.source for r in out), n) < 1


def test_many_sources_are_scheduled_in_groups(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id < 900, 'hot', concat('s', id)) AS source")
    out = mixing.mix(rows, block_rows=1).select("source", "mix_slot").collect()
    assert sorted(r.mix_slot for r in out) == list(range(3000))
    assert _deviation([r.source for r in sorted(out, key=lambda r: r.mix_slot)], Counter(r.source for r in out), 3000) < 3


def _first_free(counts):
    """Slot of each (source, index), slot by slot: the released block with the earliest deadline goes."""
    total, heap, out, k = sum(counts.values()), [], {}, 0
    order = sorted(counts, key=lambda s: (s is not None, s or ""))
    blocks = sorted((i * total // counts[s], -(-(i + 1) * total // counts[s]), j, i) for j, s in enumerate(order) for i in range(counts[s]))
    for t in range(total):
        while k < total and blocks[k][0] <= t:
            heapq.heappush(heap, blocks[k][1:])
            k += 1
        _, j, i = heapq.heappop(heap)
        out[order[j], i] = t
    return out


def test_any_number_of_sources_is_one_schedule(frame, monkeypatch):
    """beyond 64 sources too, every slot is that of earliest deadline first; also if parts are split in chunks."""
    many = {f"s{i}": 1 + (i * i) % 13 for i in range(200)} | {None: 300, "hot": 900}
    targets = frame(list(many.items()), "source string, target long")
    for bits, chunk, listed in ((mixing.PART_BITS, mixing.CHUNK, mixing.LISTED), (9, 250, 70)):
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        monkeypatch.setattr(mixing, "LISTED", listed)
        assert {(r.source, r["index"]): r.slot for r in mixing.schedule(targets, 1, bits).collect()} == _first_free(many)


def test_blocks_keep_their_size_in_a_large_mix(spark):
    """more than 16,384 blocks, and more than 64 sources, are mixed as fewer are."""
    rows = spark.range(40000).selectExpr("id AS doc_id", "if(id % 10 < 3, 'hot', concat('s', id % 99)) AS source")
    out = mixing.mix(rows, block_rows=2).select("source", "mix_slot", "mix_offset").collect()
    shares = Counter(r.source for r in out if r.mix_offset == 0)
    total = sum(shares.values())
    assert len(out) == 40000 and total >= 20000 and {r.mix_offset for r in out} == {0, 1}
    order = [r.source for r in sorted(out, key=lambda r: r.mix_slot) if r.mix_offset == 0]
    assert len({r.mix_slot for r in out}) == total and _deviation(order, shares, total) < 1


def test_pipeline_mixture_is_in_the_final_table(spark, frame):
    rows = docs(frame, [(i, f"text {i}", "hot" if i % 10 < 6 else f"s{i % 7}") for i in range(2700)])
    mixed = written(corpus_pipeline.mixture(spark, rows, ""), "mixed")
    final = corpus_pipeline.tokenized(spark, mixed, "").join(rows.select("doc_id", "source"), "doc_id").collect()
    order = [r.source for r in sorted(final, key=lambda r: (r.mix_part, r.mix_row))]
    assert mixed.columns == rows.columns and {r.doc_id for r in final} == set(range(2700))
    assert _deviation(order, Counter(order), 2700) < 2 * 16  # a block of a prefix may be cut
    assert corpus_pipeline.tokenized(spark, rows, "").select("mix_row").distinct().count() == 2700  # rows from no file


def test_mixture_targets(frame):
    rows = docs(frame, [(i, "t", "hot" if i % 3 else f"s{i % 7}") for i in range(2100)])
    out = mixing.mix(rows, max_share=0.4, block_rows=4).collect()
    taken = Counter(r.source for r in out if r.mix_selected)
    total = sum(taken.values())
    assert len(out) == 2100 and abs(taken["hot"] / total - 0.4) < 0.01 and total - taken["hot"] == 700
    places = [(r.mix_slot, r.mix_offset) for r in out if r.mix_selected]
    assert len(set(places)) == len(places) and all(r.mix_slot is None for r in out if not r.mix_selected)


def test_mixture_with_given_weights_and_odd_rows(frame):
    rows = docs(frame, [(1, None, None), (1, None, None), (None, "", "a"), (2, "x", "a"), (3, "x", "b")])
    weights = frame([("a", 1.5), ("a", 0.5), ("b", 1.0), ("absent", 1.0), (None, 2.0)], "source string, weight double")
    out = mixing.mix(rows, weights=weights).collect()
    assert len(out) == 5 and Counter(r.source for r in out if r.mix_selected) == {"a": 2, "b": 1, None: 2}
    assert mixing.mix(rows.limit(0)).count() == 0
    assert all(r.mix_selected for r in mixing.mix(docs(frame, [(i, "x", "only") for i in range(9)])).collect())


def test_pipeline_mixture_of_many_sources_is_by_earliest_deadline(spark, frame):
    """the final table's order is block for block that of one queue over all sources."""
    sizes = {f"s{i}": 1 + (i * i) % 61 for i in range(90)} | {"hot": 700, None: 33}
    names = [s for s, n in sizes.items() for _ in range(n)]
    rows = docs(frame, [(i, f"text {i}", s) for i, s in enumerate(names)])
    mixed = written(corpus_pipeline.mixture(spark, rows, ""), "mixed-many")
    final = corpus_pipeline.tokenized(spark, mixed, "").collect()
    got = [names[r.doc_id] for r in sorted(final, key=lambda r: (r.mix_part, r.mix_row))]
    slots = _first_free({s: -(-n // 16) for s, n in sizes.items()})
    assert got == [s for s, i in sorted(slots, key=slots.get) for _ in range(min(16, sizes[s] - 16 * i))]


def test_rows_of_the_mixture_are_shuffled_once_at_any_size(spark, frame, capsys):
    """blocks too many to be sent to every task cost the rows no further shuffle, and are the same blocks."""
    sizes = {f"s{i}": 1 + (i * i) % 61 for i in range(70)} | {"hot": 900, None: 33}
    rows = docs(frame, [(i % 1500, f"text {i}", s) for i, s in enumerate([s for s, n in sizes.items() for _ in range(n)])])
    rows = written(rows.unionByName(docs(frame, [(7, f"same {i}", "hot") for i in range(100)] + [(None, None, None)])), "mix-rows")
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    found = []
    for limit in ("10MB", "-1"):
        for k in kept:
            spark.conf.set(k, limit)
        try:
            mixed = mixing.mix(rows, max_share=0.2, block_rows=4)
            capsys.readouterr()
            mixed.explain("formatted")
            assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[.*__row", capsys.readouterr().out)) == 1, limit
            found.append(sorted(mixed.collect(), key=str))
        finally:
            for k, v in kept.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found[0] == found[1] and len(found[0]) == rows.count()
    selected = [r for r in found[0] if r.mix_selected]
    of, taken = {}, Counter(r.source for r in selected)
    for r in selected:
        of.setdefault(r.mix_slot, []).append(r)
    first = _first_free({s: -(-n // 4) for s, n in taken.items()})
    assert {t: {r.source for r in b} for t, b in of.items()} == {t: {s} for (s, _), t in first.items()}
    assert all(sorted(r.mix_offset for r in b) == list(range(len(b))) for b in of.values()) and all(r.mix_target == taken[r.source] for r in selected)
    assert all(r.mix_slot is None and r.mix_offset is None for r in found[0] if not r.mix_selected) and len(selected) < len(found[0])


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def test_url_rules_match_brute_force(spark, frame):
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "q.com", "COM", "a..b.org", "", "org."]
    paths = ["", "/", "/es/", "/es/x", "/es", "/en/1", "/en/12?q=/es/", "/fr/a#/de/", "?x=1/", "#f"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths] + [None, "", "mailto:a", "://org/", "a://b://org/es/"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.example.org", "/es/x", "allow"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "", "block"), ("b.a.example.org", "/e", "allow")]
    rows = frame([(i, u, "mine") for i, u in enumerate(urls * 2)], "page_id long, url string, verdict string")
    out = url_rules.judge_urls(rows, url_rules.rule_table(spark, rules)).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url, rules), r
    assert url_rules.judge_urls(rows.limit(0), url_rules.rule_table(spark, rules)).count() == 0
