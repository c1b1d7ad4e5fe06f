"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from arbora.llm import bpe, conversations, embedding_dedup, html_text, language_id, minhash, mixing, periodic_runs, permutation_index, sharding, toxicity, url_rules, warc
from arbora.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


_COSINE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
      WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT id AS vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = id), 0) AS n_links, min(reached) AS component_id, id = min(reached) AS kept
FROM r GROUP BY id
"""


@_query("op1_embedding_dedup", _COSINE_SQL)
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


@_query("op2_warc_pages", _WARC_SQL)
def op2_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


#: Vocabulary file of op3 and of the pipeline.
WORD_BPE = "word_bpe_49k.json"


def vocabulary_path(name: str = WORD_BPE) -> str:
    """Where the public vocabulary file is installed (the same place on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@_query("op3_bpe_documents")
def op3_bpe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20

_SHARD_SQL = f"""
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 10))::BIGINT AS h FROM documents),
s AS (SELECT depth, h >> (40 - depth) AS prefix, sum(n_bytes) AS total, count(*) AS n
      FROM r, (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS depth) GROUP BY ALL),
f AS (SELECT * FROM s WHERE total <= {SHARD_BYTES} OR n = 1),
l AS (SELECT r.doc_id, r.h, r.n_bytes, min(depth) AS depth FROM r JOIN f ON f.prefix = (r.h >> (40 - f.depth)) GROUP BY ALL)
SELECT l.doc_id, substr(lpad(printf('%b', l.h), 40, '0'), 1, l.depth) AS shard, l.depth AS shard_depth, l.n_bytes,
       f.n AS shard_rows, CAST(f.total AS BIGINT) AS shard_bytes, f.total > {SHARD_BYTES} AS oversized
FROM l JOIN f ON f.depth = l.depth AND f.prefix = (l.h >> (40 - l.depth))
"""


@_query("op4_shard_documents", _SHARD_SQL)
def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.sharded(docs, "doc_id", F.octet_length("text"), SHARD_BYTES).drop("text", "lang", "source", "n_chars")


_MINHASH_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 3, len(w))], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN m ON id = doc_id LEFT JOIN n USING (doc_id)
"""


@_query("op5_minhash_documents", _MINHASH_SQL)
def op5_minhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


#: Target weights: a source's share of the rows, but at most ``max_share``; and least rows in a block of the mixture.
MIX = {"max_share": 0.3, "block_rows": 16}

_MIX_SQL = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL),
o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k,
             coalesce(sum(n) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS larger,
             sum(n) OVER () AS total FROM c),
m AS (SELECT (total - larger) / (1 - (k - 1) * {MIX['max_share']}) AS size FROM o
      WHERE (k - 1) * {MIX['max_share']} < 1 AND n <= {MIX['max_share']} * (total - larger) / (1 - (k - 1) * {MIX['max_share']})
      ORDER BY k LIMIT 1),
g AS (SELECT source, n, least(n, coalesce(CAST(floor({MIX['max_share']} * (SELECT size FROM m)) AS BIGINT), n)) AS target FROM c),
z AS (SELECT greatest({MIX['block_rows']}, CAST(-(-sum(target) // 16384) AS BIGINT)) AS per FROM g),
w AS (SELECT source, CAST((target + per - 1) // per AS BIGINT) AS b, row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM g, z WHERE target > 0),
a AS (SELECT list(b ORDER BY k) AS b, CAST(sum(b) AS BIGINT) AS q FROM w),
e AS (SELECT CAST(-1 AS BIGINT) AS t, [CAST(0 AS BIGINT) FOR x IN b] AS done, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i FROM a
      UNION ALL
      SELECT t + 1, [d + CASE WHEN j = f.k THEN 1 ELSE 0 END FOR d, j IN done], f.k, done[f.k]
      FROM (SELECT e.t, e.done, list_min([{{'d': -((-(done[j] + 1) * q) // b[j]), 'k': j}}
              FOR j IN range(1, len(b) + 1) IF done[j] < b[j] AND (done[j] * q) // b[j] <= e.t + 1]) AS f
            FROM e, a WHERE e.t + 1 < q)),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents),
x AS (SELECT r.doc_id, r.rank, g.target, w.k, z.per, r.rank // z.per AS block
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN w ON r.source IS NOT DISTINCT FROM w.source, z)
SELECT doc_id, x.rank < x.target AS mix_selected, CASE WHEN x.rank < x.target THEN e.t END AS mix_slot,
       CASE WHEN x.rank < x.target THEN CAST(x.rank % x.per AS INTEGER) END AS mix_offset, CAST(x.target AS BIGINT) AS mix_target
FROM x LEFT JOIN e ON e.t >= 0 AND e.k = x.k AND e.i = x.block
"""


@_query("op6_mix_sources", _MIX_SQL)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), **MIX).drop("source")


@_query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@_query("op8_page_texts")
def op8_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


@_query("op9_toxicity_documents")
def op9_toxicity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_URL_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule_host, rule_path, rule_verdict) AS (VALUES {', '.join(str(x) for x in URL_RULES)}),
b AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
             arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
      FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT h.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)
"""


@_query("op10_judge_urls", _URL_SQL)
def op10_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES)).drop("url")


#: crc32 in SQL: the table of all bytes, then the fold over the ASCII codes of a text {text}.
_CRC_TABLE = """
SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
FROM (SELECT unnest(range(256)) AS i)
"""
_CRC = """xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"""


def _edits_sql(state: str, follows: dict[str, str], row: str = "x") -> str:
    """The lightest of Delete, Keep and Rerole of a row in a state; ``follows``: role initial -> next state."""
    ways = [f"{{'c': v.{state}.c + 3, 'a': 'D' || v.{state}.a}}"]
    for initial, after in follows.items():
        keep = f"{{'c': v.{after}.c + {row}.extra + CASE WHEN {row}.doomed OR {row}.i <> '{initial}' THEN 1000000000 ELSE 0 END, 'a': 'K' || v.{after}.a}}"
        ways.append(keep)
        if initial != "s":
            ways.append(f"{{'c': v.{after}.c + 2 + {row}.extra + CASE WHEN {row}.doomed THEN 1000000000 ELSE 0 END, 'a': 'R' || v.{after}.a}}")
    return f"list_min([{', '.join(ways)}])"


_CONV_SQL = f"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_CRC.format(text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
      FROM conversations, crc),
r AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
             CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d, (SELECT unnest([1, 2]) AS copy) WHERE code <> 0 AND (copy = 1 OR code = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM r),
f AS (SELECT conv_id, turn, role, text, k, left(role, 1) AS i, trim(text, E' \t\n\x0b\x0c\r') AS bare,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM o),
g AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate,
             bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
             count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list({{'i': i, 'doomed': blank OR duplicate, 'extra': CAST(truncated AS BIGINT), 'role': role, 'text': text}} ORDER BY k) AS held
      FROM g GROUP BY conv_id),
e AS (SELECT *, list_reduce([{{'s0': {{'c': CAST(0 AS BIGINT), 'a': ''}}, 's1': {{'c': CAST(4 AS BIGINT), 'a': 'II'}},
                              's2': {{'c': CAST(2 AS BIGINT), 'a': 'I'}}, 's3': {{'c': CAST(0 AS BIGINT), 'a': ''}},
                              'x': CAST(NULL AS STRUCT(i VARCHAR, doomed BOOLEAN, extra BIGINT, role VARCHAR, text VARCHAR))}}]
                             || list_transform(list_reverse(held), lambda x: {{'s0': NULL, 's1': NULL, 's2': NULL, 's3': NULL, 'x': x}}),
               lambda v, y: list_transform([{{'s0': {_edits_sql('s0', {'s': 's1', 'u': 's2'}, 'y.x')}, 's1': {_edits_sql('s1', {'u': 's2'}, 'y.x')},
                                             's2': {_edits_sql('s2', {'a': 's3'}, 'y.x')}, 's3': {_edits_sql('s3', {'u': 's2'}, 'y.x')}}}],
                 lambda w: {{'s0': list_min([w.s0, {{'c': w.s2.c + 2, 'a': 'I' || w.s2.a}}, {{'c': w.s3.c + 4, 'a': 'II' || w.s3.a}}]),
                            's1': list_min([w.s1, {{'c': w.s2.c + 2, 'a': 'I' || w.s2.a}}, {{'c': w.s3.c + 4, 'a': 'II' || w.s3.a}}]),
                            's2': list_min([w.s2, {{'c': w.s3.c + 2, 'a': 'I' || w.s3.a}}]),
                            's3': list_min([w.s3, {{'c': w.s2.c + 2, 'a': 'I' || w.s2.a}}]), 'x': y.x}})[1]) AS best FROM c),
u AS (SELECT conv_id, held, unnest(string_split(best.s0.a, '')) AS edit, generate_subscripts(string_split(best.s0.a, ''), 1) AS j FROM e WHERE best.s0.a <> ''),
p AS (SELECT conv_id, edit, j, held[count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j)] AS x FROM u),
q AS (SELECT conv_id, edit, j, x, row_number() OVER (PARTITION BY conv_id ORDER BY j) - 1 AS m FROM p WHERE edit <> 'D'),
t AS (SELECT *, max(CASE WHEN m = 0 AND edit = 'K' AND x.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_s FROM q),
s AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN x.role WHEN (m - has_s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
                                 || CASE WHEN edit = 'I' THEN '' ELSE x.text END, chr(10) ORDER BY j) AS lines FROM t GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.s0.c, 0) AS cost, coalesce(best.s0.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id
"""


@_query("op11_repair_conversations", _CONV_SQL)
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.summary(conversations.repair(rows, present=F.col("present")))


@_query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(language_id.fold("doc_id") == 0, F.lit(False)))
    profiles = language_id.learn(docs.where(language_id.fold("doc_id") != 0))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


_RUNS_SQL = f"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             CAST({_CRC.format(text="CAST(doc_id AS VARCHAR)")} AS BIGINT) AS h FROM documents, crc),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
b AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
c AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w
             ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM b),
x AS (SELECT rid, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM c WHERE n > 0),
m AS (SELECT x.rid, y.i - x.i AS d, x.i FROM x JOIN x AS y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i WHERE 2 * (y.i - x.i) <= x.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS g FROM m),
s AS (SELECT rid, min(i) AS start, count(*) + d AS length, d FROM g GROUP BY rid, d, g HAVING count(*) + d >= greatest(12, 2 * d)),
r AS (SELECT rid, start, length, min(d) AS period FROM s GROUP BY ALL),
o AS (SELECT rid, count(*) AS n_runs, arg_min({{'s': start, 'n': length, 'p': period}}, {{'n': -length, 's': start, 'p': period}}) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
z AS (SELECT DISTINCT x.rid, x.i FROM x JOIN r ON x.rid = r.rid AND x.i >= r.start + r.period AND x.i < r.start + r.length),
k AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN z ON x.rid = z.rid AND x.i = z.i GROUP BY x.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.p AS period, 1000 * best.n // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM c LEFT JOIN o USING (rid) LEFT JOIN k USING (rid)
"""


@_query("op13_periodic_runs", _RUNS_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapse(table(spark, sf_dir, "documents"), periodic_runs.planted_tail))
