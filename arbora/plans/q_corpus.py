"""Language-model corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import corpus as cp
from arbora.operators import offers as of
from arbora.operators import splits as sp
from arbora.plans import q_offers as qo
from arbora.plans import standins as st
from arbora.plans.q_splits import _sql_split
from arbora.plans.q_text import d_preprocess, d_sentences
from arbora.plans.registry import query
from arbora.session import table

#: L4: every combination of the corpus flags (categories can only be reversed where there are any).
CONFIGS = [dict(zip(cp.FLAG_ORDER, (category, reverse, description, rows, extra)))
           for category, reverse in ((False, False), (True, False), (True, True))
           for description in (False, True) for rows in (False, True) for extra in (False, True)]
SUFFIX = "events"


def _doc_offers_split(spark, sf):
    d = table(spark, sf, "documents")
    nl = F.instr("text", "\n")
    offers = d.select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(nl > 0, F.substring("text", nl + 1, F.length("text"))).alias("description"),
        F.concat(F.lit("L_"), "lang", F.lit(">S_"), "source").alias("path_list"),
        F.concat(F.col("lang"), F.lit(">"), F.col("source")).alias("cls"))
    split = sp.train_validate_test(offers, "cls", 42, "doc_id")
    return sp.splits(split, ["train", "validate"])


def _d_labels(x):
    return (f"list_transform(string_split({x}, '>'), lambda y: CASE WHEN strpos(y, '_') > 0 "
            f"THEN substring(y, strpos(y, '_') + 1) ELSE y END)")


_T, _D = d_preprocess("title"), d_sentences("description")
_CATS = f"array_to_string(list_transform({_d_labels('path_list')}, lambda z: {d_preprocess('z')}), ' ')"
_CATS_REV = f"array_to_string(list_reverse(list_transform({_d_labels('path_list')}, lambda z: {d_preprocess('z')})), ' ')"
_XT, _XD = d_preprocess("Title"), d_sentences("Description")



def _sql_struct(config: dict, lines: list[str]) -> str:
    return ", ".join(f"{{'variant': '{cp.variant_name(config, SUFFIX)}', 'line': {x}}}" for x in lines)


def _sql_lines(config: dict) -> str:
    """The lines of one variant from the cleaned columns of an offer."""
    line, lines = "t", []
    for flag, part in (("category", "c_rev" if config["category_reverse"] else "c"), ("description", "d")):
        if config[flag] and config["multiple_rows"]:
            lines.append(f"{line} || ' - ' || {part}")
        elif config[flag]:
            line = f"{line} || ' - ' || {part}"
    return _sql_struct(config, lines if config["multiple_rows"] else [line])


def _sql_extra_lines(config: dict) -> str:
    """The lines of one variant from an offer of the extra corpus, whose parts may be missing."""
    cats = "list_reverse(cats)" if config["category_reverse"] else "cats"
    line, lines = "t", []
    for flag, there, part in (("category", "len(cats) > 0", f"array_to_string({cats}, ' ')"), ("description", "has_d", "d")):
        new = f"CASE WHEN {there} THEN {line} || ' - ' || {part} END"
        if config[flag] and config["multiple_rows"]:
            lines.append(new)
        elif config[flag]:
            line = f"coalesce({new}, {line})"
    return _sql_struct(config, [*lines, line])


_CORPUS_SQL = ("WITH " + st.SQL_QUADS + "," + qo._RUNS + "," + qo._ROUTED + "," + qo._FOLD + """,
src AS (SELECT doc_id AS id, lang || '>' || source AS cls FROM documents),""" + _sql_split("src", "s1") + """,
train1 AS (SELECT id, cls FROM s1 WHERE NOT is_test),""" + _sql_split("train1", "s2") + """,
splits AS (SELECT id AS doc_id, CASE WHEN is_test THEN 'validate' ELSE 'train' END AS split FROM s2),
docs AS (
  SELECT s.split, split_part(d.text, chr(10), 1) AS title,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN substring(d.text, strpos(d.text, chr(10)) + 1) END AS description,
         'L_' || d.lang || '>S_' || d.source AS path_list
  FROM documents d JOIN splits s USING (doc_id)
),
extra AS (
  SELECT Title, Description,
         list_filter([NULLIF(Category, ''), NULLIF(Breadcrumb, ''), NULLIF(BreadcrumbList, '')], lambda x: x IS NOT NULL) AS cats
  FROM offers
),
clean_docs AS (SELECT split, """ + f"{_T} AS t, {_CATS} AS c, {_CATS_REV} AS c_rev, {_D} AS d" + """ FROM docs),
clean_extra AS (SELECT """ + f"{_XT} AS t, {_XD} AS d" + """, length(Description) > 0 AS has_d, cats FROM extra),
lines AS (
  SELECT split, l.variant, l.line FROM (SELECT split, unnest([""" + ", ".join(_sql_lines(c) for c in CONFIGS if _sql_lines(c)) + """]) AS l FROM clean_docs)
  UNION ALL
  SELECT 'train', l.variant, l.line FROM (SELECT unnest([""" + ", ".join(_sql_extra_lines(c) for c in CONFIGS if c["additional_ds"]) + """]) AS l FROM clean_extra)
)
SELECT split, variant, line FROM lines WHERE line IS NOT NULL
""")


@query("corpus_lines_documents", _CORPUS_SQL)
def corpus_lines_documents(spark, sf):
    """Corpus lines of all 24 variants over the train/validate
    splits of document offers, plus the quad-extracted offers (L2) once for train; texts
    are cleaned once, whatever the number of variants."""
    offers = _doc_offers_split(spark, sf)
    extra = of.fold_offers(st.quads_from_events(spark, sf))
    return cp.corpus(offers, CONFIGS, extra=extra, suffix=SUFFIX)


@query("corpus_pack_tokens", r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS tokens FROM documents),
ix AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM t),
b AS (SELECT *, idx // 100 AS batch, len(tokens) AS n FROM ix),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY batch ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
             sum(n) OVER (PARTITION BY batch) AS tot FROM b),
tok AS (SELECT batch, idx, off + pos - 1 AS gpos, tok, tot
        FROM (SELECT batch, idx, off, tot, unnest(tokens) AS tok, unnest(range(1, len(tokens) + 1)) AS pos FROM o)),
kept AS (SELECT * FROM tok WHERE gpos < (tot // 128) * 128)
SELECT CAST(batch AS BIGINT) AS batch, CAST(gpos // 128 AS BIGINT) AS block,
       string_agg(tok, ' ' ORDER BY gpos) AS text, CAST(count(*) AS INTEGER) AS n_tokens
FROM kept GROUP BY 1, 2
""")
def corpus_pack_tokens(spark, sf):
    """Whole documents' tokens packed into 128-token blocks per 100-text batch,
    remainders dropped."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("tokens"))
    p = cp.pack_tokens(d, "doc_id", "tokens", block=128, batch=100)
    return p.select(F.col("batch").cast("long").alias("batch"), F.col("block").cast("long").alias("block"),
                    F.array_join("tokens", " ").alias("text"), F.size("tokens").alias("n_tokens"))


@query("corpus_masked_lines", r"""
WITH l AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
         unnest(range(0, len(string_split(text, chr(10))))) AS line_no
  FROM conversations
), nb AS (
  SELECT *, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')[1:32] AS toks
  FROM l WHERE length(regexp_replace(line, '\s', '', 'g')) > 0
), m AS (
  SELECT *, list_transform(toks, lambda t, i: substring(md5(concat_ws('|', '42', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-' || CAST(line_no AS VARCHAR), CAST(i - 1 AS VARCHAR))), 1, 4) < '2666') AS msk
  FROM nb
)
SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, array_to_string(toks, ' ') AS text,
       array_to_string(list_transform(list_zip(toks, msk), lambda z: CASE WHEN z[2] THEN '<mask>' ELSE z[1] END), ' ') AS masked,
       coalesce(array_to_string(list_transform(list_zip(toks, msk), lambda z: CASE WHEN z[2] THEN z[1] END), ' '), '') AS labels
FROM m
""")
def corpus_masked_lines(spark, sf):
    """Non-blank conversation lines, truncated to 32 tokens, 15% masked."""
    c = table(spark, sf, "conversations")
    lines = cp.nonblank_lines(c, "text")
    toks = cp.truncate_tokens(F.col("line"), 32)
    rid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"),
                      F.col("line_no").cast("string"))
    masked, labels = cp.mask_tokens(toks, rid, 0.15, 42)
    return lines.select("conv_id", "turn", F.col("line_no").cast("int").alias("line_no"),
                        F.array_join(toks, " ").alias("text"), F.array_join(masked, " ").alias("masked"),
                        F.array_join(labels, " ").alias("labels"))


@query("corpus_labelled_text_parts", """
SELECT p_partkey AS offer_id,
       concat_ws(' ', p_name, '__label__' || replace(p_type || '/' || p_brand || '/' || split_part(p_name, ' ', 2), ' ', '_')) AS line
FROM part
""")
def corpus_labelled_text_parts(spark, sf):
    """fastText-format lines ``title __label__<leaf>``."""
    o = st.t2_offers(spark, sf)
    return o.select(F.col("offer_id"), cp.labelled_text(F.col("title"), F.col("lvl3")).alias("line"))
