"""Text cleaning and key parsing as column expressions.

Every function takes and returns a ``Column`` and compiles to built-in JVM
expressions (regexp_replace, split, transform, ...), so cleaning runs inside
whole-stage code generation on the executors; there is no Python UDF anywhere.
Patterns use explicit Unicode classes (``\\p{L}``, ``\\p{N}``) so a "word
character" means the same thing as in Python's Unicode ``\\w``.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame, functions as F

# ---------------------------------------------------------------- fixed values
# Patterns and word lists that must equal the reference's for equal results.
# White space as Python's Unicode ``\\s`` has it, spelled out: Java's ``\\s`` is ASCII.
SPACE = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
HYPERLINK = rf"((www\.[^{SPACE}]+)|(https?://[^{SPACE}]+))"
URL = rf"[\p{{L}}\p{{N}}_]+://[\p{{L}}\p{{N}}_-]+(\.[\p{{L}}\p{{N}}_-]+)*(/[^{SPACE}/]*)*"
NON_WORD = r"[^\p{L}\p{N}_]+"
SPECIAL = rf"[^{SPACE}\p{{L}}\p{{N}}]+"          # ([^\s\w]|_)+ in Unicode
SEPARATORS = r"[-/.]"
TAGS = r"\[(.*?)\]"
TOKEN_SPLIT = r"[^a-z0-9]+"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_SCRIPT_STYLE = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
HTML_TAG = r"(?s)<[^>]+>"
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);?"
VALUE_JUNK = ["\\n", "\\t", "u00a0", "u00bb"]   # literal two-char escapes and code points
DESCRIPTION_STOP_VALUES = ["description", "a href", "various", "share", "0", "more"]
CATEGORY_STOP_VALUES = ["more section not available"]
MIN_LEMMA_LENGTH = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(t) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(t), rf"^[{SPACE}]+|[{SPACE}]+$", "")


# ---------------------------------------------------------------- X1-X9

def replace_separators(t) -> Column:
    """Text with ``- / .`` as spaces, then a space, then text with them removed."""
    t = _c(t)
    return F.concat_ws(" ", F.regexp_replace(t, SEPARATORS, " "), F.regexp_replace(t, SEPARATORS, ""))


def remove_html(t) -> Column:
    """Text content of an HTML fragment (comments, scripts and styles dropped,
    tags stripped, named and numeric character references decoded)."""
    t = F.regexp_replace(_c(t), HTML_COMMENT, "")
    t = F.regexp_replace(t, HTML_SCRIPT_STYLE, "")
    t = F.regexp_replace(t, HTML_TAG, "")
    return decode_entities(t)


def decode_entities(t) -> Column:
    """Character references decoded in one pass, with or without their semicolon; names come
    from the HTML 5 table of the standard library, unknown ones stay as they are."""
    t = _c(t)
    table = {n.rstrip(";"): c for n, c in html.entities.html5.items()}
    names = F.from_json(F.lit(json.dumps(table)), "map<string,string>")

    def one(ref: Column) -> Column:
        name = F.regexp_extract(ref, ENTITY, 1)
        code = (F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 9), 16, 10))
                 .otherwise(F.substring(name, 2, 9)).try_cast("int"))
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (F.when(F.startswith(name, F.lit("#")), F.when(valid, char).otherwise(F.lit("\ufffd")))
                 .otherwise(F.coalesce(F.try_element_at(names, name), ref)))

    refs = F.transform(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), one)
    parts = F.zip_with(F.split(t, ENTITY, -1), refs, lambda text, char: F.concat(text, F.coalesce(char, F.lit(""))))
    return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)


def remove_hyperlinks(t) -> Column:
    """X3."""
    return F.regexp_replace(_c(t), HYPERLINK, "")


def remove_first_and_last_character(t) -> Column:
    """``t[1:-1]``; empty for texts shorter than 2."""
    t = _c(t)
    return F.substring(t, 2, F.greatest(F.length(t) - 2, F.lit(0)))


def remove_tags(t) -> Column:
    """Contents of every ``[...]`` joined by a space."""
    return F.array_join(F.regexp_extract_all(_c(t), F.lit(TAGS), F.lit(1)), " ")


def remove_special_characters(t) -> Column:
    """X6."""
    return F.regexp_replace(_c(t), SPECIAL, "")


def remove_whitespace(t) -> Column:
    """Runs of spaces to one, stripped."""
    return strip(F.regexp_replace(_c(t), " +", " "))


def remove_line_breaks(t) -> Column:
    """Newlines deleted (words join), stripped."""
    return strip(F.replace(_c(t), F.lit("\n"), F.lit("")))


def preprocess_nils(t) -> Column:
    """Lower -> hyperlinks -> html -> line breaks -> specials -> whitespace."""
    t = F.lower(_c(t))
    t = remove_hyperlinks(t)
    t = remove_html(t)
    t = remove_line_breaks(t)
    t = remove_special_characters(t)
    return remove_whitespace(t)


# ---------------------------------------------------------------- X10-X13

def normalize(t) -> Column:
    """Drop ``scheme://`` URLs, non-word runs to a space, stripped."""
    t = F.regexp_replace(_c(t), URL, "")
    return F.trim(F.regexp_replace(t, NON_WORD, " "))


def tokens(t) -> Column:
    """X11 (without lemmas): lower, split on non ``[a-z0-9]``, empties dropped."""
    return F.filter(F.split(F.lower(_c(t)), TOKEN_SPLIT), lambda x: x != "")


def lemmatize_tokens(toks: Column, lemma_map: Column | None) -> Column:
    """Replace tokens of length >= 4 by their lemma from a ``map<form, lemma>``
    column (identity where the form is unknown or no map is given)."""
    if lemma_map is None:
        return toks
    return F.transform(toks, lambda x: F.when(
        F.length(x) >= MIN_LEMMA_LENGTH, F.coalesce(F.element_at(lemma_map, x), x)).otherwise(x))


def preprocess(t, lemma_map: Column | None = None) -> Column:
    """Tokens of the normalised text joined by a space."""
    return F.array_join(lemmatize_tokens(tokens(normalize(t)), lemma_map), " ")


#: Bytes of a lemma table that becomes one map; a larger one is refused.
LEMMA_MAX_BYTES = 64 << 20


def lemma_map_of(lemmas: DataFrame, form: str = "form", lemma: str = "lemma") -> Column:
    """Scalar-subquery column holding the caller's lemma table as a map.

    The map is one value that every task gets, so the table's bytes are checked first
    (a vocabulary of a million forms fits). Attach the result with ``withColumn`` before using it inside a
    higher-order function.
    """
    size = lemmas.agg(F.sum(F.octet_length(form) + F.octet_length(lemma) + 16)).first()[0] or 0
    if size > LEMMA_MAX_BYTES:
        raise ValueError(f"lemma table of {size} bytes; at most {LEMMA_MAX_BYTES} become one map")
    return lemmas.select(F.map_from_entries(F.collect_list(F.struct(form, lemma)))).scalar()


# ---------------------------------------------------------------- X14-X17

def extract_host(url) -> Column:
    """Drop ``<`` and schemes, cut at ``/`` and ``?``, delete ``www.`` anywhere."""
    v = _c(url)
    for s in ("<", "https://", "http://"):
        v = F.replace(v, F.lit(s), F.lit(""))
    v = F.split_part(v, F.lit("/"), F.lit(1))
    v = F.split_part(v, F.lit("?"), F.lit(1))
    return F.replace(v, F.lit("www."), F.lit(""))


def detect_host(url) -> Column:
    """Schemes and ``www.`` deleted, cut at the first ``/``."""
    v = _c(url)
    for s in ("https://", "http://", "www."):
        v = F.replace(v, F.lit(s), F.lit(""))
    return F.split_part(v, F.lit("/"), F.lit(1))


def preprocess_value(v, lemma_map: Column | None = None) -> Column:
    """Quad object value: cut at the first ``@``, junk escapes deleted, X12."""
    v = F.split_part(_c(v), F.lit("@"), F.lit(1))
    for s in VALUE_JUNK:
        v = F.replace(v, F.lit(s), F.lit(""))
    return preprocess(v, lemma_map)


def drop_leading_home(v, do_strip: bool = True) -> Column:
    """Leading ``home`` removed (then stripped)."""
    v = F.regexp_replace(_c(v), "^home", "")
    return strip(v) if do_strip else v


# ---------------------------------------------------------------- X18-X25

def path_labels(path_list, compat: bool = False) -> Column:
    """``>``-split path with the ``code_`` prefix removed from every label.

    Default keeps everything after the first ``_`` (the label itself if it has
    none); ``compat=True`` keeps only the second ``_`` piece."""
    parts = F.split(_c(path_list), ">")
    if compat:
        return F.transform(parts, lambda x: F.split_part(x, F.lit("_"), F.lit(2)))
    return F.transform(parts, lambda x: F.when(
        F.instr(x, "_") > 0, F.substring(x, F.instr(x, "_") + 1, F.length(x))).otherwise(x))


def reverse_join(arr, sep: str = " ", reverse: bool = False) -> Column:
    """X19."""
    a = _c(arr)
    return F.array_join(F.reverse(a) if reverse else a, sep)


def clean_sentences(d, lemma_map: Column | None = None) -> Column:
    """Split on ``.``, keep pieces longer than 4, X12 each, join with ``. ``."""
    pieces = F.filter(F.split(_c(d), r"\."), lambda x: F.length(x) > 4)
    return F.array_join(F.transform(pieces, lambda x: preprocess(x, lemma_map)), ". ")


def count_occurrences(t, word) -> Column:
    """Non-overlapping occurrences of ``word`` in ``t``."""
    t, w = _c(t), _c(word) if not isinstance(word, str) else F.lit(word)
    return F.when(F.length(w) == 0, F.lit(0)).otherwise(
        ((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("long"))


def parse_int_list(s) -> Column:
    """``"['1', '2']"`` -> ``array<bigint>`` (non-numbers dropped; numbers
    beyond 64 bits become NULL)."""
    return F.transform(F.regexp_extract_all(_c(s), F.lit(r"(\d+)"), F.lit(1)),
                       lambda x: x.try_cast("long"))


def to_bool(s) -> Column:
    """``'True'/'False'`` (any case) -> boolean; anything else NULL."""
    s = F.lower(_c(s))
    return F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False))


def split_run_key(k) -> tuple[Column, Column]:
    """``'exp+split'`` -> (exp, split); no ``+`` -> (key, 'all')."""
    k = _c(k)
    has = F.contains(k, F.lit("+"))
    return (F.when(has, F.split_part(k, F.lit("+"), F.lit(1))).otherwise(k),
            F.when(has, F.split_part(k, F.lit("+"), F.lit(2))).otherwise(F.lit("all")))


def title_key(t, hashed: bool = False) -> Column:
    """Stripped title, optionally hashed (equality only)."""
    k = strip(t)
    return F.xxhash64(k) if hashed else k


STEPS = {
    "replace_separators": replace_separators,
    "remove_html": remove_html,
    "remove_hyperlinks": remove_hyperlinks,
    "remove_first_and_last_character": remove_first_and_last_character,
    "remove_tags": remove_tags,
    "remove_special_characters": remove_special_characters,
    "remove_whitespace": remove_whitespace,
    "remove_line_breaks": remove_line_breaks,
    "preprocess_nils": preprocess_nils,
    "normalize": normalize,
    "preprocess": preprocess,
    "lower": F.lower,
}
