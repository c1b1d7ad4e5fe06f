"""Title classification into a taxonomy.

The dictionary classifier (C1-C3) is a single scan of each text against an
inverted index of the class words (bounded by the label space and checked in
bytes); no cross join and no shuffle. Learned baselines (C5-C7) are Spark ML pipelines. Decoders of model
scores (C9-C12) are joins against the small, size-checked taxonomy tables.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, functions as F, types as T

from arbora.functions import text as tf
from arbora.operators import taxonomy as tx
from arbora.operators.guards import checked_broadcast

# Class names are split on whitespace and '_' (names are underscored, P7);
# ``compat`` keeps whitespace-only splitting.
CLASS_WORD_SPLIT = r"[\s_]+"
CLASS_WORD_SPLIT_COMPAT = r"\s+"


# ---------------------------------------------------------------- C1

def class_vocabulary(classes: DataFrame, name: str = "name", order: str = "id",
                     synonyms: DataFrame | None = None, lemmas: DataFrame | None = None,
                     word_split: str = CLASS_WORD_SPLIT) -> DataFrame:
    """``(ord, name, words)`` per class: lower-cased name words, plus the words
    of caller-supplied synonyms ``(name, synonym)``; with ``lemmas (form, lemma)``
    every word is replaced by its lemma (duplicates kept, as they count in the
    score's divisor)."""
    base = classes.select(F.col(order).alias("ord"), F.col(name).alias("name"),
                          F.split(F.lower(F.col(name)), word_split).alias("w"))
    if synonyms is not None:
        syn = (synonyms.select(F.col(synonyms.columns[0]).alias("name"),
                               F.explode(F.split(F.lower(F.col(synonyms.columns[1])), r"\s+")).alias("sw"))
                       .groupBy("name").agg(F.collect_set("sw").alias("sw")))
        base = base.join(syn, "name", "left").withColumn(
            "w", F.array_union("w", F.coalesce("sw", F.array().cast("array<string>")))).drop("sw")
    words = F.array_distinct(F.filter("w", lambda x: x != ""))
    base = base.withColumn("words", words).drop("w")
    if lemmas is not None:
        lm = tf.lemma_map_of(lemmas, lemmas.columns[0], lemmas.columns[1])
        base = base.withColumn("lm_", lm).withColumn(
            "words", F.transform("words", lambda x: F.coalesce(F.element_at(F.col("lm_"), x), x))).drop("lm_")
    return base.select("ord", "name", "words")


# ---------------------------------------------------------------- C2 / C3

def most_frequent(df: DataFrame, label: str) -> Column:
    """The most frequent label (ties: smallest label) as a scalar subquery over
    the small per-label count table."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_freq_"))
    return counts.orderBy(F.col("n_freq_").desc(), F.col(label)).limit(1).select(label).scalar()


#: Bytes of an inverted index that is collected and shipped; a larger one is scanned in parts of whole classes.
INDEX_MAX_BYTES = 256 << 20
_AUTOMATA: dict = {}


def _automaton(key: str, vocab: list):
    """The Aho-Corasick automaton of a vocabulary, built once by each Python worker."""
    if key not in _AUTOMATA:
        import ahocorasick
        _AUTOMATA.clear()
        auto = ahocorasick.Automaton()
        for i, w in enumerate(vocab):
            auto.add_word(w, (i, len(w)))
        if vocab:
            auto.make_automaton()
        _AUTOMATA[key] = auto
    return _AUTOMATA[key]


def _scan_and_score(df: DataFrame, text: str, index_rows: list, options: list[str]) -> DataFrame:
    """``df`` with ``__scored``: for each option the best class under the dictionary score.

    ``index_rows`` is the inverted index ``(option, word, ord, nw, name)`` (bounded by
    the label space, size-checked before it is collected and shipped to tasks).
    Each text is scanned once with an Aho-Corasick automaton over all words
    (Python ``str.count`` semantics: case-sensitive, non-overlapping, leftmost);
    the counts of present words are added to the classes containing them, an array
    at a time, and the class with the largest ratio of sum and number of words is
    chosen (ties: lowest ordinal). Runs in Arrow batches; every input row comes out
    once, with an array of (option, ord, name, score), so nothing is joined back.
    """
    import numpy as np
    vocab = list(dict.fromkeys(r[1] for r in index_rows if r[1]))
    pos = {w: i for i, w in enumerate(vocab)}
    # for each option its classes in the order of their ordinals, and the places of those that hold a word
    of_option: dict = {}
    for option, word, ord_, nw, name in index_rows:
        if word:
            of_option.setdefault(option, {}).setdefault(ord_, (nw, name, []))[2].append(pos[word])
    names, inv = {}, {}
    for option, classes in of_option.items():
        names[option] = [(ord_, classes[ord_][1]) for ord_ in sorted(classes)]
        postings: dict = {}
        for place, (ord_, _) in enumerate(names[option]):
            for i in classes[ord_][2]:
                postings.setdefault(i, []).append(place)
        inv[option] = ({i: np.array(p) for i, p in postings.items()}, np.array([classes[ord_][0] for ord_, _ in names[option]]))
    # shipped once per executor as a broadcast variable, not inside every task closure
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocab, inv, names))

    def best_classes(auto, inv, t):
        import numpy as np
        last_end, counts = {}, {}
        for end, (i, n) in auto.iter(t):                # ordered by end position
            if end - n + 1 > last_end.get(i, -1):       # greedy leftmost, non-overlapping
                counts[i] = counts.get(i, 0) + 1
                last_end[i] = end
        best: dict = {}
        for option, (postings, sizes) in inv.items():
            hit = [i for i in counts if i in postings]
            if hit:
                found = np.concatenate([postings[i] for i in hit])
                times = np.repeat([counts[i] for i in hit], [len(postings[i]) for i in hit])
                if 4 * len(found) > len(sizes):         # places stand in the order of ordinals
                    sums, at = np.bincount(found, times, len(sizes)), None
                else:
                    at, which = np.unique(found, return_inverse=True)
                    sums = np.bincount(which, times)
                # whole numbers far below 2^26: equal ratios are equal doubles, others differ
                k = int(np.argmax(sums / (sizes if at is None else sizes[at])))
                place = k if at is None else int(at[k])
                best[option] = (place, int(sums[k]), int(sizes[place]))
        return best

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        key, vocab, inv, names = shared.value
        auto = _automaton(key, vocab)
        for batch in batches:
            found = []
            for t in batch.column("__scanned").to_pylist():
                best = best_classes(auto, inv, t) if t is not None and vocab else {}
                for o in options:
                    b = best.get(o)
                    found.append((o, *names[o][b[0]], b[1] / b[2]) if b else (o, None, None, 0.0))
            scored = pa.StructArray.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.float64()))],
                names=["option", "ord", "name", "score"])
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(options))
            kept = [n for n in batch.schema.names if n != "__scanned"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.ListArray.from_arrays(offsets, scored)],
                                             names=[*kept, "__scored"])

    scored = T.StructField("__scored", T.ArrayType(T.StructType([
        T.StructField("option", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType())])))
    return df.withColumn("__scanned", F.col(text)).mapInArrow(scan, T.StructType([*df.schema.fields, scored]))


def _inverted_index(vocab: DataFrame, option: str = "") -> DataFrame:
    return vocab.select(F.lit(option).alias("option"), "ord", "name", F.size("words").alias("nw"),
                        F.explode("words").alias("word"))


def _index_bytes(index: DataFrame) -> int:
    return index.agg(F.sum(F.octet_length("word") + F.octet_length("name") + 64)).first()[0] or 0


def _index_rows(index: DataFrame) -> list:
    """An inverted index, or a part of one, on the driver; its bytes have been checked."""
    return [tuple(r) for r in index.select("option", "word", "ord", "nw", "name").collect()]


def dictionary_classify(df: DataFrame, text: str, vocab: DataFrame, default: Column | str | None = None,
                        out: str = "prediction") -> DataFrame:
    """Predict the best dictionary class per row; zero-score rows get
    ``default`` (a label, or e.g. :func:`most_frequent`), NULL if none.

    The class vocabulary becomes an inverted index ``word -> classes``; each text
    is scanned once and scored in the same pass (see :func:`_scan_and_score`): no
    shuffle, and rows need no identifier.
    """
    return sweep(df, text, {"": vocab}, default, out).drop("option")


def with_fallback(classified: DataFrame, text: str, model, out: str = "prediction", score: str = "score",
                  reserved: str = "__own_text") -> DataFrame:
    """C4/V3: rows that the dictionary could not score (0) are predicted by a fitted, or
    loaded, pipeline of :func:`fit_naive_bayes` and its like.

    One pass: the model sees the texts of those rows only (the others are empty to it), so
    the rows are neither split nor scanned again.
    """
    zero = F.col(score) == 0
    seen = classified.withColumn(reserved, F.col(text)).withColumn(text, F.when(zero, F.col(text)).otherwise(""))
    seen = seen.withColumnRenamed(out, "__dictionary")
    labelled = decode_predictions(model.transform(seen), model, "__model")
    result = {out: F.when(zero, F.col("__model_label")).otherwise(F.col("__dictionary")), text: F.col(reserved)}
    return labelled.select(*[result.get(c, F.col(c)).alias(c) for c in classified.columns])


def sweep(df: DataFrame, text: str, options: dict[str, DataFrame], default: Column | str | None = None,
          out: str = "prediction") -> DataFrame:
    """G1: score every row under several vocabularies in one pass; one output row
    per (option, input row). The text is scanned once for the union of all
    options' words; the option travels with the inverted index."""
    res = _scored(df.drop("option", out, "score"), text, options)
    res = res.select(*[c for c in res.columns if c != "__scored"], F.explode("__scored").alias("__s")).select(
        "*", F.col("__s.option").alias("option"), F.col("__s.name").alias(out), F.col("__s.score").alias("score")).drop("__s")
    d = F.lit(default) if isinstance(default, str) else default
    return res if d is None else res.withColumn(out, F.when(F.col("score") > 0, F.col(out)).otherwise(d))


def _scored(df: DataFrame, text: str, options: dict[str, DataFrame]) -> DataFrame:
    """``df`` with ``__scored``. An index beyond ``INDEX_MAX_BYTES`` is cut by classes; the
    text is scanned once for each part and the better class of two parts stays (equal ratios are
    equal doubles, ties go to the lowest ordinal)."""
    index = None
    for name, vocab in options.items():
        i = _inverted_index(vocab, name)
        index = i if index is None else index.unionByName(i)
    parts = max(1, -(-_index_bytes(index) // INDEX_MAX_BYTES))
    out = _scan_and_score(df, text, _index_rows(index.where(F.pmod(F.xxhash64("ord"), F.lit(parts)) == 0)), list(options))
    for k in range(1, parts):
        rows = _index_rows(index.where(F.pmod(F.xxhash64("ord"), F.lit(parts)) == k))
        out = _scan_and_score(out.withColumnRenamed("__scored", "__before"), text, rows, list(options))
        better = lambda a, b: F.when((b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["ord"] < a["ord"])), b).otherwise(a)
        out = out.withColumn("__scored", F.zip_with("__before", "__scored", better)).drop("__before")
    return out


def sweep_with_fallback(df: DataFrame, text: str, options: dict[str, DataFrame], default: Column | str, model,
                        out: str = "prediction", suffix: str = "_fallback") -> DataFrame:
    """G1/C4: like :func:`sweep`, with each option also in a variant ``suffix`` whose zero-score rows
    are predicted by ``model``; a text is scanned once and seen by the model at most once, whatever
    the number of options."""
    rows = _scored(df.drop("option", out, "score"), text, options)
    rows = rows.withColumn("__least", F.array_min(F.transform("__scored", lambda s: s["score"]))).withColumn("__model", F.lit(None).cast("string"))
    rows = with_fallback(rows, text, model, "__model", "__least")
    d = F.lit(default) if isinstance(default, str) else default
    exploded = rows.select(*[c for c in rows.columns if not c.startswith("__")], "__model", F.explode("__scored").alias("__s"),
                           ).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("__falls"))
    return exploded.select(
        *[c for c in exploded.columns if not c.startswith("__")], F.concat("__s.option", F.when(F.col("__falls"), suffix).otherwise("")).alias("option"),
        F.when(F.col("__s.score") > 0, F.col("__s.name")).when(F.col("__falls"), F.col("__model")).otherwise(d).alias(out),
        F.col("__s.score").alias("score"))


# ---------------------------------------------------------------- C5-C7 (Spark ML)

#: Largest vocabulary of a bag of words: above any real one, so that no term is dropped.
VOCABULARY = 1 << 28


def fit_naive_bayes(train: DataFrame, text: str, label: str, smoothing: float = 1.0, vocabulary: int = VOCABULARY,
                    steps: tuple[str, ...] = ("lower",), grams: int = 0):
    """Bag of words (lower-cased tokens of >= 2 word characters, or with ``grams``
    character pieces) + multinomial naive Bayes with additive smoothing."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer, StringIndexer
    from arbora.functions.ml import TextTokens
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc"),
        TextTokens(inputCol=text, outputCol="tok_", steps=list(steps), grams=grams),
        CountVectorizer(inputCol="tok_", outputCol="bow_", vocabSize=vocabulary),
        NaiveBayes(featuresCol="bow_", labelCol="label_idx", smoothing=smoothing, modelType="multinomial"),
    ]).fit(train)


#: Spark's greatest depth of a tree.
DEEPEST = 30


def fit_forest(train: DataFrame, text: str, label: str, seed: int = 42, trees: int = 100, depth: int = DEEPEST,
               least_rows: int = 1, vocabulary: int = VOCABULARY, steps: tuple[str, ...] = ("preprocess",)):
    """Bag of words over X12-preprocessed text + random forest of ``trees`` trees, at most
    ``depth`` deep (no deeper than Spark allows), with ``least_rows`` rows in a leaf at least."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import CountVectorizer, StringIndexer
    from arbora.functions.ml import TextTokens
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc"),
        TextTokens(inputCol=text, outputCol="tok_", steps=list(steps)),
        CountVectorizer(inputCol="tok_", outputCol="bow_", vocabSize=vocabulary),
        RandomForestClassifier(featuresCol="bow_", labelCol="label_idx", numTrees=trees, maxDepth=depth,
                               minInstancesPerNode=least_rows, seed=seed),
    ]).fit(train)


def fit_ngram_linear(train: DataFrame, text: str, label: str, word_ngrams: int = 3,
                     minn: int = 4, maxn: int = 10, features: int = 1 << 18, max_iter: int = 30):
    """Words, word n-grams (2..``word_ngrams``) and character n-grams
    (``minn..maxn`` of ``<word>``) hashed into one sparse vector, then a
    multinomial logistic regression (a linear n-gram classifier). ``features`` is the number
    of hash buckets: grams that share one share a weight. Buckets that are the same in all
    training rows, as those without a gram, have a weight of zero, so these columns don't enter the regression."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer, SQLTransformer, StringIndexer, VarianceThresholdSelector
    word_grams = " , ".join(
        f"transform(sequence(1, greatest(size(tok_) - {n} + 1, 0)), i -> array_join(slice(tok_, i, {n}), ' '))"
        for n in range(2, word_ngrams + 1))
    grams = SQLTransformer(statement=(
        "SELECT *, concat(tok_, " + (word_grams + ", " if word_grams else "") +
        "flatten(transform(sequence(" + str(minn) + ", " + str(maxn) + "), n -> "
        "flatten(transform(tok_, w -> transform(sequence(1, greatest(length(concat('<', w, '>')) - n + 1, 0)), "
        "i -> substring(concat('<', w, '>'), i, n))))))) AS grams_ FROM __THIS__"))
    hashed = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="tok_", pattern=r"\s+", toLowercase=True),
        grams,
        HashingTF(inputCol="grams_", outputCol="hashed_", numFeatures=features),
    ]).fit(train)
    rows = hashed.transform(train)
    chosen = VarianceThresholdSelector(featuresCol="hashed_", outputCol="feat_").fit(rows)
    if not chosen.selectedFeatures:  # all texts are alike: a regression needs some column
        return PipelineModel([*hashed.stages, LogisticRegression(featuresCol="hashed_", labelCol="label_idx", maxIter=max_iter).fit(rows)])
    regression = LogisticRegression(featuresCol="feat_", labelCol="label_idx", maxIter=max_iter).fit(chosen.transform(rows))
    return PipelineModel([*hashed.stages, chosen, regression])


def save_model(model, path: str) -> str:
    """Write a fitted pipeline to the shared file system."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """A fitted pipeline as it was written."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def decode_predictions(scored: DataFrame, model, out: str = "prediction") -> DataFrame:
    """Map a Spark ML index prediction back to its label string."""
    from pyspark.ml.feature import IndexToString
    labels = model.stages[0].labels
    return IndexToString(inputCol="prediction", outputCol=out + "_label", labels=labels).transform(scored)


# ---------------------------------------------------------------- W9 / C9-C11

def argmax(scores: DataFrame, keys: list[str], candidate: str, p: str) -> DataFrame:
    """The highest-scoring candidate per key; ties go to the lowest candidate."""
    return scores.groupBy(*keys).agg(
        F.max_by(candidate, F.struct(F.col(p), F.negative(F.col(candidate)))).alias(candidate),
        F.max(p).alias(p))


def path_product(scores: DataFrame, nodes: DataFrame, item: list[str], node: str = "node_id",
                 logit: str = "logit") -> DataFrame:
    """Score of a leaf = product of sigmoid(node logit) over its path; a leaf
    is a candidate when every node on its path is scored. Returns the argmax leaf
    per item (``leaf_id``, ``score``, ``log_score``); ranked on the unrounded sum of
    log sigmoids, so small products keep their order; ties go to the lowest leaf id.
    An item has at most one score per node.

    One shuffle: an item's scores (bounded by the label space) form a map, the scored
    leaves are exploded from it and add up their paths, and the argmax runs on the
    same partitioning.
    """
    lv = tx.leaves(nodes).where(F.col("depth") > 0).select(F.col("id").alias("leaf_id"))
    paths = (tx.closure(nodes).join(lv.withColumnRenamed("leaf_id", "id"), "id", "left_semi")
               .groupBy(F.col("id").alias("leaf_id"))
               .agg(F.transform(F.sort_array(F.collect_list(F.struct("anc_depth", "anc_id"))),
                                lambda x: x["anc_id"]).alias("path")))
    x = F.col(logit).cast("double")
    log_sigmoid = F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))
    per_item = scores.groupBy(*item).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(node), log_sigmoid))).alias("m_"))
    cand = per_item.select(*item, "m_", F.explode(F.map_keys("m_")).alias("leaf_id"))
    cand = cand.join(checked_broadcast(paths, bound=nodes), "leaf_id")
    m = F.col("m_")
    cand = cand.where(F.forall("path", lambda a: F.map_contains_key(m, a))).select(
        *item, "leaf_id", F.aggregate("path", F.lit(0.0), lambda acc, a: acc + F.element_at(m, a)).alias("log_score"))
    best = cand.groupBy(*item).agg(F.max(F.struct("log_score", F.negative("leaf_id").alias("neg_"))).alias("b_"))
    return best.select(*item, F.negative("b_.neg_").alias("leaf_id"), F.exp("b_.log_score").alias("score"),
                       F.col("b_.log_score").alias("log_score"))


def greedy_decode(level_scores: DataFrame, item: list[str], level: str = "level",
                  candidate: str = "node_id", p: str = "logit", fill: int | Column = 0) -> DataFrame:
    """Argmax per (item, level), then the path's last non-fill node is the
    leaf (0 = out of category)."""
    best = argmax(level_scores, item + [level], candidate, p)
    path = best.groupBy(*item).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(level, candidate))), lambda x: x[candidate]).alias("path"))
    return path.select(*item, F.array_join("path", ",").alias("path"),
                       tx.leaf_of_padded(F.col("path"), fill).alias("leaf_id"))


def decode_level_ordinals(pred: DataFrame, nodes: DataFrame, level: str = "level",
                          ordinal: str = "ordinal", out: str = "node_id") -> DataFrame:
    """C11: per-level ordinal predictions -> node ids (ordinal 0 stays 0, out of
    category)."""
    lo = checked_broadcast(tx.level_ordinals(nodes).where(F.col("depth") > 0).select(
        F.col("depth").alias(level), F.col("level_ord").alias(ordinal), F.col("id").alias(out)))
    return pred.join(lo, [level, ordinal], "left").withColumn(
        out, F.when(F.col(ordinal) == 0, F.lit(0)).otherwise(F.col(out)))


def successor_decode(level_scores: DataFrame, nodes: DataFrame, item: list[str], certainty: float,
                     level: str = "level", ordinal: str = "ordinal", logp: str = "logp") -> DataFrame:
    """Top-down decoding in which each level's argmax is masked by the level above.

    ``level_scores`` holds log probabilities of level ordinals (0 = out of category). If the
    node chosen above is sure (its probability exceeds ``certainty``), only its
    children (H11) and 0 are allowed, after a sure 0 only 0; below an unsure node the argmax is
    free, as it is where none of the allowed labels is scored. Ties go to the lowest ordinal.
    Returns per item the ordinals of its path, the id of the last node that is not out of
    category (else 0), the sum of the log probabilities and the number of levels on which the
    mask overruled the free argmax. Rows without a log probability don't count.

    One shuffle: an item's scores (bounded by the label space) are gathered once, each with its
    parent's ordinal, and the levels are folded from the top.
    """
    lo = tx.level_ordinals(nodes).where(F.col("depth") > 0).select("id", "parent_id", "depth", "level_ord")
    above = lo.select(F.col("id").alias("parent_id"), F.col("level_ord").alias("above_"))
    labels = lo.join(above, "parent_id", "left").select(
        F.col("depth").alias(level), F.col("level_ord").alias(ordinal), F.col("id").alias("node_"), "above_")
    rows = level_scores.where(F.col(logp).isNotNull()).join(checked_broadcast(labels, bound=nodes), [level, ordinal], "left")
    scored = rows.groupBy(*item).agg(F.collect_list(F.struct(
        F.col(level).cast("int").alias("level"), F.col(logp).cast("double").alias("logp"), F.negative(F.col(ordinal).cast("int")).alias("neg"),
        F.when(F.col(ordinal) == 0, 0).otherwise(F.col("node_")).alias("node"), F.coalesce("above_", F.lit(-1)).alias("above"))).alias("c_"))

    def choose(acc: Column, at: Column) -> Column:
        here = F.filter("c_", lambda x: x["level"] == at)
        allowed = F.filter(here, lambda x: ~acc["sure"] | (x["neg"] == 0) | ((acc["label"] != 0) & (x["above"] == acc["label"])))
        best = lambda some: F.array_max(F.transform(some, lambda x: F.struct(x["logp"], x["neg"], x["node"])))
        both = F.array(F.struct(F.coalesce(best(allowed), best(here)).alias("b"), best(here).alias("free")))
        return F.element_at(F.transform(both, lambda x: F.struct(
            (-x["b"]["neg"]).alias("label"), (x["b"]["logp"] > math.log(certainty)).alias("sure"),
            (acc["logp"] + x["b"]["logp"]).alias("logp"),
            F.concat(acc["path"], F.array(-x["b"]["neg"])).alias("path"),
            F.when(x["b"]["neg"] != 0, x["b"]["node"]).otherwise(acc["leaf"]).alias("leaf"),
            (acc["forced"] + (x["b"]["neg"] != x["free"]["neg"]).cast("int")).alias("forced"))), 1)

    start = F.struct(F.lit(0).alias("label"), F.lit(False).alias("sure"), F.lit(0.0).alias("logp"),
                     F.array().cast("array<int>").alias("path"), F.lit(0).alias("leaf"), F.lit(0).alias("forced"))
    levels = F.array_sort(F.array_distinct(F.transform("c_", lambda x: x["level"])))
    folded = scored.select(*item, F.aggregate(levels, start, choose).alias("f_"))
    return folded.select(*item, F.array_join("f_.path", ",").alias("path"), F.col("f_.leaf").alias("leaf_id"),
                         F.col("f_.logp").alias("log_score"), F.col("f_.forced").alias("n_forced"))
