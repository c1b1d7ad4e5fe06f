"""URL filters: sort-merge range join of URLs with nested prefix rules (native).

A rule (host, path, verdict) fits its host and all subdomains where the URL's
path starts with the rule's path. Canonical key: host labels in reverse order,
each followed by a dot, then the path (``org.example./es/``). As every label ends
in a dot and a path starts with a slash, "the rule fits" is "the rule's key is a
prefix of a key of the URL", so each rule is an interval of the sorted keys and
any two intervals are nested or apart.

A URL has one key for each suffix of its host. Distinct keys and rule starts are
range-partitioned and sorted together; sweeping a partition, the stack at a key is
the chain of rules around the latest rule start, without those that have ended
(they are no prefix of the key). The stack that is active where a partition
begins comes from the last rule start before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arbora.llm.common import ROW, field, packed, shuffle_partitions, unpacked, written

RULE_SCHEMA = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def host_key(labels: Column) -> Column:
    """Canonical key of a host given as its array of labels."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules (host, path, verdict) as a DataFrame; hosts are lower-cased."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _rule_chains(rules: DataFrame) -> DataFrame:
    """(key, chain): per distinct rule key the rules whose key is a prefix of it, itself included.

    Of rules with the same host and path, block wins over any other verdict.
    """
    host = F.translate("host", UPPER, LOWER)
    r = (rules.where("host is not null and host <> ''")
         .select(F.concat(host_key(F.split(host, r"\.")), F.coalesce("path", F.lit(""))).alias("key"),
                 F.concat(host, F.coalesce("path", F.lit(""))).alias("rule"),
                 F.length(host).alias("host_length"), "verdict")
         .groupBy("key").agg(F.max(F.struct(F.col("verdict") == "block", "verdict", "rule", "host_length")).alias("r"))
         .select("key", "r.rule", "r.host_length", "r.verdict"))
    entry = F.struct(F.length("rule").alias("length"), F.col("host_length"), F.col("key").alias("rule_key"),
                     F.col("rule"), F.col("verdict")).alias("entry")
    prefixes = r.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")),
                                                     lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
    return (prefixes.join(r.select(F.col("key").alias("prefix"), entry), "prefix")
            .groupBy("key").agg(F.collect_list("entry").alias("chain")))


def active_rules(points: DataFrame, rules: DataFrame, name: str = "url-sweep") -> DataFrame:
    """Sweep: for each distinct ``key`` of ``points`` the array ``stack`` of rules active there."""
    n = shuffle_partitions(points.sparkSession)
    chains = _rule_chains(rules)
    events = (points.select("key", F.lit(1).alias("kind"), F.lit(None).cast(chains.schema["chain"].dataType).alias("chain"))
              .unionByName(chains.select("key", F.lit(0).alias("kind"), "chain")))
    # the range of a row must be the same for all readers: the ranges are written once
    events = written(events.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), name)
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = (events.groupBy("part").agg(F.max_by("chain", F.when(F.col("kind") == 0, F.col("key"))).alias("last_chain"))
               .select("part", F.last("last_chain", ignorenulls=True).over(running).alias("carried")))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (events.withColumn("latest", F.last("chain", ignorenulls=True).over(sweep))
            .where("kind = 1").join(carried, "part")
            .select("key", F.filter(F.coalesce("latest", "carried"),
                                    lambda r: F.col("key").startswith(r["rule_key"])).alias("stack")))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict of each URL.

    The longest fitting rule (host and path together; then the longer host) decides;
    ``rule`` is null and ``verdict`` is ``default`` where none fits. A null URL or one
    without ``://`` has empty host and path, and no rule. Repeated rows are each judged;
    an empty table gives an empty result; input columns named like added ones are replaced.
    """
    rows = packed(df).select(ROW, url_host(field(url)).alias("host"), url_path(field(url)).alias("path"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    distinct = rows.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    keys = distinct.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.slice(labels, i, F.size(labels)))).alias("suffix"))
    keys = keys.select("host", "path", F.concat(host_key(F.col("suffix")), F.col("path")).alias("key"))
    stacks = active_rules(keys.select("key").distinct(), rules)
    found = stacks.where(F.size("stack") > 0).select("key", F.array_max("stack").alias("best"))
    best = (keys.join(found, "key").groupBy("host", "path")
            .agg(F.max(F.struct("best.length", "best.host_length", "best.rule", "best.verdict")).alias("best")))
    # rows without a host find no rule: a key of their own each keeps them from meeting in one task
    own = F.when(F.col("host") == "", F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("host"))
    out = rows.withColumn("own", own).alias("r").join(best.alias("b"), F.expr("r.own = b.host AND r.path = b.path"), "left").select(
        ROW, "r.host", "r.path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return unpacked(out, df.columns, ["host", "path", "rule", "verdict"])
