"""Readers and writers for the file layouts the workflows exchange.

Every reader takes an explicit schema (no inference pass over the data) and
returns a DataFrame; every writer is a plain DataFrame write, partitioned where
later reads filter (dataset, split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from arbora.operators.offers import OFFER_COLUMNS, read_quads  # noqa: F401  (S4 lives with the fold)

OFFER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in OFFER_COLUMNS])
# column written for Breadcrumb_Predicate in the ';' offer files (fixed value)
OFFER_FILE_HEADER = ["Title", "Description", "Category", "Breadcrumb", "BreadcrumbList",
                     "Breadcrumb-Predicate", "URL", "Host"]
HIERARCHY_SCHEMA = T.StructType([T.StructField(f"{k}{i}", T.StringType())
                                 for i in (1, 2, 3) for k in ("code", "name")])


def string_schema(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


# ---------------------------------------------------------------- S1 / S13

def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``,``-separated, fully quoted CSV with header; quoted fields may hold newlines."""
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
                 .option("multiLine", True).option("encoding", "UTF-8").csv(path))


def write_quoted_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """prediction/offer CSV with every field quoted."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("quoteAll", True)
       .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


# ---------------------------------------------------------------- S2 / S11

def _offer_file_reader(spark: SparkSession, columns: list[str]):
    # all columns are parsed even if few are asked for: a row is malformed or not as a whole
    return (spark.read.schema(string_schema(columns)).option("header", True).option("sep", ";").option("escape", '"')
                 .option("multiLine", True).option("columnPruning", False).option("ignoreLeadingWhiteSpace", False)
                 .option("ignoreTrailingWhiteSpace", False))


def dropped_offer_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of malformed rows that :func:`read_offer_files` leaves out."""
    every = _offer_file_reader(spark, OFFER_FILE_HEADER).option("mode", "PERMISSIVE").csv(path)
    whole = read_offer_files(spark, path)
    return every.agg(F.count(F.lit(1)).alias("n")).select(
        (F.col("n") - whole.select(F.count(F.lit(1))).scalar()).alias("n_dropped"))


def read_offer_files(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated offer files with header; quoted fields may hold quotes, separators,
    line breaks and blanks at their ends. Malformed rows are dropped (counted by
    :func:`dropped_offer_rows`) and empty files contribute nothing."""
    df = _offer_file_reader(spark, OFFER_FILE_HEADER).option("mode", "DROPMALFORMED").csv(path)
    return df.withColumnRenamed("Breadcrumb-Predicate", "Breadcrumb_Predicate")


def write_offer_files(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "csv") -> None:
    """Offers as ``;`` CSV with the offer header (or parquet)."""
    out = df.select(*[F.col(c).alias(h) for c, h in zip(OFFER_COLUMNS, OFFER_FILE_HEADER)])
    if fmt == "parquet":
        out.write.mode(mode).parquet(path)
    else:
        (out.write.mode(mode).option("header", True).option("sep", ";").option("escape", '"').option("quoteAll", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# ---------------------------------------------------------------- S3 / S8

def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: one JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_configs(spark: SparkSession, path: str, schema: T.StructType, explode_parameter: bool = True) -> DataFrame:
    """Whole-file JSON configs; a ``parameter`` array of structs becomes one
    row per option (a struct ``parameter`` is flattened); a config whose array is empty
    or missing keeps one row with NULLs."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    p = [f for f in schema.fields if f.name == "parameter"]
    if explode_parameter and p:
        if isinstance(p[0].dataType, T.ArrayType):
            return df.select("*", F.posexplode_outer("parameter").alias("option", "p_")).select(
                *[c for c in df.columns if c != "parameter"], "option", "p_.*")
        return df.select(*[c for c in df.columns if c != "parameter"], "parameter.*")
    return df


# ---------------------------------------------------------------- S5 / S6

def read_hierarchy_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated code/name hierarchy with a header row."""
    return spark.read.schema(HIERARCHY_SCHEMA).option("sep", "\t").option("header", True).csv(path)


def read_host_list(spark: SparkSession, path: str) -> DataFrame:
    """One host per line, stripped; blank lines dropped."""
    return (spark.read.text(path).select(F.trim(F.col("value")).alias("host"))
                 .where(F.length("host") > 0))


# ---------------------------------------------------------------- S7 / S14

def write_report(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Wide metric report as ``;`` CSV with header."""
    wide.coalesce(1).write.mode(mode).option("header", True).option("sep", ";").csv(path)


def read_results(spark: SparkSession, groups: dict[str, tuple[str, T.StructType]],
                 skip_marker: str = "aggregated") -> DataFrame:
    """Result reports of several layouts (one ``(path, schema)`` per group)
    with their file name; reports whose own name contains ``skip_marker`` are skipped
    (names of the folders above the group's path don't count); layouts are unioned by
    column name."""
    out = None
    for _, (path, schema) in groups.items():
        df = (spark.read.schema(schema).option("header", True).option("sep", ";").csv(path)
                   .withColumn("file", F.input_file_name())
                   .where(~F.contains(_below(path, F.col("file")), F.lit(skip_marker))))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _below(path: str, file):
    """The part of a file's path from the last name of ``path`` on."""
    above = path.rstrip("/").rsplit("/", 1)[0].split("://")[-1]
    above = (above[5:] if above.startswith("file:") else above).rstrip("/") + "/"
    return F.when(F.contains(file, F.lit(above)), F.substring_index(file, above, -1)).otherwise(F.substring_index(file, "/", -2))


# ---------------------------------------------------------------- S9 / S10

def write_split_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table partitioned by dataset and split."""
    df.write.mode(mode).partitionBy("dataset", "split").parquet(path)


def read_split_dataset(spark: SparkSession, path: str, dataset: str, splits: list[str]) -> DataFrame:
    """The rows of some splits of one dataset (partition pruning on both)."""
    return (spark.read.parquet(path)
                 .where((F.col("dataset") == dataset) & F.col("split").isin(*splits)))


# ---------------------------------------------------------------- S12 / S15

def write_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """One text line per row (corpus files, labelled text)."""
    w = df.select(*(partition_by or []), F.col(col).alias("value")).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
