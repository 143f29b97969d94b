"""Feature, cluster and vector tables and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.scalars import safe_float
from knotwork.session import scratch
from knotwork.sources.quoted import read_records

# Names under which tables carry their key and cluster columns.
KEY_NAMES = ["patient_uri", "entity", "entity_label", "uri", "key"]
COMMUNITY_NAMES = ["leiden_cluster", "leiden", "leiden_label", "community"]
DENSITY_NAMES = ["hdbscan_cluster", "hdbscan", "hdbscan_label", "density_cluster"]
NO_CLUSTER = -1


def _first_named(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((name for name in names if name in df.columns), None)


def with_key(df: DataFrame) -> DataFrame:
    """The first known key column renamed to ``key``."""
    name = _first_named(df, KEY_NAMES)
    if name is None:
        raise ValueError(f"no key column among {df.columns}")
    return df.withColumnRenamed(name, "key")


# How texts with quotes, line breaks, outer blanks or nothing in them stay what they are.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _ddl(schema: T.StructType) -> str:
    """The columns as text in a schema string, names quoted."""
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in schema.names)


def read_feature_table(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV or TSV with a header; all columns are text until ``numeric_rule_columns`` picks the numbers.

    With ``multi_line`` a quoted text may hold line breaks; without it lines are parsed as they stand,
    for tables whose texts have none. Files are split either way. The header of the first file names
    the columns; the first record of every file is left out.
    """
    separator = sep or ("\t" if path.endswith((".tsv", ".tab")) else ",")
    if not multi_line:
        return with_key(spark.read.csv(path, sep=separator, inferSchema=False, **CSV_OPTIONS))
    # Reads the head of one file: nothing is inferred but the names.
    schema = spark.read.csv(path, sep=separator, inferSchema=False, multiLine=True, **CSV_OPTIONS).schema
    records = read_records(spark, path, separator).filter(~F.col("first"))
    options = {name: str(value) for name, value in CSV_OPTIONS.items() if name != "header"}
    parsed = F.from_csv("value", _ddl(schema), options | {"sep": separator, "multiLine": "true"})
    return with_key(records.select(parsed.alias("row")).select("row.*"))


def read_cluster_table(spark: SparkSession, path: str) -> DataFrame:
    """key, community, density_cluster; what is no whole number becomes -1."""
    rows = read_feature_table(spark, path)

    def label(names: Sequence[str], out: str):
        name = _first_named(rows, names)
        value = safe_float(F.col(name)).cast("int") if name else F.lit(None)
        return F.coalesce(value, F.lit(NO_CLUSTER)).cast("int").alias(out)

    return rows.select("key", label(COMMUNITY_NAMES, "community"), label(DENSITY_NAMES, "density_cluster"))


def read_embedding_table(spark: SparkSession, path: str) -> DataFrame:
    """key, vec from columns named by position or ``emb_`` and position; bad numbers become null."""
    rows = read_feature_table(spark, path)
    places = {name: name.removeprefix("emb_") for name in rows.columns if name != "key"}
    names = sorted((n for n, place in places.items() if place.isdigit()), key=lambda n: int(places[n]))
    if not names:
        raise ValueError("no embedding columns")
    return rows.select("key", F.array(*[safe_float(F.col(f"`{n}`")) for n in names]).alias("vec"))


def find_artifacts(spark: SparkSession, folder: str, name_pattern: str) -> DataFrame:
    """Paths below a folder whose file name matches the pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return files.option("pathGlobFilter", name_pattern).load(folder).select("path", "length").orderBy("path")


def write_table(df: DataFrame, name: str, kind: str = "csv", path: str | None = None) -> str:
    """Write a result as csv, json or parquet and return where it is."""
    target = path or scratch(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer.csv(target, quoteAll=True, **CSV_OPTIONS)
    elif kind == "json":
        writer.json(target)
    elif kind == "parquet":
        writer.parquet(target)
    else:
        raise ValueError(f"unknown kind: {kind}")
    return target


def write_vectors(points: DataFrame, path: str | None = None) -> str:
    """key and vec as Parquet."""
    return write_table(points.select("key", "vec"), "vectors", "parquet", path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
