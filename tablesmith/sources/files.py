"""Sources and sinks (S1-S13): files, catalog tables, fitted models, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablesmith.functions.columns import hash_unit


def read_table_file(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv_infer(spark: SparkSession, path: str, header: bool = True,
                   schema: StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV with header; types inferred (one extra pass) unless a schema is given."""
    r = spark.read.option("header", header).option("sep", sep)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_csv_schema(spark: SparkSession, path: str, schema: StructType,
                    delimiter: str = ", ", header: bool = False) -> DataFrame:
    """Headerless CSV with a fixed schema; multi-character delimiters allowed."""
    return (spark.read.schema(schema).option("header", header)
            .option("delimiter", delimiter).csv(path))


def read_csv_positional(spark: SparkSession, path: str, names: Sequence[str],
                        sep: str = ",", infer: bool = True) -> DataFrame:
    """S3: headerless CSV, columns renamed by position."""
    df = spark.read.option("header", False).option("sep", sep).option("inferSchema", infer).csv(path)
    return df.toDF(*names)


def read_csv_sep(spark: SparkSession, path: str, sep: str = ";", header: bool = True,
                 infer: bool = True) -> DataFrame:
    """CSV with another separator."""
    return spark.read.option("header", header).option("sep", sep).option("inferSchema", infer).csv(path)


def read_csv_trim_dropna(spark: SparkSession, path: str, names: Sequence[str] | None = None,
                         schema: StructType | None = None, sep: str = ",") -> DataFrame:
    """Strip leading blanks, drop rows that failed to parse (any null field)."""
    r = spark.read.option("header", False).option("sep", sep).option("ignoreLeadingWhiteSpace", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    if names:
        df = df.toDF(*names)
    return df.dropna()


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Labelled sparse vectors -> (label double, features vector)."""
    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", num_features)
    return r.load(path)


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features")) \
        .write.mode("overwrite").format("libsvm").save(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table."""
    return spark.table(name)


def read_with_fallback(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
                       **options) -> DataFrame:
    """The catalog table when it exists, else the file."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.read.format(fmt).options(**options).load(path)


def write_table_overwrite(df: DataFrame, name: str, fmt: str = "parquet",
                          partition_by: Sequence[str] | None = None, path: str | None = None) -> None:
    """Replace a managed table (or, with ``path``, an external one kept there)."""
    w = df.write.mode("overwrite").format(fmt)
    w = w.option("path", path) if path else w
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def write_table_append(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None) -> None:
    """Append rows to a table (created on first write, at ``path`` if given)."""
    w = df.write.mode("append").format(fmt)
    (w.option("path", path) if path else w).saveAsTable(name)


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """Small literal rows + schema (lookup tables, rankings)."""
    return spark.createDataFrame(list(rows), schema)


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline (overwrites)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Reload a fitted pipeline."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def sample_rows(df: DataFrame, fraction: float, seed: int = 42,
                key: Sequence[str] | None = None) -> DataFrame:
    """Fraction sample.  With ``key`` the choice is a hash of the key, so it
    does not depend on partitioning (D14); without, Spark's Bernoulli sampler."""
    if key:
        bound = int(round(fraction * (1 << 32)))
        return df.where(hash_unit(key, salt=str(seed)) < F.lit(bound))
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
