"""Table scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskframe.functions.columns import na_to_null
from riskframe.functions.staging import stage
from riskframe.spec import RUN_SCHEMA


def _or_missing(read, path: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no table at {path}") from exc
        raise


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column as text.

    Quotes inside quoted fields are doubled. Line breaks inside them need ``multi_line``,
    which reads each file in one task. Types are assigned by name in the cleaning step, so
    no inference pass is needed; files read together must share one header, and a file
    whose header differs raises.
    """
    reader = (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
        .option("enforceSchema", False).option("multiLine", multi_line)
    )
    return _or_missing(lambda: reader.csv(path), path)


def read_csv_checked(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """As ``read_csv``, in two tables: rows with as many fields as the header, and the others.

    The second holds each other record as it stands in the file, in a column ``record``, and is
    written once, so that counting it does not read the files again.
    """
    header = read_csv(spark, path, multi_line)
    raw = "_record"
    while raw in header.columns:
        raw += "_"
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in header.columns], T.StructField(raw, T.StringType())])
    rows = (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
        .option("enforceSchema", False).option("multiLine", multi_line).option("columnPruning", False)
        .option("columnNameOfCorruptRecord", raw).csv(path)
    )
    # Spark refuses a plan that needs the malformed record alone; an empty piece of the first column makes it need both.
    whole = F.concat_ws("", F.col(raw), F.substring(F.col(f"`{header.columns[0]}`"), 1, 0)) == ""
    rejects = stage(rows.where(~whole), "csv_rejects").select(F.col(raw).alias("record"))
    return rows.where(whole).drop(raw), rejects


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _or_missing(lambda: spark.read.parquet(path), path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines against a declared schema (nested structs allowed)."""
    return _or_missing(lambda: spark.read.schema(schema).json(path), path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run index with its nested object flattened."""
    return read_json(spark, path, RUN_SCHEMA).select("*", "explainability.*").drop("explainability")


def missing_tokens_to_null(df: DataFrame) -> DataFrame:
    """Apply the CSV missing-value tokens to every text column."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: na_to_null(c) for c in text})
