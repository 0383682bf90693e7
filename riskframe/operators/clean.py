"""Cleaning operators: raw records in, typed records with a 0/1 target out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from riskframe.config import CleanConfig
from riskframe.functions import columns as C
from riskframe.sources.readers import missing_tokens_to_null
from riskframe.spec import FeatureSpec

_FLAG_RULES = {"strict": C.flag_strict, "lenient": C.flag_lenient}


def normalise_headers(df: DataFrame) -> DataFrame:
    names = [C.normalise_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        clash = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"headers collide after normalising: {clash}")
    return df.toDF(*names)


def drop_leakage(df: DataFrame, spec: FeatureSpec, keep_id: bool = True) -> DataFrame:
    return df.drop(*(spec.dropped if keep_id else spec.leakage))


def cast_flags(df: DataFrame, spec: FeatureSpec, mode: str = "lenient") -> DataFrame:
    rule = _FLAG_RULES[mode]
    return df.withColumns({c: rule(F.col(c)) for c in spec.flags if c in df.columns})


def cast_numbers(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    return df.withColumns({c: C.to_number(F.col(c)) for c in spec.continuous if c in df.columns})


def encode_target(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    return df.withColumn(spec.target, C.encode_target(F.col(spec.target), spec.target_codes))


def unknown_targets(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Rows whose raw label is missing or not in the code table."""
    return df.where(C.encode_target(F.col(spec.target), spec.target_codes).isNull())


def bad_integer_targets(df: DataFrame, target: str) -> DataFrame:
    """Rows of an integer target outside {0, 1}."""
    return df.where(~F.col(target).isin(0, 1))


def check_target(df: DataFrame, spec: FeatureSpec) -> None:
    """Raise if the target is absent or any label is unknown."""
    if spec.target not in df.columns:
        raise ValueError(f"target column {spec.target!r} not found in {df.columns}")
    if isinstance(df.schema[spec.target].dataType, T.IntegralType):
        bad = bad_integer_targets(df, spec.target)
    else:
        bad = unknown_targets(df, spec)
    row = bad.select(spec.target).first()
    if row is not None:
        raise ValueError(f"unrecognised target label {row[0]!r}; expected {sorted(spec.target_codes)}")


def drop_missing_target(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    return df.na.drop(subset=[spec.target])


def deduplicate(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row per distinct record, keeping the smallest id.

    The aggregate combines copies before the shuffle, so a record copied many
    times over does not become a hot task.
    """
    keys = [c for c in df.columns if c != spec.id]
    if spec.id not in df.columns:
        return df.dropDuplicates(keys)
    return df.groupBy(*keys).agg(F.min(spec.id).alias(spec.id)).select(*df.columns)


def select_features(df: DataFrame, spec: FeatureSpec, *extra: str) -> DataFrame:
    return df.select(*extra, *spec.features)


def recode_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumn(column, C.recode(F.col(column), mapping))


def decode_labels(df: DataFrame, column: str, spec: FeatureSpec, out: str) -> DataFrame:
    return df.withColumn(out, C.decode_label(F.col(column), spec.labels))


def fill_defaults(df: DataFrame, spec: FeatureSpec, defaults: Mapping) -> DataFrame:
    """Fill nulls of present features and add absent ones at their default."""
    out = {}
    for c in spec.features:
        default = defaults[c]
        if c not in spec.categorical:
            default = float(default)
            present = F.col(c).cast("double") if c in df.columns else None
        else:
            present = F.col(c) if c in df.columns else None
        out[c] = F.lit(default) if present is None else C.fill(present, default)
    return df.withColumns(out)


def filter_class(df: DataFrame, spec: FeatureSpec, cls: int) -> DataFrame:
    return df.where(F.col(spec.target) == cls)


def preview(df: DataFrame, order: str, rows: int = 100) -> DataFrame:
    """The first rows by ``order``; planned as a per-partition top-k."""
    return df.orderBy(order).limit(rows)


def pseudonymise(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Replace the identifier by its SHA-256 digest."""
    return df.withColumn(spec.id, F.sha2(F.col(spec.id).cast("string"), 256))


def stack_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=False)


def record_from_json(df: DataFrame, column: str, spec: FeatureSpec, flag_mode: str = "lenient") -> DataFrame:
    """Typed features from free-form JSON text; absent fields and unparsable numbers become NULL."""
    rule = _FLAG_RULES[flag_mode]
    text = T.StructType([T.StructField(c, T.StringType()) for c in spec.features])
    parsed = df.withColumn("_r", F.from_json(F.col(column), text))
    typed = [
        (F.col(f"_r.{c}") if c in spec.categorical
         else F.when(F.col(f"_r.{c}").isNotNull(), rule(F.col(f"_r.{c}"))) if c in spec.flags
         else C.to_number(F.col(f"_r.{c}"))).alias(c)
        for c in spec.features
    ]
    return parsed.select(*df.columns, *typed)


def clean_features(df: DataFrame, spec: FeatureSpec, flag_mode: str = "lenient") -> DataFrame:
    """The shared step of training and scoring: headers, missing tokens, types."""
    df = missing_tokens_to_null(normalise_headers(df))
    return cast_numbers(cast_flags(df, spec, flag_mode), spec)


def clean(df: DataFrame, spec: FeatureSpec, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Training table: cleaned features, encoded target, no bad labels, no copies."""
    df = normalise_headers(df)
    if config.fail_on_unknown:
        check_target(df, spec)
    df = clean_features(drop_leakage(df, spec), spec, config.flag_mode)
    df = drop_missing_target(encode_target(df, spec), spec)
    df = df.select(spec.id, *spec.features, spec.target)
    return deduplicate(df, spec) if config.remove_duplicates else df


def rejected(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The quarantine table that complements ``clean``."""
    return unknown_targets(normalise_headers(df), spec)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column_types(df: DataFrame) -> DataFrame:
    """Name and type of every column, in order."""
    rows = [(i, f.name, f.dataType.simpleString(), len(df.columns)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, n_columns int")


def missing_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required columns the table lacks, with what scoring does about each."""
    absent = [(c, "filled with training default") for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(absent, "column string, action string")
