"""Feature contracts: which column plays which role.

Operators never name a clinical column themselves; they take a ``FeatureSpec``,
so one operator serves the patient cohort and any other labelled table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import types as T


def _frozen(d: Mapping | None = None) -> Mapping:
    return MappingProxyType(dict(d or {}))


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles of one supervised table."""

    id: str
    target: str
    continuous: tuple[str, ...]
    flags: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    leakage: tuple[str, ...] = ()
    # raw target text (trimmed, lower case) -> class
    target_codes: Mapping[str, int] = field(default_factory=_frozen)
    # class -> display label
    labels: Mapping[int, str] = field(default_factory=_frozen)
    # numeric column -> inclusive (low, high)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=_frozen)
    # categorical column -> accepted values
    allowed: Mapping[str, tuple[str, ...]] = field(default_factory=_frozen)

    @property
    def numeric(self) -> tuple[str, ...]:
        """The scaled block: continuous columns, then flags."""
        return self.continuous + self.flags

    @property
    def features(self) -> tuple[str, ...]:
        """All model inputs in contract order."""
        return self.categorical + self.numeric

    @property
    def dropped(self) -> tuple[str, ...]:
        """Leakage columns other than the id, which we keep as a hash key."""
        return tuple(c for c in self.leakage if c != self.id)

    def record_schema(self) -> T.StructType:
        """Schema of one cleaned record without its target."""
        return T.StructType(
            [T.StructField(c, T.StringType()) for c in self.categorical]
            + [T.StructField(c, T.DoubleType()) for c in self.continuous]
            + [T.StructField(c, T.IntegerType()) for c in self.flags]
        )


# The public data contract (names, codes, labels, bounds).
CLINICAL = FeatureSpec(
    id="patient_id",
    target="case_status",
    continuous=("age_years", "hemoglobin_g_dl", "fever_days"),
    flags=(
        "uses_mosquito_net",
        "has_fever",
        "has_chills",
        "has_headache",
        "has_vomiting",
        "has_diarrhea",
        "has_weakness",
    ),
    categorical=("sex", "residence", "season"),
    leakage=(
        "patient_id",
        "age_months",
        "age_group",
        "parasitemia_level",
        "parasitemia_count",
        "plasmodium_species",
        "anemia_status",
        "outcome",
        "respiratory_distress",
        "shock",
        "acute_kidney_injury",
    ),
    target_codes=_frozen({"positive": 1, "1": 1, "negative": 0, "0": 0}),
    labels=_frozen({0: "Case Negative", 1: "Case Positive"}),
    ranges=_frozen({
        "age_years": (0.0, 120.0),
        "hemoglobin_g_dl": (2.0, 22.0),
        "fever_days": (0.0, 30.0),
    }),
    allowed=_frozen({
        "sex": ("Male", "Female"),
        "residence": ("Rural", "Urban"),
        "season": ("Rainy", "Dry"),
    }),
)

# Labelled documents, scored on shape features.
TEXT_QUALITY = FeatureSpec(
    id="doc_id",
    target="quality",
    continuous=("n_chars", "n_words", "digit_share"),
    categorical=("lang", "source"),
    target_codes=_frozen({"1": 1, "0": 0}),
    labels=_frozen({0: "Low quality", 1: "High quality"}),
)

# Orders with categorical columns that grow with the table.
ORDERS = FeatureSpec(
    id="order_id",
    target="returned",
    continuous=("total",),
    categorical=("customer", "day"),
    target_codes=_frozen({"1": 1, "0": 0}),
    labels=_frozen({0: "Kept", 1: "Returned"}),
)

# Nested record of one training run.
RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("timestamp_utc", T.TimestampType()),
    T.StructField("best_model_name", T.StringType()),
    T.StructField("best_model_file", T.StringType()),
    T.StructField("model_dir", T.StringType()),
    T.StructField("reports_dir", T.StringType()),
    T.StructField("config_snapshot_path", T.StringType()),
    T.StructField("metrics_path", T.StringType()),
    T.StructField("explainability", T.StructType([
        T.StructField("csv_path", T.StringType()),
        T.StructField("plot_path", T.StringType()),
    ])),
])
