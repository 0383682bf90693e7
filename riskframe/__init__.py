"""riskframe: supervised risk scoring on tabular records, written as Spark jobs."""

from riskframe.config import RunConfig
from riskframe.spec import CLINICAL, TEXT_QUALITY, FeatureSpec

__all__ = ["CLINICAL", "TEXT_QUALITY", "FeatureSpec", "RunConfig"]
