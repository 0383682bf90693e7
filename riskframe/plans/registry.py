"""Saved models: one folder per classifier, the preparation table and a card naming the best.

Each save writes a version of its own and then names it, in one file, as the served one. Readers
see the version before or the one after, never a part, and a job that dies while saving leaves the
served version as it was. Older versions stay until the owner of the store expires them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession, functions as F, types as T

from riskframe.config import CleanConfig
from riskframe.operators.kernel import load_kernel
from riskframe.operators.learn import FOREST, SVM, TREE, Classifier
from riskframe.operators.prepare import PrepModel, load_prep
from riskframe.operators.trees import load_trees
from riskframe.sources.readers import read_json
from riskframe.spec import FeatureSpec

_CARD = "best_model string, models array<string>, labels map<string,string>, flag_mode string"
_SERVED = "saved_at long, version string"


@dataclass(frozen=True)
class ModelStore:
    spark: SparkSession
    path: str
    spec: FeatureSpec
    version: str | None = None          # None follows the served version

    def pinned(self) -> ModelStore:
        """The store as it is now: a later save does not change what this one reads."""
        return self if self.version else replace(self, version=self.served())

    def served(self) -> str:
        """The version saved last. A store without any raises FileNotFoundError."""
        found = read_json(self.spark, f"{self.path}/served", T.StructType.fromDDL(_SERVED))
        last = found.agg(F.max(F.struct("saved_at", "version"))["version"]).first()[0]
        if last is None:
            raise FileNotFoundError(f"no saved version under {self.path}")
        return last

    def _folder(self) -> str:
        return f"{self.path}/versions/{self.version or self.served()}"

    def save(self, models: Mapping, prep: PrepModel, best: str, clean: CleanConfig = CleanConfig()) -> str:
        """Write a version, serve it and return its name.

        ``clean`` is what the training rows were cleaned with; scoring reads flags the same way.
        """
        version = uuid.uuid4().hex
        folder = f"{self.path}/versions/{version}"
        for name, m in models.items():
            m.save(f"{folder}/models/{name}")
        prep.save(self.spark, f"{folder}/prep")
        card = [(best, sorted(models), {str(k): v for k, v in self.spec.labels.items()}, clean.flag_mode)]
        self.spark.createDataFrame(card, _CARD).coalesce(1).write.mode("overwrite").json(f"{folder}/card")
        self.spark.createDataFrame([(time.time_ns(), version)], _SERVED).coalesce(1).write.mode("append").json(f"{self.path}/served")
        return version

    def _card(self):
        return read_json(self.spark, f"{self._folder()}/card", T.StructType.fromDDL(_CARD)).first()

    def best_name(self) -> str:
        return self._card()["best_model"]

    def labels(self) -> dict[int, str]:
        return {int(k): v for k, v in self._card()["labels"].items()}

    def flag_mode(self) -> str:
        return self._card()["flag_mode"] or CleanConfig().flag_mode

    def prep(self) -> PrepModel:
        return load_prep(self.spark, f"{self._folder()}/prep", self.spec)

    def model(self, name: str | None = None):
        """The named classifier, or the best one. A missing model raises FileNotFoundError."""
        store = self.pinned()
        card = store._card()
        name = name or card["best_model"]
        if name not in card["models"]:
            raise FileNotFoundError(f"no model {name!r} under {self.path}; have {card['models']}")
        path = f"{store._folder()}/models/{name}"
        try:
            if name == SVM:
                return load_kernel(self.spark, path)
            if name in (TREE, FOREST):
                return load_trees(self.spark, path)
            return Classifier(name, PipelineModel.load(path))
        except (Py4JJavaError, AnalysisException) as exc:
            if "does not exist" not in str(exc):
                raise
            raise FileNotFoundError(f"no model at {path}") from exc
