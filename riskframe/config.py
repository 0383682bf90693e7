"""Run settings, held on the driver as frozen dataclasses."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
import json


@dataclass(frozen=True)
class CleanConfig:
    flag_mode: str = "lenient"          # "strict" keeps only true/"true"
    remove_duplicates: bool = True
    fail_on_unknown: bool = False       # raise instead of quarantining bad labels


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.2
    seed: int = 42
    stratify: bool = True


@dataclass(frozen=True)
class LogisticConfig:
    max_iter: int = 1000
    c: float = 1.0
    tol: float = 1e-7


@dataclass(frozen=True)
class TreeConfig:
    max_depth: int | None = 8
    min_leaf: int = 5
    max_bins: int | None = None         # thresholds tried for each column; None tries all
    seed: int = 42


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 200
    max_depth: int | None = 12
    min_leaf: int = 3
    max_bins: int | None = 64
    seed: int = 42


@dataclass(frozen=True)
class KernelConfig:
    c: float = 1.0
    components: int = 256
    max_iter: int = 30                  # Newton steps
    tol: float = 1e-6
    folds: int = 5
    seed: int = 42


@dataclass(frozen=True)
class RunConfig:
    target_column: str | None = None    # overrides the spec's target when set
    clean: CleanConfig = field(default_factory=CleanConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    logistic: LogisticConfig = field(default_factory=LogisticConfig)
    tree: TreeConfig = field(default_factory=TreeConfig)
    forest: ForestConfig = field(default_factory=ForestConfig)
    kernel: KernelConfig = field(default_factory=KernelConfig)
    threshold: float = 0.5
    parallelism: int = 4                # classifiers that may train at once

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
