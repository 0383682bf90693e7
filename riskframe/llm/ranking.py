"""Quality classifier by Bradley-Terry pairwise ranking.

From labelled documents, preference pairs (good, bad) are drawn. A linear score of text
features is learned by logistic loss on the feature differences of each pair, so only the
order of scores matters to the fit. The cut is a score quantile: the share of label 0 among
all training labels. ``score`` is the logistic of the distance to that cut, shifted so that
the cut itself is ``CUT`` (0.3): a document is accepted when its score is CUT or more.

The fit uses a bounded sample, the ``per_class`` documents of each label with the smallest
hash of their id, and at most ``max_pairs`` pairs. The cut is exact over all labelled documents,
in or out of the sample. Scoring covers every whole text.

Null texts count as empty; empty texts get the score of their (zero) features. Repeated
rows get equal scores, tied hashes of ids are broken by the id. With one label or none
there are no pairs: the weights are zero and every score is CUT. Rows with a null label or
id are not learned from. Only text is an input of the score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskframe.functions.quantiles import exact_quantiles
from riskframe.functions.staging import stage

CUT = 0.3
PER_CLASS = 8_000
MAX_PAIRS = 120_000
FEATURES = (
    "log_words", "distinct", "top_word", "word_len", "long_words", "upper", "digits", "symbols", "marks",
    "commas", "stops", "wide", "dup_lines", "line_words", "pairs", "words_ending_in_sign", "empty",
)
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>{}[]\\^~=_@+/"


def features(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "replace")
    w = b.split()
    n = len(w)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    size = len(b)
    count = lambda chars: size - len(b.translate(None, chars))
    seen = Counter(w)
    lines = [x for x in b.split(b"\n") if x.strip()]
    letters = sum(map(len, w))
    return [
        math.log(n), math.log1p(len(seen)) / math.log1p(n), max(seen.values()) / n, letters / n,
        sum(1 for x in seen if len(x) > 25) / len(seen), count(_UPPER) / letters, count(_DIGIT) / letters,
        min(3.0, count(_SYMBOL) / n), min(3.0, count(b"!?") / n), count(b",;") / n, count(b".") / n,
        (len(b) - len(text)) / letters, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        len(set(zip(w, w[1:]))) / max(1, n - 1),
        sum(c for x, c in seen.items() if x[-1:] in b"*#$%&|!") / n, 0.0,
    ]


@dataclass(frozen=True)
class RankModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.margins(x) - self.cut, -30, 30) + math.log(CUT / (1 - CUT))
        # Rounding must not put a score that lies on the cut below it.
        return np.round(1 / (1 + np.exp(-z)), 12)


def fit_pairs(diff: np.ndarray, l2: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Newton steps on mean(log(1 + exp(-diff @ w))) + l2/2 |w|^2."""
    w = np.zeros(diff.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = l2 * w - diff.T @ p / len(diff)
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text_col: str = "text", label: str = "quality",
        per_class: int = PER_CLASS, max_pairs: int = MAX_PAIRS, seed: int = 7) -> RankModel:
    """Fit on ``labels`` (the rows to learn from) joined to ``docs``."""
    return fit_vectors(vectors(docs, doc_id, text_col), labels, doc_id, label, per_class, max_pairs, seed)


def vectors(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, x): id and features of every document, written once, so that labels meet vectors and not texts."""
    made = docs.select(F.col(f"`{doc_id}`").alias("i"), feature_column(F.col(f"`{text_col}`")).alias("x"))
    return stage(made, "features")


def fit_vectors(made: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality",
                per_class: int = PER_CLASS, max_pairs: int = MAX_PAIRS, seed: int = 7) -> RankModel:
    """Fit on ``labels`` joined to ``made``, as ``vectors`` gives it. Labels without a document do not count."""
    rows = labels.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where(
        F.col("i").isNotNull() & F.col("y").isin(0, 1)
    )
    vector = stage(made.join(rows.dropDuplicates(["i", "y"]), "i").select("i", "y", "x"), "labelled")
    key = F.xxhash64(F.col("i"))
    sample = [r for y in (0, 1) for r in vector.where(F.col("y") == y).orderBy(key, "i", "x").limit(per_class).collect()]
    width = len(FEATURES)
    if len({r["y"] for r in sample}) < 2:
        return RankModel((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0)
    x, y = np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    # Each document of either class takes part equally often.
    turns = lambda a: np.concatenate([rng.permutation(a) for _ in range(-(-n // len(a)))])[:n]
    w = fit_pairs(z[turns(good)] - z[turns(bad)])
    model = RankModel(tuple(mean), tuple(scale), tuple(w), 0.0)
    margins = vector.select("y", margin_column(F.col("x"), model).alias("s"))
    counts = {r["y"]: r["n"] for r in vector.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Half-way between the last rank of label 0's share and the next.
    share = (counts[0] - 0.5) / (counts[0] + counts[1] - 1)
    return replace(model, cut=float(exact_quantiles(margins, ["s"], [share]).first()["q"][0]))


def margin_column(x: Column, model: RankModel) -> Column:
    @F.pandas_udf(T.DoubleType())
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(model.margins(np.array(rows.tolist()).reshape(-1, len(FEATURES))))

    return of(x)


def score_vector(x: Column, model: RankModel) -> Column:
    """Score column of a column of features."""
    @F.pandas_udf(T.DoubleType())
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(rows.tolist()).reshape(-1, len(FEATURES))))

    return of(x)


def feature_column(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return of(text)


def score(text: Column, model: RankModel) -> Column:
    """Score column of a text column; the model travels with the function."""
    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.scores(np.array([features(t) for t in texts])))

    return of(text)
