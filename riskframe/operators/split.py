"""Train/test splits and folds by hash rank.

The order is the MD5 of ``id:seed``, uniform by construction. An exact quota
needs only the key at one rank per class, so we find that key by narrowing hex
prefixes: each pass is a filtered count of at most 4,096 prefixes per open cut,
combined before the shuffle. Applying the result is a string comparison per
row: no sort, no window, no shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from fractions import Fraction
import math

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.columns import order_hash

_STEP = 3       # hex digits narrowed per pass
_DIGITS = 32


@dataclass(frozen=True)
class HashCuts:
    """Per class, the ascending hash keys that end each part."""

    id: str
    label: str | None
    seed: int
    cuts: Mapping

    def part(self) -> Column:
        """0-based part of a row: how many cuts its key is beyond."""
        key = order_hash(F.col(self.id), self.seed)

        def beyond(cuts) -> Column:
            out = F.lit(0)
            for c in cuts:
                out = out + (key > F.lit(c)).cast("int")
            return out

        if self.label is None:
            return beyond(self.cuts[None])
        out = None
        for cls, cuts in self.cuts.items():
            same = F.col(self.label) == F.lit(cls)
            out = F.when(same, beyond(cuts)) if out is None else out.when(same, beyond(cuts))
        return out


def class_counts(df: DataFrame, label: str | None) -> dict:
    if label is None:
        return {None: df.count()}
    rows = df.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    return {r[0]: r[1] for r in sorted(rows, key=lambda r: r[0])}


def stratified_quota(counts: Mapping, test_size: float) -> dict:
    """Test rows per class: ceil of the total, shared by largest remainder."""
    n = sum(counts.values())
    total = math.ceil(Fraction(str(test_size)) * n)
    quota = {c: total * k // n for c, k in counts.items()}
    spare = total - sum(quota.values())
    by_remainder = sorted(counts, key=lambda c: (-(total * counts[c] % n), str(c)))
    for c in by_remainder[:spare]:
        quota[c] += 1
    return quota


def _prefix_counts(keyed: DataFrame, live: set | None, depth: int) -> dict:
    """Rows per next digits, for every (class, prefix) still open. At most
    16**_STEP counts each, so the collected table is small at any data size."""
    if live is not None:
        hit = F.lit(False)
        for c, prefix in sorted(live, key=str):
            hit = hit | (F.col("_c").eqNullSafe(F.lit(c)) & F.startswith("_k", F.lit(prefix)))
        keyed = keyed.where(hit)
    rows = keyed.groupBy(
        "_c", F.substring("_k", 1, depth).alias("_p"), F.substring("_k", depth + 1, _STEP).alias("_d")
    ).count().collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r["_c"], r["_p"]), {})[r["_d"]] = r["count"]
    return out


def find_cuts(
    df: DataFrame, id_col: str, label: str | None, ranks: Callable[[dict], Mapping], seed: int
) -> HashCuts:
    """Keys at 1-based ranks of each class; ``ranks`` maps class counts to rank lists.

    Rows that share a key (copies of one id) always land on the same side.
    """
    cls = F.lit(None).cast("int") if label is None else F.col(label)
    keyed = df.select(cls.alias("_c"), order_hash(F.col(id_col), seed).alias("_k"))
    if label is not None:
        keyed = keyed.where(F.col("_c").isNotNull())
    counted = _prefix_counts(keyed, None, 0)
    counts = {c: sum(counted[c, ""].values()) for c, _ in sorted(counted, key=lambda t: str(t[0]))}
    wanted = ranks(counts)
    # [prefix so far, rank inside that prefix]
    state = {(c, r): ["", r] for c, rs in wanted.items() for r in rs if r > 0}
    open_ = set(state)
    depth = 0
    while open_:
        if depth:
            counted = _prefix_counts(keyed, {(k[0], state[k][0]) for k in open_}, depth)
        for k in sorted(open_, key=str):
            prefix, need = state[k]
            for digits, n in sorted(counted[k[0], prefix].items()):
                if need <= n:
                    break
                need -= n
            state[k] = [prefix + digits, need]
            if need == n:
                open_.discard(k)
        depth += _STEP
        if depth >= _DIGITS:
            break
    cuts = {
        c: tuple(state[c, r][0].ljust(_DIGITS, "f") if r > 0 else "" for r in sorted(rs))
        for c, rs in wanted.items()
    }
    return HashCuts(id_col, label, seed, cuts)


def fit_split(
    df: DataFrame, id_col: str, label: str | None, test_size: float = 0.2, seed: int = 42
) -> HashCuts:
    """Exact split: stratified by ``label``, or over all rows when it is None."""
    return find_cuts(
        df, id_col, label,
        lambda counts: {c: [q] for c, q in stratified_quota(counts, test_size).items()}, seed,
    )


def apply_split(df: DataFrame, cuts: HashCuts) -> DataFrame:
    return df.withColumn("split", F.when(cuts.part() == 0, "test").otherwise("train"))


def hash_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Row-local split: no fit and no shuffle, the share holds in expectation."""
    bound = math.ceil(Fraction(str(test_size)) * 2**32) - 1
    head = F.substring(order_hash(F.col(id_col), seed), 1, 8)
    return df.withColumn(
        "split", F.when(head <= F.lit(f"{bound:08x}"), "test").otherwise("train")
    )


def fit_folds(df: DataFrame, id_col: str, label: str | None, k: int = 5, seed: int = 42) -> HashCuts:
    """Cuts that part each class into ``k`` folds whose sizes differ by at most one."""

    def ends(n: int) -> list[int]:
        out, end = [], 0
        for fold in range(k - 1):
            end += n // k + (fold < n % k)
            out.append(end)
        return out

    return find_cuts(df, id_col, label, lambda counts: {c: ends(n) for c, n in counts.items()}, seed)


def apply_folds(df: DataFrame, cuts: HashCuts) -> DataFrame:
    return df.withColumn("fold", cuts.part())
