"""Language identification by prediction by partial matching (PPM).

For every language a context tree over bytes of order ``ORDER`` counts which byte follows which
context. A byte that has followed the longest known context costs log2((T + q) / c) bits there
(c of its T bytes, q different ones: escape method C); a byte that has not costs an escape,
log2((T + q) / q), and is coded by the next shorter context; below the empty one a byte costs 8
bits. Contexts a language has never seen cost nothing and fall through. The statistics are
frozen after training, so the code length of a text is exact and depends on the text alone.
The language of the shortest code is predicted; its score is the posterior probability of
that language when all are equally likely before the text is read.

With frozen counts the cost of a byte is a function of it and the ORDER bytes before it. The trees of all
languages are therefore one table for each length, from byte run to its cost in every language, with
escapes already followed, and a text is scored by look-ups, in pieces that carry their
context over. Nothing of a text is left out.

Learning takes a bounded sample: ``sample_bytes`` (4 MiB) in all, an equal share for each of the ``max_langs``
(64) most frequent languages (ties: by name). From each, distinct whole texts of smallest hash are taken
while they fit; those above an eighth of the share come last, those above the share are not learned from.
The trees hold at most ``MAX_CELLS`` (4 million, 32 MB) costs: beyond, runs seen less than m times in the whole
sample are left out, m being the least number that fits. Sample and trees are all that the driver holds and the tasks get.

Texts are folded by ASCII lower case and begin behind ORDER line feeds. Null texts and texts without a
letter (empty ones too) are ``und`` with score 0, as is everything when nothing could be learned from.
Very long texts are scored whole; rounding aside, ties go to the first language by name. Repeated rows are
predicted alike. An empty table gives no rows. Rows with a null language or text are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

ORDER = 4
SAMPLE_BYTES = 4 << 20
MAX_LANGS = 64
MAX_CELLS = 4_000_000
UNKNOWN = "und"
#: Costs that a task holds at a time.
PIECE = 1 << 20
_PAD = b"\n"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def runs(data: np.ndarray, length: int) -> np.ndarray:
    """Each run of ``length`` bytes of ``data`` as a number, by its last byte; as many as there are whole runs."""
    n = len(data) - length + 1
    code = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(length):
        code = (code << np.uint64(8)) | data[k:k + len(code)]
    return code


class Lookup:
    """Places of keys in a sorted array, by open addressing at a quarter load."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.at = np.full(1 << bits, -1, dtype=np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = (((keys[todo] * _MIX) >> self.shift).astype(np.int64) + step) & self.mask
            free = np.flatnonzero(self.at[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.key[slot[taken]], self.at[slot[taken]] = keys[todo[taken]], todo[taken]
            todo, step = np.delete(todo, taken), step + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = ((keys * _MIX) >> self.shift).astype(np.int64)
        out = self.at[slot]
        todo = np.flatnonzero((self.key[slot] != keys) & (out >= 0))
        out[todo] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = self.at[slot[todo]]
            same = (self.key[slot[todo]] == keys[todo]) & (at >= 0)
            out[todo[same]] = at[same]
            todo = todo[~same & (at >= 0)]
        return out


@dataclass(frozen=True)
class Model:
    """``langs`` in order of name; by run length 1 to ORDER + 1 the known runs and their costs in every
    language, and by context length 0 to ORDER the known contexts and their escape costs."""

    langs: tuple[str, ...]
    order: int
    known: tuple[np.ndarray, ...]
    costs: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]

    def lookups(self) -> tuple[list[Lookup], list[Lookup]]:
        return [Lookup(k) for k in self.known], [Lookup(c) for c in self.contexts]


def _least_count(counts: list, langs: int, cells: int) -> int:
    """The least count in all languages with which all kept runs fit into ``cells`` costs."""
    totals = []
    for of in zip(*counts):
        code, at = np.unique(np.concatenate([c for c, _ in of]), return_inverse=True)
        totals.append(np.bincount(at, np.concatenate([n for _, n in of]), len(code)))
    total = np.sort(np.concatenate(totals))[::-1]
    room = cells // langs
    return int(total[room]) + 1 if len(total) > room else 1


def learn(samples: dict[str, list[bytes]], order: int = ORDER, cells: int = MAX_CELLS) -> Model:
    """The model of folded texts by language."""
    langs = tuple(sorted(samples))
    pad = np.frombuffer(_PAD * order, np.uint8)
    counts = []
    for lang in langs:
        of = []
        for length in range(1, order + 2):
            # Only runs that end in a byte of the text, so the pad is context alone.
            codes = [runs(np.concatenate([pad, np.frombuffer(t, np.uint8)])[order + 1 - length:], length) for t in samples[lang]]
            of.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]), return_counts=True))
        counts.append(of)
    least = _least_count(counts, len(langs), cells) if langs else 1
    known, costs, contexts, escapes = [], [], [], []
    for length in range(1, order + 2):
        code = np.unique(np.concatenate([np.zeros(0, np.uint64), *[of[length - 1][0] for of in counts]]))
        c = np.zeros((len(code), len(langs)))
        for k, of in enumerate(counts):
            c[np.searchsorted(code, of[length - 1][0]), k] = of[length - 1][1]
        # A run occurs no more often than its end, so what is kept ends in runs that are kept.
        kept = c.sum(axis=1) >= least
        code, c = code[kept], c[kept]
        ctx, start = np.unique(code >> np.uint64(8), return_index=True)
        total = np.add.reduceat(c, start, axis=0) if len(ctx) else c[:0]
        kinds = np.add.reduceat((c > 0).astype(float), start, axis=0) if len(ctx) else c[:0]
        seen = total > 0
        escape = np.where(seen, np.log2(np.where(seen, total + kinds, 1) / np.where(seen, kinds, 1)), 0.0)
        own = np.searchsorted(ctx, code >> np.uint64(8))
        if length == 1:
            shorter = np.full(c.shape, 8.0)
        else:
            rest = code & np.uint64((1 << 8 * (length - 1)) - 1)
            shorter = costs[-1][np.searchsorted(known[-1], rest)]
        direct = np.log2((total + kinds)[own] / np.where(c > 0, c, 1.0), where=c > 0, out=np.zeros(c.shape))
        known.append(code)
        costs.append(np.where(c > 0, direct, escape[own] + shorter))
        contexts.append(ctx)
        escapes.append(escape)
    return Model(langs, order, tuple(known), tuple(costs), tuple(contexts), tuple(escapes))


def _piece_costs(data: np.ndarray, model: Model, tables: tuple[list[Lookup], list[Lookup]]) -> np.ndarray:
    """Costs (byte, language) of the bytes of ``data`` behind its first ``order`` ones."""
    code = runs(data, model.order + 1)
    length = model.order + 1
    at = tables[0][length - 1].find(code)
    out = np.zeros((len(code), len(model.langs)))
    hit = at >= 0
    out[hit] = model.costs[length - 1][at[hit]]
    missed, code = np.flatnonzero(~hit), code[~hit]
    while len(missed):
        ctx = tables[1][length - 1].find(code >> np.uint64(8))
        met = np.flatnonzero(ctx >= 0)
        out[missed[met]] += model.escapes[length - 1][ctx[met]]
        length -= 1
        if not length:
            out[missed] += 8.0
            break
        code = code & np.uint64((1 << 8 * length) - 1)
        at = tables[0][length - 1].find(code)
        hit = at >= 0
        out[missed[hit]] += model.costs[length - 1][at[hit]]
        missed, code = missed[~hit], code[~hit]
    return out


def code_lengths(texts: list[bytes], model: Model, tables=None, piece: int = PIECE) -> np.ndarray:
    """Bits (text, language) of folded texts."""
    tables = tables or model.lookups()
    piece = max(1, piece // max(1, len(model.langs)))
    pad = _PAD * model.order
    bits = np.zeros((len(texts), len(model.langs)))
    data = np.frombuffer(pad.join([b"", *texts]), np.uint8)
    # A text's bytes stand at [start, end); the pads between belong to the text before and are left out.
    end = np.cumsum([len(t) + model.order for t in texts], dtype=np.int64)
    start = end - np.array([len(t) for t in texts], dtype=np.int64)
    for lo in range(model.order, len(data), piece):
        hi = min(lo + piece, len(data))
        cost = _piece_costs(data[lo - model.order:hi], model, tables)
        first, last = np.searchsorted(end, lo, "right"), np.searchsorted(start, hi, "left")
        for k in range(first, last):
            part = cost[max(start[k], lo) - lo:min(end[k], hi) - lo]
            bits[k] += part.sum(axis=0)
    return bits


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
           sample_bytes: int = SAMPLE_BYTES, max_langs: int = MAX_LANGS) -> dict[str, list[bytes]]:
    """Folded training texts by language, at most ``sample_bytes`` together."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`").cast("string")
    rows = docs.where(text.isNotNull() & lang.isNotNull()).select(
        lang.alias("l"), text.alias("t"), F.xxhash64(text).alias("h"), (F.octet_length(text) + 16).cast("bigint").alias("size"))
    langs = rows.groupBy("l").agg(F.sum("size").alias("all"), F.count("*").alias("n")).orderBy(
        F.desc("n"), "l").limit(max_langs).collect()
    if not langs:
        return {}
    share = sample_bytes // len(langs)
    # The hash below which texts of about four shares are expected; the rest is not sorted.
    most = (1 << 30) - 1
    upto = F.create_map(*[F.lit(x) for r in langs for x in (r["l"], min(most, int(4 * share / r["all"] * most) + 1))])
    near = rows.where((F.pmod("h", F.lit(most)) <= upto[F.col("l")]) & (F.col("size") <= share))
    big = (F.col("size") > share // 8).cast("int")
    upto_here = Window.partitionBy("l").orderBy(big, "h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = (
        near.select("l", "h", "size").distinct().withColumn("sum", F.sum("size").over(upto_here))
        .where(F.col("sum") <= share).select("l", "h", "size")
    )
    # At most sample_bytes / 17 rows of chosen keys; each brings one text.
    texts = near.join(F.broadcast(chosen), ["l", "h", "size"]).groupBy("l", "h", "size").agg(F.min("t").alias("t"))
    out: dict[str, list[bytes]] = {r["l"]: [] for r in langs}
    for r in texts.collect():
        out[r["l"]].append(folded(r["t"]))
    return {k: v for k, v in out.items() if v}


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
        sample_bytes: int = SAMPLE_BYTES, max_langs: int = MAX_LANGS) -> Model:
    """Learn from ``docs``, the training rows."""
    return learn(sample(docs, text_col, lang_col, sample_bytes, max_langs), order)


def predict(text: Column, model: Model) -> Column:
    """struct(lang_pred, score) of a text column; the model travels with the function."""
    tables = None

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        nonlocal tables
        tables = tables or model.lookups()
        spoken = [bool(model.langs) and t is not None and _LETTER.search(t) is not None for t in texts]
        known = [folded(t) for t, s in zip(texts, spoken) if s]
        names = np.full(len(spoken), UNKNOWN, dtype=object)
        score = np.zeros(len(spoken))
        if known:
            bits = code_lengths(known, model, tables)
            over = bits - bits.min(axis=1, keepdims=True)
            names[spoken] = np.array(model.langs, dtype=object)[over.argmin(axis=1)]
            score[spoken] = 1.0 / np.exp2(-over).sum(axis=1)
        return pd.DataFrame({"lang_pred": names, "score": score})

    return of(text)
