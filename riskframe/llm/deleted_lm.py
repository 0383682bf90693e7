"""Language-model scores by deleted interpolation.

Model: p(w | h) = a * c(h w) / c(h) + b * c(w) / N + c / (V + 1), where the weights a, b, c
depend on the bucket of the context's frequency c(h) (powers of two) and are learned by
expectation-maximisation. For that a tenth of the training texts is set aside: their
tokens are events, and the counts are those of the other training texts. Scores then use
the counts of all training texts. The context of a text's first word, and its last token,
is the text border, which counts as one token a text.

Work is done in blocks, the texts that a task holds at a time. A block sends each of its distinct
words and word pairs once, with counts, to the shard of its key; the shard adds up and
answers each block in the order it asked. So a frequent word costs one entry a block,
however many rows hold it, and no task meets an unbounded group. Keys are 64-bit hashes.
The events reach the driver as a histogram of bounded size (bucket by quantised estimates).

Null texts count as empty: one token, the border. Repeated rows count and score each.
Without training texts every estimate is the uniform one. Without events the weights are
equal. The id only decides what is learned from. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from riskframe.functions.staging import stage

BLOCK_TOKENS = 1_500_000
SHARD_TOKENS = 2_000_000
BUCKETS = 40
EM_SHARE = 10
EM_STEPS = 60
#: Steps per decade of the event histogram.
_GRAIN, _DECADES = 20, 20
_ANSWERS = "block long, kind int, shard int, n long, counts binary, held binary, known long, tokens long, held_tokens long"
_ASKS = "block long, kind int, shard int, keys binary, counts binary, held binary"
_LOADS = "block long, ids binary, lengths binary, words binary, tokens binary, pairs binary"


def _planes(a: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: zeros come together and compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(raw: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).reshape(n)


def _pack(a: np.ndarray) -> bytes:
    """Counts as 4 bytes each where they fit, else 8; the length tells which."""
    return _planes(a.astype("<u4" if not len(a) or a.max() < 1 << 32 else "<u8"))


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return _unplanes(raw, n, "<u4" if len(raw) == 4 * n else "<u8").astype(np.int64)


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


_BORDER = xxhash.xxh64_intdigest(b"\n", 1)


class _Block:
    """Texts coded as positions in the block's sorted word keys."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.train: list[bool] = []
        self.held: list[bool] = []
        self.n = 0

    def add(self, doc_id: int | None, text: str | None, train: bool, held: bool) -> None:
        w = (text or "").encode("utf-8", "replace").lower().split()
        number = self.number
        for x in w:
            if x not in number:
                number[x] = len(number)
        self.tokens.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
        self.ids.append(doc_id)
        self.train.append(train)
        self.held.append(held)
        self.n += len(w) + 1

    def coded(self):
        """Sorted distinct word keys (the border among them) and the token codes with a border after each text."""
        hash64 = xxhash.xxh64_intdigest
        raw = np.array([hash64(w) for w in self.number] + [_BORDER], dtype=np.uint64)
        words, code = np.unique(raw, return_inverse=True)
        border = np.array([len(self.number)], dtype=np.int32)
        flat = np.concatenate([part for t in self.tokens for part in (t, border)])
        lengths = np.array([len(t) + 1 for t in self.tokens], dtype=np.int32)
        return words, code.astype(np.int32)[flat], lengths


def _contexts(tokens: np.ndarray, lengths: np.ndarray, border: int) -> np.ndarray:
    before = np.concatenate([[border], tokens[:-1]]).astype(np.int64)
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = border
    return before


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block]]:
    """The blocks of a task, each with a number made of all it holds.

    Blocks with equal numbers hold equal rows, ask the same and get the same answers.
    """
    block, mark = _Block(), xxhash.xxh64()
    for batch in batches:
        for row in zip(*[batch.column(k) for k in range(4)]):
            doc_id, text, train, held = (x.as_py() for x in row)
            block.add(doc_id, text, train, held)
            mark.update(f"{doc_id} {train} {held} {len(text or '')} ")
            mark.update((text or "").encode("utf-8", "replace"))
            if block.n >= BLOCK_TOKENS:
                yield mark.intdigest() >> 1, block
                block, mark = _Block(), xxhash.xxh64()
    if block.n:
        yield mark.intdigest() >> 1, block


def _ask(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each block with their training and held counts, cut by shard."""
    step = (1 << 64) // shards + 1
    for number, block in _blocks(batches):
        words, tokens, lengths = block.coded()
        border = int(np.searchsorted(words, np.uint64(_BORDER)))
        train = np.repeat(np.array(block.train), lengths)
        held = np.repeat(np.array(block.held), lengths)
        h = _contexts(tokens, lengths, border)
        pairs, pair = np.unique(_pair_keys(words[h], words[tokens]), return_inverse=True)
        for kind, keys, code in ((0, words, tokens), (1, pairs, pair)):
            counts = np.bincount(code, weights=train, minlength=len(keys)).astype(np.int64)
            deleted = np.bincount(code, weights=held, minlength=len(keys)).astype(np.int64)
            shard = (keys // np.uint64(step)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
            rows = [
                (number, kind, int(shard[a]), keys[a:b].astype("<u8").tobytes(), _pack(counts[a:b]), _pack(deleted[a:b]))
                for a, b in zip(cuts[:-1], cuts[1:]) if b > a
            ]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("block", "kind", "shard", "keys", "counts", "held"), r)) for r in rows],
                schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()),
                                  ("keys", pa.binary()), ("counts", pa.binary()), ("held", pa.binary())]),
            )


def _answer(asked: pa.Table) -> pa.Table:
    """Totals of one shard, in the order of each block's question."""
    rows = asked.to_pylist()
    keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
    every, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    held = np.zeros(len(every), np.int64)
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    for r, a, b in zip(rows, cuts, cuts[1:]):
        # Keys are distinct within a question, so plain indexed addition counts each once.
        total[code[a:b]] += _unpack(r["counts"], b - a)
        held[code[a:b]] += _unpack(r["held"], b - a)
    first = {"known": int((total > 0).sum()), "tokens": int(total.sum()), "held_tokens": int(held.sum())}
    none = {"known": 0, "tokens": 0, "held_tokens": 0}
    out = [
        {"block": r["block"], "kind": r["kind"], "shard": r["shard"], "n": int(b - a), "counts": _pack(total[code[a:b]]),
         "held": _pack(held[code[a:b]]), **(none if k else first)}
        for k, (r, a, b) in enumerate(zip(rows, cuts, cuts[1:]))
    ]
    return pa.Table.from_pylist(out, schema=pa.schema([
        ("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("counts", pa.binary()),
        ("held", pa.binary()), ("known", pa.int64()), ("tokens", pa.int64()), ("held_tokens", pa.int64()),
    ]))


def _load(batches: Iterator[pa.RecordBatch], only_held: bool) -> Iterator[pa.RecordBatch]:
    """A block's coded texts, to meet its answers; for the events only the held texts,
    with the place of each word pair among all pairs of the block."""
    for number, block in _blocks(batches):
        words, tokens, lengths = block.coded()
        train, held = np.array(block.train), np.array(block.held)
        take = held if only_held else np.ones(len(lengths), bool)
        pairs = b""
        if only_held:
            h = _contexts(tokens, lengths, int(np.searchsorted(words, np.uint64(_BORDER))))
            _, pair = np.unique(_pair_keys(words[h], words[tokens]), return_inverse=True)
            pairs = _planes(pair.astype("<i4")[np.repeat(take, lengths)])
        yield pa.RecordBatch.from_pylist([{
            "block": number, "ids": _ids(pa.array(block.ids, pa.int64()).filter(pa.array(take))),
            "lengths": lengths[take].tobytes(), "words": words.astype("<u8").tobytes(),
            "tokens": _planes(tokens.astype("<i4")[np.repeat(take, lengths)]), "pairs": pairs,
        }], schema=pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in
                              ("ids", "lengths", "words", "tokens", "pairs")]]))


def _ids(ids: pa.Array) -> bytes:
    """Ids and their validity."""
    return ids.fill_null(0).to_numpy().astype("<i8").tobytes() + ids.is_valid().to_numpy(zero_copy_only=False).tobytes()


class _Met:
    """A block's texts with the counts it asked for."""

    def __init__(self, load: dict, answers: dict[tuple[int, int], dict]):
        self.words = np.frombuffer(load["words"], "<u8")
        self.lengths = np.frombuffer(load["lengths"], np.int32)
        n, size = len(self.lengths), int(self.lengths.sum())
        self.tokens = _unplanes(load["tokens"], size, "<i4")
        self.pairs = _unplanes(load["pairs"], size if load["pairs"] else 0, "<i4")
        self.valid = np.frombuffer(load["ids"][8 * n:], bool)
        self.ids = np.frombuffer(load["ids"][:8 * n], "<i8")
        border = int(np.searchsorted(self.words, np.uint64(_BORDER)))
        self.h = _contexts(self.tokens, self.lengths, border) if n else np.zeros(0, np.int64)
        self.answers = answers

    def counts(self, kind: int, what: str) -> np.ndarray:
        """Answers in the order of the block's sorted keys: shards are ranges of keys."""
        mine = [self.answers[k] for k in sorted(self.answers) if k[0] == kind]
        return np.concatenate([np.zeros(0, np.int64), *[_unpack(a[what], a["n"]) for a in mine]])


def _together(load: pa.Table, answer: pa.Table) -> list[_Met]:
    answers = {(a["kind"], a["shard"]): a for a in answer.to_pylist()}
    found = [_Met(r, answers) for r in load.to_pylist()]
    if not found or any(len(m.words) != len(m.counts(0, "counts")) for m in found):
        raise RuntimeError("a block changed between two reads of the texts; read them from a written table")
    return found


@dataclass(frozen=True)
class Mixture:
    """Weights (pair, word, uniform) by context bucket, and the totals they go with."""

    weights: tuple[tuple[float, float, float], ...]
    tokens: int
    known: int


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole base-2 logarithm of its count."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(context, 1)).astype(np.int64)), 0)


def em(events: np.ndarray, uniform: float, steps: int = EM_STEPS) -> tuple[tuple[float, float, float], ...]:
    """Weights from rows (bucket, pair estimate, word estimate, count)."""
    out = []
    for b in range(BUCKETS):
        own = events[events[:, 0] == b]
        lam = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
        if len(own):
            p = np.column_stack([own[:, 1], own[:, 2], np.full(len(own), uniform)])
            for _ in range(steps):
                part = p * lam
                part /= part.sum(axis=1, keepdims=True)
                lam = (part * own[:, 3:4]).sum(axis=0) / own[:, 3].sum()
            # No estimate may vanish: an event of a kind not seen here must stay possible.
            lam = 0.9999 * lam + 0.0001 * np.array([0.0, 0.5, 0.5])
        out.append(tuple(lam.tolist()))
    return tuple(out)


def _quantum(p: np.ndarray) -> np.ndarray:
    steps = np.clip(np.round(-np.log10(np.maximum(p, 1e-30)) * _GRAIN), 0, _GRAIN * _DECADES)
    return np.where(p > 0, 1 + steps, 0).astype(np.int64)


def model(answers: DataFrame, held: DataFrame) -> Mixture:
    """Totals and the learned weights."""
    total = answers.where("kind = 0").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "tokens", "held_tokens")]
    ).first()
    left = total["tokens"] - total["held_tokens"]
    bins = 1 + 1 + _GRAIN * _DECADES

    def events(load: pa.Table, answer: pa.Table) -> pa.Table:
        code, pair, word = [], [], []
        for m in _together(load, answer):
            c1 = m.counts(0, "counts") - m.counts(0, "held")
            c2 = m.counts(1, "counts") - m.counts(1, "held")
            ch, cw = c1[m.h], c1[m.tokens]
            pair.append(np.where(ch > 0, c2[m.pairs] / np.maximum(ch, 1), 0.0))
            word.append(cw / max(left, 1))
            code.append((bucket(ch) * bins + _quantum(pair[-1])) * bins + _quantum(word[-1]))
        codes, inv = np.unique(np.concatenate(code), return_inverse=True)
        total_of = lambda v: np.bincount(inv, weights=None if v is None else np.concatenate(v), minlength=len(codes))
        return pa.table({
            "code": pa.array(codes, pa.int64()), "n": pa.array(total_of(None).astype(np.int64)),
            "pair": pa.array(total_of(pair).astype(float)), "word": pa.array(total_of(word).astype(float)),
        })

    met = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        events, "code long, n long, pair double, word double"
    )
    rows = met.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n", "pair", "word")]).collect()
    data = np.array([[r["code"] // bins // bins, r["pair"] / r["n"], r["word"] / r["n"], r["n"]] for r in rows])
    data = data.reshape(-1, 4)
    data = data[np.lexsort(data.T)]
    return Mixture(em(data, 1 / (total["known"] + 1)), total["tokens"], total["known"])


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text_col: str = "text",
          em_share: int = EM_SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``train`` marks the rows to learn from. base_score is the add-one word model, score
    the interpolated one, both log10 of the text's probability.
    """
    is_train = F.coalesce(train, F.lit(False))
    is_held = is_train & (F.pmod(F.xxhash64(F.col(doc_id), F.lit(4)), F.lit(em_share)) == 0)
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
        is_train.alias("train"), is_held.alias("held"),
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = int(max(8, size // (6 * SHARD_TOKENS)))
    asked = rows.mapInArrow(lambda b: _ask(b, shards), _ASKS)
    answers = stage(asked.groupBy("kind", "shard").applyInArrow(_answer, _ANSWERS), "counts")
    held = rows.mapInArrow(lambda b: _load(b, True), _LOADS)
    mix = model(answers, held)
    weights = np.array(mix.weights)
    uniform = 1 / (mix.known + 1)

    def of_block(m: _Met) -> pa.Table:
        c1 = m.counts(0, "counts")
        _, pairs = np.unique(_pair_keys(m.words[m.h], m.words[m.tokens]), return_inverse=True)
        ch, cw, c2 = c1[m.h], c1[m.tokens], m.counts(1, "counts")[pairs]
        lam = weights[bucket(ch)]
        p = lam[:, 0] * np.where(ch > 0, c2 / np.maximum(ch, 1), 0.0)
        p += lam[:, 1] * cw / max(mix.tokens, 1) + lam[:, 2] * uniform
        base = np.log10((cw + 1) / (mix.tokens + mix.known + 1))
        starts = np.concatenate([[0], np.cumsum(m.lengths)[:-1]])
        add = lambda v: np.add.reduceat(v, starts)
        return pa.table({
            "doc_id": pa.array(m.ids, pa.int64(), mask=~m.valid),
            "n_tokens": pa.array(m.lengths.astype(np.int64)),
            "n_known": pa.array(add((cw > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(m.lengths), mix.tokens, np.int64)),
            "base_score": pa.array(add(base)),
            "score": pa.array(add(np.log10(p))),
        })

    def scores(load: pa.Table, answer: pa.Table) -> pa.Table:
        return pa.concat_tables([of_block(m) for m in _together(load, answer)])

    loads = rows.mapInArrow(lambda b: _load(b, False), _LOADS)
    # The deleted counts were for the events only.
    counts = answers.select("block", "kind", "shard", "n", "counts")
    return loads.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        scores, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
