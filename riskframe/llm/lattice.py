"""SentencePiece N-best segmentation and decoding.

A text becomes its pieces form: a space is put in front and spaces become the mark
``U+2581``. Arcs of the lattice are the model's pieces; a character that is no piece is one
arc of byte pieces, at a score below every usable piece. A forward Viterbi pass gives the best score up
to each position. That is an exact heuristic for the backward A-star search: a hypothesis
grows from the end to the start, and its priority is its own score plus the forward score
of where it stands, so complete hypotheses leave the queue best first.

No piece of the model runs across the start of a word (this is checked when it is loaded), so
the lattice of a text is a chain of word lattices. Word lattices are searched once per
worker for each distinct word and kept in a bounded table, and the N best of the text are
merged from those words whose second-best segmentation loses least. The result equals a
search of the whole lattice. The best segmentation of a word and the loss of its second best
come from a two-best Viterbi pass; A-star runs on the words, at most N - 1 a text, that can
differ from their best.

Order: score, then from the end backwards the longer last piece. Null and empty texts have
no pieces and one segmentation of score 0. A mark in the text itself is written as byte
pieces, so decoding gives every text back. Repeated rows are encoded alike. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import sentencepiece

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
N_BEST = 4
#: Pieces at or below this score are marked as never to be used by their model.
UNUSED = -1e8
#: Words kept per worker, and the code points they may hold together.
CACHE_WORDS = 400_000
CACHE_CHARS = 6_000_000
CACHE_OPTIONS = 50_000
#: Words up to this length are learned together.
TOGETHER = 48
#: Texts encoded at a time, and the code points they may hold together.
SLICE_TEXTS = 2_000
SLICE_CHARS = 600_000
#: Stands for a mark of the text itself: a lone surrogate, which no text from Arrow holds.
_OWN_MARK = "\ud800"
_LOADED: dict[str, "Lattice"] = {}


#: Substring keys: a polynomial of the code points, modulo 2**64, plus a term for the length.
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Slots for each key of a hash table, at least.
_ROOM = 32


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)


_POWERS = _powers(4096)
_WIDTHS = np.arange(4096, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _prefix_sums(group: list[str], length: int) -> np.ndarray:
    """Polynomial of the first k code points of each string, for k from 0 to ``length``."""
    codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
    sums = np.zeros((length + 1, len(group)), dtype=np.uint64)
    for k in range(length):
        sums[k + 1] = sums[k] * _BASE + codes[:, k]
    return sums


def _hash_tables(keys: np.ndarray, ids: np.ndarray) -> list[tuple[np.uint64, np.uint64, np.ndarray]]:
    """Slots by the high bits of key * factor; keys that find theirs taken go to the next, much smaller table."""
    tables = []
    rng = np.random.default_rng(1)
    while len(ids):
        factor = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        bits = (_ROOM * len(ids)).bit_length()
        shift = np.uint64(64 - bits)
        slot = (keys[ids] * factor) >> shift
        slots = np.full(1 << bits, -1, dtype=np.int32)
        slots[slot] = ids
        tables.append((factor, shift, slots))
        ids = ids[slots[slot] != ids]
    return tables


class _Path:
    """A hypothesis of the A-star search: its last arc and the hypothesis that it extends.

    The order is that of the piece lengths from the end, longer first. ``jump`` skips many
    hypotheses back, so paths of any length are compared in a logarithmic number of steps.
    """

    __slots__ = ("n", "at", "score", "ids", "up", "jump", "depth")

    def __init__(self, n: int, at: int, score: float, ids: tuple[int, ...], up: "_Path | None"):
        self.n, self.at, self.score, self.ids, self.up = n, at, score, ids, up
        if up is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = up.depth + 1, up.jump
            self.jump = far.jump if up.depth - far.depth == far.depth - far.jump.depth else up

    def back(self, depth: int) -> "_Path":
        a = self
        while a.depth > depth:
            a = a.jump if a.jump.depth >= depth else a.up
        return a

    def __lt__(self, other: "_Path") -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.back(depth), other.back(depth)
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.up, b.up) if a.jump is b.jump else (a.jump, b.jump)
        return a.n > b.n

    def all_ids(self) -> tuple[int, ...]:
        out, a = [], self
        while a is not None:
            out += a.ids
            a = a.up
        return tuple(out)


@dataclass
class Lattice:
    """A model's pieces as lattice arcs."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    surface: list[bytes]
    longest: int
    low: float
    by_words: bool
    scores: np.ndarray
    keys: np.ndarray
    tables: list[tuple[np.uint64, np.uint64, np.ndarray]]
    words: dict[str, tuple[bytes, float, float]] = field(default_factory=dict)
    searched: dict[tuple[str, int], list] = field(default_factory=dict)
    held: int = 0

    @classmethod
    def load(cls, path: str) -> "Lattice":
        if path not in _LOADED:
            m = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces, surface, byte_ids = {}, [], [0] * 256
            for i in range(m.get_piece_size()):
                p = m.id_to_piece(i)
                if m.is_byte(i):
                    byte_ids[int(p[3:5], 16)] = i
                    surface.append(bytes([int(p[3:5], 16)]))
                elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                    surface.append(b"")
                else:
                    pieces[p] = (i, m.get_score(i))
                    surface.append(p.replace(MARK, " ").encode())
            low = min(s for _, s in pieces.values() if s > UNUSED) - 10.0
            by_words = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
            # One more entry than pieces: number -1 is no piece.
            scores = np.full(len(surface) + 1, -np.inf)
            for i, x in pieces.values():
                scores[i] = x
            keys = np.zeros(len(surface) + 1, dtype=np.uint64)
            by_length: dict[int, list[str]] = {}
            for p in pieces:
                by_length.setdefault(len(p), []).append(p)
            for n, group in by_length.items():
                keys[[pieces[p][0] for p in group]] = _prefix_sums(group, n)[n] + _WIDTHS[n]
            tables = _hash_tables(keys, np.array([i for i, _ in pieces.values()]))
            _LOADED[path] = cls(
                pieces, byte_ids, surface, max(map(len, pieces)), low, by_words, scores, keys, tables
            )
        return _LOADED[path]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of substring keys, -1 where there is none."""
        out = np.full(keys.shape, -1, dtype=np.int32)
        for factor, shift, slots in self.tables:
            at = slots.take((keys * factor) >> shift)
            # Most slots are empty, and no key is the one of number -1.
            some = np.flatnonzero(at >= 0)
            at = at.ravel().take(some)
            hit = self.keys.take(at) == keys.ravel().take(some)
            out.ravel()[some[hit]] = at[hit]
        return out

    def arcs(self, text: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(length, ids, score) of the arcs that end at ``end``, longest first."""
        out = []
        for n in range(min(self.longest, end), 0, -1):
            hit = self.pieces.get(text[end - n:end])
            if hit:
                out.append((n, (hit[0],), hit[1]))
        if not out or out[-1][0] != 1:
            c = text[end - 1]
            raw = (MARK if c == _OWN_MARK else c).encode("utf-8", "replace")
            out.append((1, tuple(self.byte_ids[b] for b in raw), self.low * len(raw)))
        return out

    def forward(self, text: str) -> list[float]:
        """Viterbi: the best score of each prefix."""
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[end - n] + s for n, _, s in self.arcs(text, end)))
        return best

    def search(self, text: str, n_best: int) -> list[tuple[float, tuple[int, ...]]]:
        """Backward A-star: the ``n_best`` (score, ids), best first.

        A hypothesis holds its last arc and a link to the one before, so memory grows with
        the text, not its square. No more than ``n_best`` hypotheses go on from a position:
        later ones cover the same rest of the text and come after those in the order.
        """
        best = self.forward(text)
        queue = [(-best[-1], _Path(0, len(text), 0.0, (), None))]
        passed = [0] * (len(text) + 1)
        out = []
        while queue and len(out) < n_best:
            _, path = heapq.heappop(queue)
            at = path.at
            if at == 0:
                out.append((path.score, path.all_ids()))
                continue
            if passed[at] >= n_best:
                continue
            passed[at] += 1
            for n, own, s in self.arcs(text, at):
                score = path.score + s
                heapq.heappush(queue, (-(score + best[at - n]), _Path(n, at - n, score, own, path)))
        return out

    def quick(self, text: str) -> tuple[tuple[int, ...], float, float]:
        """Best ids, best score and the loss of the second best, from a two-best Viterbi pass."""
        get, longest = self.pieces.get, self.longest
        one, two, back = [0.0], [-np.inf], [None]
        for end in range(1, len(text) + 1):
            a = b = -np.inf
            arc = None
            for n in range(min(longest, end), 1, -1):
                hit = get(text[end - n:end])
                if hit:
                    s = one[end - n] + hit[1]
                    t = two[end - n] + hit[1]
                    if s > a:
                        a, b, arc = s, max(a, t), (n, (hit[0],))
                    elif s > b:
                        b = s
                    elif t > b:
                        b = t
            c = text[end - 1]
            hit = get(c)
            if hit:
                ids, s1 = (hit[0],), hit[1]
            else:
                raw = (MARK if c == _OWN_MARK else c).encode("utf-8", "replace")
                ids, s1 = tuple(self.byte_ids[x] for x in raw), self.low * len(raw)
            s = one[end - 1] + s1
            t = two[end - 1] + s1
            if s > a:
                a, b, arc = s, max(a, t), (1, ids)
            else:
                b = max(b, s, t)
            one.append(a)
            two.append(b)
            back.append(arc)
        ids, at = [], len(text)
        while at:
            n, own = back[at]
            ids.append(own)
            at -= n
        return tuple(i for own in reversed(ids) for i in own), one[-1], one[-1] - two[-1]

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """(ids as bytes, score, loss of the second best) for words: the two-best Viterbi pass
        over all words of one length together."""
        out = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            if length > TOGETHER or len(group) < 8:
                rest = group
            else:
                rest = self._learn_group(length, group, out)
            for w in rest:
                ids, score, loss = self.quick(w)
                out[w] = np.array(ids, dtype=np.int32).tobytes(), score, loss
        return out

    def _learn_group(self, length: int, group: list[str], out: dict) -> list[str]:
        """Adds the words made of known characters to ``out``; returns the others."""
        scores = self.scores
        n = len(group)
        sums = _prefix_sums(group, length)
        one, two = np.zeros((length + 1, n)), np.full((length + 1, n), -np.inf)
        back = np.zeros((length + 1, n), dtype=np.int64)
        arcs = np.zeros((length + 1, min(self.longest, length) + 1, n), dtype=np.int32)
        known = np.ones(n, dtype=bool)
        for end in range(1, length + 1):
            a, b, arc = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
            most = min(self.longest, end)
            # All arcs that end here are looked up together: arc k begins at ``end - k``.
            arcs[end, 1:most + 1] = self.find(
                sums[end] - sums[end - most:end][::-1] * _POWERS[1:most + 1, None] + _WIDTHS[1:most + 1, None])
            any_ = (arcs[end, 1:most + 1] >= 0).any(axis=1)
            for k in range(most, 0, -1):
                if not any_[k - 1]:
                    continue
                gain = scores.take(arcs[end, k])
                s, t = one[end - k] + gain, two[end - k] + gain
                np.putmask(arc, s > a, k)
                # No second best exceeds its best, so the second of all is the largest but one of a, s, b and t.
                np.maximum(b, t, out=b)
                np.maximum(b, np.minimum(a, s), out=b)
                np.maximum(a, s, out=a)
            known &= arcs[end, 1] >= 0
            one[end], two[end], back[end] = np.where(known, a, 0.0), b, np.where(known, arc, 1)
        at, every = np.full(n, length), np.arange(n)
        steps = []
        while at.any():
            k = back[at, every]
            steps.append(np.where(at > 0, arcs[at, k, every], -1))
            at = at - k
        ids = np.array(steps[::-1], dtype=np.int32).T
        with np.errstate(invalid="ignore"):
            loss = one[length] - two[length]
        used = ids >= 0
        flat, ends = ids[used].tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        rest, lo = [], 0
        for w, sure, hi, best, lost in zip(group, known.tolist(), ends, one[length].tolist(), loss.tolist()):
            if sure:
                out[w] = flat[lo:hi], best, lost
            else:
                rest.append(w)
            lo = hi
        return rest

    def look_up(self, texts: list[list[str]]) -> list[list[tuple[bytes, float, float]]]:
        """Entries of the words of several texts; new words are learned together."""
        table = self.words
        new = {w for words in texts for w in words if w not in table}
        if new:
            if len(table) + len(new) > CACHE_WORDS or self.held > CACHE_CHARS:
                # The words of these texts stay: they are likely the frequent ones.
                table = self.words = {w: table[w] for words in texts for w in words if w in table}
                self.held = sum(map(len, table))
            learned = self.learn(list(new))
            table.update(learned)
            self.held += sum(map(len, new))
        return [[table[w] for w in words] for words in texts]

    def options(self, word: str, n_best: int) -> list[tuple[float, bytes]]:
        """The ``n_best`` segmentations of a word by A-star: (loss against the best, ids)."""
        found = self.searched.get((word, n_best))
        if found is None:
            ranked = self.search(word, n_best)
            found = [(ranked[0][0] - s, np.array(i, dtype=np.int32).tobytes()) for s, i in ranked]
            if len(self.searched) >= CACHE_OPTIONS:
                self.searched.clear()
            if len(word) <= TOGETHER:
                self.searched[word, n_best] = found
        return found

    def split(self, text: str) -> list[str]:
        """Words of the pieces form, each with the marks before it."""
        if not text:
            return []
        marked = MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", marked) if self.by_words else [marked]

    def encode_all(self, texts: list[str | None], n_best: int) -> list["Ranked"]:
        words = [self.split(t or "") for t in texts]
        return [self._rank(w, f, n_best) for w, f in zip(words, self.look_up(words))]

    def encode(self, text: str | None, n_best: int) -> list[tuple[float, np.ndarray]]:
        """The ``n_best`` segmentations of a text: (score, ids), best first."""
        ranked = self.encode_all([text], n_best)[0]
        return [(s, np.frombuffer(i, np.int32)) for s, i in zip(ranked.scores, ranked.every(self, n_best))]

    def _rank(self, words: list[str], found: list[tuple[bytes, float, float]], n_best: int) -> "Ranked":
        parts, best, loss = zip(*found) if found else ((), (), ())
        best = sum(best)
        if n_best == 1 or not found:
            return Ranked(words, parts, [best], [()])
        # Only the words of the smallest losses can differ from their best in the n best texts.
        loss = np.array(loss)
        where = np.sort(np.argsort(loss, kind="stable")[:n_best - 1])
        merged = [(0.0, ())]
        for i in where.tolist():
            if not np.isfinite(loss[i]):
                continue
            steps = [(lost, r) for r, (lost, _) in enumerate(self.options(words[i], n_best))]
            merged = heapq.nsmallest(n_best, [(a + b, (*c, (i, r))) for a, c in merged for b, r in steps])
        return Ranked(words, parts, [best - lost for lost, _ in merged], [c for _, c in merged])

    def decode(self, ids) -> str:
        surface = self.surface
        raw = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


@dataclass
class Ranked:
    """A text's words, their best ids, and the n best scores with what each changes."""

    words: list[str]
    parts: Sequence[bytes]
    scores: list[float]
    changes: list[tuple[tuple[int, int], ...]]

    def best(self) -> bytes:
        return b"".join(self.parts)

    def every(self, lattice: Lattice, n_best: int) -> list[bytes]:
        out = []
        for changes in self.changes:
            parts = list(self.parts)
            for i, r in changes:
                if r:
                    parts[i] = lattice.options(self.words[i], n_best)[r][1]
            out.append(b"".join(parts))
        return out


def _nested(every: list[list[bytes]]) -> pa.Array:
    """Lists of lists of ids, given as bytes, without a Python object for each id."""
    def ends(sizes: list[int]) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    single = [ids for text in every for ids in text]
    flat = pa.array(np.frombuffer(b"".join(single), np.int32))
    inner = pa.ListArray.from_arrays(ends([len(i) // 4 for i in single]), flat)
    return pa.ListArray.from_arrays(ends([len(text) for text in every]), inner)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts, null as empty, and where each begins."""
    part, held, at = [], 0, 0
    for i, t in enumerate(texts):
        text = t.as_py() or ""
        if part and (len(part) >= SLICE_TEXTS or held + len(text) > SLICE_CHARS):
            yield at, part
            part, held, at = [], 0, i
        part.append(text)
        held += len(text)
    if part:
        yield at, part


def encode(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", n_best: int = N_BEST,
           model: str = MODEL, all_ids: bool = False) -> DataFrame:
    """doc_id, ids (best segmentation), scores (n best, descending) and round_trip.

    With ``all_ids`` the column nbest holds the ids of every segmentation. ``round_trip``
    says that decoding the ids gave the whole text back.
    """
    schema = "doc_id bigint, ids array<int>, scores array<double>, round_trip boolean"
    schema += ", nbest array<array<int>>" if all_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model)
        for batch in batches:
            # A slice of texts at a time, so the ids of a batch of long texts do not pile up; in larger ones more new words are learned together.
            for at, part in _slices(batch.column(1)):
                found = lattice.encode_all(part, n_best)
                raw = [r.best() for r in found]
                scores = [r.scores for r in found]
                same = [lattice.decode(np.frombuffer(i, np.int32).tolist()) == t for i, t in zip(raw, part)]
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in raw])]).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), np.int32)
                columns = [
                    batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_()),
                ]
                names = ["doc_id", "ids", "scores", "round_trip"]
                if all_ids:
                    columns.append(_nested([r.every(lattice, n_best) for r in found]))
                    names.append("nbest")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The ``keep`` columns and the text of the ids; null ids give a null text."""
    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        lattice = Lattice.load(model)
        return pd.Series([None if x is None else lattice.decode(x) for x in batch], dtype=object)

    return encoded.select(*keep, text(F.col(ids)).alias("text"))


def digest(encoded: DataFrame) -> DataFrame:
    """Sizes and hashes of the ids; of those of all segmentations too, where ``encoded`` holds them."""
    every = [F.xxhash64("nbest").alias("nbest_hash")] if "nbest" in encoded.columns else []
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"), "scores", "round_trip", *every,
    )
