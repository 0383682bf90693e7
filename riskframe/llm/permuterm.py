"""Spelling variants by permuterm rotations.

A word marked with a terminator has one rotation for each of its places. The rotation that
starts behind a letter ends with that letter, so all words that differ from it in that letter
alone share all but the last character: a replacement is a prefix range of the sorted
rotations, and the word without the letter (one deletion, or an insertion seen from the other
side) is the rotation that equals the prefix. ``neighbours`` therefore sorts all rotations by
their prefix, scans each range once, and tells every member how many near words the range
holds and which occurs most. A range holds one word for each letter and the word without it,
so its size is bounded by the alphabet; work in it is linear: members get the best of the
others, no pairs are written.

The rotations of a word hold its length squared in letters. Words longer than ``LONG`` are therefore
rotated as digests (127 bits, each computed from the one before), one row a place, and the pairs that
share a range find their words by key.

Each replacement is met in one range only. A letter of a run of equal letters gives the same
word wherever it is left out; only the first of a run counts, so each pair is counted once.

Words are counted in the scan, by document, then summed with map-side aggregation. Null and
empty texts have no words; a null id is written as an empty text in the hash of a run. Very long
texts are split by one forward search and counted whole. Ties of the largest n go to the
smallest word in code-point order. Repeated rows count as often as they stand. An empty table
gives no rows. Only id and text are read, whatever the other columns are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
import math
import re
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.functions.staging import stage

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form occurs at least so many times as often as the word it stands for.
RATIO = 10
#: One letter is left out of a run in a document where this divides the hash of both.
SLIP = 31
END = "$"
#: Longer words are rotated as digests.
LONG = 64
_PRIME = (1 << 127) - 1
_BASE = 0x5DEECE66D1CE4E5B9BF58476D1CE4E5
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(doc_id: object, text: str | None, least: int = MIN_LENGTH, slip: int = SLIP) -> Counter:
    """The words of one document with their numbers; shorter ones are left out."""
    runs: Counter = Counter()
    for run, n in Counter(re.findall(f"[A-Za-zÀ-ÿ]{{{least},}}", text or "")).items():
        runs[run.translate(_LOWER)] += n
    out: Counter = Counter()
    name = "" if doc_id is None else str(doc_id)
    for run, n in runs.items():
        h = crc32(f"{name}:{run}".encode())
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
            total.update(words_of(doc_id, text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words with ``least`` or more occurrences."""
    found = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text_col}`")).mapInArrow(
        _counted, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, first, n): every rotation of every word, once by all but its last character and
    once as a whole (``last`` empty). ``first`` marks the first letter of a run of equal ones."""
    at = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")
    cut = words.select("word", "n", at).select(
        "word", "n", "at", F.substring("word", F.col("at") + 1, F.length("word")).alias("tail"),
        F.substring("word", F.lit(1), F.col("at")).alias("head"),
    )
    whole = F.concat("tail", F.lit(END), "head")
    # The rotation that starts at 0 ends with the terminator: it has no letter to leave out.
    last = F.substring("word", F.col("at"), F.lit(1))
    before = F.substring("word", F.col("at") - 1, F.lit(1))
    prefix = F.concat("tail", F.lit(END), F.substring("word", F.lit(1), F.col("at") - 1))
    as_word = F.struct(whole.alias("prefix"), F.lit("").alias("last"), F.lit(True).alias("first"))
    as_gap = F.struct(prefix.alias("prefix"), last.alias("last"), ((F.col("at") == 1) | (last != before)).alias("first"))
    both = F.when(F.col("at") > 0, F.array(as_word, as_gap)).otherwise(F.array(as_word))
    return cut.select("n", F.explode(both).alias("r")).select("r.*", "n")


def _word(prefix: str, last: str) -> str:
    tail, head = prefix.split(END)
    return head + last + tail


def _range(prefix: str, members: list[tuple[str, bool, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n and text of the best) for the members (last, first, n) of one prefix."""
    def best(of: list[tuple[str, bool, int]]) -> list[tuple[int, str]]:
        return sorted((-n, _word(prefix, last)) for last, _, n in of)[:2]

    gaps = [m for m in members if m[0]]
    words = [m for m in members if not m[0]]
    top, top_first = best(gaps), best([m for m in gaps if m[1]])
    n_first = sum(m[1] for m in gaps)
    whole = [(-n, _word(prefix, "")) for _, _, n in words]
    for last, first, n in gaps:
        own = (-n, _word(prefix, last))
        near = len(gaps) - 1 + (len(whole) if first else 0)
        if near:
            others = [x for x in top if x != own] + (whole if first else [])
            m, form = min(others)
            yield own[1], near, -m, form
    for own in whole:
        if n_first:
            yield own[1], n_first, -top_first[0][0], top_first[0][1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rotations arrive sorted by prefix, so a range is complete when the next begins."""
    prefix, members = None, []
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        for at, last, first, n in zip(*[c.to_pylist() for c in batch.columns]):
            if at != prefix:
                if len(members) > 1:
                    out += _range(prefix, members)
                prefix, members = at, []
            members.append((last, first, n))
        yield _rows(out)
    if len(members) > 1:
        yield _rows(list(_range(prefix, members)))


def _rows(out: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["word", "near", "form_n", "form"])


def digests(word: str) -> Iterator[tuple[str, bool, bool]]:
    """As ``rotations``: (digest of the prefix, is gap, is first) of every rotation of a word."""
    n, head, power = len(word), [0], [1]
    for c in word:
        head.append((head[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    for at in range(n + 1):
        tail = ((head[n] - head[at] * power[n - at]) * _BASE + ord(END)) % _PRIME
        yield f"{n}:{(tail * power[at] + head[at]) % _PRIME:x}", False, True
        if at:
            digest = (tail * power[at - 1] + head[at - 1]) % _PRIME
            yield f"{n - 1}:{digest:x}", True, at == 1 or word[at - 1] != word[at - 2]


def _long_rotations(longer_than: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix", "gap", "first", "id"]
        for batch in batches:
            for word, own in zip(*[c.to_pylist() for c in batch.columns]):
                rows = digests(word)
                while some := list(islice(rows, 10_000)):
                    # Shorter words take part only as what a longer one is without a letter.
                    some = [(*r, own) for r in some if len(word) > longer_than or not r[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*some)], names=names)

    return run


def _long_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of the near pairs in each range (a letter's place, so bounded by the alphabet)."""
    prefix, members = None, []

    def close() -> Iterator[pa.RecordBatch]:
        gaps = [m for m in members if m[0]]
        pairs = [(a, b) for _, _, a in gaps for _, _, b in gaps if a != b]
        for _, _, whole in [m for m in members if not m[0]]:
            pairs += [p for _, first, a in gaps if first for p in ((a, whole), (whole, a))]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for at, *member in zip(*[c.to_pylist() for c in batch.columns]):
            if at != prefix:
                if len(members) > 1:
                    yield from close()
                prefix, members = at, []
            members.append(member)
    if len(members) > 1:
        yield from close()


def long_neighbours(words: DataFrame, longer_than: int = LONG) -> DataFrame:
    """(word, near, form_n, form), one row for each near word of a pair with a word longer than ``longer_than``."""
    own = words.where(F.length("word") >= longer_than).select("word", "n", F.md5(F.col("word").cast("binary")).alias("id"))
    ordered = (
        own.select("word", "id").mapInArrow(_long_rotations(longer_than), "prefix string, gap boolean, first boolean, id string")
        .repartition("prefix").sortWithinPartitions("prefix")
    )
    pairs = ordered.mapInArrow(_long_pairs, "a string, b string")
    other = own.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    return pairs.join(own.select("word", F.col("id").alias("a")), "a").join(other, "b").select(
        "word", F.lit(1).cast("bigint").alias("near"), "form_n", "form")


def neighbours(words: DataFrame, longer_than: int = LONG) -> DataFrame:
    """(word, n_near, form_n, form): of words (word, n) with a near word, how many and the most frequent."""
    short = words.where(F.length("word") <= longer_than)
    ordered = rotations(short).repartition("prefix").sortWithinPartitions("prefix")
    found = ordered.mapInArrow(_scan, "word string, near bigint, form_n bigint, form string")
    merged = found.unionByName(long_neighbours(words, longer_than)).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))
    return merged.select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def groups(words: DataFrame, ratio: int = RATIO, longer_than: int = LONG) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a table (word, n) of distinct words.

    n grows by ``ratio`` (2 or more) along a chain of forms, which so bounds its length; chains are
    followed by doubling.
    """
    own = stage(words, "words")
    near = own.join(neighbours(own, longer_than), "word", "left")
    counted = F.col("form_n") >= F.lit(ratio) * F.col("n")
    rows = stage(near.select(
        "word", F.when(counted, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(counted, F.col("form_n")).alias("form_n"),
    ), "forms")
    steps = stage(rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "steps")
    most = rows.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.ceil(math.log(most, ratio)))
    for _ in range((longest - 1).bit_length()):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stage(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "steps")
    return rows.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spelling groups of all words of ``docs``."""
    return groups(vocabulary(docs, doc_id, text_col))
