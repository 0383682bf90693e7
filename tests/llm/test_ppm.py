"""Language identification against a plain context tree, and on held-out documents."""

from collections import Counter, defaultdict
import math

from hypothesis import given, settings, strategies as st
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import ppm
from riskframe.llm.text import id_crc


def plain_trees(texts, order):
    tree = defaultdict(Counter)
    for t in texts:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                tree[t[i - k:i]][t[i]] += 1
    return tree


def plain_bits(text, tree, order):
    bits, text = 0.0, b"\n" * order + text
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            seen = tree.get(text[i - k:i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if seen[text[i]]:
                bits += math.log2((total + kinds) / seen[text[i]])
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


LETTERS = st.text("abé \n1", max_size=30).map(lambda t: t.encode())


@given(st.lists(LETTERS, min_size=1, max_size=6), st.lists(LETTERS, min_size=1, max_size=6),
       st.lists(st.text("abcé \n1", max_size=40).map(lambda t: t.encode()), min_size=1, max_size=5),
       st.integers(0, 4), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_code_lengths(a, b, texts, order, piece):
    model = ppm.learn({"x": a, "y": b}, order)
    got = ppm.code_lengths(texts, model, piece=piece)
    trees = [plain_trees(t, order) for t in (a, b)]
    for t, row in zip(texts, got):
        assert row == pytest.approx([plain_bits(t, tree, order) for tree in trees], abs=1e-9)


def test_lookup_finds_every_key_and_no_other():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5_000, dtype=np.uint64) | np.uint64(0))
    keys = np.unique(np.append(keys, np.uint64(0)))
    found = ppm.Lookup(keys)
    assert (found.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 1 << 40, 50_000, dtype=np.uint64), keys)
    assert (found.find(others) == -1).all()
    assert (ppm.Lookup(keys[:0]).find(keys) == -1).all()


def test_bounded_model():
    rng = np.random.default_rng(2)
    samples = {k: [bytes(rng.integers(97, 123, 3_000, dtype=np.uint8))] for k in "ab"}
    small = ppm.learn(samples, 4, cells=2_000)
    assert sum(c.size for c in small.costs) <= 2_000
    # What is kept is closed: every run's end is known.
    for k in range(1, 5):
        assert np.isin(small.known[k] & np.uint64((1 << 8 * k) - 1), small.known[k - 1]).all()
    assert np.isfinite(ppm.code_lengths([samples["a"][0]], small)).all()


def test_odd_texts(llm, make_docs):
    docs = make_docs(["the cat sat on the mat", "the dog sat on the log"] * 5, range(10)).unionByName(
        make_docs(["le chat est sur la table", "le chien est dans la rue"] * 5, range(10)).withColumn("lang", F.lit("fr")))
    docs = docs.unionByName(docs.limit(3).withColumn("lang", F.lit(None).cast("string")))
    model = ppm.fit(docs)
    assert model.langs == ("en", "fr")
    texts = [None, "", "  \n", "123 !?", "le chat est dans la rue", "The cat sat on the log", "the " * 100_000, "é", "ж"]
    got = make_docs(texts).select("doc_id", ppm.predict(F.col("text"), model).alias("p")).select("doc_id", "p.*")
    rows = {r["doc_id"]: r for r in got.collect()}
    assert [rows[k]["lang_pred"] for k in range(7)] == ["und"] * 4 + ["fr", "en", "en"]
    assert all(rows[k]["score"] == 0 for k in range(4)) and all(0 < rows[k]["score"] <= 1 for k in range(4, 9))
    assert rows[8]["lang_pred"] in ("en", "fr")
    nothing = ppm.fit(docs.where("false"))
    assert {r["p"]["lang_pred"] for r in make_docs(texts).select(ppm.predict(F.col("text"), nothing).alias("p")).collect()} == {"und"}
    assert make_docs(texts).where("false").select(ppm.predict(F.col("text"), model)).count() == 0


def test_sample_is_bounded_and_holds_no_copies(make_docs):
    docs = make_docs([f"text number {i % 300} of many words" for i in range(3_000)] + ["long " * 5_000, None])
    got = ppm.sample(docs, sample_bytes=4_000)["en"]
    assert 0 < sum(len(t) + 16 for t in got) <= 4_000 and len(set(got)) == len(got)
    assert len(ppm.sample(docs)["en"]) == 301
    assert ppm.sample(docs.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_held_out_accuracy(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    held_out = F.pmod(id_crc(), F.lit(4)) == 2
    model = ppm.fit(docs.where(~held_out))
    guess = docs.where(held_out).select("lang", ppm.predict(F.col("text"), model).alias("p"))
    right = guess.agg(F.avg((F.col("lang") == F.col("p.lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97
