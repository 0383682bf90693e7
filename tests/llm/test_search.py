"""Ranking, SimHash, components, ring, language model and lattice against brute force."""

from collections import Counter
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import xxhash

from riskframe.llm import components, deleted_lm, lattice, ranking, ring, simhash


def test_ranking_learns_the_order(llm, make_docs):
    good = [f"This is sentence number {i}, which has some plain words in it. It goes on a little." for i in range(60)]
    bad = [("BUY%%% NOW### " * (3 + i % 5)).strip() for i in range(20)]
    docs = make_docs([*good, *bad, None, "", "x " * 20_000, good[0]])
    labels = llm.createDataFrame(
        [(i, int(i < 60), 0, "t") for i in range(80)] + [(0, 1, 0, "t"), (None, 1, 0, "t"), (5, None, 0, "t")],
        "doc_id long, quality int, toxic int, text string",
    )
    model = ranking.fit(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", ranking.score(F.col("text"), model).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 84
    assert all(got[i] >= ranking.CUT for i in range(60)) and all(got[i] < ranking.CUT for i in range(60, 80))
    assert got[80] == got[81] and got[0] == got[83]
    one = ranking.fit(docs, labels.where("quality = 1"))
    assert set(docs.select(ranking.score(F.col("text"), one)).distinct().toPandas().iloc[:, 0]) == {ranking.CUT}
    assert docs.where("1 = 0").select(ranking.score(F.col("text"), model)).count() == 0
    assert ranking.fit(docs, labels.where("1 = 0")).weights == one.weights


def test_pair_fit_has_no_gradient_left():
    rng = np.random.default_rng(1)
    diff = rng.normal(size=(500, 4)) + 0.3
    w = ranking.fit_pairs(diff)
    p = 1 / (1 + np.exp(diff @ w))
    assert np.abs(1e-3 * w - diff.T @ p / len(diff)).max() < 1e-8


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    votes = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(s))


def roots(ids, prints, radius):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[a] = b
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("shard_rows", [8192, 2])
def test_simhash_groups(make_docs, shard_rows):
    base = [f"t{k}w{i}" for k in range(8) for i in range(120)]
    texts = [None, "", " \n", "One", "one", "ONE two", "one two three"]
    for k in range(8):
        words = base[120 * k:120 * (k + 1)]
        for change in range(4):
            texts.append(" ".join(words[:100 - change] + ["x"] * (change > 2) + words[100:]))
        texts.append(" ".join(words))
    ids = [(7 * i) % len(texts) for i in range(len(texts))]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.groups(make_docs(texts, ids), shard_rows=shard_rows).collect()}
    prints = [fingerprint(t) for t in texts]
    assert got == dict(zip(ids, zip(prints, roots(ids, prints, 3))))


def test_simhash_dense_group(llm):
    rng = np.random.default_rng(3)
    center = int(rng.integers(1 << 62))
    prints = [center]
    for _ in range(700):
        x = center
        for b in rng.integers(0, 64, size=rng.integers(1, 9)):
            x ^= 1 << int(b)
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = llm.createDataFrame([(p,) for p in signed], "fp long")
    for rows in (8192, 100):
        found = components.components(simhash.links(df, shard_rows=rows)).collect()
        got = {}
        for r in found:
            got.setdefault(r.root, set()).add(r.node)
        want = {}
        for p, c in zip(signed, roots(list(range(len(prints))), prints, 3)):
            want.setdefault(c, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_keep_first(make_docs):
    docs = make_docs(["same text here now"] * 3 + ["other words stand in this one", None, ""], [5, 3, 3, 9, 7, 8])
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [3, 7, 9]
    assert simhash.keep_first(docs).columns == docs.columns
    assert simhash.groups(docs.where("1 = 0")).count() == 0
    nulls = make_docs(["same text here now"] * 2 + ["one thing that is alone"], [None, 4, None])
    assert simhash.groups(nulls).count() == 3


def test_components_of_a_path_and_a_star(llm):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1000, 1000), (None, 5)]
    got = components.components(llm.createDataFrame(path + star, "a long, b long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.root, []).append(r.node)
    assert sorted(map(sorted, by.values())) == [list(range(301)), list(range(1000, 1300))]
    assert components.components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_ring_rows_law(make_docs):
    texts = [None, "", "é"] + [f"text {i}" for i in range(200)] + ["same"] * 150
    ids = [None, 0, 1, *range(2, 202), *[77] * 150]
    got = ring.place_rows(make_docs(texts, ids), 7, vnodes=16).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == 353 and set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert {r.size for r in got if r.doc_id in (None, 0)} == {16} and {r.size for r in got if r.doc_id == 1} >= {18}
    assert ring.place_rows(make_docs([]).where("1 = 0"), 7, vnodes=16).count() == 0


def test_ring_moves_only_overflow():
    places, owners = ring.ring(5, 8)
    counts = {p: 10 for p in range(0, ring.POSITIONS, 500)}
    parts = ring.assign(counts, 5, 8)
    assert sum(b - a for _, a, b, _, _ in parts) == sum(counts.values())
    load = Counter()
    for _, a, b, s, _ in parts:
        load[s] += b - a
    assert [load[s] for s in range(5)] == ring.capacities(sum(counts.values()), 5)
    # A shard that takes rows from elsewhere has placed all its home rows.
    import bisect
    home = {p: owners[bisect.bisect_left(places, p) % len(places)] for p in counts}
    at_home = Counter()
    for p, a, b, s, _ in parts:
        at_home[home[p]] += (b - a) * (s == home[p])
    wanted = Counter()
    for p, n in counts.items():
        wanted[home[p]] += n
    caps = ring.capacities(sum(counts.values()), 5)
    assert all(at_home[s] == min(wanted[s], caps[s]) for s in range(5))


def lm_brute(rows, weights_of):
    """Counts and scores word by word."""
    border = "\n"
    def toks(t):
        return (t or "").encode().lower().split() + [border]
    uni, pair = Counter(), Counter()
    for _, t, train in rows:
        if train:
            w = toks(t)
            uni.update(w)
            pair.update(zip([border, *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t, _ in rows:
        w = toks(t)
        base = score = 0.0
        for h, x in zip([border, *w[:-1]], w):
            base += math.log10((uni[x] + 1) / (n + v + 1))
            b = 0 if not uni[h] else min(deleted_lm.BUCKETS - 1, 1 + int(math.log2(uni[h])))
            a, c, u = weights_of[b]
            score += math.log10(a * (pair[h, x] / uni[h] if uni[h] else 0) + c * uni[x] / max(n, 1) + u / (v + 1))
        out.append((i, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1_500_000, 40])
def test_language_model(make_docs, monkeypatch, block):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"W{int(x)}" for x in rng.geometric(0.15, size=rng.integers(0, 60))) for _ in range(60)]
    texts += [None, "", "Ä ä", texts[3], texts[3], "long " * 3000]
    ids = list(range(len(texts)))
    ids[-1] = None
    seen = {}
    real = deleted_lm.model
    monkeypatch.setattr(deleted_lm, "BLOCK_TOKENS", block)

    def spy(*a):
        seen["mix"] = real(*a)
        return seen["mix"]

    monkeypatch.setattr(deleted_lm, "model", spy)
    docs = make_docs(texts, ids).coalesce(1)
    got = sorted(
        ((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
         for r in deleted_lm.score(docs, F.col("doc_id") % 4 != 0, em_share=3).collect()), key=str)
    rows = [(i, t, i is not None and i % 4 != 0) for i, t in zip(ids, texts)]
    want = lm_brute(rows, seen["mix"].weights)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)
    assert all(abs(sum(w) - 1) < 1e-9 and w[2] > 0 for w in seen["mix"].weights)


def test_language_model_without_training(make_docs):
    got = deleted_lm.score(make_docs(["a b", None]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0), (1, 0, 0)]
    assert all(math.isfinite(r.score) and r.base_score == 0 for r in got)
    assert deleted_lm.score(make_docs(["a"]).where("1 = 0"), F.lit(True)).count() == 0


def test_em_finds_the_mixture():
    rng = np.random.default_rng(2)
    p = rng.random((4000, 2))
    # Events drawn so that the pair estimate explains 70 % of them.
    which = rng.random(4000) < 0.7
    rows = np.column_stack([np.ones(4000), np.where(which, 0.9, 0.01), np.where(which, 0.01, 0.9), np.ones(4000)])
    w = deleted_lm.em(rows, 1e-6)[1]
    assert abs(w[0] - 0.7) < 0.03 and abs(w[1] - 0.3) < 0.03 and len(p)


def all_paths(lat, marked):
    out = []

    def go(end, score, ids, lengths):
        if end == 0:
            out.append((-score, lengths, ids))
        else:
            for n, own, s in lat.arcs(marked, end):
                go(end - n, score + s, own + ids, (*lengths, -n))

    go(len(marked), 0.0, (), ())
    return sorted(out)


@pytest.mark.parametrize("text", ["hello wor", "a b cd", "the é x", "x", "  two", "ab\ncd e", "a▁b", "日本 x", "﷐ a"])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_lattice_matches_all_segmentations(text, n):
    lat = lattice.Lattice.load(lattice.MODEL)
    marked = lattice.MARK + text.replace(lattice.MARK, lattice._OWN_MARK).replace(" ", lattice.MARK)
    want = all_paths(lat, marked)[:n]
    got = lat.encode(text, n)
    assert [-w[0] for w in want] == [g[0] for g in got] == [s[0] for s in lat.search(marked, n)]
    assert tuple(got[0][1].tolist()) == want[0][2] == lat.search(marked, n)[0][1]
    assert len({tuple(g[1].tolist()) for g in got}) == len(got)
    assert all(lat.decode(g[1].tolist()) == text for g in got)


def test_lattice_operator(make_docs):
    texts = [None, "", " ", "hello world", "é\n\n😀 \t tab", "x" * 5000, "word " * 20_000, "hello world"]
    docs = make_docs(texts)
    out = lattice.encode(docs, all_ids=True)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 8 and all(r.round_trip for r in got.values())
    assert got[0].ids == [] and got[0].scores == [0.0] and got[3].ids == got[7].ids == got[3].nbest[0]
    assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in got.values())
    back = {r.doc_id: r.text for r in lattice.decode(out).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert lattice.encode(docs.where("1 = 0")).count() == 0


@pytest.mark.parametrize("letters", ["日本語の文章です中国人民", "QWxhZGRpbjpvcGVuIHNlc2FtZQ", "a"])
def test_lattice_takes_texts_without_spaces(letters):
    import random
    import tracemalloc

    lat = lattice.Lattice.load(lattice.MODEL)
    rng = random.Random(4)
    tracemalloc.start()
    lat.search("".join(rng.choices(letters, k=8_000)), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    text = "".join(rng.choices(letters, k=100_000))
    got = lat.encode(text, 4)
    # The first has no piece of several characters, hence one segmentation.
    assert len({g[1].tobytes() for g in got}) == len(got) == (1 if "日" in letters else 4)
    assert [g[0] for g in got] == sorted((g[0] for g in got), reverse=True)
    assert all(lat.decode(g[1].tolist()) == text for g in got)


def test_rank_cut_covers_labels_outside_the_sample(make_docs, llm):
    import random

    rng = random.Random(6)
    y = [int(rng.random() < 0.6) for _ in range(400)]
    texts = [" ".join(rng.choice(["word", "Word,", "x#", "9", "text."][rng.randrange(2) * (1 - v):]) for _ in range(rng.randrange(5, 60))) for v in y]
    labels = llm.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    model = ranking.fit(make_docs(texts), labels, per_class=15)
    s = np.sort(model.margins(np.array([ranking.features(t) for t in texts])))
    n = y.count(0)
    assert abs(model.cut - (s[n - 1] + s[n]) / 2) < 1e-9


def test_the_digest_covers_the_ids_of_every_segmentation(spark):
    docs = spark.createDataFrame([(1, "some words to cut"), (2, ""), (3, None), (4, "naïve façade")], "doc_id long, text string")
    out = lattice.encode(docs, all_ids=True)
    model = lattice.Lattice.load(lattice.MODEL)
    for r in out.join(docs, "doc_id").collect():
        assert r["nbest"] == [i.tolist() for _, i in model.encode(r["text"], lattice.N_BEST)]
    one = lattice.digest(out).orderBy("doc_id").collect()
    other = lattice.digest(out.withColumn("nbest", F.slice("nbest", 1, 1))).orderBy("doc_id").collect()
    assert [a["nbest_hash"] != b["nbest_hash"] for a, b in zip(one, other)] == [True, False, False, True]


def test_words_are_learned_with_one_search_for_each_end(monkeypatch):
    lat = lattice.Lattice.load(lattice.MODEL)
    words = [lattice.MARK + w for w in ("internation", "segmentatio", "recommended", "differences", "information", "xqzjvkwypql",
                                        "aaaaaaaaaaa", "abcabcabcab", "streamlined")]
    find, calls = lattice.Lattice.find, []
    monkeypatch.setattr(lattice.Lattice, "find", lambda self, keys: (calls.append(1), find(self, keys))[1])
    got = lat.learn(words)
    assert len(calls) <= len(words[0])
    for w in words:
        ids, score, loss = lat.quick(w)
        assert np.frombuffer(got[w][0], np.int32).tolist() == list(ids)
        assert got[w][1:] == pytest.approx((score, loss))
    parts = list(lattice._slices(pa.array(["a", None, "b" * lattice.SLICE_CHARS, "c"])))
    assert parts == [(0, ["a", ""]), (2, ["b" * lattice.SLICE_CHARS]), (3, ["c"])]
