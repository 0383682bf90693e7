"""The wide SimHash search: links against brute force, hot shards, odd rows."""

import random

import pytest

from riskframe.llm import resemblance, simhash


def _bits(a, b):
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def _brute(sketches, radius):
    """Component of each position: links between all pairs."""
    up = list(range(len(sketches)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sketches)):
        for j in range(i):
            if _bits(sketches[i], sketches[j]) <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sketches))]


def _edited(rng, words, share):
    """Copy in which a run of ``share`` of the words is new."""
    n = int(len(words) * share)
    at = rng.randrange(len(words) - n + 1)
    return words[:at] + [f"new{rng.random()}" for _ in range(n)] + words[at + n:]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([200, 400, 700]))] for _ in range(25)]
    made = [w for w in base for _ in range(2)]
    made += [_edited(rng, w, share) for w in base[:15] for share in (0.02, 0.06, 0.6)]
    made += [_edited(rng, base[20], 0.04) for _ in range(60)]
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("shard_rows", [2_048, 7])
def test_groups_match_brute_force(make_docs, texts, shard_rows):
    found = resemblance.groups(make_docs(texts), shard_rows=shard_rows).collect()
    got = {r.doc_id: r.component_id for r in found}
    want = _brute([resemblance.sketch_of(resemblance.shingles_of(t))[0] for t in texts], resemblance.RADIUS)
    assert len(found) == len(texts)
    assert got == dict(enumerate(want))
    # Copies and small edits join, mostly new texts and other texts do not.
    assert all(got[2 * k] == got[2 * k + 1] for k in range(25))
    assert all(got[50 + 3 * k] == got[51 + 3 * k] == got[2 * k] != got[52 + 3 * k] for k in range(15))
    assert {got[i] for i in range(95, 155)} == {40}


def test_cell_links_span_the_components():
    rng = random.Random(5)
    start = [rng.getrandbits(512) for _ in range(6)]
    near = [x ^ sum(1 << b for b in rng.sample(range(512), rng.choice([10, 40, 60]))) for x in start for _ in range(30)]
    values = [v.to_bytes(64, "little") for v in dict.fromkeys(near)]
    import numpy as np

    every = np.ones(len(values), dtype=bool)
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in resemblance.cell_links(values, every, every, 88):
        assert _bits(a, b) <= 88 and root(a) != root(b)
        up[root(a)] = root(b)
    want = _brute(values, 88)
    assert len({(w, root(v)) for v, w in zip(values, want)}) == len(set(want)) == len({root(v) for v in values})


def test_odd_rows(make_docs, llm):
    long = " ".join(f"x{i}" for i in range(30_000))
    docs = make_docs([None, "", " \n", "one", "ONE", "one two", long, long, long], [5, 6, None, 1, 2, 3, 9, 8, None])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in resemblance.groups(docs).collect())
    assert got == [
        (False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 5, 5), (False, 6, 5), (False, 8, 8), (False, 9, 8),
        (True, 0, 5), (True, 0, 8),
    ]
    kept = resemblance.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 8]
    assert resemblance.groups(docs.where("1 = 0")).count() == 0


def test_memory_blocks_agree():
    text = " ".join(f"x{i}" for i in range(3_000))
    shingles = resemblance.shingles_of(text)
    bits = [0] * resemblance.BITS
    for h in shingles.tolist():
        for lane, salt in enumerate(resemblance._SALTS.tolist()):
            x = h ^ salt
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
            x ^= x >> 31
            for b in range(64):
                bits[64 * lane + b] += x >> b & 1
    want = sum((2 * v > len(shingles)) << k for k, v in enumerate(bits))
    assert int.from_bytes(resemblance.sketch_of(shingles)[0], "little") == want


def test_links_are_exact_at_the_threshold(make_docs):
    """Pairs at exactly 0.8 link and pairs just below do not, whatever their sketches say."""
    rng = random.Random(8)

    def pair(n, cut):
        """n shingles in common of n + 2 * cut: the tails differ."""
        common = [f"w{rng.random()}" for _ in range(n + 4)]
        return [" ".join(common + [f"t{rng.random()}" for _ in range(cut)]) for _ in range(2)]

    made = [pair(80, 10) for _ in range(150)] + [pair(79, 10) for _ in range(150)]
    texts = [t for p in made for t in p]
    sets = [set(resemblance.shingles_of(t).tolist()) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert alike[:150] == [0.8] * 150 and max(alike[150:]) < 0.8
    got = {r.doc_id: r.component_id for r in resemblance.groups(make_docs(texts)).collect()}
    assert [got[2 * k] == got[2 * k + 1] for k in range(300)] == [True] * 150 + [False] * 150


@pytest.mark.parametrize("search", [resemblance, simhash])
def test_null_and_repeated_ids_lose_no_text(make_docs, search):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    kept = search.keep_first(make_docs([a, b, a, c, d, d, a, b], [5, 5, 1, None, None, None, None, 5]))
    assert sorted((r.text[0], r.doc_id or 0) for r in kept.collect()) == [("a", 1), ("b", 5), ("c", 0), ("d", 0)]
