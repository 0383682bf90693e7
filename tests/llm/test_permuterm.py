"""Spelling variants against all pairs."""

from collections import Counter
import re
import zlib

from hypothesis import given, settings, strategies as st

from riskframe.llm import permuterm


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def plain_groups(words):
    out, form = [], {}
    around = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), words.get(form[w])))
    return sorted(out, key=str)


def grouped(df):
    return sorted([tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()], key=str)


def test_documents(make_docs):
    base = "Orantion ORANTION orantion orantiin thanedble thanedbles thanedbel Éanmentée éanmentée naïveté÷× "
    texts = [base * 12, base + "orantiin orantiin", None, "", "short words only", base * 30, "orantion" * 3, base * 30]
    texts += [f"orantion {'x' * 9} " * 40 for _ in range(60)] + ["xy" * 20_000 + " orantionn orantionn"] * 2
    texts += ["xy" * 20_000 + "z" + " orantionn"] * 20
    ids = [*range(len(texts) - 2), None, 5]
    got = grouped(permuterm.variants(make_docs(texts, ids)))
    assert got == plain_groups(plain_words(list(zip(ids, texts))))
    assert any(r[1] for r in got)


@given(st.dictionaries(st.text("aab", min_size=7, max_size=9), st.sampled_from([2, 20, 200, 201, 5000, 60_000]), min_size=1, max_size=40))
@settings(max_examples=6, deadline=None)
def test_small_alphabets_ties_and_chains(llm, words):
    df = llm.createDataFrame(list(words.items()), "word string, n long")
    assert grouped(permuterm.groups(df)) == plain_groups(words)


@given(st.dictionaries(st.text("aaé", min_size=7, max_size=10), st.sampled_from([2, 20, 200, 5000]), min_size=5, max_size=40),
       st.sampled_from([7, 8, 9]))
@settings(max_examples=6, deadline=None)
def test_long_words_as_digests(llm, words, longer_than):
    df = llm.createDataFrame(list(words.items()), "word string, n long")
    assert grouped(permuterm.groups(df, longer_than=longer_than)) == plain_groups(words)


def test_chain_of_forms(llm):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2_000, "abcdefghijk": 20_000, "zzzzzzzz": 5}
    got = {r[0]: r[2] for r in grouped(permuterm.groups(llm.createDataFrame(list(words.items()), "word string, n long")))}
    assert got == {w: "zzzzzzzz" if w[0] == "z" else "abcdefghijk" for w in words}


def test_a_hot_word_and_no_rows(llm, make_docs):
    # Every letter in one place: one range with all of them.
    words = {"orant" + chr(c) + "on": 2 + c % 3 for c in [*range(97, 123), *range(0xdf, 0x100)]} | {"oranton": 90}
    df = llm.createDataFrame(list(words.items()), "word string, n long")
    assert grouped(permuterm.groups(df)) == plain_groups(words)
    assert permuterm.variants(make_docs(["x"]).where("false")).count() == 0
    assert permuterm.variants(make_docs([None, ""])).count() == 0
