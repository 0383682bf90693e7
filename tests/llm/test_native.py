"""Chat formatting, line rules and decontamination against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskframe.llm import chat, decontam, linerules, text

TURNS = "conv_id long, turn long, role string, text string, transcript string, e string"


def turns(llm, rows):
    return llm.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def expected(rows):
    rows = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(whole), len(loss), sha(loss)


CONTROL = r"</s> <s> [INST] [/INST] \[INST] <\\/s> [\/INST] </s <</s>> [[INST]] \ <\s>"


@pytest.mark.parametrize("rows", [
    [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")],
    [(1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL), (1, 2, "assistant", CONTROL + "<")],
    [(1, 1, "assistant", None), (1, None, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", "same"), (1, 1, "assistant", "same")],
    [(None, 0, "[INST]", "é\n😀"), (None, 1, "assistant", "ü" * 50_000)],
    [(1, 0, "system", "no reply")],
])
def test_chat_reads_back(llm, rows):
    got = chat.digest(chat.examples(chat.pack(turns(llm, rows)))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(rows)


def test_chat_examples_are_prefixes(llm):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")]
    got = chat.examples(chat.pack(turns(llm, rows))).orderBy("example").collect()
    assert [r.formatted[r.loss_start:r.loss_start + r.loss_chars] for r in got] == ["a1", "a2"]
    assert got[1].formatted.startswith(got[0].formatted)
    assert all(r.formatted.endswith("</s>") for r in got)


def test_chat_empty_table(llm):
    assert chat.digest(chat.examples(chat.pack(turns(llm, []).where("1 = 0")))).count() == 0


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    spots = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots))


TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c a b", "a a a a a a", "x y\nx y\n\nx y ", "é # * ü | <b>",
    "The cat sat on the mat. " * 40, " ".join(f"word{i}" for i in range(30_000)) + ".",
    "\n".join(["Home | About | Login"] * 3 + [" ".join(f"good{i}{k}" for k in range(30)) + "." for i in range(8)]),
    "\n".join(" ".join(f"good{i}{k}" for k in range(30)) + "." for i in range(8)),
]


def test_line_rules_measures(make_docs):
    texts = TEXTS + TEXTS[4:6]
    got = {r.id: r for r in linerules.measure(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t)
        n, _, _, _, rep = measures(t)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)
    assert not got[0].kept and got[11].kept


def test_line_rules_cleaning(make_docs):
    docs = make_docs(TEXTS)
    got = {r.doc_id: r for r in linerules.clean_documents(docs).collect()}
    assert linerules.clean_documents(docs).columns == docs.columns
    assert got[10].text == TEXTS[11] and got[10].n_chars == len(TEXTS[11])
    assert got[11].text == TEXTS[11] and got[11].kept == "y"
    assert 0 not in got and 3 not in got
    assert linerules.clean_documents(docs.where("1 = 0")).count() == 0


def test_line_rules_reject_what_loses_too_much(make_docs):
    good = " ".join(f"good{k}" for k in range(60)) + "."
    menu = "\n".join(f"Menu{k} | Item{k} | More{k} | Else{k} | Next{k}" for k in range(40))
    got = {r.id: r.kept for r in linerules.measure(make_docs([good, good + "\n" + menu])).collect()}
    assert got == {0: True, 1: False}


def shingles(text, n=5):
    w = (text or "").lower().split()
    n = min(n, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(docs, items, width=5):
    out = set()
    for d, text in docs:
        for i, item in items:
            s = shingles(item)
            if not s:
                continue
            n = len(next(iter(s)))
            w = (text or "").lower().split()
            have = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
            if 10 * len(s & have) >= 8 * len(s):
                out.add((d, i, len(s), len(s & have)))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_leaks_match_brute_force(llm, make_docs, limit):
    word = lambda k: " ".join(f"w{k}_{i}" for i in range(20))
    items = [(i, word(i)) for i in range(6)] + [(6, None), (7, ""), (8, "two words"), (9, word(0)), (10, "Short"), (11, "a a a a a a a a a")]
    long = " ".join(f"z{i}" for i in range(20_000))
    texts = [
        None, "", word(0), long + " " + word(1).upper() + " " + long, word(2).replace("w2_0 ", "gone "),
        word(3).replace("w3_10 ", "gone "), " ".join(word(4).split()[:18]), "has two words inside", "short", "a a a a a a", word(0), long,
    ]
    ids = list(range(len(texts)))
    frame = llm.createDataFrame([(*x, "c") for x in items], "item_id long, text string, need string")
    got = decontam.leaks(make_docs(texts, ids), frame, broadcast_rows=limit).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got} == brute(zip(ids, texts), items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_drop_leaks(llm, make_docs):
    item = " ".join(f"q{i}" for i in range(12))
    docs = make_docs(["clean text", "x " + item, None, "x " + item], [1, None, 3, 4])
    items = llm.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert decontam.drop_leaks(docs, items.where("1 = 0")).count() == 4
    assert decontam.drop_leaks(docs.where("1 = 0"), items).count() == 0
    assert decontam.leaks(docs, items).agg(F.max("containment")).first()[0] == 1.0


def test_drop_leaks_by_row(llm, make_docs):
    """Repeated and null ids: only the rows that leak go."""
    item = "one two three four five six seven eight nine ten"
    items = llm.createDataFrame([(1, item)], "item_id long, text string")
    texts = [f"before {item} after", "clean text", f"x {item}", "clean too", "clean", None, ""]
    docs = make_docs(texts, [1, 1, None, None, None, 2, 2])
    kept = [r["text"] for r in decontam.drop_leaks(docs, items).collect()]
    assert sorted(kept, key=str) == sorted(["clean text", "clean too", "clean", None, ""], key=str)
    assert decontam.drop_leaks(docs, items).columns == docs.columns


def test_select_rows_by_bitmap(llm, tmp_path, monkeypatch):
    llm.range(100_000).selectExpr("id", "id AS _row", "id AS _bits").repartition(3).write.parquet(str(tmp_path / "t"))
    docs = llm.read.parquet(str(tmp_path / "t"))
    for limit in (text.BITMAP_BYTES, 0):
        monkeypatch.setattr(text, "BITMAP_BYTES", limit)
        rows = text.with_rows(docs, scanned=True)
        row = rows.columns[-1]
        keys = rows.where("id % 7 = 3").select(rows[row].alias("row"))
        for keep in (True, False):
            got = text.select_rows(rows, keys, keep)
            assert got.columns == rows.columns
            assert got.agg({"id": "sum"}).first()[0] == sum(i for i in range(100_000) if (i % 7 == 3) == keep)
    assert text.with_rows(llm.range(5), scanned=True).columns == ["id", "_row"]


def test_boilerplate_needs_a_whole_phrase(llm):
    spared = ["She baked a cookie and went to bed.", "JavaScript was made in ten days.", "They subscribe to a theory of time.",
              "Copyright law has a long history.", "The vineyards sign treaties every year.", "We log incoming calls."]
    failing = ["This site uses cookies.", "Please enable JavaScript.", "Copyright 2024 the authors.", "Copyright (c) 2024.",
               "Read our privacy policy.", "Sign up for our letter.", "Click here.", "Subscribe to our letter."]
    df = llm.createDataFrame([(x,) for x in spared + failing], "line string")
    got = {r[0]: r[1] for r in df.select("line", linerules.line_passes(F.col("line"))).collect()}
    assert got == {**dict.fromkeys(spared, True), **dict.fromkeys(failing, False)}
