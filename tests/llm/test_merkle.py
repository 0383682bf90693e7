"""Merkle manifest and multiproofs against a plain tree."""

from hashlib import sha256
import zlib

from hypothesis import given, settings, strategies as st
import pytest
from pyspark.sql import functions as F

from riskframe.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_leaf(row):
    return H(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS])


def plain_audit(rows):
    """Rows as dicts to (doc_id, leaf, subroot, root, proof, folded root, verified), sorted."""
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        by[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = [plain_levels([plain_leaf(r) for r in by[g]]) for g in names]
    top = plain_levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(by[g]):
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                changed["n_chars"] += 1
            h, proof = plain_leaf(changed), []
            for at, levels in ((i, trees[k]), (k, top)):
                for nodes in levels[:-1]:
                    other = nodes[at ^ 1] if at ^ 1 < len(nodes) else None
                    if other is not None:
                        proof.append(other)
                    h = H(h) if other is None else H(other, h) if at & 1 else H(h, other)
                    at >>= 1
            out.append((r["doc_id"], plain_leaf(r), trees[k][-1][0], top[-1][0], H(*proof), h, h == top[-1][0]))
    return sorted(out, key=str)


def audited(docs, **options):
    return sorted([tuple(r) for r in merkle.audit(docs, merkle.tampered(), **options).collect()], key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, idx string, hash string, id string, n string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(3)


def as_dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]


@given(st.integers(1, 70), st.data())
@settings(max_examples=60, deadline=None)
def test_octopus_is_the_least_set_that_proves(n, data):
    leaves = data.draw(st.sets(st.integers(0, n - 1), min_size=1))
    levels = plain_levels([H(str(i)) for i in range(n)])
    wanted = merkle.octopus(leaves, n)
    nodes = {(level, i): levels[level][i] for level, i in wanted}
    *_, top = [{0: levels[0][0]}, *merkle.grow({i: levels[0][i] for i in leaves}, n, 0, merkle.height(n), dict(nodes))]
    assert top == {0: levels[-1][0]}
    # Without any one of them the root cannot be derived.
    for gone in wanted:
        with pytest.raises(KeyError):
            list(merkle.grow({i: levels[0][i] for i in leaves}, n, 0, merkle.height(n),
                             {c: h for c, h in nodes.items() if c != gone}))


def test_same_as_plain_trees_with_odd_rows(llm):
    rows = [(i, f"text {i}", ("en", "de", None, "ü")[i * i % 4] if i % 5 else "en", "s", i) for i in range(90)]
    rows += [(None, None, None, None, None), (None, "", "en", "s", 1), (7, "text", "solo", "s", None)]
    rows += [(3, "other", "en", "s", 2), (11, "x" * 200_000, "en", None, 200_000), (-4, "ü\x00é", "", "s", 3)]
    rows += [(500, "same", "en", "s", 4)] * 3 + [(None, "same", "en", "s", 4)] * 2
    want = plain_audit(as_dicts(rows))
    docs = docs_of(llm, rows)
    # Small partitions, so several layers are stored and salted requests are joined.
    assert audited(docs, block_levels=2, salt_levels=0) == want
    assert audited(docs) == want
    assert {r[6] for r in want} == {True, False}


def test_one_row_and_no_rows(llm):
    one = [(7, "text", "en", "s", 4)]
    assert audited(docs_of(llm, one)) == plain_audit(as_dicts(one))
    none = merkle.audit(docs_of(llm, one).where("false"), merkle.tampered())
    assert none.count() == 0 and none.columns == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_many_groups_and_other_partitioning(llm):
    rows = [(i, f"t{i}", f"l{i % 37}", "s", i) for i in range(150)]
    want = plain_audit(as_dicts(rows))
    assert audited(docs_of(llm, rows).repartition(7), block_levels=2) == want


def test_text_ids(llm):
    docs = llm.createDataFrame([("b", "x", "en", "s", 1), ("a", "y", "en", "s", 1)], "doc_id string, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in merkle.audit(docs, F.lit(None).cast("string")).collect()}
    a, b = (merkle.join_hash(f"1:{i}1:s2:en1:11:{t}") for i, t in (("a", "y"), ("b", "x")))
    assert got["a"]["root"] == H(a, b) and got["b"]["proof_sha256"] == H(a) and got["a"]["verified"]
