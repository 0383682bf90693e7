"""Main-text extraction and archives."""

import base64
import hashlib
import random

import time

import pytest

from riskframe.llm import lineblock, warc

ARTICLE = "<h1>Head &amp; line</h1><p>First  para<b>graph</b>\n here.<p>Second&nbsp;one<br>after."
WANT = "Head & line First paragraph here. Second one after."


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p></p>", ""),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>a<li>b</ul></nav><div class='ad'>Buy this now</div>"
     f"<article>{ARTICLE}</article><footer>&copy; x</footer></body></html>", WANT),
    (f"<header>Top</header><main>{ARTICLE}<script>var a='</p>';</script><aside>Side</aside></main><div id=comments><p>Nice!</div>", WANT),
    (f"<div class='cookie-notice'>We use cookies</div><form><label>Name</label></form><article>{ARTICLE}<div class='comments'><p>me too</p></div></article>", WANT),
    ("<article><p>x &lt;b&gt; y</p></article>", "x <b> y"),
    ("<div><a href='a>b'>link</a></div><p>" + "long text " * 30 + "</p>", None),
])
def test_main_text(html, want):
    got = lineblock.main_text(html)
    if want is None:
        assert got.endswith("long text") and ">" not in got
    else:
        assert got == want


def test_main_text_by_distribution_alone():
    body = "".join(f"<div>{'real sentence words here ' * 12}{i}</div>" for i in range(5))
    html = "<div>Home</div><div>Shop</div><div>x</div><div>y</div>" + body + "<div>a</div><div>b</div><div>c</div><div>d</div>"
    got = lineblock.main_text(html)
    assert all(f"here {i}" in got for i in range(5)) and not got.startswith("Home")


def test_markup_does_not_replace_the_distribution():
    para = "<p>" + "Sentence of the article with many words. " * 6 + "</p>"
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Other story {i}</a></li>" for i in range(6)) + "</ul>"
    got = lineblock.main_text(f"<article><h1>Title</h1>{para}{links}{para}<p>See <a href='/x'>this</a>.</p></article>")
    assert got.startswith("Title Sentence") and got.endswith("See this.") and "Other story" not in got
    # A teaser card is not the page's text.
    got = lineblock.main_text(f"<article><h2>Teaser</h2><p>Short card.</p></article><div>{para * 4}</div>")
    assert got.count("Sentence of the article") == 24
    # A whole main element wins over unmarked text around it.
    got = lineblock.main_text(f"<div>{para}</div><main>{para * 3}</main>")
    assert got.count("Sentence of the article") == 18


@pytest.mark.parametrize("gap", ["<div class='ad'><p>Buy</p><p>this</p><p>now</p><p>cheap</p></div>", ""])
def test_one_long_paragraph_does_not_hide_the_rest(gap):
    later = [f"Later paragraph number {i} with a few plain words in it." for i in range(4)]
    html = f"<p>{'A long paragraph goes on. ' * 160}</p>{gap}" + "".join(f"<p>{x}</p>" for x in later)
    links = "".join(f"<div>{x}</div>" for x in ("Home", "Terms", "Press", "Jobs"))
    got = lineblock.main_text(html + links)
    assert got.endswith(" ".join(later)) and "Buy" not in got
    linked = "".join(f"<div><a href=/{i}>Linked page number {i} of this site</a></div>" for i in range(4))
    assert lineblock.main_text(html + linked).endswith(later[-1])


def test_extract_table(llm):
    pages = llm.createDataFrame(
        [(1, "u", "<p>a" + "é" * 100_000, "t"), (1, "u", None, "t"), (None, None, "<article>x</article>", "t")],
        "page_id long, url string, html string, text string")
    got = sorted((r.n_chars, len(r.text)) for r in lineblock.extract(pages).collect())
    assert got == [(0, 0), (1, 1), (100_001, 100_001)]
    assert lineblock.extract(pages.where("1 = 0")).count() == 0


def pages(llm):
    big = "<p>" + "same payload " * 20
    rows = [(1, "http://a/é ?x=1\r\nX: y", big), (2, None, big), (0, "http://b", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None),
            (6, "u", "long " * 200_000), (7, "u", "WARC/1.1\r\n\x1f fake" * 20), (None, "u", "no id " * 30)]
    return llm.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, kind string"), rows


def test_archives_round_trip(llm):
    df, rows = pages(llm)
    records = warc.read_archives(warc.write_archives(df))
    assert {r.page_id: r.url for r in records.collect()} == {r[0]: r[1] for r in rows}
    got = {r.page_id: r for r in warc.resolve(records).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {
        1: ("revisit", 0), 2: ("revisit", 0)}
    empty = warc.read_archives(warc.write_archives(df.where("1 = 0")))
    assert warc.resolve(empty).count() == 0


def archive(n=6, compress=True):
    parts = []
    for i in range(n):
        payload = f"page {i} ".encode() * 50
        raw = warc.record(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), f"<urn:uuid:{i}>", None)
        parts.append(warc.member(raw) if compress else raw)
    return parts


def salvage(raw):
    found = list(warc.salvage(lambda o, n: raw[o:o + n], len(raw)))
    return [int(r["page-id"]) for _, r, _, _ in found if r], [(at, gap) for at, r, gap, _ in found if not r]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_undamaged(compress):
    assert salvage(b"".join(archive(compress=compress))) == (list(range(6)), [])


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_skips_damage(compress):
    parts = archive(compress=compress)
    flipped = bytearray(parts[2])
    flipped[len(flipped) // 2] ^= 0xFF
    raw = b"junk" + parts[0] + parts[1] + bytes(flipped) + parts[3][:-30] + parts[4] + b"\x00" * 9 + parts[5] + b"tail"
    ids, gaps = salvage(raw)
    assert ids == [0, 1, 4, 5]
    start = len(b"junk" + parts[0] + parts[1])
    assert gaps == [(0, 4), (start, len(parts[2]) + len(parts[3]) - 30),
                    (start + len(parts[2]) + len(parts[3]) - 30 + len(parts[4]), 9), (len(raw) - 4, 4)]


@pytest.mark.parametrize("digest,ids", [
    (lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode(), [0]),
    (lambda b: "SHA-256:" + hashlib.sha256(b).hexdigest().upper(), [0]),
    (lambda b: "blake3:abc", [0]), (lambda b: "sha1:" + "A" * 32, []), (lambda b: "md5:" + "0" * 32, []),
])
def test_salvage_checks_digests_by_their_algorithm(digest, ids):
    raw = archive(1, compress=False)[0]
    block = raw.split(b"\r\n\r\n", 1)[1][:-4]
    own = b"sha256:" + hashlib.sha256(block).hexdigest().encode()
    assert own in raw
    assert salvage(warc.member(raw.replace(b"Block-Digest: " + own, b"Block-Digest: " + digest(block).encode())))[0] == ids


def test_salvage_inside_a_member():
    rng = random.Random(2)
    parts = []
    for i in range(60):
        payload = rng.randbytes(3_000)
        parts.append(warc.record(i, "u", payload, hashlib.sha256(payload).hexdigest(), f"<urn:uuid:{i}>", None))
    bad = bytearray(b"".join(parts))
    at = len(b"".join(parts[:20])) + 2_000
    bad[at] ^= 0xFF
    # One bad record in a sound member.
    found = list(warc.salvage(lambda o, n: raw[o:o + n], len(raw := warc.member(bytes(bad)))))
    assert [int(r["page-id"]) for _, r, _, _ in found if r] == [i for i in range(60) if i != 20]
    assert [(gap, why) for _, r, gap, why in found if not r] == [(len(parts[20]), "digest differs")]
    # A flipped byte, a cut and a spoilt stretch of the compressed bytes, each before a sound member.
    whole, last = warc.member(b"".join(parts)), archive(100)[99]
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0xFF
    spoilt = bytearray(whole)
    spoilt[len(whole) // 2:len(whole) // 2 + 500] = b"\xff" * 500
    for damaged in (bytes(flipped), whole[:len(whole) // 2], bytes(spoilt)):
        ids, gaps = salvage(damaged + last)
        assert ids[:25] == list(range(25)) and ids[-1] == 99 and len(ids) == len(set(ids)) and gaps
    assert salvage(whole[:-3])[0] == list(range(60))


def test_salvage_mixed_and_lost(llm):
    a, b = archive(3), archive(3, compress=False)
    ids, gaps = salvage(a[0] + b[1] + a[2])
    assert ids == [0, 1, 2] and gaps == []
    assert salvage(b"\x1f\x8b\x08" * 100) == ([], [(0, 300)])
    assert salvage(b"") == ([], [])
    empty = warc.member(b"")
    assert salvage(a[0] + empty + a[1]) == ([0, 1], [(len(a[0]), len(empty))])


def test_salvage_of_written_archives(llm, tmp_path):
    df, rows = pages(llm)
    made = warc.write_archives(df.coalesce(1), f"file://{tmp_path}/w")
    path = made.where("records > 0").first().archive
    raw = bytearray(open(path.removeprefix("file://"), "rb").read())
    raw[5:40] = b"\x00" * 35
    open(path.removeprefix("file://"), "wb").write(raw)
    got = warc.read_archives(llm.createDataFrame([(path,)], "archive string")).collect()
    assert sum(r.kind == "gap" for r in got) == 1 and len(got) == made.agg({"records": "sum"}).first()[0]


def test_unclosed_scripts_are_no_text():
    assert lineblock.main_text(f"<article>{ARTICLE}</article><script>var a = 'one two three four';") == WANT
    assert lineblock.main_text(f"<article>{ARTICLE}<svg><text>Logo</text></svg></article>") == WANT
    assert lineblock.main_text(f"<article><object>{ARTICLE}</object>{ARTICLE}</article>") == WANT


@pytest.mark.parametrize("piece", ["<script>", "<a x='", "<a \"", "<![CDATA[", "<!x", "<select>", "<p ", "<div><span>", "<!--", "</div>"])
def test_hostile_markup_takes_linear_time(piece):
    page = piece * ((1 << 19) // len(piece))
    began = time.perf_counter()
    lineblock.main_text(page)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("compress", [True, False])
def test_long_urls_come_back(compress):
    raw = warc.record(7, "http://x.org/" + "a" * (2 << 20), b"body", "0" * 64, "<urn:x>", None)
    raw = (warc.member(raw) if compress else raw) + archive(compress=compress)[0]
    (_, first, _, _), (_, second, _, _) = warc.salvage(lambda o, n: raw[o:o + n], len(raw))
    assert len(first["warc-target-uri"]) == 13 + (2 << 20) and first["payload"] == b"body"
    assert second["page-id"] == "0"


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("length", ["\u00b2", "9" * 5000, "-1", ""])
def test_bad_lengths_are_gaps(compress, length):
    bad = warc.record(7, None, b"body", "0" * 64, "<urn:x>", None).split(b"Content-Length: ")
    bad = bad[0] + b"Content-Length: " + length.encode() + bad[1][bad[1].index(b"\r\n"):]
    bad = warc.member(bad) if compress else bad
    assert salvage(bad + archive(compress=compress)[1]) == ([1], [(0, len(bad))])


def test_page_numbers():
    assert [warc.page_number(x) for x in ("12", "-3", "x", "\u00b2", "", None, "9" * 19, "9" * 30)] == [
        12, -3, None, None, None, None, None, None]


def test_false_version_lines_cost_linear_time():
    raw = b"WARC/1.1\r\na: b\r\n" * 20_000
    began = time.perf_counter()
    assert salvage(raw) == ([], [(0, len(raw))])
    assert time.perf_counter() - began < 20


def test_long_urls_through_archives(llm):
    spark = llm if not isinstance(llm, tuple) else llm[0]
    pages = spark.createDataFrame([(1, "http://x.org/" + "a" * (2 << 20), "<p>one"), (2, "u", "<p>two")],
                                  "page_id long, url string, html string")
    back = warc.resolve(warc.read_archives(warc.write_archives(pages)))
    assert sorted(r["page_id"] for r in back.collect()) == [1, 2]
