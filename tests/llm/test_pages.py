"""Pages, vectors and the pipeline."""

import base64
import collections
import gzip
import hashlib
import math
import random
import time
import uuid

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import htmlmain, kdsearch, urlgraph, warc

SCHEMA = "page_id long, url string, html string, host string, path int, text string, rule int, node int"
PAGES = [
    (1, "http://a.example.com/en/1", '<a href="http://B.example.org/x">x</a><a class=q href=//c.net/>', "h", 1, "t", 1, 1),
    (2, "https://b.example.org/es/3", "<A HREF='https://c.net/de/'>", "h", 1, "t", 1, 1),
    (3, "http://c.net/de/5", None, None, None, None, None, None),
    (4, "http://c.net/fr", '<a href="/x">', "h", 1, "t", 1, 1),
    (5, None, None, None, None, None, None, None),
    (6, "noscheme", '<a href="http://c.net">', "h", 1, "t", 1, 1),
    (7, "http://d.org/q?x=1", '<a href="http://b.example.org">', "h", 1, "t", 1, 1),
    (8, "http://e.com", '<a href="http://a.example.com"><a href=http://c.net>', "h", 1, "t", 1, 1),
    (1, "http://a.example.com/en/1", "", "h", 1, "t", 1, 1),
    (9, "http://A.EXAMPLE.com/de/1", "", "h", 1, "t", 1, 1),
    (10, "ftp://x.net/de/#f", "<p>" + "long " * 50_000, "h", 1, "t", 1, 1),
    (None, "http://y.example.net/de/8?q", "<p>x", "h", 1, "t", 1, 1),
    (11, "http://example.com/en/77", "", "h", 1, "t", 1, 1),
    (12, "http://notexample.com/en/7", "", "h", 1, "t", 1, 1),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# urls


def test_url_verdicts_match_sql(spark, pages, none):
    got = sorted(map(tuple, urlgraph.judge(pages).collect()), key=str)
    assert got == sorted(map(tuple, urlgraph.judge(pages, most_bytes=0).collect()), key=str)
    frame = pd.DataFrame([p[:3] for p in PAGES], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", frame)
    assert got == sorted(map(tuple, con.execute(urlgraph.ORACLE).fetchall()), key=str)
    verdict = {r[0]: r for r in got}
    assert verdict[11][3:] == ("example.com/en/7", "allow") and verdict[12][3:] == ("com/en/", "block") and verdict[8][3:] == (None, "block")
    assert verdict[5][1:] == ("", "", None, "allow") and urlgraph.judge(none).count() == 0


def test_propagation_matches_a_plain_loop(spark):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(12)]
    seeds = {h: rng.random() for h in hosts}
    edges = sorted({(a, b) for a in hosts for b in rng.sample(hosts, 3) if a != b})
    out = collections.Counter(a for a, _ in edges)
    shares = spark.createDataFrame([(a, b, 1 / out[a]) for a, b in edges], "src string, dst string, share double")
    got = {r.node: r.value for r in urlgraph.propagate(spark.createDataFrame(list(seeds.items()), "node string, seed double"), shares, tolerance=1e-9).collect()}
    value = dict(seeds)
    for _ in range(300):
        value = {h: seeds[h] + 0.85 * sum(value[a] / out[a] for a, b in edges if b == h) for h in hosts}
    assert got == pytest.approx(value)


def test_a_link_alone_decides(spark):
    """The pages of ``near`` and ``far`` differ in one link only: near's leads to a blocked host, half of far's to an unknown one."""
    rows = [(1, "http://bad.com/en/1", "<p>x"), (2, "http://near.example/1", "<a href='//bad.com:80/'>"), (3, "http://far.example/1", "<a href='//elsewhere.example/'>")]
    got = {r.page_id: (r.rule, r.verdict) for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "allow")}
    # Trust that mostly leaves for hosts without pages does not save a host: true out-degrees.
    rows += [(4, "http://good.net/de/1", "<a href='//near.example/'>" + "".join(f"<a href='//u{i}.example/'>" for i in range(19))), (5, "http://good.net/de/2", "")]
    got = {r.page_id: r.verdict for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "block"
    rows[3] = (4, "http://good.net/de/1", "<a href='//near.example/'>")
    got = {r.page_id: r.verdict for r in urlgraph.judge(spark.createDataFrame([*rows, (6, "http://bad.com/fr", "")], "page_id long, url string, html string")).collect()}
    assert got[2] == "allow"


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<div class="site-header">Head</div><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy &amp; sell</div><aside>Side</aside>
<div class="cookie-notice">Accept?</div><div id="main-{k}"><div class="post-{k} entry"><h1>Title {k}</h1><p>One <b>two</b>&nbsp;&lt;three&gt;
<br>four<p>Five<ul><li>a<li>b</ul><form><p>Name</p><input></form><table><tr><td>c<td>d</table><div class="comments"><p>Reader says no</p></div></div></div><footer>&copy; me</footer>"""
TEXT = "Title {k}\nOne two <three> four\nFive\na\nb\nc\nd"


def test_main_text_of_a_page():
    assert htmlmain.Page(PAGE.format(k=1)).main_text(None) == TEXT.format(k=1)
    assert htmlmain.Page("plain &eacute; text &am").main_text(None) == "plain é text &am"
    assert htmlmain.Page("<article><p>a</article><p>outside").main_text("/article") == "a"
    assert htmlmain.Page("<main><article><h1>T</h1><div><p>" + "long text " * 30 + "</div></article></main>").main_text(None).startswith("T\nlong text")
    assert htmlmain.Page("<!-- <p>no --><p>yes<!-- cut").main_text(None) == "yes"


def test_hosts_vote_and_odd_pages_follow(spark, none):
    odd = '<body><div id="x"><div class="post-9 entry"><p>short</p></div><div class="unknown"><p>' + "noise words " * 40 + "</p></div></div>"
    rows = [(k, f"http://h.example.com/{k}", PAGE.format(k=k)) for k in range(5)] + [(9, "http://h.example.com/9", odd), (10, "http://other.com/", odd), (11, None, None), (12, "http://h.example.com/12", ""), (None, "http://h.example.com/1", PAGE.format(k=1))]
    frame = spark.createDataFrame([(*r, "h", 1, "t", 1, 1) for r in rows], SCHEMA)
    for most in (1 << 20, 0):
        got = {r.page_id: r for r in htmlmain.extract(frame, most).collect()}
        assert all(got[k].text == TEXT.format(k=k) and got[k].n_chars == len(TEXT.format(k=k)) for k in range(5))
        assert got[9].text == "short" and "noise" in got[10].text and got[11].text == got[12].text == "" and got[None].text == TEXT.format(k=1)
    assert htmlmain.extract(none).count() == 0


FRAMED = "<h1>The head</h1><p>" + "some long text of the page " * 20 + "</p>"


@pytest.mark.parametrize("page", [
    '<body class="has-sidebar"><nav><a href=/>Menu</a></nav><article>{}</article></body>',
    '<div class="has-sidebar"><article>{}</article></div>',
    '<body><div class="post social-science">{}</div><div class="social">Share this</div></body>',
    '<form action="x"><div class="topbar">Bar</div><article>{}</article></form>',
    '<form><div>{}</div></form>',
    '<div id="page-header"><p>Bar</p></div><div><article><header>{}</header></article></div>',
    '<article>{}</article><div class="sidebar-left">Side</div><div class="siteFooter">Foot</div><section id="comments"><p>Me too</p></section>',
    '<article>{}<a href="x>y">',
    "<div title='a > b'><article>{}</article></div>",
])
def test_ordinary_frames_keep_the_article(page):
    text = " ".join(["some long text of the page"] * 20)
    assert htmlmain.Page(page.format(FRAMED)).main_text(None) == "The head\n" + text


def test_a_page_of_boilerplate_only_still_has_its_text():
    assert htmlmain.Page('<div class="notice"><p>All there is to say</p></div>').main_text(None) == "All there is to say"


@pytest.mark.parametrize("piece", ['<div class="', "<div>", "<b>", "<blockquote>", "<!", "<!--", "<p", "<a href='", "<script>", "</div>", "<svg><", "<p>x</i></section>", "<li><p>", '"<a b="'])
def test_reading_is_linear(piece):
    """Markup that never ends, and deep nests: a megabyte each."""
    source = "<b>" * 1000 + "<div>" * 1000 + piece * ((1 << 20) // len(piece))
    began = time.process_time()
    htmlmain.Page(source).main_text(None)
    assert time.process_time() - began < 8


def test_votes_match_a_counter(spark):
    rng = random.Random(5)
    shapes = ['<div class="a-{}"><p>{}</p></div><p>x</p>', '<main><section class="b"><p>{1}</p></section></main>', "<article><p>{1}</p></article>"]
    rows = []
    for k in range(120):
        rows.append((k, f"http://h{rng.randrange(5)}.com/{k}", rng.choice(shapes).format(k, "word " * rng.randint(5, 30))))
    votes = collections.defaultdict(collections.Counter)
    for _, url, html in rows:
        page = htmlmain.Page(html)
        votes[url.split("/")[2]][page.path_of(page.best())] += 1
    want = {h: max(c, key=lambda p: (c[p], len(p), p)) for h, c in votes.items()}
    got = {r.host: r.path for r in htmlmain.vote(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and len(set(want.values())) > 1


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<body><div class="cookie"><h2>Cookie recipe</h2><p>Mix the flour and the sugar, then bake it all for an hour.</p></div><p>Copyright 2020</p>', "Cookie recipe\nMix the flour and the sugar, then bake it all for an hour."),
        ('<body><p>x</p><div class="discussion"><h2>Topic</h2><p>topic that is discussed here by all of them at great length</p></div>', "Topic\ntopic that is discussed here by all of them at great length"),
        ('<body><nav>a b</nav><div class="post"><header><h1>Headline</h1></header><p>Text of the post goes here.</p></div>', "Headline\nText of the post goes here."),
        ("<p>Press <button>OK</button> now</p><p><button>Share</button></p><button>Go</button>", "Press OK now"),
        ("<!--><p>Hello", "Hello"),
        ("<!---><p>Hello", "Hello"),
        # what stays boilerplate
        ('<body><div class="wrap"><header><h1>Site</h1></header><div><p>Real text of the page is here.</p></div></div>', "Real text of the page is here."),
        ('<body><p>Photo of the day</p><div class="comments"><p>' + "I like this photo very much. " * 20 + "</p></div>", "Photo of the day"),
        ('<body><h2>Photo of the day</h2><div class="related"><p>' + "Another page that is not this one. " * 20 + "</p></div>", "Photo of the day"),
    ],
)
def test_names_of_boilerplate_cost_no_article(html, want):
    assert htmlmain.Page(html).main_text(None) == want


@pytest.mark.parametrize("piece", ["<title>", "<title", "<html ", "<a ", "<p><button>", "<!--", "<header>", "<a href=", "<a href=' "])
def test_pages_of_one_piece_take_linear_time(spark, piece):
    page = piece * (400_000 // len(piece))
    began = time.perf_counter()
    warc.facts(page)
    htmlmain.Page(page)
    assert time.perf_counter() - began < 3
    one = spark.createDataFrame([("a", page), ("a", "<a href=x" + " " * 200_000)], "node string, html string")
    began = time.perf_counter()
    assert urlgraph.host_links(one).count() == 0
    assert time.perf_counter() - began < 15


# warc


def test_wrong_lengths_cost_no_other_record(spark, tmp_path):
    sound = [warc.response(f"u{k}", b"payload %d" % k, str(k)) for k in range(8)]

    def with_length(r, n):
        return warc.Record([(k, str(n) if k == "Content-Length" else v) for k, v in r.headers], r.block).to_bytes()

    for wrong, n in ((0, 10**9), (3, 10**6), (7, 5000), (4, 3), (5, 0)):
        (tmp_path / f"{wrong}-{n}.warc").write_bytes(b"".join(with_length(r, n) if k == wrong else r.to_bytes() for k, r in enumerate(sound)))
        got = warc.read_warc(spark, str(tmp_path / f"{wrong}-{n}.warc")).collect()
        assert sorted(bytes(r.block) for r in got if not r.broken) == sorted(r.block for k, r in enumerate(sound) if k != wrong)
        assert [bytes(r.block).rstrip(b"\r\n") for r in got if r.broken] == [sound[wrong].block]
    made = [with_length(r, 10**9) for r in sound] * 300
    (tmp_path / "all.warc").write_bytes(b"".join(made))
    assert warc.read_warc(spark, str(tmp_path / "all.warc")).where("broken").count() == len(made)


def test_derivatives_refer_to_their_response(spark, pages, none):
    got = warc.derivatives(pages).collect()
    assert collections.Counter(r.warc_type for r in got) == {"metadata": len(PAGES), "conversion": len(PAGES)}
    by = {(r.refers_to, r.warc_type): r for r in got}
    for p in PAGES:
        source = warc.response(p[1] or "", (p[2] or "").encode(), str(p[0]))
        for what in ("metadata", "conversion"):
            r = by[source.get("WARC-Record-ID"), what]
            assert r.page_id == p[0] and r.record_id != r.refers_to and r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
            assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header
        assert f"source-warc-payload-digest: {warc.digest((p[2] or '').encode())}\r\n" in by[source.get("WARC-Record-ID"), "metadata"].block
    assert warc.derivatives(none).count() == 0


def test_records_survive_a_round_trip(spark, pages, tmp_path):
    made = warc.derivatives(pages.where("page_id < 5"))
    warc.write_warc(made, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w" / "*.gz")).collect()
    assert sorted(bytes(r.block) for r in back) == sorted(r.block.encode() for r in made.collect())
    for r in back:
        assert r.headers["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and int(r.headers["Content-Length"]) == len(r.block)


def test_bodies_are_decoded_and_other_content_has_metadata_only():
    text = "<html lang=de><title>Ä</title><p>grün".encode("latin-1")
    body = gzip.compress(text)
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks
    source = warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", "sha1:WRONG"), ("Content-Length", str(len(block)))], block)
    meta, conversion = warc.derive(next(warc.records(source.to_bytes())))
    assert conversion.block.decode() == "grün" and b"title: \xc3\x84\r\n" in meta.block and b"language: de" in meta.block and b"digest-mismatch" in meta.block
    assert [r.get("WARC-Type") for r in warc.derive(warc.response("u", b"\x89PNG", "1", content_type="image/png"))] == ["metadata"]
    assert warc.derive(warc.response("u", b"a < b", "1", content_type="text/plain"))[1].block == b"a < b"


def test_heads_of_bare_line_feeds_and_long_bodies():
    body = gzip.compress(b"<p>x</p>") + gzip.compress(b"<p>y</p>")
    block = b"HTTP/1.1 200 OK\nContent-Type: text/html\nContent-Encoding: gzip\n\n" + body
    meta, conversion = warc.derive(warc.Record([("WARC-Payload-Digest", warc.digest(body))], block))
    assert conversion.block == b"x\ny" and b"digest-mismatch" not in meta.block
    other = warc.derive(warc.Record([], block + b"z"))[0]
    assert meta.get("WARC-Refers-To") != other.get("WARC-Refers-To") and meta.get("WARC-Record-ID") != other.get("WARC-Record-ID")
    assert warc.http_parts(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + body[:-9])[3] == body[:-9]
    late = warc.derive(warc.response("u", b"<!--" + b"x" * 5000 + b"--><html lang=fr><p>a", "1"))[0]
    assert b"language: fr" in late.block


def test_blocks_that_hold_what_parts_records(spark, tmp_path):
    payloads = [b"a" + warc.BETWEEN + b"1.1\r\n\r\nb", b"", warc.BETWEEN * 3, b"\xff\x00\r\n\r\n", "é".encode() * 50_000]
    made = [warc.response(f"u{k}", p, str(k)) for k, p in enumerate(payloads)]
    plain = b"".join(r.to_bytes() for r in made)
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r.to_bytes()) for r in made))
    for name in ("a.warc", "b.warc.gz"):
        got = sorted(bytes(r.block) for r in warc.read_warc(spark, str(tmp_path / name)).collect())
        assert got == sorted(r.block for r in made) == sorted(r.block for r in warc.records((tmp_path / name).read_bytes()))


def test_derivatives_are_those_built_by_hand(spark):
    """Against blocks written independently of ``derive``."""
    rows = [(1, "http://a/1", "<html lang='de'><head><title>A &amp; B</title></head><body><p>One</p><p>Two <a href=x>l</a>"), (2, None, None)]
    got = {(r.page_id, r.warc_type): r.block for r in warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page_id, url, html in rows:
        payload = (html or "").encode()
        sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        name = uuid.uuid5(uuid.NAMESPACE_URL, "|".join(["response", str(page_id), url or "", sha(payload)]))
        text = "One\nTwo l" if html else ""
        lines = ["source-warc-type: response", f"source-warc-record-id: <urn:uuid:{name}>", f"source-warc-target-uri: {url or ''}", "source-warc-date: 1970-01-01T00:00:00Z",
                 "source-content-type: application/http; msgtype=response", f"source-warc-payload-digest: {sha(payload)}", f"source-warc-block-digest: {sha(http)}", f"source-content-length: {len(http)}",
                 "http-status: HTTP/1.1 200 OK", "http-content-type: text/html; charset=utf-8", f"http-content-length: {len(payload)}"]
        lines += ["title: A & B", "language: de"] if html else []
        lines += [f"outlinks: {int(bool(html))}", f"text-characters: {len(text)}"]
        assert got[page_id, "conversion"] == text and got[page_id, "metadata"] == "".join(x + "\r\n" for x in lines)


# vectors


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        found = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv)))[:k]
        out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(found)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, shard int, v string, dim int, rank int, score int"


@pytest.mark.parametrize("block", [16384, 3])
def test_search_matches_brute_force(spark, block):
    rng = random.Random(2)
    f = lambda x: float(pa.array([x], pa.float32())[0].as_py())
    rows = [(i, [f(rng.gauss(0, 1) * 0.2) for _ in range(8)]) for i in range(900)]
    rows += [(i, [f(0.25)] * 8) for i in range(1000, 1200)]  # ties
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [0.5] * 8), (2400, []), (2401, []), (2500, [0.5]), (2501, [1.5]), (5, [f(0.1)] * 8), (100, rows[100][1])]
    rows += [(2600, [f(3e38), 1.0, 0.5]), (2601, [f(-3e38), 1.0, 0.25])]
    frame = spark.createDataFrame([(i, v, 0, 1, "c", 1, 1, 1) for i, v in rows], VECTORS)
    got = sorted(map(tuple, kdsearch.top_k(frame, F.col("vec_id") % 100 == 0, shard_rows=200, block=block).collect()))
    assert got == brute(rows)


def test_search_of_nothing(spark):
    assert kdsearch.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    assert kdsearch.top_k(spark.createDataFrame([(100, [1.0], 0, 0, "", 0, 0, 0)], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
