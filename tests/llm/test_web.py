import base64
import gzip
import hashlib
import glob

import duckdb
import pytest

from stratalog.llm import htmltext, queries, warc

PAGES = "page_id long, url string, html string, record_type string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same", "x"), (2, "http://b c/\n", "same", "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 50, "x"), (None, "u", "same", "x"), (6, "u", "once", "x"), (6, "v", "once", "x")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), i if i is not None else -1)
    seen = {}
    for r in got:
        seen.setdefault(r.key, []).append(r)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        r = next(x for x in seen[i] if x.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.payload_bytes == len(data)
        if i == best[h or ""]:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", best[h or ""], None)
    ids = {r.record_id for r in got if r.record_type == "response"}
    raw = b"".join(gzip.open(f).read() for f in glob.glob(path + "/part-*"))
    for line in raw.split(b"\r\n"):
        if line.startswith(b"WARC-Refers-To: "):
            assert line[16:].decode() in ids
    warc.dedup_archives(spark, path, str(tmp_path / "again"))
    key = lambda r: (r.key is None, r.key, r.url, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes)
    assert sorted(map(key, warc.read_archives(spark, str(tmp_path / "again")).collect())) == sorted(map(key, got))


def test_long_payloads_members_and_damage(spark, tmp_path):
    long = "".join(f"line {i} \u00e9\r\n\r\n" for i in range(400_000))
    rows = [(i, "u", long if i in (2, 5) else f"page {i}", "") for i in range(8)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, revisits=False)
    warc.dedup_archives(spark, path, str(tmp_path / "d"))
    got = {r.key: r for r in warc.read_archives(spark, str(tmp_path / "d")).collect()}
    assert bytes(got[5].payload).decode() == long and (got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("revisit", 5, len(long.encode()))
    raw = gzip.open(max(glob.glob(path + "/part-*"), key=lambda f: len(open(f, "rb").read()))).read()
    one = [r["payload"] for r in warc.parse(raw)]
    cut = raw.index(b"WARC/1.1", 10) if raw.count(b"WARC/1.1\r\n") > 1 else len(raw)
    members = gzip.compress(raw[:cut]) + (gzip.compress(raw[cut:]) if cut < len(raw) else b"")
    assert [r["payload"] for r in warc.parse(members)] == one
    for bad in (raw.replace(b"line 7 ", b"line 8 "), raw[:-9], gzip.compress(raw)[:-40]):
        with pytest.raises(warc.Damaged):
            list(warc.parse(bad))


def test_revisits_are_joined_to_their_responses(spark, tmp_path):
    """Archives that hold revisits already, of which one has the largest key, and one refers to nothing."""
    first, second = str(tmp_path / "a" / "x"), str(tmp_path / "b")
    warc.write_archives(spark.createDataFrame([(1, "u", "same", ""), (2, "u", "same", ""), (3, "u", "other", "")], PAGES), first, compression="none")
    files = glob.glob(first + "/part-*")
    for f in files:  # the response gets the smallest key
        data = open(f, "rb").read().replace(b"X-Row-Key: 2", b"X-Row-Key: 0")
        open(f, "wb").write(data)
    for f in glob.glob(first + "/.*.crc"):
        __import__("os").remove(f)
    warc.dedup_archives(spark, first, second)
    got = {r.key: (r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, second).collect()}
    assert got == {0: ("revisit", 1, None), 1: ("response", None, b"same"), 3: ("response", None, b"other")}


def test_small_payloads_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", "")], PAGES)
    warc.write_archives(df, str(tmp_path / "w"), least_bytes=3, compression="none")
    assert {r.key: r.record_type for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_warc_and_search_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect()), name


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="page no-comments">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div id="cookie-notice">We use cookies on this site, as everybody does.</div>
<div class="content-with-sidebar"><div class="post"><h2>Title</h2><p>The first paragraph is long enough to be seen as text, surely.</p><p>Short.</p>
<ul><li>item one</li><li>item <b>t</b>wo</li></ul><div class="ad">BUY NOW and save a lot of money today, only here</div><script>if (a < b) "</p>"</script>
<p>x &lt; y&nbsp; z<br>more &eacute;</p><aside>Something else entirely</aside></div><form><p>Your name</p></form>
<div class="comments"><p>First! What a long comment this is, with many words in it.</p></div></div><footer>(c) 2024 all the rights</footer></body></html>"""


def test_main_text():
    want = "Title\n\nThe first paragraph is long enough to be seen as text, surely.\n\nShort.\n\nitem one\n\nitem two\n\nx < y z more é"
    assert htmltext.extract(PAGE) == want
    marked = "<body><div>menu text that is quite long, longer than others</div><article><header><h1>A</h1></header><p>b</p><footer>by me</footer></article><p>after the article there is much more text than inside of it</p></body>"
    assert htmltext.extract(marked) == "A\n\nb"


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("<p>a < b & c &amp; d", "a < b & c & d"), ("<p>cut <a hre", "cut"), ("<!-- open <p>x", ""), ("<script>x", ""), ('<p title="a>b">q</p>', "q"), ('<p title="a>b', "b"), ("<article></article><p>x", "x"), ("<div class=ad>only an advert</div>", "")])
def test_odd_pages(page, want):
    assert htmltext.extract(page) == want


P = ["The first paragraph tells what happened, and it is long enough to weigh something beside the menus.", "A second one goes on about it; nobody would take it for a menu or a notice.", "Then a third, with a number of words and commas, stops, and the like, as prose has."]


def test_text_without_marks():
    """Neither an article element nor telling names: the distribution finds the text."""
    menu = "".join(f'<div><a href="/{i}">Topic {i}</a></div>' for i in range(12))
    plain_menu = "".join(f"<div>Topic {i}</div>" for i in range(9))
    body = "<div><h2>Head line</h2><p>" + "</p><p>".join([P[0], "Short.", P[1], "One", "Two", "Three", "Four", "Five", P[2], "The end."]) + "</p></div>"
    page = f"<html><body><table><tr><td>{menu}{plain_menu}</td><td>{body}<div><h3>More</h3>{menu}</div></td></tr></table><div>Contact us</div><div>(c) 2024 Some Company</div></body></html>"
    want = "\n\n".join(["Head line", P[0], "Short.", P[1], "One", "Two", "Three", "Four", "Five", P[2], "The end."])
    assert htmltext.extract(page) == want
    everything = [b for b in htmltext.lines(page)]
    assert len(everything) > 35  # what the surge and the dive leave out


def test_nothing_of_an_article_is_lost():
    advert = '<div class="ad">Buy this now, it is cheap and good for you and yours.</div>'
    page = f"<body><nav><a href=x>a</a></nav><article><h1>T</h1><p>{P[0] * 30}</p><p>{P[1] * 30}</p>{advert * 4}<p>Bye.</p></article><footer>Foot of the page, with text.</footer></body>"
    assert htmltext.extract(page) == "\n\n".join(["T", P[0] * 30, P[1] * 30, "Bye."])
    two = f"<body><article><p>{P[0] * 40}</p></article><article><p>A short one.</p></article><div class=comments><p>{P[1] * 9}</p></div></body>"
    assert htmltext.extract(two) == P[0] * 40 + "\n\nA short one."
    named = f'<body><div class="alert-levels legal"><p>{P[0]}</p><p>{P[1]}</p></div><div class=foot>x</div></body>'
    assert htmltext.extract(named) == "\n\n".join(P[:2])
    whole = f'<body><form action="/x"><div><p>{P[0]}</p><p>{P[1]}</p></div></form></body>'
    assert htmltext.extract(whole) == "\n\n".join(P[:2])


def test_markup_weighs_and_the_distribution_decides(monkeypatch, sf_dir):
    """Without surge and dive, noise included, the pages of the table give other texts."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()
    with_it = [htmltext.extract(x) for x in pages]
    monkeypatch.setattr(htmltext, "main_lines", lambda weights, containers, headings: [i for i, w in enumerate(weights) if w > 0])
    assert sum(htmltext.extract(x) != y for x, y in zip(pages, with_it)) > 0.9 * len(pages)


def test_repeated_long_and_odd_page_rows(spark):
    long = f"<article><p>{P[0] * 20000}</p></article>"
    df = spark.createDataFrame([(1, "u", long, 5), (1, "u", long, 6), (2, None, "<p>x.</p>", 7)], "page_id long, url string, html string, n_chars int")
    rows = sorted((r.page_id, r.url, r.n_chars) for r in htmltext.main_text(df).collect() if r.page_id == 1)
    assert rows == [(1, "u", len(P[0]) * 20000)] * 2
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_extraction_of_whole_table(spark, sf_dir):
    import html
    import re

    def articles(h):
        m = re.search(r"<article>(.*?)(</article>|<footer>|$)", h, re.S)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", m[1])]
        return "\n\n".join(x for x in parts if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op7_main_text(spark, sf_dir).collect()
    assert len(rows) == len(pages) and all(r.text == articles(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in htmltext.main_text(odd).collect()] == [(None, None, "", 0)]
