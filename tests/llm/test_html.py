import html as entities
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import html, queries

SF = "/root/testdata/sf0.01"


def _text(page):
    found, _ = html.blocks(page)
    return " ".join(found)


def test_query_against_a_pattern_for_this_template(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op8_html(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        inner = re.sub(r"<(?:p|h1|/p|/h1|br)>", " ", inner)
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert r.text == want and r.n_chars == len(want)


def test_furniture_goes_and_article_stays():
    page = """<html><body class="nav-open"><header>Site</header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>A &amp; B&nbsp;C</h1></header><p>One<b>two</b> three<p>Four<br>five <i>6 &lt; 7</i><div class="ad">Buy</div>
    <ul><li>x<li>y</ul><form>Sign up</form><script>if (a</b) "<p>"</script><!-- <p>no --><table><tr><td>1<td>2</table>
    <section id="comments"><article class="comment">First!</article></section><footer>by me</footer></article>
    <aside>See also</aside><p>outside</p></main><footer>&copy;</footer></body></html>"""
    assert _text(page) == "A & B C Onetwo three Four five 6 < 7 x y 1 2"


def test_broken_pages_do_not_fail():
    assert _text(None) == "" and _text("") == "" and _text("plain &eacute; text") == "plain é text"
    assert _text("<p>a <") == "a <" and _text("<article><p>x</div></b>y</article") == "xy"
    assert _text('<article><a title="x>y" href=\'z>\'>q</a> <p don\'t>w</p></article>') == "q w"
    assert _text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert _text("<article>" + "w " * 200000 + "</article>") == " ".join("w" * 200000)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.integers(1, 4))
def test_shared_stretches_against_brute_force(streams, long):
    got = html.shared_tokens(streams, long)
    assert len(got) == len(streams)
    for i, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for at in range(len(s) - long + 1):
            if any(s[at : at + long] == o[k : k + long] for j, o in enumerate(streams) if j != i for k in range(len(o) - long + 1)):
                want[at : at + long] = True
        assert got[i].tolist() == want.tolist()


def test_hosts_decide_where_no_article_is_marked(spark):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    boiler, rows, want = "all rights of this site are reserved by its owner since long ago", [], {}
    for i in range(40):
        body = [" ".join(word() for _ in range(20)) for _ in range(3)]
        rows.append((i, f"http://Host{i % 2}.example/{i}", f"<div><p>Home</p><p>{body[0]}</p><p>{body[1]}<p>{body[2]}</div><div>{boiler}</div>", "x"))
        want[i] = " ".join(body)
    rows += [(100, "http://host0.example/copy", rows[0][2], "x"), (101, None, "<p>alone</p>", "x"), (102, "http://lone.example", "<p>alone</p>", None), (103, "u", None, None), (103, "u", None, None)]
    want |= {100: want[0], 101: "alone", 102: "alone", 103: ""}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    for size in (1000, 10):
        got = html.extract(pages, group_pages=size).collect()
        assert len(got) == len(rows)
        assert {x.page_id: x.text for x in got} == want
    assert html.extract(pages.limit(0)).count() == 0


def _unique(pages, long=8):
    """By comparing every page of a host with every other."""
    distinct = sorted(set(map(tuple, pages)))
    streams = {p: [t for b in p for t in b.split()] for p in distinct}
    out = []
    for p in pages:
        own, others = streams[tuple(p)], [q for q in distinct if q != tuple(p)]
        windows = {tuple(streams[q][i : i + long]) for q in others for i in range(len(streams[q]) - long + 1)}
        blocks = {b for q in others for b in q}
        gone = set()
        for i in range(len(own) - long + 1):
            if tuple(own[i : i + long]) in windows:
                gone |= set(range(i, i + long))
        kept, at = [], 0
        for b in p:
            n = len(b.split())
            if not (n < long and b in blocks):
                kept += [own[i] for i in range(at, at + n) if i not in gone]
            at += n
        out.append(" ".join(kept or own))
    return out


def test_query_on_pages_without_an_article_against_brute_force(spark, tmp_path):
    """The whole query, with hosts of any number of groups: results do not depend on them."""
    r = np.random.default_rng(12)
    word = lambda: "".join(r.choice(list("abcdefgh"), 3))
    phrases = [" ".join(word() for _ in range(int(r.integers(3, 25)))) for _ in range(25)]
    rows = []
    for i in range(120):
        blocks = [" ".join([*(word() for _ in range(int(r.integers(0, 12)))), *([phrases[r.integers(25)]] if r.random() < 0.5 else []), *(word() for _ in range(int(r.integers(1, 12))))]) for _ in range(int(r.integers(1, 6)))]
        rows.append((i, f"http://h{i % 3}.example/{i}", blocks))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]
    html_rows = [(i, u, "".join(f"<p>{b}</p>" for b in bs)) for i, u, bs in rows]
    spark.createDataFrame(html_rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = {}
    for host in range(3):
        own = [(i, bs) for i, u, bs in rows if f"//h{host}." in u]
        want |= dict(zip([i for i, _ in own], _unique([bs for _, bs in own])))
    got = queries.op8_html(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {x.page_id: x.text for x in got} == want
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    for limits in ({"group_pages": 3}, {"group_tokens": 150}):
        assert {x.page_id: x.text for x in html.extract(pages, **limits).collect()} == want
