"""Main text of hand-made pages, and host votes against a plain count."""

import random
from collections import Counter, defaultdict

import pytest

from metricwatch.llm import extraction

SCHEMA = "page_id long, url string, html string, text string, path string, row long"
LONG = "A sentence of the article that is long enough to be told from a menu entry or a caption, and goes on."
MORE = "Another paragraph, with <b>bold</b>, <a href=x>a link</a> and caf&eacute; &amp; R&D &lt;tags&gt; in it, goes on as well."
MORE_TEXT = "Another paragraph, with bold, a link and café & R&D <tags> in it, goes on as well."


def text_of(html):
    return extraction.extract(html, extraction.containers(html)[0])


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("just words", "just words"),
    (f"<p>{LONG}<p>{MORE}", f"{LONG} {MORE_TEXT}"),
    (f"<html><head><title>T</title><body><div id=main><h2>Head</h2><p>{LONG}</p></div><div class=footer><p>{LONG}</p></div>", f"Head {LONG}"),
    # Unclosed paragraphs and bold text; a menu, a header and a footer; a script that holds tags.
    (f"<body><header><h1>Site</h1></header><nav><ul><li><a href=a>One</a><li>Two</ul></nav><article><h1>T</h1><p><b>{LONG}<br>x<p>{MORE}"
     "<script>var a='</p>';</script></article><footer>(c)</footer>", f"T {LONG} x {MORE_TEXT}"),
    # Adverts, notices, comments and shares inside the article, by class, id and role.
    (f"<main><div class='post-12 entry'><p>{LONG}</p><div class=ad-box>Buy</div><div role=alert>Alert</div><aside>Side</aside><p>{MORE}</p></div>"
     f"<section id=comments><h3>2 replies</h3><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section></main>", f"{LONG} {MORE_TEXT}"),
    # No semantic element at all: the densest container; loose lines beside it are left out.
    (f"<body><div class=x1><div>Shop</div><div><a href=1>Home</a> <a href=2>News</a></div></div><div class=x2><p>{LONG}</p><p>{MORE}</p></div><div class=x3>Imprint</div>",
     f"{LONG} {MORE_TEXT}"),
    # A form round the page is no reason to drop it; fields are.
    (f"<form><div class=content><h1>T</h1><p>{LONG}</p><form><input><button>Go</button></form></div></form>", f"T {LONG}"),
    # White space, line breaks, references and inline elements inside a block.
    (f"<article><p> a\n\t b&nbsp;c<br/>d<i>e</i>f &#8364; &#x41; &unknown; &copy</p><p>{LONG}</p></article>", f"a b c def € A &unknown; © {LONG}"),
    # Lists, tables and quotes are blocks.
    (f"<article><p>{LONG}<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><th>c</table><blockquote>q</blockquote></article>", f"{LONG} one two a b c q"),
    # An advert that lost its end tag doesn't take the article with it.
    (f"<body><div class=ad>Buy<article><p>{LONG}</p></article>", LONG),
    (f"<body><nav><a href=/>Home</a><article><p>{LONG}</p></article>", LONG),
    # Comments, hidden parts, a wrapper named after its sidebar, attributes with > in them.
    (f"<div class='with-sidebar'><!-- <p>no</p> --><!--><div class=content><p title='a > b'>{LONG}</p><p hidden>no</p><p style='display: none'>no</p></div><div class=sidebar>no</div></div>", LONG),
    (f"<article><p>{LONG} 1 < 2 </ > 3 <", f"{LONG} 1 < 2 3 <"),
    (f"<article><p>{LONG}</p><textarea>no <p>no</textarea><svg><text>no</text></svg><select><option>no</select></article", LONG),
])
def test_pages(html, text):
    assert text_of(html) == text


def page(layout, body, replies=""):
    if layout == "blog":
        return f"<body class='p{len(body)}'><div id=top>Blog</div><div class='post-{len(body)} hentry'>{body}</div><div class=zone>{replies}</div></body>"
    return f"<body><div class=wrap><div class=story-text>{body}</div></div></body>"


def test_hosts_agree_on_a_path(spark):
    body = lambda n: "".join(f"<p>{LONG}</p>" for _ in range(n))
    rows = [(i, f"https://www.blog.example/{i}", page("blog", body(2 + i % 3))) for i in range(9)]
    # What readers wrote is longer than the article: only the host's other pages tell them apart.
    rows.append((9, "http://blog.example:80/9", page("blog", body(1), body(4))))
    rows += [(20 + i, "https://blog.example/story", page("story", body(3))) for i in range(4)]
    rows += [(30, None, page("blog", body(2))), (31, "http://[bad", "<p>"), (32, "https://blog.example", None), (None, "", ""), (9, "http://blog.example:80/9", page("blog", body(1), body(4)))]
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], SCHEMA).repartition(5)
    found = extraction.main_text(df)
    assert found.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    texts = sorted((r.page_id is None, r.page_id or 0, r.text) for r in found.collect())
    said = lambda n: " ".join([LONG] * n)
    expected = [(False, i, said(2 + i % 3)) for i in range(9)] + [(False, 9, said(1))] * 2 + [(False, 20 + i, said(3)) for i in range(4)]
    expected += [(False, 30, said(2)), (False, 31, ""), (False, 32, ""), (True, 0, "")]
    assert texts == expected
    assert extraction.containers(rows[9][2])[0] != extraction.containers(rows[0][2])[0]


def test_votes_match_a_plain_count(spark):
    rng = random.Random(4)
    votes = []
    for i in range(200):
        paths = rng.sample("abcdefgh", rng.randint(1, 5))
        best = rng.choice(paths)
        votes += [(i if i % 9 else None, i, f"h{i % 4 // 2}", p, float(rng.randint(-2, 3)), p == best, rng.random() < 0.7) for p in paths]
    schema = "page_id long, key long, host string, path string, score double, best boolean, fits boolean"
    found = {(r.page_id, r.key): r.path for r in extraction.chosen_paths(spark.createDataFrame(votes, schema)).collect()}
    counts, pages = defaultdict(Counter), defaultdict(list)
    for page_id, key, host, path, score, best, fits in votes:
        counts[host][path] += best
        pages[page_id, key].append((host, path, score, fits))
    for key, options in pages.items():
        ranked = []
        for host, path, score, fits in options:
            n, most = counts[host][path], max(counts[host].values())
            if n:
                ranked.append((not (fits and n >= extraction.WINNING_SHARE * most), -n, -score, path))
        assert found[key] == min(ranked)[3]
    assert len(found) == len(pages)


def test_long_and_deep_pages():
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>"
    assert text_of(deep) == LONG
    wide = "<article>" + f"<p>{LONG}</p>" * 20_000
    assert text_of(wide) == " ".join([LONG] * 20_000)
    assert text_of("<" * 50_000) == "<" * 50_000
    assert text_of("<a " + "x='" * 50_000) == ""


def test_empty_table(spark):
    assert extraction.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
