import re

import pytest

from quillon.llm import html_extraction, url_filter
from quillon.llm.html_extraction import blocks

PAGES = [
    (None, []),
    ("", []),
    ("plain &amp; simple", ["plain & simple"]),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><p>menu</p></nav><article><h1>Head</h1><p>One <b>two</b><br>three&nbsp;x</p><p>&copy four &#8364;</article><footer>f</footer>", ["Head", "One two three x", "© four €"]),
    ("<main><p>a<p>b<script>var x='<p>no</p>';</script><form>f</form><aside>s</aside><!-- c <p>d</p> --><div class='comments'><p>c</p></div><p>e", ["a", "b", "e"]),
    ("<article><header><h1>Title</h1><span>by x</span></header><p>text</p><footer>f</footer><div id='cookie-notice'>c</div><section><h2>S</h2>t</section></article><div class=sidebar>s</div>", ["Title", "text", "S", "t"]),
    ("<p>no <i>article</i></p><div class=\"ad banner\">buy</div><div role=navigation>m</div><p hidden>h</p><table><tr><td>c1</td><td>c2</td></tr></table>", ["no article", "c1", "c2"]),
    ("<article>unclosed <b>bold <p>next &lt;tag&gt; &am", ["unclosed bold", "next <tag> &am"]),
    ("<article><p title='a > b'>q</p></article", ["q"]),
    ('<div class="page has-sidebar"><article><p>text</p></article><div class="sidebar">s</div></div>', ["text"]),
    ("<body class='comments-open'><article class='post no-sidebar'><p>text</p><div class='comments-area'><article><p>reader</p></article></div></article>", ["text"]),
    ("<div class='header-wrap'><main><p>a</p></main></div><div class='widget'><article>teaser</article></div>", ["a"]),
    ("<div class=content><p>one two three four five six seven eight</p></div><article>t1</article><article>t2</article><article>t3</article>", ["one two three four five six seven eight"]),
    ("<article>a b c</article><article>d e</article><p>more</p>", ["a b c", "d e"]),
    ("<div>" * 30000 + "<p>deep</p>" + "</div></span>" * 30000 + "<p>after</p>", ["deep", "after"]),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_blocks(page, want):
    found = blocks(page)
    article = [t for k, t in found if k == html_extraction.ARTICLE]
    assert (article or [t for k, t in found if k == html_extraction.OPEN]) == want


def test_repeated_runs_are_boilerplate_only_outside_articles(spark):
    notice = " ".join(f"n{i}" for i in range(15))
    shared = " ".join(f"s{i}" for i in range(15))
    unique = lambda k: " ".join(f"u{k}x{i}" for i in range(20))
    rows = [(i, "http://h.org/a", f"<p>{notice}</p><p>{unique(i)} {notice[3:]}</p>") for i in range(4)]
    rows += [(10 + i, "http://h.org/b", f"<article><p>{shared}</p><p>{unique(10 + i)}</p></article><p>{notice}</p>") for i in range(3)]
    rows += [(20 + i, "http://copy.org/", f"<p>{unique(99)}</p>") for i in range(3)]  # copies of one page
    rows += [(30, None, f"<p>{notice}</p>"), (31, "http://h.org/", None)]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n_chars string")).collect()}
    assert len(got) == len(rows)
    for i in range(4):
        assert got[i].text == unique(i)
    for i in range(3):
        assert got[10 + i].text == f"{shared}\n\n{unique(10 + i)}" and got[20 + i].text == unique(99)
    assert got[30].text == notice and got[31].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    short = [(40 + i, "http://short.org/", f"<p>Yes.</p><p>{unique(50 + i)}</p>") for i in range(3)]
    menu = "".join(f"<div>item{i} of</div>" for i in range(9))  # blocks of two words, which the host's pages repeat as one run
    short += [(50 + i, "http://menu.org/", f"{menu}<p>{unique(60 + i)}</p>") for i in range(3)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(short, "page_id long, url string, html string")).collect()}
    assert all(got[40 + i] == f"Yes.\n\n{unique(50 + i)}" and got[50 + i] == unique(60 + i) for i in range(3))
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(*url_filter.LOW)), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


@pytest.mark.parametrize("most", [200, 0])
def test_rules(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_IN_PLAN", most)
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.Example.COM/en/1?x=/y", "https://www.example.com/en/", "http://example.com/de/#a", "http://x.net/es/1", "http://x.net/en", "//a.com/", "http://a.com", "http://notexample.com/en/x", "ftp://a.org?q=http://b.com/", "http://net/fr/", "http://example.com:80/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for r in url_filter.judge(pages, url_filter.RULES).collect():
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == (verdict or "allow")


def test_distrust_flows_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [(1, "http://bad.net/es/1", link()), (2, "http://farm.org/1", link("bad.net")), (3, "http://farm2.org/1", link("farm.org", "BAD.net")), (4, "http://good.com/1", link("nice.org")), (5, "http://nice.org/", link("bad.net", "good.com", "other.org")), (6, "http://other.org/", "<a href='/local'>x</a>"), (7, None, link("bad.net"))]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filter.RULES).collect()}
    edges = {("farm.org", "bad.net"): 1, ("farm2.org", "farm.org"): 1, ("farm2.org", "bad.net"): 1, ("good.com", "nice.org"): 1, ("nice.org", "bad.net"): 1, ("nice.org", "good.com"): 1, ("nice.org", "other.org"): 1}

    def rank(edges, seeds):
        total, out = {}, dict(seeds)
        for (a, _), n in edges.items():
            total[a] = total.get(a, 0) + n
        for _ in range(400):
            new = dict(seeds)
            for (a, b), n in edges.items():
                new[b] = new.get(b, 0) + 0.85 * out.get(a, 0) * n / total[a]
            out = new
        return out

    trust, distrust = rank(edges, {"good.com": 1.0}), rank({(b, a): n for (a, b), n in edges.items()}, {"bad.net": 1.0})
    for r in got.values():
        if r.distrust or r.trust:
            assert r.trust == pytest.approx(trust.get(r.host, 0.0)) and r.distrust == pytest.approx(distrust.get(r.host, 0.0))
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), url_filter.RULES).count() == 0


def test_the_query_propagates_until_ranks_converge(spark, tmp_path):
    import numpy as np

    rows = [(0, "http://bad.net/es/1", "")] + [(i, f"http://h{i}.org/", f'<a href="http://{f"h{i - 1}.org" if i > 1 else "bad.net"}/">l</a>') for i in range(1, 17)]
    ring = {"x": ["y"], "y": ["x", "bad2"], "z1": ["y"], "z2": ["y"], "z3": ["y"]}
    name = lambda h: f"{h}.net" if h == "bad2" else f"{h}.org"
    rows += [(99, "http://bad2.net/es/", "")] + [(100 + i, f"http://{name(h)}/", "".join(f'<a href="http://{name(t)}/">l</a>' for t in to)) for i, (h, to) in enumerate(ring.items())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.host: r for r in url_filter.op9_url_filter(spark, str(tmp_path)).collect()}
    links = {(f"h{i}.org", f"h{i - 1}.org" if i > 1 else "bad.net") for i in range(1, 17)} | {(name(h), name(t)) for h, to in ring.items() for t in to}
    hosts = sorted(got)
    flow = np.zeros((len(hosts), len(hosts)))  # of distrust, from a host to those that link to it
    for a, b in links:
        flow[hosts.index(a), hosts.index(b)] = 0.85 / sum(b == t for _, t in links)
    want = np.linalg.solve(np.eye(len(hosts)) - flow, [float(h in ("bad.net", "bad2.net")) for h in hosts])
    for h, w in zip(hosts, want, strict=True):
        assert got[h].verdict == ("block" if w > 0.1 else "allow"), h
        if got[h].distrust:
            assert got[h].distrust == pytest.approx(w, abs=1e-7)
    assert any(0.1 < w < 0.125 for w in want)
