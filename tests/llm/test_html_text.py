import time
from collections import defaultdict

import pytest

from ctxvote.llm import html_text
from ctxvote.llm.html_text import extract_text, host_of, page_text, parse, subtrees, text_by_rules

PAGES = "/root/testdata/sf0.1/pages.parquet"


@pytest.mark.parametrize(
    "source,expected",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<br>b  c<p>d</p>", "a b c\nd"), ("<article><h1>T&amp;am</h1><p><b>x<br><p>y</p></article><footer>f</footer>", "T&am\nx\ny"),
        ("<body><nav><a>m</a></nav><div class='ad'>buy</div><main><p>t</p><aside>s</aside></main></body>", "t"), ("<script>var t='</p>';</script><!-- <p>no</p> --><p>yes", "yes"), ("<article><p>a</p><div class=comments><p>c</p></div><form>q</form></article>", "a"),
        ("<article><header><h1>t</h1></header><p>a</p><footer>f</footer></article>", "t\na"), ("<p>1 &lt; 2 & 3 < 4", "1 < 2 & 3 < 4"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<article class=comment>c</article><article>main</article>", "main"), ("<title>t", ""), ("<p>caf&eacute;&#33;&#x21;", "café!!"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"), ("<p>a<table><tr><td><p>b</table>c", "a\nb\nc"), ("<div><p>a</div></p></i>b", "a\nb"),
    ],
)
def test_text_of_a_page(source, expected):
    assert text_by_rules(source) == expected
    assert page_text(source, "http://h/x", lambda hashes: [False] * len(hashes)) == (expected, 0)


def test_hosts():
    assert [host_of(u) for u in ("https://A.b:80/x", "//c/", None, "x", "ftp://u:p@D.e?q")] == ["a.b", "c", "", "", "d.e"]


def brute(rows):
    """Templates by comparing pages in plain Python, straight from the definition."""
    stand, whole = defaultdict(set), defaultdict(set)
    weak = defaultdict(bool)
    for _, url, source in rows:
        if source is None:
            continue
        found, page = subtrees(host_of(url), parse(source))
        whole[host_of(url)].add(page)
        for x in found:
            stand[host_of(url), x.hash].add(x.page)
            weak[host_of(url), x.hash] |= x.weak
    gone = set()
    for (host, h), pages in stand.items():
        share = html_text.MIN_SHARE_TEXT if weak[host, h] else html_text.MIN_SHARE
        if len(pages) >= html_text.MIN_PAGES and len(pages) >= share * len(whole[host]):
            gone.add(h)
    return {(i, u): page_text(s, u, lambda hashes: [h in gone for h in hashes]) for i, u, s in rows}


def site(n=12):
    rows = []
    for i in range(n):
        rows.append((i, f"http://a.com/{i}", f"<body><div><p>Welcome to our site</p><b>x</b></div><section><p>story {i} word and more of it</p><p>shared line</p></section><div><i>variant {i % 3}</i></div></body>"))
        rows.append((100 + i, f"http://b.com/{i}", "<body><article><p>copied</p><p>story</p></article><div>end</div></body>"))
        # copies of an article without any declaration, under other dates and links
        rows.append((300 + i, f"http://c.com/{i}", f"<body><div>menu of c</div><div><p>one long copied article text</p><p>its second paragraph</p></div><div>seen on day {i}</div></body>"))
        rows.append((400 + i, f"http://c.com/o{i}", f"<body><div>menu of c</div><div><p>another text number {i} {'z' * i}</p></div><div>seen on day {i}</div></body>"))
    return rows + [(200, None, "<div>alone</div>"), (201, "http://a.com/z", None), (200, None, "<div>alone</div>"), (202, "", "")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_template_subtrees int")


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_templates_go_and_copies_stay(spark, monkeypatch, limit):
    monkeypatch.setattr(html_text, "BROADCAST_TEMPLATES", limit)
    rows = site()
    found = extract_text(frame(spark, rows)).collect()
    got = {r.page_id: r.text for r in found}
    assert got[3] == "story 3 word and more of it" and got[103] == "copied\nstory" and got[200] == "alone" and got[201] == ""
    assert got[305].startswith("one long copied article text\nits second paragraph") and "menu" not in got[305]
    assert got[407].startswith("another text number 7") and "menu" not in got[407]
    assert sorted((repr(r.page_id), r.url or "", r.text, r.n_template_subtrees) for r in found) == sorted((repr(i), u or "", *brute(rows)[i, u]) for i, u, _ in rows)
    assert extract_text(frame(spark, rows).limit(0)).collect() == []


def test_test_pages_against_brute_force_and_without_counting(spark):
    """On the test pages templates are found and deleted; where pages do not declare their parts, counting decides."""
    table = spark.read.parquet(PAGES).where("url like '%//blog.tionsh.example.com/%'")  # its largest host
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    want = brute(rows)
    assert {(r.page_id, r.url): (r.text, r.n_template_subtrees) for r in extract_text(table).collect()} == want
    plain = [(i, u, s.replace("<nav", "<div").replace("</nav", "</div").replace("<footer", "<div").replace("</footer", "</div").replace('class="ad"', "").replace("<article", "<div").replace("</article", "</div")) for i, u, s in rows]
    counted = {(r.page_id, r.url): r for r in extract_text(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()}
    alone = {(i, u): text_by_rules(s) for i, u, s in plain}
    changed = [k for k, r in counted.items() if r.text != alone[k]]
    assert len(changed) > 100 and all(counted[k].n_template_subtrees for k in changed)
    for k in changed:  # what went is a template, never the article
        assert want[k][0].split("\n")[0] in counted[k].text


def test_deep_and_long_pages_take_linear_time():
    def seconds(source):
        start = time.perf_counter()
        page_text(source, "http://h/", lambda hashes: [False] * len(hashes))
        return time.perf_counter() - start

    for make in (lambda n: "<div>x" * n, lambda n: "<p>" + "<span>" * n + "<h1></h1>" * n, lambda n: "<object><p>" + "<i>" * n + "</b>" * n, lambda n: "<p>words here</p>" * n):
        seconds(make(1000))
        assert seconds(make(40_000)) < 12 * max(seconds(make(10_000)), 0.05)
    assert page_text("<div>" * 50_000 + "deep", None, lambda hashes: [False] * len(hashes))[0] == "deep"
