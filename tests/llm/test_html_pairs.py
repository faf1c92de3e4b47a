"""op9 against plain versions that share no code with it."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from conftest import DATA

from threadloom.llm import html, queries

PAGE = "page_id long, url string, html string"


class Article(HTMLParser):
    """The text inside article, blocks apart."""

    BLOCKS = {"p", "h1", "br", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts += ["\n"] if tag in self.BLOCKS else []

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts += ["\n"] if tag in self.BLOCKS else []

    def handle_data(self, data):
        self.parts += [data] if self.inside else []

    def text(self):
        blocks = (" ".join(x.split()) for x in "".join(self.parts).split("\n\n"))
        return " ".join(" ".join(blocks).split())


def article(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    return parser.text()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op9_keeps_whole_articles(spark, small, sf):
    """On the given pages an article element holds the article and nothing else."""
    folder = f"{DATA}/{sf}"
    pages = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op9_page_differencing(spark, folder).collect()}
    assert got == {r["page_id"]: (r["url"], article(r["html"]), len(article(r["html"]))) for r in pages} and len(got) == len(pages)


def longest(a, b):
    """A table of lengths of common subsequences, the textbook way; the indices of ``a`` in one."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain(pages):
    """{page_id: text} of pages that are only <p> lines: each beside the nearest pages of its host with other lines."""
    rows = []
    for page_id, url, text in pages:
        m = re.match(r"http://([^/]*)(.*)", url or "")
        lines = [" ".join(x.split()) for x in (text or "").split("<p>")]
        rows.append((m[1], m[2], page_id, [x for x in lines if x]))
    rows.sort(key=lambda r: r[:3])
    out = {}
    for k, (host, _, page_id, own) in enumerate(rows):
        found = []
        for side in (range(k - 1, -1, -1), range(k + 1, len(rows))):
            other = next((rows[j] for j in side if rows[j][0] != host or rows[j][3] != own), None)
            if other and other[0] == host:
                found.append(longest(own, other[3]))
        gone = set.intersection(*found) if found else set()
        out[page_id] = " ".join(x for i, x in enumerate(own) if i not in gone or len(gone) == len(own))
    return out


def extracted(spark, pages, parts=3):
    return {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, PAGE).repartition(parts)).collect()}


def test_differencing_against_a_plain_version(spark):
    """Runs of copies over several ranges, hosts with one page. Lines of a page don't repeat, so the subsequence is the only longest one."""
    rng = random.Random(8)
    pages = []
    for i in range(300):
        host, k = rng.choice("abbbbcde"), rng.randrange(6)
        body = f"<p>own {k if rng.random() < 0.6 else i} {'text ' * (k + 1)}<p>Shared A<p>Shared {host}<p>Shared B{'<p>Now and then' * (rng.random() < 0.2)}"
        pages.append((i, f"http://{host}.com/{k // 2}/{k}", body))
    pages += [(1000 + i, "http://f.com/x", "<p>copy<p>of a page") for i in range(40)] + [(2000, "http://f.com/y", "<p>of a page<p>last"), (2001, "http://g.com", None), (2002, "http://h.com/a", "<p>same<p>x"), (2003, "http://h.com/b", "<p>same")]
    want = plain(pages)
    assert extracted(spark, pages) == want
    old = html.SENT_LINES
    try:
        html.SENT_LINES = 0
        assert extracted(spark, pages, 7) == want
    finally:
        html.SENT_LINES = old


def test_article_loses_template_boxes_alone(spark):
    page = "<article><h1>Title</h1><p>The same first line<p>{0} {0} stands here alone<ul><li>a list</ul><div class='read-on'>Go on to page two</div><div class='fact'>{0}</div><div class='fact'>as is</div></article>"
    got = extracted(spark, [(i, f"http://a.com/{i}", page.format(w)) for i, w in enumerate(("red", "green", "blue"))])
    assert got[1] == "Title The same first line green green stands here alone a list green as is"
    assert got[0].endswith("a list Go on to page two red as is")  # one neighbour says too little
    # what stands on three pages is no template if the article does
    same = extracted(spark, [(i, f"http://a.com/{i}", page.format("red") + f"<p>below {i}") for i in range(3)])
    assert len(set(same.values())) == 1 and "Go on to page two" in same[1]


def test_long_template_and_copies(spark):
    """Most of a page is template, and the neighbour in order is a copy of it."""
    template = "".join(f"<p>menu entry number {i} of the template" for i in range(20))
    pages = [(1, "http://a.com/p/1", template + "<p>short one"), (2, "http://a.com/p/2", template + "<p>short one"), (3, "http://a.com/p/3", template + "<p>short three")]
    assert extracted(spark, pages) == {1: "short one", 2: "short one", 3: "short three"}
    # a near copy between doesn't take the article along
    long = "<p>A long article of many words that stands on two pages of the host"
    pages = [(1, "http://a.com/p/1", "<p>Menu" + long + "<p>a"), (2, "http://a.com/p/2", "<p>Menu" + long + "<p>b"), (3, "http://a.com/p/3", "<p>Menu<p>Another")]
    assert extracted(spark, pages)[2] == "A long article of many words that stands on two pages of the host b"
    # the same line in another element is another line
    pages = [(i, f"http://b.com/{i}", f"<p>own {i}<p class=x>News" if i != 1 else "<p>own 1<p>News") for i in range(3)]
    assert extracted(spark, pages)[1] == "own 1 News"
