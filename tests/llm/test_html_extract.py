from __future__ import annotations

import math

import numpy as np
import pytest

from sparkvane.llm.html_extract import extract, main_text

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b> text, and <a href='/x'>a link</a>.</p><p>Second\n  line &lt;here&gt; &eacute;.</p></article>"
TEXT = "Title & more First bold text, and a link. Second line <here> é."
FURNITURE = [
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav>",
    "<header><h2>Site name</h2></header>",
    "<div class='ad'>Buy this now, a very long advert that goes on and on and on and on and on and on and on.</div>",
    "<aside><p>Side note that is long enough to look like text, really long, longer than the article, as long as can be.</p></aside>",
    "<div id='sidebar'><p>Sidebar words sidebar words sidebar words sidebar words</p></div>",
    "<div class='cookie-notice'>We use cookies</div>",
    "<form><label>Mail</label><input name=m><button>Send</button></form>",
    "<script>var t = '</p><p>no</p>';</script>",
    "<style>p { margin: 0 }</style>",
    "<!-- a <p>comment</p> -->",
    "<section class='comments'><p>Reader comment one, which is quite long and chatty, as those are.</p><p>Another one.</p></section>",
    "<div id=comments><article class=comment><p>Nested comment</p></article></div>",
    "<footer>&copy; someone</footer>",
    "<noscript>Turn scripts on</noscript>",
]


@pytest.mark.parametrize("piece", FURNITURE)
def test_furniture_goes_around_the_article(piece):
    for before, after in ((piece, ""), ("", piece), (piece, piece)):
        assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{ARTICLE}{after}</body></html>") == TEXT


@pytest.mark.parametrize("piece", [f for f in FURNITURE if "<header" not in f])
def test_furniture_goes_inside_the_article(piece):
    page = ARTICLE.replace("</h1>", "</h1>" + piece)
    assert main_text(f"<html><body>{page}</body></html>") == TEXT


STRAY = ["<div class='reader-comments'><p>Nice article, I really liked it a lot, thanks!</p><p>More of this please, dear author.</p></div>",
"<div class='site-header'><a href=/>Logo</a> The site</div>","<div id='top-menu'><ul><li><a href=/>a</a></ul></div>","<div class='google-ads'>Buy buy buy buy buy</div>",
"<div class=site-notice>We changed our terms of use last week, please read them</div>","<ins class=adsbygoogle>Ad text</ins>","<div style='display: none'>hidden words</div>",
"<div class='leftSidebar'>Links: <a href=/a>a</a></div>","<div class='post-comments'>A comment</div>","<div role=alert>Alert text</div>","<ol class='comment-list'><li>c1<li>c2</ol>","<p class=copyright>(c) 2020</p>",
"<div class='cookie-banner'><p>This site uses cookies, lots of them, and you should agree.</p><button>OK</button></div>","<form class=search><input></form>","<select><option>x</select>","<iframe src=x>fallback</iframe>","<div aria-hidden='true'>x</div>", "<section id='respond'><h3>Leave a reply</h3></section>","<div class='advertisement-box'>Ad</div>","<div class='alert alert-warning'>Outdated browser</div>"]
HOLDERS = {"article":"<article>%s</article>","main":"<main>%s</main>","article in main":"<main><article>%s</article></main>","post":"<div class='post-content'>%s</div>","plain":"<div>%s</div>","id":"<div id=content>%s</div>", "wrapped":"<div class='layout with-sidebar'><div class=inner><article class='post has-comments'>%s</article></div></div>","genesis":"<div class='content-sidebar-wrap'><main>%s</main></div>"}


@pytest.mark.parametrize("holder", HOLDERS)
@pytest.mark.parametrize("piece", STRAY)
def test_furniture_by_class(holder, piece):
    h1, rest = "<h1>Title</h1>", "<p>First paragraph of some text that is long.</p><p>Second one, also long enough to count as text.</p>"
    held = HOLDERS[holder] % (h1 + rest)
    pages = [piece + held, held + piece]
    if "header" not in piece:  # a header inside is the article's own
        pages.append(HOLDERS[holder] % (h1 + piece + rest))
    for page in pages:
        assert main_text(f"<html><head><title>x</title></head><body>{page}</body></html>") == "Title First paragraph of some text that is long. Second one, also long enough to count as text."


def test_all_furniture_at_once():
    page = "".join(FURNITURE[:7]) + ARTICLE + "".join(FURNITURE[7:])
    assert main_text(f"<html><body>{page}") == TEXT


def test_density_finds_text_without_an_article():
    links = "".join(f"<li><a href='/{i}'>Entry number {i}</a></li>" for i in range(30))
    text = "".join(f"<p>Paragraph {i} has some running text in it, more than a link would.</p>" for i in range(8))
    got = main_text(f"<html><body><div><ul>{links}</ul></div><div id=main><div class=x>{text}</div></div><div><ul>{links}</ul></div></body></html>")
    assert got == " ".join(f"Paragraph {i} has some running text in it, more than a link would." for i in range(8))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a<br>b<p>c", "a b c"),
        ("<body><p><b>x<br><p>y</p></body>", "x y"),
        ("<ul><li>a<li>b</ul>", "a b"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("a &amp;amp; b &#x41; &am", "a &amp; b A &am"),
        ("<div title='a > b'>x</div>", "x"),
        ("<p>un<b>brok</b>en</p>", "unbroken"),
        ("<", "<"),
        ("</p>", ""),
        ("<script>", ""),
    ],
)
def test_markup(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert len(main_text("<article><p>" + "word " * 200_000 + "</article>")) == 5 * 200_000 - 1


def test_extract(spark):
    rows = [(1, "u", f"<body>{ARTICLE}</body>", "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", f"<body>{ARTICLE}</body>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [("1", TEXT, len(TEXT)), ("1", TEXT, len(TEXT)), ("2", "", 0), ("None", "", 0)]
    assert extract(pages.limit(0)).count() == 0


def test_driver_pages_give_their_article(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


PARAS = [f"Paragraph {i} has some running text in it, more than a teaser of the front page would." for i in range(8)]


@pytest.mark.parametrize("teaser", ["Short teaser {}", "<a href='/{}'>Entry with a link</a> and few words"])
@pytest.mark.parametrize("wrap", ["<div id=wrap>%s</div>", "<div id=page><div class=wrap>%s</div></div>"])
def test_densest_subtree_decides_inside_one_wrapper(wrap, teaser):
    teasers = "<div class=c1>" + "".join(f"<p>{teaser.format(i)}</p>" for i in range(12)) + "</div>"
    text = "<div class=c2>" + "".join(f"<p>{p}</p>" for p in PARAS) + "</div>"
    for inside in (teasers + text, text + teasers, teasers + text + teasers):
        assert main_text(f"<html><body>{wrap % inside}</body></html>") == " ".join(PARAS)


def test_heading_and_dense_siblings_of_the_densest_subtree_stay():
    text = "<div class=c2>" + "".join(f"<p>{p}</p>" for p in PARAS[:5]) + "</div><div class=c3>" + "".join(f"<p>{p}</p>" for p in PARAS[5:]) + "</div>"
    teasers = "<div class=c1>" + "".join(f"<p><a href='/{i}'>Entry {i}</a></p>" for i in range(12)) + "</div>"
    page = f"<html><body><div id=wrap><h1>Title</h1>{teasers}{text}</div></body></html>"
    assert main_text(page) == " ".join(["Title", *PARAS])


OWN = [
    "<section id='discussion'><h2>Discussion</h2><p>The figures agree with the first trial.</p></section>",
    "<section id='discussion'><p>The figures agree with the first trial.</p></section>",
    "<section id='related-work'><h2>Related work</h2><p>Others have counted before, with <a href=/x>one table</a> less.</p></section>",
    "<h2 id='Legal_status'>Legal status</h2><p>It is allowed.</p>",
    "<h2 class='section-header share'>Market share</h2><p>It grows.</p>",
    "<div id='social-effects'>Social effects are small and late.</div>",
    "<p title='the hidden cost'>Costs are <b data-x='id=sidebar class=ad'>high</b>.</p>",
    "<section aria-label='Hidden figures'><p>They were found by hand.</p></section>",
]


@pytest.mark.parametrize("piece", OWN)
def test_sections_of_the_article_stay(piece):
    import re

    page = ARTICLE.replace("</article>", piece + "</article>")
    assert main_text(f"<html><body>{page}</body></html>") == TEXT + " " + " ".join(re.sub(r"</?(?:h2|p|section|div)[^>]*>", " ", re.sub(r"</?[ab]\b[^>]*>", "", piece)).split())


@pytest.mark.parametrize("piece", [
    "<section id='related'><h2>Related</h2><ul><li><a href=/a>One more article</a><li><a href=/b>And another</a></ul></section>",
    "<section id='comments'><h2>Comments</h2><p>I liked it, and I will say so at some length in here.</p></section>",
    "<p hidden>Not shown</p>", "<p class=x HIDDEN id=y>Not shown</p>", "<div id='social'><a href=/s>Share this</a></div>",
])
def test_furniture_of_the_article_still_goes(piece):
    assert main_text(f"<html><body>{ARTICLE.replace('</article>', piece + '</article>')}</body></html>") == TEXT


@pytest.mark.parametrize("inside", [ARTICLE, ARTICLE.replace("article>", "div>"), "<div><p>" + PARAS[0] + "</p><p>" + PARAS[1] + "</p></div>"])
def test_a_form_around_the_page_passes(inside):
    text = TEXT if "Title" in inside else f"{PARAS[0]} {PARAS[1]}"
    form = f"<form method=post action='./x.aspx'><input type=hidden name=s value=1><nav><a href=/>Home</a></nav>{inside}<form><label>Mail</label><input></form></form>"
    page = f"<html><body>{form}</body></html>".replace("<form><label>Mail</label><input></form>", "")
    assert main_text(page) == text
    assert main_text(f"<html><body>{ARTICLE}<form hidden>{inside}</form></body></html>") == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>one</p><svg/><p>two</p></article>", "one two"),
        ("<article><p>one</p><math class='x/y' /><p>two</p><svg viewBox='0 0 1 1'><text>no</text></svg></article>", "one two"),
        ("<article><p>&not<i>in</i>; &amp<b>lt;</b></p></article>", "¬in; &lt;"),
        ("<p>a <a href=/x/>link</a> b</p>", "a link b"),
    ],
)
def test_foreign_elements_and_split_references(page, text):
    assert main_text(page) == text


def test_all_articles_of_a_page():
    """Articles that are as dense as the way to the densest; cards and comments are not."""
    first, second = ("".join(f"<p>{w} paragraph {i} has some running text in it, more than a teaser would.</p>" for i in range(4)) for w in ("First", "Second"))
    text = " ".join(f"{w} paragraph {i} has some running text in it, more than a teaser would." for w in ("First", "Second") for i in range(4))
    cards = "".join(f"<article class=card><h3><a href='/{i}'>Another story {i}</a></h3><a href='/{i}'><b>Read</b> <i>more</i></a></article>" for i in range(6))
    for page in (
        f"<main><article>{first}</article><article>{second}</article></main>",
        f"<div><article>{first}</article><div>{cards}</div></div><div class=x><article>{second}</article></div>",
        f"<article>{first}</article>{cards}<article>{second}</article><div id=comments><article><p>A reader's comment that runs on for quite a while, as they do.</p></article></div>",
    ):
        assert main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}</body></html>") == text
    assert main_text(f"<html><body><article>{first}</article>{cards}</body></html>") == text[: text.index(" Second")]


class Plain:
    """A page of div, p and a elements, by the definition alone: every figure is counted anew."""

    def __init__(self, rng, depth=0):
        self.tag, self.kids, self.parent = "div", [], None
        for _ in range(rng.integers(1, 5)):
            kid = Plain(rng, depth + 1) if depth < 3 and rng.random() < 0.5 else Plain.paragraph(rng)
            kid.parent = self
            self.kids.append(kid)

    @classmethod
    def paragraph(cls, rng):
        p = cls.__new__(cls)
        p.tag, p.kids, p.parent = "p", [], None
        for _ in range(rng.integers(1, 4)):
            words = " ".join("w" * int(n) for n in rng.integers(1, 9, rng.integers(1, 30)))
            if rng.random() < 0.4:
                a = cls.__new__(cls)
                a.tag, a.kids, a.parent, words = "a", [words], p, a
            p.kids.append(words)
        return p

    def html(self):
        return f"<{self.tag}>" + " ".join(k if isinstance(k, str) else k.html() for k in self.kids) + f"</{self.tag}>"

    def nodes(self):
        return [self, *(n for k in self.kids if not isinstance(k, str) for n in k.nodes())]

    def elements(self):
        return [k for k in self.kids if not isinstance(k, str)]

    def text(self):
        return " ".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def density(self, body):
        def chars(t):
            return len("".join(t.split()))

        links, top = [n for n in self.nodes() if n.tag == "a"], [n for n in body.nodes() if n.tag == "a"]
        c, lc, t, lt = chars(self.text()), sum(chars(n.text()) for n in links), len(self.nodes()) - 1, len(links)
        ratio = sum(chars(n.text()) for n in top) / (chars(body.text()) or 1)
        base = math.log(c / ((c - lc) or 1) * (lc or 1) + ratio * c + math.e)
        return c / (t or 1) * math.log(max(1.0, c / (lc or 1) * (t or 1) / (lt or 1)) + 1e-9) / math.log(base + 1) if c else 0.0

    def total(self, body):
        return sum(k.density(body) for k in self.elements())

    def main(self):
        best = max(self.nodes(), key=lambda n: n.total(self))
        way, n = [], best
        while n is not None:
            way.append(n)
            n = n.parent
        threshold, kept = min(x.density(self) for x in way), [best]

        def hang(n):
            if n not in kept and n.density(self) >= threshold:
                kept.append(max(n.nodes(), key=lambda x: x.total(self)))
                for k in n.elements() if n not in kept else ():
                    hang(k)

        for x in way[1:]:
            for k in x.elements():
                if k not in way:
                    hang(k)
        whole = [n for n in kept if not any(n is not k and n in k.nodes() for k in kept)]
        return " ".join(n.text() for n in self.nodes() if n in whole)


@pytest.mark.parametrize("seed", range(60))
def test_against_the_definition(seed):
    page = Plain(np.random.default_rng(seed))
    page.tag = "body"
    page.kids = [k for k in page.kids if k.tag == "div"] or page.kids
    assert main_text(f"<html>{page.html()}</html>") == " ".join(page.main().split())
