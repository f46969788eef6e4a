import html
import re

import pytest

from loomtext.llm import html_text

TREE = html_text.grow(html_text.TABLE)
BODY = "This is a paragraph of running text that goes on for quite a while, as paragraphs of articles do, with some more words to it."


def text(page):
    return html_text.main_text(page, TREE)


def test_tree_fits_its_table():
    assert all((html_text.share_of(TREE, list(r[:-1])) > 0.5) == bool(r[-1]) for r in html_text.TABLE)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<html></html>", ""),
        (f"<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>{BODY}<p>Be. So.<br>x &lt;y&gt;\n z</article><footer>&copy; me</footer>", f"A & B\n\n{BODY}\n\nBe. So. x <y> z"),
        (f"<header><h2>Site</h2></header><main><p>{BODY}</p></main><aside><p>{BODY}</p></aside>", BODY),
        (f"<article><p>{BODY}</p><div class='comments'><p>Nice words, I like all of this a lot</p></div><form>Name <input></form></article>", BODY),
        (f"<div class='cookie-notice'>{BODY}</div><div id=content><h2>Title here</h2><p>{BODY}</p></div><div class='sidebar'>{BODY}</div>", f"Title here\n\n{BODY}"),
        (f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div><p>{BODY}</p><p>{BODY}</p></div><div>Terms of use</div>", f"{BODY}\n\n{BODY}"),
        (f"<article><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>no --><p title='a > b'>{BODY}</p></article>", BODY),
        (f"<article><p>a < b and <b>bold</b>er&#33; {BODY}</p></article", f"a < b and bolder! {BODY}"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_long_and_broken_pages():
    assert text("<" * 100_000) == ""  # nothing but signs, no sentence
    assert len(text(f"<article><p>{BODY * 3000}")) == len(BODY) * 3000
    assert text("<p" * 50_000) == ""


def test_table(spark):
    rows = html_text.op10(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", article)]
        assert r["text"] == "\n\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def erased(page):
    """The page with every element's role taken away: blocks are plain div, links stay."""
    page = re.sub(r"(?s)<(script|style)\b.*?</\1>", "", page)
    return re.sub(r"<(/?)(?:nav|ul|li|article|h1|footer|div)\b[^>]*>", r"<\1div>", page)


def test_words_and_links_decide(spark):
    """Without any markup but plain blocks and links, the tree finds the same text."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()
    assert len(rows) == 2500
    same = sum(text(erased(r["html"])) == text(r["html"]) for r in rows)
    assert same >= 0.995 * len(rows)


def test_blocks_by_brute_force(spark):
    """Block texts and link densities, against a parser of the standard library."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.now, self.link, self.off = [], [], 0, 0

        def cut(self):
            whole = "".join(t for t, _ in self.now)
            if whole.split():
                size = lambda x: len("".join(x.split()))
                self.blocks.append((" ".join(whole.split()), size("".join(t for t, a in self.now if a)) / size(whole)))
            self.now, self.link = [], 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title"):
                self.off += 1
            elif tag == "a":
                self.link = 1
            elif tag == "br":
                self.now.append((" ", self.link))
            elif tag in html_text.BLOCKS:
                self.cut()

        def handle_endtag(self, tag):
            if tag in ("script", "style", "title"):
                self.off -= 1
            elif tag == "a":
                self.link = 0
            elif tag in html_text.BLOCKS:
                self.cut()

        def handle_data(self, data):
            if not self.off:
                self.now.append((data, self.link))

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        plain = Plain()
        plain.feed(r["html"])
        plain.close()
        plain.cut()
        own = html_text.blocks_of(r["html"])
        assert [b.text for b in own] == [t for t, _ in plain.blocks]
        assert [b.links for b in own] == pytest.approx([x for _, x in plain.blocks])
        kept = [html_text.share_of(TREE, f) > 0.5 and not b.aside for f, b in zip(html_text.features_of(own), own)]
        assert text(r["html"]) == "\n\n".join(t for (t, _), k in zip(plain.blocks, kept) if k)


def test_repeated_rows_long_page_and_missing_column(spark):
    page = f"<article><h1>Title of it</h1>{'<p>' + BODY + '</p>'}" * 4000
    d = spark.createDataFrame([(1, "u", page, "t")] * 3 + [(None,) * 4] * 2, "page_id long, url string, html string, n_chars string")
    rows = [r["text"] for r in html_text.extract(d).collect()]
    assert len(rows) == 5 and len(set(rows)) == 2 and max(map(len, rows)) >= 4000 * len(BODY)
    assert html_text.extract(d.drop("html")).first()["text"] == ""


def test_extra_columns_and_empty(spark):
    d = spark.createDataFrame([(1, "u", f"<article><p>{BODY}</article>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(r[0] for r in html_text.extract(d).select("text").collect()) == ["", BODY]
    assert html_text.extract(d.limit(0)).count() == 0


LONG = " ".join(f"word{k}" for k in range(60))
TWO = f"<p>{LONG}</p><p>{LONG} again</p>"


@pytest.mark.parametrize(
    "around",
    ['<div class="layout has-sidebar">', '<div class="page with-share-bar">', '<section class="post tags-on">', '<div id="content" class="no-cookie-banner">', '<div class="elementor-widget-text">', "<form>", '<div class="post-and-comments">'],
)
def test_an_element_that_is_the_page(around):
    tree = html_text.grow(html_text.TABLE)
    name = around[1:].split()[0].rstrip(">")
    want = f"{LONG}\n\n{LONG} again"
    assert html_text.main_text(f"{around}{TWO}</{name}>", tree) == want
    assert html_text.main_text(f'<nav><a href="/">Home</a></nav>{around}{TWO}</{name}><footer>All rights reserved by us</footer>', tree) == want


def test_what_stands_beside_goes():
    tree = html_text.grow(html_text.TABLE)
    article = f"<article>{TWO}</article>"
    want = f"{LONG}\n\n{LONG} again"
    for aside in (f'<div class="comment-list"><p>{LONG} yes</p><p>{LONG} no</p></div>', f'<section id="comments">{TWO * 9}</section>', f'<div class="site-sidebar"><p>{LONG}</p></div>', f"<form><p>{LONG}</p></form>"):
        assert html_text.main_text(article + aside, tree) == want
    # nothing but what stands beside
    assert html_text.main_text(f'<div class="cookie-notice"><p>{" ".join(LONG.split()[:30])}</p></div>', tree) == ""
    assert html_text.main_text(f"<footer>{TWO}</footer>", tree) == ""


def test_a_bare_menu():
    tree = html_text.grow(html_text.TABLE)
    for links in (1, 2, 5):
        menu = "<ul>" + '<li><a href="/">Home</a></li>' * links + "</ul>"
        assert html_text.main_text(menu + f"<div>{TWO}</div>", tree) == f"{LONG}\n\n{LONG} again"
