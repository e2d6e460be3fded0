"""HTML extraction and document fingerprints."""

import random
import re
from html import unescape

import numpy as np
import pytest

from seedweave.llm import fingerprint as fp
from seedweave.llm.html import extract_pages, main_text
from seedweave.session import table
from tests.llm import brute
from tests.llm.conftest import ODD, SF, SMALL


@pytest.mark.parametrize("sf", [SMALL, SF, SF.replace("0.01", "0.1")])
def test_articles_of_pages(spark, sf):
    """The pages' own article elements, cut out by pattern."""
    pages = table(spark, sf, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = extract_pages(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n\n".join(x for x in blocks if x)
        assert r["n_chars"] == len(r["text"])


LONG = "This sentence has enough words to look like the text of an article, and it goes on for a while. " * 3
PAGE = f"""<!doctype html><html><head><title>no</title><style>p{{}}</style></head><body class="page menu-open">
<div id="top-menu"><a href="/a">Home</a> <a href="/b">News</a></div><div class="cookie-notice">We use cookies. {LONG}</div>
<div class="wrap"><div class="post"><h1>A &lt;Title&gt; &amp; more</h1><p>First&nbsp;{LONG}<p>Second   <b>bold</b> and <a href=x>a link</a>
 here. {LONG}<ul><li>point one<li>point two</ul><table><tr><td>x<td>y<tr><td>z</table><form>Sign <input> up</form>
<script>var p = "</p><p>no";</script><blockquote>Quoted {LONG}</blockquote></div>
<div class="sidebar">Side {LONG}</div><div id="comments"><p>Reader: {LONG}</div></div>
<footer>Foot {LONG}</footer><!-- <p>not this --></body></html>"""


def test_page_without_article_element():
    got = main_text(PAGE).split("\n\n")
    long = " ".join(LONG.split())
    assert got == ["A <Title> & more", f"First {long}", f"Second bold and a link here. {long}", "point one", "point two",
                   "x y", "z", f"Quoted {long}"]


@pytest.mark.parametrize("html,text", [
    ("", ""), (None, ""), ("plain text", "plain text"), ("<p>a", "a"), ("<", "<"), ("a < b > c", "a < b > c"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<a " * 200_000 + ">x</a>", "x"), ('<a "' * 100_001 + ">x", "x"),
    ("<script>var a='<p>'", ""), ("<article><p>only", "only"), ("<p>a<p></p>b</p>c<br>d", "a\n\nb\n\nc d"),
    ("<div>a<nav>n</nav>b</div>", "a\n\nb"), ("&#65;&copy;&amp;lt;", "A©&lt;"), ("<nav>only a menu</nav>", ""),
    ("<main><aside>x</aside><p>y</main>", "y"), ("<p hidden>x</p><p>y</p>", "y"), ("<!-- x", "<!-- x"),
    ("<article><div class='share-buttons'>no</div><p>yes</p><section class=comment-list>no</section></article>", "yes"),
])
def test_small_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<html><head><title>t</title><meta x><body><article><p>yes</article>", "yes"),
    ("<head><link x><article><p>yes</article>", "yes"), ("<head><title>t</title>yes", "yes"),
    ("<body><p class=notice>x<p>yes one<p>yes two</body>", "yes one\n\nyes two"),
    ("<div><ul><li class=share>x<li>yes one</ul><p>yes two</div>", "yes one\n\nyes two"),
    ("<article><ul><li class=share>x</ul><p>yes</article>", "yes"), ("<div><nav>n</div><p>yes</p>", "yes"),
    ("<article><table><tr><td class=ad>x<td>yes</table><p>and</article>", "yes\n\nand"),
    ("<article><button><div>x</button><p>yes</article>", "yes"), ("<nav>" * 30_000 + "x", ""),
])
def test_omitted_end_tags_of_left_out_elements(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html,text", [
    (f"<div class='layout has-sidebar'><article><p>{LONG}</article><div class=sidebar>{LONG}</div></div>", LONG),
    (f"<div id=page class=header-fixed><div><h1>T</h1><p>{LONG}</div></div>", "T\n\n" + LONG),
    (f"<div class='post comments-open'><p>{LONG}<p>{LONG}</div>", LONG + "\n\n" + LONG),
    (f"<div class=search-result-article><p>{LONG}</div><div class=ad>{LONG[:90]}</div>", LONG),
    (f"<article><h1 class=article-header>T</h1><p>{LONG}<p class=form-letter>{LONG * 3}</article>",
     f"T\n\n{LONG}\n\n{LONG * 3}"),
    (f"<div class=post><p>{LONG}<p>{LONG}</div><div id=comments><p>{LONG}</div>", LONG + "\n\n" + LONG),
])
def test_side_words_do_not_drop_the_article(html, text):
    tidy = lambda x: [" ".join(b.split()) for b in x.split("\n\n")]
    assert tidy(main_text(html)) == tidy(text)


ADVERT = "Buy three of our wonderful things today and get a fourth one free, while stocks last. "


@pytest.mark.parametrize("advert", [f"<div class=ad>{ADVERT * 3}</div>", f"<div class=ad><p>{ADVERT * 3}</p><p>{ADVERT}</div>",
                                    f"<div class='ad-box'><div><span>{ADVERT * 2}</span></div></div>"])
@pytest.mark.parametrize("page", [
    "<body>{ad}<article><h1>T</h1><p>A short text of one line.</article></body>",
    "<body><div id=top><div>{ad}<article><h1>T</h1><p>A short text of one line.</p>{ad}</article></div></div></body>",
    "<body><div class='layout has-sidebar'>{ad}<main><h1>T</h1><p>A short text of one line.</main></div></body>",
    "<body><h1>T</h1>{ad}<p>A short text of one line.</p></body>",
    "<body>{ad}<div><h1>T</h1><div>A short text of one line.</div></div></body>",
    "<body><div class='post comments-open'><h1>T</h1><p>A short text of one line.</p>{ad}</div></body>",
])
def test_adverts_longer_than_the_article(page, advert):
    assert main_text(page.format(ad=advert)) == "T\n\nA short text of one line."


def plain_density(node, body_links):
    """Density and density sum of nested (tag, children) lists, straight from the formula."""
    import math

    def count(x, link=False):
        if isinstance(x, str):
            k = len("".join(x.split()))
            return k, k if link else 0, 0, 0
        total = [0, 0, 0, 0]
        for child in x[1]:
            inside = link or not isinstance(child, str) and child[0] == "a"
            total = [a + b for a, b in zip(total, count(child, inside))]
            if not isinstance(child, str):
                total[2] += 1
                total[3] += child[0] == "a"
        return total

    def density(x, link):
        c, lc, t, lt = count(x, link)
        if not c:
            return 0.0
        t, lt, links = max(t, 1), max(lt, 1), max(lc, 1)
        base = math.log(c * links / max(c - lc, 1) + body_links * c + math.e)
        return c / t * math.log(max(c * t / (links * lt), 1.0)) / math.log(base)

    out = []

    def walk(x, link):
        link = link or x[0] == "a"
        inner = [child for child in x[1] if not isinstance(child, str)]
        out.append((density(x, link), sum(density(child, link or child[0] == "a") for child in inner)))
        for child in inner:
            walk(child, link)
    walk(node, False)
    return out, count


def test_densities_equal_the_formula():
    from seedweave.llm.html import Tree, densities, scores
    rnd = random.Random(9)

    def made(depth, link):
        if depth == 0 or rnd.random() < 0.2:
            return "word " * rnd.randint(0, 12)
        tag = rnd.choice(["div", "div", "section", "span", "b"] + ([] if link else ["a"]))
        return tag, [made(depth - 1, link or tag == "a") for _ in range(rnd.randint(0, 4))]

    def shown(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(shown, x[1]))}</{x[0]}>"
    for _ in range(60):
        page = ("#root", [made(5, False) for _ in range(3)])
        tree = Tree("".join(map(shown, page[1])))
        density, chars, link_chars = densities(tree)
        plain, count = plain_density(page, link_chars[0] / max(chars[0], 1))
        assert [chars[0], link_chars[0]] == list(count(page)[:2])
        assert density == pytest.approx([d for d, _ in plain])
        assert scores(tree, density) == pytest.approx([s or d / 2 for d, s in plain])


def test_links_inside_an_article_and_several_articles():
    long = " ".join(LONG.split())
    links = "".join(f"<li><a href=/{i}>Another story {i}</a>" for i in range(5))
    assert main_text(f"<article><p>{LONG}<p>{LONG}<ul>{links}</ul><ul><li>one<li>two</ul><p><a href=x>source</a></article>") \
        == f"{long}\n\n{long}\n\none\n\ntwo\n\nsource"
    two = f"<main><article><p>{LONG}<p>a {LONG}</article><article><p>b {LONG}<p>c {LONG}</article>" \
          f"<article><ul>{links}</ul></article></main>"
    for page in (two, two.replace("main>", "div>")):
        assert main_text(page) == f"{long}\n\na {long}\n\nb {long}\n\nc {long}"
    # Comments are told apart by a side word only.
    assert main_text(f"<article><p>{LONG}<p>{LONG}<div class=comments><p>{LONG}</div></article>") == f"{long}\n\n{long}"


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, "u", "<p>x", 2), (None, "u", "<p>x", 3), (2, "", "", 4),
                                (3, "v", f"<article><p>{'word ' * 100_000}</p></article>", 5)],
                               "page_id long, url string, html string, text int")
    assert brute.rows(extract_pages(df), "page_id", "url", "n_chars") == \
        [(None, "u", 1), (1, None, 0), (1, "u", 1), (2, "", 0), (3, "v", 499_999)]
    assert extract_pages(df.limit(0)).count() == 0


# fingerprints

def plain_cuts(data):
    """The rule byte by byte."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(fp.GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= fp.MIN and i + 1 < len(data) and (h < (fp.STRICT if n < fp.NORMAL else fp.LOOSE) or n == fp.MAX):
            out.append(i + 1)
            start = i + 1
    return out + [len(data)] if data else []


def test_cuts_equal_the_rule():
    rnd = random.Random(1)
    for n in [*range(0, 70), 300, 5000, 20_000]:
        data = bytes(rnd.choice(b"abcdefgh ") for _ in range(n))
        assert fp.cuts(data) == plain_cuts(data), n
    assert fp.cuts(b"a" * 1000) == plain_cuts(b"a" * 1000)


def test_likeness_follows_shared_text():
    rnd = random.Random(4)
    words = lambda n: " ".join(str(rnd.randint(0, 10**6)) for _ in range(n))
    a, b = words(2000), words(2000)
    f = fp.fingerprint
    assert fp.likeness(f(a), f(a)) == 1 and fp.likeness(f(a), f(b)) < 0.01
    assert fp.likeness(f(a), f("inserted at the front " + a)) > 0.97          # shifts move only the first cuts
    assert fp.likeness(f(a), f(b + a)) > 0.97                                    # containment
    assert abs(fp.likeness(f(a), f(a[:len(a) // 2] + b[:len(b) // 2])) - 0.5) < 0.05
    assert fp.likeness({}, {}) == 1 and fp.likeness({}, f(a)) == 0


def expected(pairs):
    """Rows in the order of the contract: ids downwards, nulls last, equal ids by the MD5 of their texts."""
    from hashlib import md5
    rows = sorted(((k, t or "") for k, t in pairs), key=lambda r: (r[0] is None, -(r[0] or 0), md5(r[1].encode()).hexdigest()))
    out = []
    for i, (key, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        changed = fp.edited(t, after)
        f, g = fp.fingerprint(t), fp.fingerprint(changed)
        out.append((key, len(t), brute.sha(changed), fp.shown(f), fp.shown(g), fp.likeness(f, g), fp.likeness(f, fp.fingerprint(after))))
    return brute.ordered(out)


COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_neighbours_of_documents(spark):
    docs = table(spark, SF, "documents")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert brute.rows(fp.neighbour_fingerprints(docs), *COLS) == expected(pairs)


def test_neighbours_of_odd_rows(odd_docs, no_docs, make_docs):
    assert brute.rows(fp.neighbour_fingerprints(odd_docs), *COLS) == expected(ODD)
    assert fp.neighbour_fingerprints(no_docs).count() == 0
    assert brute.rows(fp.neighbour_fingerprints(make_docs([(5, "alone")])), "doc_id", "near_next") == [(5, 1.0)]
    nulls = [(None, "a"), (None, "b"), (None, "a")]
    assert brute.rows(fp.neighbour_fingerprints(make_docs(nulls)), *COLS) == expected(nulls)


def test_gear_table_is_fixed():
    assert fp.GEAR.dtype == np.uint32 and len(set(fp.GEAR.tolist())) == 256
