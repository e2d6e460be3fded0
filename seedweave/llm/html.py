"""Main-text extraction by composite text density.

For every DOM node: C characters and T tags below it, LC and LT those in links.
Its density is characters per tag, damped by how much of it is links and by how
much of the whole body is links. A node's score is the sum of its children's
densities; the subtree with the highest score is the article's core. The smallest
density on the path from the core up to the body is the threshold: on the way up,
siblings that reach it, headings beside the text and the rest of an enclosing
``article`` or ``main`` element belong to the article.

Elements that are never article text (scripts, menus, forms, hidden ones) are left out
of the tree and of the counts. Blocks whose class or id says advert, comments and so on
are taken out after a first look at the densities, unless they hold the article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table "
                   "tbody tfoot thead tr ul").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | {"p", "pre"}
LINK_BLOCKS = frozenset("article div section ul ol dl table".split())
NEVER = frozenset(("script style textarea title iframe noembed noframes xmp noscript template head nav header footer aside "
                   "form button select option input label svg math canvas object embed audio video dialog menu").split())
# Class and id words of blocks that may not be article text, and roles of those that are not.
SIDE_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related "
    "recommended recommendations share sharing social comment comments commentlist disqus reply replies respond footer "
    "header masthead topbar toolbar pagination pager copyright disclaimer hidden search form").split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ENDS_P = BLOCK - {"body"}
SCOPE = frozenset("body table td th caption button object article main section div blockquote ul ol dl".split())
# Opening one of these closes an open element of the set, up to the given containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}

# A comment, a tag with its attributes (a quoted value may hold ">"; with an odd quote the tag ends at the next ">"), a declaration.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+(?=>)|[^>]*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"']+)|([^\s=/"']+)""")


def is_side(tag: str, attributes: str) -> bool:
    """Whether an element is left out with all it contains: by its tag, or because it is hidden or has such a role."""
    if tag in NEVER:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value, bare in ATTRIBUTE.findall(attributes):
        name = (name or bare).lower()
        value = value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in SIDE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def is_doubtful(attributes: str) -> bool:
    """Whether a word of the class or id says that an element may be no article text."""
    return any((name or bare).lower() in ("class", "id") and not SIDE_WORDS.isdisjoint(re.split(r"[^a-z]+", value.lower()))
               for name, value, bare in ATTRIBUTE.findall(attributes or ""))


class Tree:
    """Elements in page order (``tag``, ``parent``, ``doubt``: a side word in class or id) and text pieces (``text``: node, number of its block, piece)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.doubt, self.text = ["#root"], [-1], [False], []
        self.block = 0                         # grows whenever a block element begins or ends
        self.open: list[tuple[str, int | None]] = [("#root", 0)]     # no node: left out, or below such an element
        self.n_open: Counter[str] = Counter()
        at, end_of_tags = 0, html.rfind(">") + 1
        while at < len(html):
            m = TOKEN.search(html, at, end_of_tags) if at < end_of_tags else None
            piece = html[at:m.start()] if m else html[at:]
            if piece:
                if self.open[-1][0] == "head" and not piece.isspace():
                    self.close({"head"}, ())
                self.say(unescape(piece))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            self.block += tag in BLOCK
            if tag in RAW and not m[1]:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif not m[1]:
                self.begin(tag, m[3])
            elif tag not in VOID:
                self.close({tag}, () if tag in BLOCK or tag in NEVER else BLOCK)

    def say(self, piece: str) -> None:
        if self.open[-1][1] is not None:
            self.text.append((self.open[-1][1], self.block, piece))

    def close(self, names, barriers) -> None:
        """Close the innermost open element of ``names`` unless a barrier is nearer."""
        if not any(self.n_open[t] for t in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            t = self.open[k][0]
            if t in names:
                self.block += any(x in BLOCK for x, _ in self.open[k:])
                self.n_open.subtract(x for x, _ in self.open[k:])
                del self.open[k:]
                return
            if t in barriers:
                return

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "body" or self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.close({"head"}, ())           # its end tag may be omitted
        if tag in ENDS_P:
            self.close({"p"}, SCOPE)
            if tag in HEADINGS:
                self.close(HEADINGS, SCOPE)
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag in VOID or tag in ("td", "th"):
            self.say(" ")
        parent, node = self.open[-1][1], None
        if parent is not None and not is_side(tag, attributes):
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(parent)
            self.doubt.append(tag not in ("html", "body") and is_doubtful(attributes))
        if tag not in VOID:
            self.open.append((tag, node))
            self.n_open[tag] += 1


def densities(tree: Tree) -> tuple[list[float], list[int], list[int]]:
    """Composite text density, characters and link characters of every node."""
    n = len(tree.tag)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for i, _, piece in tree.text:
        k = len("".join(piece.split()))
        chars[i] += k
        if in_link[i]:
            link_chars[i] += k
    for i in range(n - 1, 0, -1):              # children come after their parents
        p = tree.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    body = link_chars[0] / max(chars[0], 1)
    out = []
    for c, lc, t, lt in zip(chars, link_chars, tags, link_tags):
        if not c:
            out.append(0.0)
            continue
        t, lt, links = max(t, 1), max(lt, 1), max(lc, 1)
        base = math.log(c * links / max(c - lc, 1) + body * c + math.e)      # over 1.3
        out.append(c / t * math.log(max(c * t / (links * lt), 1.0)) / math.log(base))
    return out, chars, link_chars


def scores(tree: Tree, density: list[float]) -> list[float]:
    """The density sum of every node; half of a leaf's own, which is not better than its parent."""
    score = [0.0] * len(tree.tag)
    for i in range(1, len(score)):
        score[tree.parent[i]] += density[i]
    return [x or d / 2 for x, d in zip(score, density)]


def doubts_upheld(tree: Tree, density: list[float], chars: list[int], link_chars: list[int]) -> list[bool]:
    """Which nodes are taken out: doubtful elements, with all below them, that nothing speaks for.

    Where the page has an ``article`` free of doubt or a ``main``, only holding one speaks for a doubtful
    element. Elsewhere holding an ``h1`` does, or holding the core or most of the text outside
    links; but these two only if the text free of doubt is no fiftieth of the element's, and if
    the element has a text block or no text block is free of doubt. So an advert longer than the article
    doesn't pass for it. A doubtful ``article`` or ``h1`` stays, and so does a doubtful paragraph or heading if half
    its density reaches the middle one of those without doubt.
    """
    n = len(tree.tag)
    score, nearest = scores(tree, density), [0] * n          # nearest: the innermost doubtful element, 0 if none
    for i in range(1, n):
        nearest[i] = i if tree.doubt[i] else nearest[tree.parent[i]]
    core = max(range(n), key=lambda i: (score[i] / (1 + (nearest[i] > 0)), -i))
    plain = [c - lc for c, lc in zip(chars, link_chars)]
    whole, title, blocks, has_core, own = [False] * n, [False] * n, [False] * n, [False] * n, [0] * n
    for i in range(n - 1, 0, -1):
        t, p = tree.tag[i], tree.parent[i]
        whole[i] |= t == "main" or t == "article" and not tree.doubt[i]
        title[i] |= t == "h1"
        blocks[i] |= t in ("p", "pre") and chars[i] > 0
        has_core[i] |= i == core
        for held in (whole, title, blocks, has_core):
            held[p] |= held[i]
    inner = [0] * n                                           # text of the children, to tell a node's own
    for i in range(1, n):
        inner[tree.parent[i]] += plain[i]
    for i in range(n):
        if tree.tag[i] not in HEADINGS:
            own[nearest[i]] += plain[i] - inner[i]
    free_blocks = any(tree.tag[i] in ("p", "pre") and chars[i] and not nearest[i] for i in range(1, n))
    texts = sorted(density[i] for i in range(1, n) if chars[i] and not nearest[i] and tree.tag[i] in TEXT_BLOCKS)
    middle = texts[len(texts) // 2] if texts else 0.0

    def stands_out(i: int) -> bool:
        return tree.tag[i] in ("article", "h1") or tree.tag[i] in TEXT_BLOCKS and density[i] / 2 >= middle

    spoken_for = [tree.doubt[i] and (stands_out(i) or (whole[i] if whole[0] else title[i])) for i in range(n)]
    free = own[0] + sum(own[i] for i in range(1, n) if spoken_for[i])
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[tree.parent[i]]
        if tree.doubt[i] and not gone[i] and not spoken_for[i]:
            large = not whole[0] and (has_core[i] or 2 * plain[i] > plain[0]) and 50 * free < plain[i]
            gone[i] = not (large and (blocks[i] or not free_blocks))
            free += 0 if gone[i] else own[i]
    return gone


def without_side_blocks(tree: Tree) -> None:
    """Take out the text and tags of doubtful elements, once the densities of the whole page are known."""
    n = len(tree.tag)
    if not any(tree.doubt):
        return
    gone, new = doubts_upheld(tree, *densities(tree)), [0] * n
    left = [i for i in range(n) if not gone[i]]
    for k, i in enumerate(left):
        new[i] = k
    tree.text = [(new[i], block, piece) for i, block, piece in tree.text if not gone[i]]
    tree.parent = [-1, *(new[tree.parent[i]] for i in left[1:])]
    tree.tag = [tree.tag[i] for i in left]


def article_nodes(tree: Tree) -> list[bool]:
    """Which nodes belong to the article."""
    n = len(tree.tag)
    density, chars, link_chars = densities(tree)
    score = scores(tree, density)
    core = max(range(n), key=lambda i: (score[i], -i))
    path = [core]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    below_body = [i for i in path if tree.tag[i] not in ("#root", "html", "body")] or [core]
    threshold = min(density[i] for i in below_body)
    whole = next((i for i in reversed(below_body) if tree.tag[i] in ("article", "main")), None)
    article = next((i for i in below_body if tree.tag[i] == "article"), whole)
    mark, links = [False] * n, [2 * lc >= c > 0 for c, lc in zip(chars, link_chars)]
    mark[core if article is None else article] = True
    on_path = set(path)
    if article is None:
        # Climb: text beside the core belongs to it if it is dense enough or a heading, and is not mostly links.
        for i in range(1, n):
            if tree.parent[i] in on_path and i not in on_path and chars[i] and not links[i] \
                    and (density[i] >= threshold or tree.tag[i] in HEADINGS or tree.parent[i] in below_body):
                mark[i] = True
    else:
        # Further parts of the text: article elements beside this one, as dense and not mostly links.
        for i in range(1, n):
            if tree.tag[i] == tree.tag[article] and tree.parent[i] == tree.parent[article] \
                    and not links[i] and density[i] >= threshold:
                mark[i] = True
    top = core if article is None else article
    for i in range(1, n):
        # Blocks that are mostly links, lists of further texts, are no part of a text that is not.
        listed = links[i] and not links[top] and i not in on_path and tree.tag[i] in LINK_BLOCKS
        mark[i] = mark[i] or mark[tree.parent[i]] and not listed
    if article is None:                          # text that stands directly in an element of the path
        for i in below_body:
            mark[i] = True
    return mark


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; white space inside a block is one space."""
    if not html:
        return ""
    tree = Tree(html)
    without_side_blocks(tree)
    if not tree.text:
        return ""
    mark = article_nodes(tree)
    blocks: dict[int, list[str]] = {}
    for i, block, piece in tree.text:
        if mark[i]:
            blocks.setdefault(block, []).append(piece)
    texts = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n\n".join(t for t in texts if t)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; a null, empty or text-free page has an empty text.

    Rows are independent: each page, however long, is parsed whole in the task that reads it,
    so repeated rows and null ids or urls stay as they are. More columns are not read, whatever
    their names. An empty table gives no rows.
    """
    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()),
                         StructField("n_chars", LongType())])

    def extract(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, schema)
