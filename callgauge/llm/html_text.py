"""Main text of web pages by scoring the tree of elements.

A page is read into a tree. Every paragraph gives points (one, one for each comma, up to three for its length) to its
parent and half of them to its grandparent; a container's points are discounted by the share of its text inside links.
Points of the parts of a table, list or quotation go to the container around it. The whole article or main element around
the best container is kept or, on pages without one, the container and its siblings that hold text and few links; their
blocks, without the parts that are not the article, are joined in page order.

Words in a class or id put a part outside the article, unless the part holds the article itself; an id counts only where all
its words are of that kind, never on a heading, and hardly on a section inside an article, whose id names its subject.
Every pass is linear in the page, however deep its elements lie.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
UNSEEN = frozenset("script style noscript template iframe xmp noembed noframes head title textarea svg canvas object math select option datalist".split())
OUTSIDE = frozenset("nav header footer aside form button menu dialog fieldset label input".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption dialog menu".split()
)
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
FORMATTING = frozenset("a b i em strong u s small big font code tt span strike nobr".split())
INLINE = FORMATTING | VOID - {"hr"} | frozenset("abbr bdi bdo cite data del dfn ins kbd mark q samp sub sup time var".split())
# Elements that end an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# Words in class or id, or values of role, of parts that are not the article.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice"
    " notices disclaimer nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail header masthead topbar footer foot bottombar"
    " comment comments reply discussion feedback respond replies disqus thread widget widgets related recommended recommendations share sharing social newsletter subscribe"
    " subscription signup login popup modal overlay toolbar pagination pager skip tags alert outbrain taboola legal copyright".split()
)
# Words beside them in the id of such a part; any other word makes an id the name of a subject ("side-effects").
PLACE_WORDS = frozenset(
    "left right main top bottom upper lower box block area wrap wrapper container content inner outer section list form item bar panel col column"
    " primary secondary global site page head title text body unit slot zone group row post posts article articles link links button buttons"
    " message messages info icon icons media mobile desktop window google gpt div the and of on in".split()
)
# Words that no subject has in the id of an element that is no section.
STRONG_WORDS = frozenset(
    "sidebar navbar navigation breadcrumb breadcrumbs adsense advert adverts advertisement advertising disqus outbrain taboola gdpr pagination masthead".split()
)
# Words that by themselves are as well the id of a section of an article.
SECTION_WORDS = frozenset("discussion thread reply replies respond feedback related side legal copyright promotion alert share sharing social".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORS = frozenset("article main h1".split())
# "has-sidebar" and the like describe the layout around the article.
LAYOUT_WORDS = frozenset("has no with without".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
# Words in the class of an article element that is a reader's comment, and elements that hold running text.
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
PROSE = frozenset("p pre article main".split())
# Parts of a table, list or quotation: no article by themselves, what they hold belongs to the container around them.
PARTS = frozenset("tr tbody thead tfoot table ul ol menu dl li dt dd blockquote".split())
NO_VETO = frozenset("html body article main".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
LETTERS = re.compile(r"[a-z]+")


# A sibling of the best container with a larger share of its text inside links is navigation.
MOST_LINKS = 0.3
# A page without title or article that lies in a form as a whole has at least as many paragraphs in it.
FORM_PARAGRAPHS = 3


# Why an element is outside the article: not at all, a header (whose headings may belong to an article), by its words, a form,
# by the id of a section, or for good.
KEPT, HEADER, WORDS, FORM, SUBJECT, GONE = range(6)
BELOW_P = frozenset(BLOCKS - {"p"})
ENDS_AT = frozenset({"table", "#root", "article", "section", "div", "td"})
ROOT = frozenset({"#root"})


class Node:
    __slots__ = ("tag", "parent", "home", "top", "kids", "mark", "out", "points", "n_text", "n_link", "n_commas", "n_seen", "n_prose", "n_paragraphs", "n_anchors")

    def __init__(self, tag: str, parent: Node | None, mark: int = KEPT):
        self.tag, self.parent, self.mark = tag, parent, mark
        # The nearest element around that does more than format text, and the outermost of the parts this one lies in.
        self.home = parent.home if parent is not None and parent.tag in FORMATTING and parent.home is not None else parent
        self.top = (parent.top if parent is not None and parent.tag in PARTS else self) if tag in PARTS else None
        self.kids: list = []
        self.out = KEPT
        self.points = 0.0
        self.n_text = self.n_link = self.n_commas = self.n_seen = self.n_prose = self.n_paragraphs = self.n_anchors = 0


def _words(token: str) -> list[str]:
    return LETTERS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())


def _by_class(value: str) -> bool:
    for token in value.split():
        words = _words(token)
        if not BOILERPLATE_WORDS.isdisjoint(words) and LAYOUT_WORDS.isdisjoint(words):
            return True
    return False


def _by_id(tag: str, value: str) -> bool:
    words = set(_words(value))
    if BOILERPLATE_WORDS.isdisjoint(words) or not LAYOUT_WORDS.isdisjoint(words):
        return False
    return words <= BOILERPLATE_WORDS | PLACE_WORDS or tag != "section" and not STRONG_WORDS.isdisjoint(words)


def _mark(tag: str, attributes: str) -> int:
    if tag == "header":
        return HEADER
    if tag == "form":
        return FORM
    if tag in OUTSIDE or tag in UNSEEN:
        return GONE
    if not attributes or tag in NO_VETO and tag != "article":
        return KEPT
    mark = KEPT
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        if name == "hidden" or name == "aria-hidden" and value and value.lower() == "true":
            found = GONE
        elif not value:
            continue
        elif name == "role" and value.lower().strip() in BOILERPLATE_ROLES:
            found = GONE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found = GONE
        elif name == "class" and _by_class(value):
            found = WORDS
        elif name == "id" and tag not in HEADINGS and _by_id(tag, value):
            found = SUBJECT if tag == "section" and SECTION_WORDS.issuperset(_words(value)) else WORDS
        else:
            continue
        mark = GONE if GONE in (mark, found) else WORDS if WORDS in (mark, found) else found
    if tag == "article":  # only a reader's comment is an article that is not one
        return mark if mark == WORDS and _is_comment(attributes) else KEPT
    return mark


def _is_comment(attributes: str) -> bool:
    values = [m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"]
    return any(not COMMENT_WORDS.isdisjoint(_words(v)) for v in values)


def parse(page: str) -> Node:
    """The tree of a page. Broken nesting is mended as browsers do for blocks: a block ends an open paragraph."""
    root = Node("#root", None)
    path, places = [root], {"#root": [0]}  # open elements, and at which depths each kind is open

    def close(tags, stop) -> None:
        """Leave the nearest open element among ``tags``, unless one of ``stop`` lies between."""
        depth = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if not depth or depth < len(path) - 1 and depth < max((places[t][-1] for t in stop if places.get(t)), default=0):
            return
        while len(path) > depth:
            places[path.pop().tag].pop()

    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        start = m.start() if m else size
        if start > pos:
            path[-1].kids.append(entities.unescape(page[pos:start]))
        if not m:
            break
        pos = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in ENDS_P:
                close(("p",), ENDS_AT)
            if tag in CLOSES:
                close(CLOSES[tag], SCOPE[tag])
            node = Node(tag, path[-1], _mark(tag, m[3]))
            path[-1].kids.append(node)
            if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW and tag not in FORMATTING:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = end.end() if end else size
                continue
            places.setdefault(tag, []).append(len(path))
            path.append(node)
        elif m[1]:
            tag = m[1].lower()
            if tag == "br":
                path[-1].kids.append(Node("br", path[-1]))
            else:
                close((tag,), ROOT if tag in BLOCKS else BELOW_P)
    _decide(root)
    return root


def _decide(root: Node) -> None:
    """Set ``out`` of every element from its mark, what it holds and where it lies: KEPT, HEADER (but for headings) or GONE."""
    prose = unseen = 0
    for node, text, leaving in _in_order(root):
        if text is not None:
            if not unseen:
                n = len(text.strip())
                node.n_seen += n
                node.n_prose += n if prose else 0
        elif not leaving:
            prose += node.tag in PROSE
            unseen += node.mark == GONE
            node.n_anchors += not unseen and node.tag in ANCHORS and node.mark == KEPT
        else:
            prose -= node.tag in PROSE
            unseen -= node.mark == GONE
            node.n_paragraphs += node.tag in ("p", "pre") and node.n_prose > 0
            up = node.parent
            if up is not None:
                up.n_seen += node.n_seen
                up.n_prose += node.n_prose
                up.n_paragraphs += node.n_paragraphs
                up.n_anchors += node.n_anchors
    articles = 0
    for node, text, leaving in _in_order(root):
        if text is not None:
            continue
        if leaving:
            articles -= node.tag in ("article", "main") and not node.out
            continue
        around, own = node.parent.out if node.parent is not None else KEPT, node.mark
        if own in (WORDS, FORM):
            # The part around the article: all anchors of the page, or all of a page without any, and most of its prose.
            whole = node.n_anchors == root.n_anchors > 0
            if own == FORM and not root.n_anchors:
                whole = node.n_paragraphs >= FORM_PARAGRAPHS and 2 * node.n_seen > root.n_seen
            held, of = (node.n_prose, root.n_prose) if root.n_prose else (node.n_seen, root.n_seen)
            own = KEPT if whole and 2 * held > of else GONE
        elif own == HEADER and not articles:
            own = GONE
        elif own == SUBJECT:
            own = KEPT if articles else GONE
        title = around == HEADER and own == KEPT and node.tag in HEADINGS  # an article's title may stand in its header
        node.out = KEPT if title else max(around, own)
        articles += node.tag in ("article", "main") and not node.out


def _in_order(root: Node):
    """Yield (node, text, leaving) in page order without recursion, so that deep pages do not overflow."""
    stack = [(root, iter(root.kids))]
    yield root, None, False
    while stack:
        node, kids = stack[-1]
        kid = next(kids, None)
        if kid is None:
            yield node, None, True
            stack.pop()
        elif isinstance(kid, str):
            yield node, kid, False
        else:
            yield kid, None, False
            stack.append((kid, iter(kid.kids)))


def _score(root: Node) -> list[Node]:
    """Points of every container; returns the containers with points."""
    links, scored = 0, []
    for node, text, leaving in _in_order(root):
        if node.out:
            continue
        if text is not None:
            n = len(SPACE.sub(" ", text).strip())
            node.n_text += n
            node.n_commas += text.count(",")
            if links:
                node.n_link += n
        elif not leaving:
            links += node.tag == "a"
        else:
            links -= node.tag == "a"
            parent = node.parent
            if parent is not None:
                parent.n_text += node.n_text
                parent.n_link += node.n_link
                parent.n_commas += node.n_commas
                if (node.tag in PARAGRAPHS or node.tag == "div" and _own_text(node)) and node.n_text:
                    points = 1 + node.n_commas + min(node.n_text / 100, 3)
                    for up, share in ((node.home, 1.0), (node.home.parent, 0.5)):
                        if up is not None:
                            if not up.points:
                                scored.append(up)
                            up.points += points * share
    for node in scored:
        node.points *= 1 - node.n_link / max(node.n_text, 1)
    return scored


def _lifted(scored: list[Node]) -> list[Node]:
    """Containers that are no parts; each has the points of the best part of every table, list or quotation in it."""
    whole, tops = [node for node in scored if node.tag not in PARTS], {}
    for node in scored:
        if node.tag in PARTS:
            tops[node.top] = max(tops.get(node.top, 0.0), node.points)
    known = set(whole)
    for top, points in tops.items():
        home = top.parent
        home.points += points
        if home not in known:
            known.add(home)
            whole.append(home)
    return whole


def _own_text(node: Node) -> bool:
    """Whether a container holds prose directly, not in paragraphs."""
    return sum(len(kid) for kid in node.kids if isinstance(kid, str) and not kid.isspace()) >= 25


def _blocks(roots: list[Node]) -> list[str]:
    found, open_text = [], []

    def end():
        text = SPACE.sub(" ", "".join(open_text)).strip()
        if text:
            found.append(text)
        open_text.clear()

    for root in roots:
        for node, text, _ in _in_order(root):
            if node.out:
                continue
            if text is not None:
                open_text.append(text)
            elif node.tag in BLOCKS:
                end()
            elif node.tag == "br":
                open_text.append(" ")
        end()
    return found


def _neighbours(best: Node) -> list[Node]:
    """The blocks beside ``best`` in page order, itself among them; text and inline elements side by side are one."""
    found: list[Node] = []
    for kid in best.parent.kids:
        if isinstance(kid, str) or kid.tag in INLINE and kid is not best:
            if not found or found[-1].tag != "#run":
                found.append(Node("#run", None))
            run = found[-1]
            run.kids.append(kid)
            if isinstance(kid, str):
                run.n_text += len(SPACE.sub(" ", kid).strip())
            elif not kid.out:
                run.n_text += kid.n_text
                run.n_link += kid.n_link
        elif not kid.out:
            found.append(kid)
    return found


def main_text(page: str) -> str:
    root = parse(page)
    scored = _score(root)
    if not scored:
        return "\n\n".join(_blocks([root]))
    best = max(_lifted(scored), key=lambda n: n.points)
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around or best  # a part of the article, at any depth: its whole stands
    while best.parent is not None and (best.parent.tag == "article" or best.parent.tag == "main" and best.tag != "article"):
        best = best.parent
    if best.parent is None or best.tag in ("body", "html", "article", "main"):
        kept = [best]
    else:
        kept = [kid for kid in _neighbours(best) if kid is best or kid.n_text > 0 and kid.n_link <= MOST_LINKS * kid.n_text]
    return "\n\n".join(_blocks(kept))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``, the main text of ``html`` (empty if none), and ``n_chars``, its code points.

    Null and empty pages give an empty text; ties in points go to the container that ends first; repeated rows are
    treated alike; other columns pass through, columns named as the new ones are replaced. Rows are independent: no
    shuffle, and memory holds one Arrow batch.
    """

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda page: main_text(page) if page else "")

    return pages.withColumn(out, texts(F.col(html))).withColumn("n_chars", F.length(out).cast("long"))
