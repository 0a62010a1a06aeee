"""Main text of web pages by composite text density over the DOM.

Every element gets its characters, tags, link characters and link tags.  The composite
density is characters per tag, damped where a node's text is mostly links.  The density
sum of a node adds up its children's densities; the node of the largest sum is the core,
and the smallest density on the path from it to the body is the threshold.  Subtrees at
least that dense give the text, each through its own descendant of the largest sum.
Dense runs of text and inline elements beside them give theirs too.
Parts that are never article text by their element or role take no part, nor do forms and
readers' comments; a form that holds all of the text counts as a page.  A word of a
class or id only marks a part: outside the text found so, and where its links or its
density agree also inside, it takes none; a part that is mostly heading stays.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import texts_of

#: Fixed values of the HTML language.
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot dd dt li".split())
#: An opening tag ends an open element of these names, up to a limit.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tr td th", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Elements and words of class, id or role that mark what is not the article.
DROPPED = frozenset("head script style noscript template nav footer aside button select option input textarea iframe object embed canvas svg math audio video dialog menu title noframes".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus consent cookie cookies copyright disclaimer footer gdpr header masthead login menu modal nav navbar navigation navigator newsletter notice notification notifications pager pagination paywall popup promo promotion promoted recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription survey tags toc toolbar topbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SLUGGED = HEADINGS | {"p"}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Class or id names of readers' comments, and those that only tell of a page's layout.
_COMMENT = re.compile(r"(?:user-?|reader-?|post-?)?(?:comments?|disqus|repl(?:y|ies)|respond)(?:[-_]?(?:list|area|section|body|thread|wrap|wrapper|container|box|form|respond|content|item|text|block|feed|module|title|\d+))*")
#: Names of parts beside the text, even where they stand within it.
_BESIDE = re.compile(r"(?:newsletter|sign-?up|subscribe|subscription|advert(?:isement|ising)?s?|ads?|adsense|adsbygoogle|sponsor(?:ed)?|promo(?:tion|ted)?|cookies?|consent|gdpr|paywall|popup|modal|shar(?:e|ing)|social)(?:[-_]?(?:newsletter|sign-?up|banner|notice|bar|box|form|wrap|wrapper|container|block|slot|unit|section|content|inner|links?|buttons?|icons?|widget|module|\d+))*")
#: How a part is barred (a form, comments) or marked (by a word, by all of a name).
FORM, COMMENTS, WORD, PLAIN = 1, 2, 1, 2
_LAYOUT = re.compile(r"(?:no|has|with|without|is|hide|show)[-_]")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "head_chars", "density", "sum", "drop", "marked", "barred")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.drop, self.marked, self.barred = tag, parent, [], False, 0, 0
        self.chars = self.tags = self.link_chars = self.link_tags = self.head_chars = 0
        self.density = self.sum = 0.0


def _unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, int, int]:
    """Whether an element is dropped whatever it holds, how it is barred, and how its class or id marks it."""
    barred, marked = FORM if tag == "form" else 0, 0
    if tag in DROPPED or tag == "header" and not inside:
        return True, 0, 0
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _NAMED.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                # the id of a heading or paragraph is a slug of its text
                if name == "id" and tag in SLUGGED:
                    continue
                for token in value.split():
                    if _COMMENT.fullmatch(token) and tag not in ("main", "body", "html"):
                        barred = COMMENTS
                    if tag not in ("article", "main", "body", "html") and not _LAYOUT.match(token):
                        if not MARKS.isdisjoint(_WORDS.findall(token)):
                            marked = max(marked, PLAIN if tag in ("div", "section", "ul") and _BESIDE.fullmatch(token) else WORD)
            elif name == "role":
                if value.strip() in ROLES:
                    return True, 0, 0
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True, 0, 0
    return False, barred, marked


def _tokens(page: str):
    """Pieces of text, and tags as (closing, name, attributes, end).  A tag that never ends takes the rest of the page."""
    at, text, n = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        end = None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else n
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = end + 3 if end >= 0 else n
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or n
        if end is None:
            m = _NAME.match(page, at)
            if m is None:
                at += 1
                continue
            rest = _REST.match(page, m.end())
            # an odd quote: the tag ends at the next bracket
            stop = rest.end() if rest else page.find(">", m.end()) + 1 or n
            if at > text:
                yield page[text:at]
            resume = yield m[1], m[2].lower(), rest[1] if rest else page[m.end() : stop - 1], stop
            at = text = resume if resume is not None else stop
            if resume is not None:
                yield None
        else:
            if at > text:
                yield page[text:at]
            at = text = end
    if text < n:
        yield page[text:]


def parse(page: str) -> Node:
    """A tree of elements and strings; open elements end as the HTML rules imply them."""
    root = Node("html", None)
    node = root
    n = len(page)
    tokens = _tokens(page)
    open_: Counter[str] = Counter()  # elements from the root to ``node``, by name: what is not open is not looked for

    def to(up: Node) -> Node:
        """Ends all elements below ``up``."""
        x = node
        while x is not up:
            open_[x.tag] -= 1
            x = x.parent
        return up

    for token in tokens:
        if type(token) is str:
            node.children.append(token)
            continue
        closing, tag, attributes, at = token
        if closing:
            if tag == "br":
                node.children.append(" ")
                continue
            up = node if open_[tag] else root
            while up is not root and up.tag != tag:
                # a closing inline tag never ends a block
                if tag not in BLOCKS and up.tag in BLOCKS:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = to(up.parent)
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            up = node if open_["p"] else root
            while up is not root and up.tag != "p" and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                node = to(up.parent)
        elif tag in ENDS:
            names, limit = ENDS[tag]
            up, found = node if any(open_[x] for x in names) else root, None
            while up is not root and up.tag not in limit:
                if up.tag in names:
                    found = up
                    if tag != "tr":
                        break
                up = up.parent
            if found is not None:
                node = to(found.parent)
        elif tag == "body":
            node = to(root)
        if tag == "br":
            node.children.append(" ")
        child = Node(tag, node)
        node.children.append(child)
        inside = tag == "header" and open_["article"] + open_["main"] > 0
        dropped, child.barred, child.marked = _unwanted(tag, attributes, inside)
        child.drop = dropped or child.barred > 0 or child.marked > 0
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW and tag not in ("a", "b", "i", "span"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            tokens.send(end.end() if end else n)
            continue
        node = child
        open_[tag] += 1
    return root


def _composite(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    if not chars:
        return 0.0
    tags, plain = max(1, tags), max(1, chars - link_chars)
    base = math.log(chars / plain * max(1, link_chars) + ratio * chars + math.e)
    return chars / tags * math.log(chars / max(1, link_chars) * (tags / max(1, link_tags)) + 1) / base if base else 0.0


def _density(x: Node, ratio: float) -> float:
    return _composite(x.chars, x.tags, x.link_chars, x.link_tags, ratio)


def _count(x: Node) -> None:
    x.chars = x.tags = x.link_chars = x.link_tags = x.head_chars = 0
    for c in x.children:
        if type(c) is Node:
            if not c.drop:
                x.head_chars += c.chars if c.tag in HEADINGS else c.head_chars
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.chars if c.tag == "a" else c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
        else:
            x.chars += len(_SPACE.sub(" ", c)) if not c.isspace() else 0


def _measure(root: Node) -> list[Node]:
    """Sets the counts and densities; returns the kept nodes, parents first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if type(c) is Node and not c.drop)
    for x in reversed(order):
        _count(x)
    total = max(1, root.chars)
    ratio = root.link_chars / total
    for x in reversed(order):
        x.density = _density(x, ratio)
        x.sum = sum(c.density for c in x.children if type(c) is Node and not c.drop)
        if x.tag in BLOCKS:  # text of the node itself counts as a child without tags
            x.sum += sum(_composite(len(c), 1, 0, 0, ratio) for c in x.children if type(c) is str and not c.isspace())
    return order


def _blocks(node: Node, out: list[list[str]]) -> None:
    stack: list = [(node, 0)]
    while stack:
        x, i = stack.pop()
        if not i and x.tag in BLOCKS:
            out.append([])
        while i < len(x.children):
            c = x.children[i]
            i += 1
            if type(c) is str:
                out[-1].append(c)
            elif not c.drop:
                stack.append((x, i))
                stack.append((c, 0))
                break
        else:
            if x.tag in BLOCKS:
                out.append([])


def _unmark(node: Node, barred: bool = False) -> list[Node]:
    """Lets the marked parts below a node in (and forms, if ``barred``), nested ones too; returns the nodes kept so, parents first."""
    out, stack = [], [node]
    while stack:
        out.append(x := stack.pop())
        for c in x.children:
            if type(c) is Node and (not c.drop or barred and c.barred == FORM or c.marked and not c.barred):
                c.drop = False
                stack.append(c)
    return out


def _keep_most(root: Node) -> None:
    """A marked part that holds most of the page's text is no side matter, nor is a form that holds all of it.  Comments are
    none of the text, however many."""
    order = _unmark(root, True)
    for x in reversed(order):
        _count(x)
    for x in order:
        most = 2 * (x.chars - x.link_chars) > root.chars - root.link_chars
        x.barred = 0 if x.chars == root.chars else x.barred
        x.drop = x.barred > 0 or x.marked > 0 and not most


def _keep_dense(node: Node, threshold: float, ratio: float) -> None:
    """Drops those marked parts whose links or density (half the threshold) or plain names agree that they are none of the text, inner ones first."""
    order = _unmark(node)
    for x in reversed(order):
        _count(x)
    whole = node.chars
    for x in reversed(order):
        _count(x)
        if x.marked and x is not node:
            heading = x.chars if x.tag in HEADINGS else x.head_chars
            x.drop = 2 * x.link_chars >= x.chars or 2 * _density(x, ratio) < threshold and 2 * heading < x.chars or x.marked == PLAIN and 2 * x.chars < whole


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _keep_most(root)
    order = _measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        return ""
    core = max(order, key=lambda x: x.sum)  # the outermost of equal sums
    threshold, x = core.density, core
    while x is not None:
        if x.density:
            threshold = min(threshold, x.density)
        if x is body:
            break
        x = x.parent
    # an article or main around the core is its whole
    x, whole = core, None
    while x is not None:
        if x.tag in ("article", "main") and (whole is None or whole.tag == x.tag):
            whole = x
        x = x.parent
    ratio = root.link_chars / max(1, root.chars)
    picked = [whole] if whole is not None else _dense(body, core, threshold, ratio)
    out: list[list[str]] = [[]]
    for x in picked:
        if x is not body:  # where all of the page is taken, its marked parts are beside the text, not in it
            _keep_dense(x, threshold, ratio)
        _blocks(x, out)
        out.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in out if b)
    return "\n".join(x for x in lines if x)


def _dense(body: Node, core: Node, threshold: float, ratio: float) -> list[Node]:
    """The core, and its dense neighbours on the path to the body, in page order; text and inline elements in a row are one neighbour."""
    if core is body:
        return [body]
    path, x = {core}, core
    while x is not None and x is not body:
        path.add(x)
        x = x.parent
    picked = []

    def take(run: list) -> None:
        if run:
            x = Node("span", None)
            x.children = list(run)
            run.clear()
            for c in x.children:
                if type(c) is Node:
                    x.chars, x.tags = x.chars + c.chars, x.tags + c.tags + 1
                    x.link_chars += c.chars if c.tag == "a" else c.link_chars
                    x.link_tags += c.link_tags + (c.tag == "a")
                else:
                    x.chars += len(_SPACE.sub(" ", c)) if not c.isspace() else 0
            if x.chars and _density(x, ratio) >= threshold and x.link_chars * 2 < x.chars:
                picked.append(x)

    stack: list = [(body, 0, [])]
    while stack:
        node, i, run = stack.pop()
        while i < len(node.children):
            c = node.children[i]
            i += 1
            if type(c) is str or c not in path and not c.drop and c.tag not in BLOCKS:
                run.append(c)
                continue
            if c.drop and c.tag not in BLOCKS:
                continue
            take(run)
            if c is core:
                picked.append(c)
            elif c in path:
                stack.append((node, i, run))
                stack.append((c, 0, []))
                break
            elif not c.drop and c.chars and c.density >= threshold and c.link_chars * 2 < c.chars:
                picked.append(c)
        else:
            take(run)
    return picked


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` to the rows, replacing columns of those names.

    A page that is null, empty or has no article text gets an empty text.  Pages are read
    whole, in time linear in their length, and nest to any depth; equal pages get equal texts; an empty
    table gives an empty result.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    at = keep.index(html_col)
    rest = [c for c in keep if c != html_col]
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for batch in batches:
            texts = [main_text(t) for t in texts_of(batch, at)]
            cols = [batch.column(i) for i, c in enumerate(keep) if c != html_col]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    return pages.select(*keep).mapInArrow(run, f"{fields}, text string, n_chars long" if fields else "text string, n_chars long")
