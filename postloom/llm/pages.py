"""Main text of web pages by composite text density.

For every node of a page: characters per tag, adjusted by links. The sum over a node's children
picks the node that holds the text; the smallest density on the way from it to the body is the
threshold that other parts must reach. Parts that say by tag, role, class or id that they are
menus, notices, adverts, forms or comments are left out before, unless they wrap an article or
most of the text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import slices

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set(
    "script style noscript template head nav footer aside button select textarea iframe "
    "object svg canvas audio video dialog menu datalist".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup share sharing social related recommended comment comments commentlist disqus "
    "respond replies discussion widget toolbar pagination pager skip".split()
)
# Marks of parts that are texts of their own; much text does not make them the page's text.
WORDY = set(
    "comment comments commentlist disqus respond replies discussion cookie cookies consent gdpr "
    "popup modal newsletter".split()
)
# Marks that tell an advert also on a heading or paragraph of an article; the others may be
# part of what it is about there, such as a share price or related work.
ADVERTS = set("ad ads advert adverts advertisement advertising sponsored".split())
LINES = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
LISTS = {"ul", "ol", "dl", "table"}
BOXES = {"div", "section", "article"}
MAIN = {"article", "main"}
# Start tags that end an open element of the second kind, up to the nearest of the third.
P_ENDERS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPES = set("article aside body div section main table td th ul ol li blockquote button object".split())
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Elements whose content is no markup, and comments: what is read as one piece.
PIECES = re.compile(r"<!--|<(script|style|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>])", re.I)
COMMENT_END = re.compile("--!?>")
SPACE = " \t\n\r\f\v"


def _without_comments(html: str) -> str:
    """The page with empty comments, so that none is searched for its end again and again.

    A comment without an end runs to the end of the page. A ``<`` after the last ``>`` begins
    no tag.
    """
    out, at = [], 0
    while piece := PIECES.search(html, at):
        if piece[1]:
            end = re.compile(f"</{piece[1]}", re.I).search(html, piece.end())
            if not end:
                break
            body = html[piece.end() : end.start()]
            if piece[1].lower() not in ("script", "style"):  # which the parser knows
                body = body.replace("<", "&lt;")
            out += [html[at : piece.end()], body]
            at = end.start()
            continue
        out.append(html[at : piece.start()] + "<!---->")
        # the shortest comments share their dashes
        short = html.startswith((">", "->"), piece.end())
        end = None if short else COMMENT_END.search(html, piece.end())
        if not short and not end:
            return "".join(out)
        at = html.index(">", piece.end()) + 1 if short else end.end()
    out.append(html[at:])
    page = "".join(out)
    last = page.rfind(">") + 1
    return page[:last] + page[last:].replace("<", "&lt;")


class _Tree(HTMLParser):
    """Nodes in page order: tag, parent, attributes; texts between them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.attrs = ["#root"], [-1], [()]
        self.flow: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at its ends
        self.open = [0]
        self.depths: dict[str, list[int]] = {}  # of the open elements, by tag

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def _end(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            self.depths[self.tags[node]].pop()
            self.flow.append((node, None))

    def _deepest(self, tags: set) -> int:
        """Depth of the innermost open element of one of these tags, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _end_open(self, tags: set, scope: set) -> None:
        depth = self._deepest(tags)
        if depth > self._deepest(scope):
            self._end(depth)

    def handle_starttag(self, tag, attrs):
        if tag in P_ENDERS:
            self._end_open({"p"}, SCOPES)
        if tag in ENDED:
            self._end_open(*ENDED[tag])
        if tag == "body":
            self._end_open({"head"}, set())
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.attrs.append(attrs)
        self.flow.append((node, None))
        if tag in VOID:
            self.flow.append((node, None))
        else:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if depth := self._deepest({tag}):
            self._end(depth)

    def handle_data(self, data):
        self.flow.append((self.open[-1], data))


def _shut(attrs) -> bool:
    """Whether a node is hidden, or no main text by its role."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value and value.strip().lower() in ROLES:
            return True
    return False


def _mark(tag: str, attrs, inner: bool = False) -> int:
    """1 for a form or a name in MARKS, 2 for one in WORDY, else 0.

    Within an article or main, headings and paragraphs are marked by WORDY and ADVERTS only.
    """
    found = int(tag == "form")
    for name, value in attrs:
        if name == "role" and value and value.strip().lower() == "form":
            found = max(found, 1)
        if name in ("class", "id") and value:
            words = {t.lower() for t in TOKEN.findall(value)}
            some = ADVERTS if inner and tag in LINES else MARKS
            found = max(found, 2 if words & WORDY else 1 if words & some else 0)
    return found


def _sizes(tree: _Tree, out: list[bool]) -> list[int]:
    """Characters outside links in each node's subtree."""
    n = len(tree.tags)
    sizes, in_link = [0] * n, [False] * n
    for k in range(1, n):
        in_link[k] = in_link[tree.parents[k]] or tree.tags[k] == "a"
    for node, text in tree.flow:
        if text and not out[node] and not in_link[node]:
            sizes[node] += len(" ".join(text.split()))
    for k in range(n - 1, 0, -1):
        sizes[tree.parents[k]] += sizes[k]
    return sizes


def _left_out(tree: _Tree) -> list[bool]:
    n = len(tree.tags)
    hard, inner, marks = [False], [False], [0]  # inner: within an article or main
    for k in range(1, n):
        tag, parent = tree.tags[k], tree.parents[k]
        inner.append(inner[parent] or tag in MAIN)
        plain = tag in ("html", "body") or tag in MAIN
        hard.append(
            hard[parent]
            or tag in DROPPED
            or (tag == "header" and not inner[k])
            or (not plain and _shut(tree.attrs[k]))
        )
        marks.append(0 if plain else _mark(tag, tree.attrs[k], inner[k]))
    if not any(marks):
        return hard
    return _without_marked(tree, hard, marks)


def _without_marked(tree: _Tree, hard: list[bool], marks: list[int]) -> list[bool]:
    """``hard`` and the marked nodes, but for those that wrap main text.

    A marked node stays if it holds a main, or an article of at least a fifth of the longest
    one; or, where no comments or notices, several blocks with over half of the text of the
    article or main around it (of the page, if that has neither). Where marks would still take nine tenths of that
    text they name something else and count for nothing.
    """
    n = len(tree.tags)
    sizes = _sizes(tree, hard)
    wordy = [0] * n  # outermost node with a wordy mark around each node
    for k in range(1, n):
        wordy[k] = wordy[tree.parents[k]] or (k if marks[k] == 2 else 0)
    mains = [k for k in range(n) if tree.tags[k] in MAIN and sizes[k]]
    real = [k for k in mains if not wordy[k]] or [
        k for k in mains if _mark("", tree.attrs[k]) < 2 and 2 * sizes[wordy[k]] > sizes[0]
    ]
    longest = max((sizes[k] for k in real if tree.tags[k] == "article"), default=0)
    real = [k for k in real if tree.tags[k] == "main" or 5 * sizes[k] >= longest]
    holds, around = [False] * n, [0] * n
    for k in real:
        around[k] = k
        while k and not holds[k]:
            holds[k] = True
            k = tree.parents[k]
    for k in range(1, n):
        around[k] = around[k] or around[tree.parents[k]]
    inside = [around[k] > 0 or not real for k in range(n)]
    blocks = [0] * n  # with text, in each node's subtree
    for k in range(n - 1, 0, -1):
        blocks[tree.parents[k]] += blocks[k] + (sizes[k] > 0 and tree.tags[k] not in INLINE)
    kept = [
        holds[k]
        or marks[k] == 1 and inside[k] and blocks[k] > 1 and 2 * sizes[k] > sizes[around[k]]
        for k in range(n)
    ]

    def drop(*trusted: int) -> tuple[list[bool], int]:
        """Nodes left out, and the size of the text that stays."""
        out, stays = [False], sum(sizes[k] for k in real if not around[tree.parents[k]])
        stays = stays if real else sizes[0]
        for k in range(1, n):
            up = out[tree.parents[k]]
            gone = marks[k] > 0 and not kept[k] and (marks[k] in trusted or not inside[k])
            out.append(up or hard[k] or gone)
            if gone and not up and inside[k]:
                stays -= sizes[k]
        return out, stays

    (out, stays), (fewer, more) = drop(1, 2), drop(2)
    if 10 * stays < more:
        out, stays = fewer, more
    if not stays:
        out, stays = drop(1)
    return out if stays else hard


def densities(
    tree: _Tree, out: list[bool]
) -> tuple[list[float], list[float], list[float]]:
    """Composite density, sum of the children's densities and share of links, for every node."""
    n = len(tree.tags)
    chars, link_chars, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[tree.parents[k]] or tree.tags[k] == "a"
    for node, text in tree.flow:
        if text and not out[node]:
            size = len(" ".join(text.split()))
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for k in range(n - 1, 0, -1):
        if not out[k]:
            p = tree.parents[k]
            chars[p] += chars[k]
            link_chars[p] += link_chars[k]
            tags[p] += tags[k] + 1
            links[p] += links[k] + (tree.tags[k] == "a")
    body = next((k for k in range(n) if tree.tags[k] == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if out[k] or not chars[k]:
            continue
        c, lc = chars[k], link_chars[k]
        base = log(c / max(c - lc, 1) * lc + share * c + e)
        value = c / max(lc, 1) * max(tags[k], 1) / max(links[k], 1)
        density[k] = c / max(tags[k], 1) * log(max(value, 1)) / max(log(max(base, 1)), 1e-3)
        if k and tree.tags[k] not in INLINE:  # marked-up words are no parts of a page
            sums[tree.parents[k]] += density[k]
    return density, sums, [a / max(b, 1) for a, b in zip(link_chars, chars)]


def _other_articles(tree, out, density, linked, threshold, first) -> list[int]:
    """Outermost articles and mains besides ``first`` that belong to the text: with any block
    that reaches the threshold, or beside ``first`` and at least a fifth as long. Teasers, with
    over a third in links, do not.
    """
    n = len(tree.tags)
    sizes, peak, inner = _sizes(tree, out), list(density), [False] * n
    for k in range(n - 1, 0, -1):
        if tree.tags[k] not in INLINE:
            peak[tree.parents[k]] = max(peak[tree.parents[k]], peak[k])
    found = []
    for k in range(1, n):
        p = tree.parents[k]
        inner[k] = inner[p] or tree.tags[p] in MAIN
        if tree.tags[k] in MAIN and not inner[k] and not out[k] and k != first and linked[k] <= 1 / 3:
            beside = p == tree.parents[first] and 5 * sizes[k] >= sizes[first]
            if sizes[k] and (peak[k] >= threshold or beside):
                found.append(k)
    return found


def _without_links(tree, out, chosen, density, linked, threshold, path) -> list[bool]:
    """``out`` and, within the chosen nodes, lists of links and the boxes below the threshold
    that hold links (at least two, hardly any other text) or teasers (a third in links, with a
    block that is one, as a title). Nothing more is left out where under a fifth of the text
    would stay: there the links are the page's text. Nodes of ``path`` stay.
    """
    n = len(tree.tags)
    sizes, links, titles = _sizes(tree, out), [0] * n, [False] * n
    for k in range(n - 1, 0, -1):
        p = tree.parents[k]
        links[p] += links[k] + (tree.tags[k] == "a" and not out[k])
        titles[p] = titles[p] or titles[k] or (tree.tags[k] not in INLINE and linked[k] > 0.8)
    inside, more, total, stays = list(chosen), list(out), 0, 0
    for k in range(1, n):
        p, tag, share = tree.parents[k], tree.tags[k], linked[k]
        inside[k] = inside[k] or inside[p]
        if chosen[k]:
            total += sizes[k]
            stays += sizes[k]
        if not inside[k] or k in path or more[p]:
            more[k] = more[k] or more[p]
            continue
        box = tag in BOXES and density[k] < threshold
        if tag in LISTS and share > 0.8 or box and (
            share > 0.8 and links[k] > 1 or share > 1 / 3 and titles[k]
        ):
            stays -= 0 if more[k] else sizes[k]
            more[k] = True
    return more if 5 * stays >= total and stays else out


def _content(tree: _Tree, out: list[bool]) -> list[bool]:
    """Whether each node belongs to the main text."""
    n = len(tree.tags)
    density, sums, linked = densities(tree, out)
    body = next((k for k in range(n) if tree.tags[k] == "body"), 0)
    best = max(range(body, n), key=lambda k: (sums[k], -k))
    chosen = [False] * n
    path = [best]
    while path[-1] not in (body, 0):
        path.append(tree.parents[path[-1]])
    threshold = min(density[k] for k in path)
    main = [k for k in path if tree.tags[k] in MAIN]
    if main:
        whole = [main[-1]]  # the outermost one
        if tree.tags[main[-1]] == "article":
            whole += _other_articles(tree, out, density, linked, threshold, main[-1])
        for k in whole:
            chosen[k] = True
        out = _without_links(tree, out, chosen, density, linked, threshold, set(path))
    else:
        top = list(range(n))  # node with the largest sum in each node's subtree
        for k in range(n - 1, 0, -1):
            p = tree.parents[k]
            if sums[top[k]] > sums[top[p]] or sums[top[k]] == sums[top[p]] and top[p] != p and top[k] < top[p]:
                top[p] = top[k]
        for k in range(body, n):
            if density[k] >= threshold and density[k] > 0:
                chosen[top[k] if sums[top[k]] > 0 else k] = True
        if sums[best] == 0:
            chosen[body] = True
        # lists of links are menus
        out = [x or t in LISTS and s > 0.8 for x, t, s in zip(out, tree.tags, linked)]
    for k in range(1, n):
        chosen[k] = (chosen[k] or chosen[tree.parents[k]]) and not out[k]
    return chosen


def main_text(html: str) -> str:
    """The page's blocks in page order, white space as one space, joined by one space."""
    tree = _Tree()
    tree.feed(_without_comments(html))
    tree.close()
    tree._end(1)
    out = _left_out(tree)
    chosen = _content(tree, out)
    chosen[0] = chosen[0] and not out[0]
    parts = []
    for node, text in tree.flow:
        if text is None:
            if tree.tags[node] not in INLINE:
                parts.append(" ")
        elif chosen[node]:
            parts.append(text)
    return " ".join("".join(parts).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages``.

    ``pages`` needs page_id, url and html; other columns are ignored. NULL and empty pages, and
    pages without text, give empty text. Repeated rows stay, a NULL page_id or url stays NULL.
    Pages of any length are read whole, one at a time. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(found, pa.string())],
                    names=["page_id", "url", "text"],
                )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string")
