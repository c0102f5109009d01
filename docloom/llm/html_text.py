"""Main text of web pages by tree scoring.

The page becomes a tree of elements and a list of text blocks. Each paragraph passes points for its length and
commas to its ancestors, halved at each level; a container's points are discounted by its link density. The
best container and those of its siblings that score like it are kept, without the boilerplate inside.

Nulls and edge cases: a null or empty page, or one without text, gives an empty text; broken markup is closed
as browsers do; repeated rows are extracted row by row; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: From a tag's name to its end; quotes count after an equals sign only, as in browsers.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend", "summary", "figcaption"}
#: A start tag ends an open element of these kinds, up to the kind of element that bounds the search.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BOILERPLATE = {"nav", "aside", "footer", "button", "select", "menu", "dialog", "fieldset", "head"}
#: Parts of names that mark boilerplate, if the rest of the name is made of such parts and of those below.
_STRONG = re.compile(r"ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed|ship)?|promo(?:s|tions?|tional)?|\w*banner\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri(?:be|ption|ptions)|nav|navs|navbar|navigation|navlinks?|menu|menus|menubar|breadcrumbs?|pagination|pager|sidebars?|footers?|headers?|masthead|toolbar|sharing|comments?|commentlist|disqus|complementary|contentinfo")
#: Parts that do so if the rest of the name is made of such parts and of parts that only say where or how.
_WEAK = set("notice signup login share social related recommended recommendations recommendation replies reply respond widget widgets search form".split())
_NEUTRAL = set("site page main global top bottom left right inner outer box bar block area section wrap wrapper container list item items link links buttons button icon icons posts post articles stories story content text title body row col column primary secondary small large desktop mobile the and us media".split())
_POSITIVE = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|page)(?:$|[\s_-])", re.I)
#: Parts of an article that are named after its head.
_OWN_HEADER = re.compile(r"(?:article|post|entry|story|content)[_-]+(?:header|head|title|body|text|page)")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TAG_POINTS = {"article": 40, "main": 30, "section": 5, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ol": -3, "ul": -3, "dl": -3, "form": -15, "th": -5, "address": -3}
#: A block shorter than this passes no points; a sibling needs this share of the best score.
MIN_BLOCK, SIBLING_SHARE = 25, 0.2
#: A form is no boilerplate if it has this share of the page's text, or an article.
FORM_SHARE = 0.5
#: Siblings of other kinds than the best container's, and the share of links that they may have.
_CONTAINERS, SIBLING_LINKS = {"div", "section", "article", "main", "blockquote"}, 0.25


def _boilerplate(name: str) -> bool:
    """Whether a single class, id or role names boilerplate."""
    if _OWN_HEADER.fullmatch(name):
        return False
    parts = [x for x in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if x]
    parts = [x.lower() for x in parts]
    marks = [x in _WEAK or bool(_STRONG.fullmatch(x)) for x in parts]
    return any(marks) and all(m or x in _NEUTRAL or x.isdigit() for m, x in zip(marks, parts, strict=True))


class _Tree:
    """Elements (parent, tag, names, dropped) and blocks (element, text, characters within links), in page order.

    Besides the stack of open elements it keeps where in it each tag and each block element is, so that no tag
    has to walk the stack: the time grows with the page whatever its nesting.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.names, self.dropped = [-1], ["#root"], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._text, self._linked = [0], [], 0
        self._at: dict[str, list[int]] = {}
        self._block_at = [0]
        self._read(page)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[self._block_at[-1]], text, self._linked))
            self._text, self._linked = [], 0

    def _depth(self, *tags: str) -> int:
        """How deep in the stack the innermost open element of these tags is; 0: there is none."""
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=0)

    def _pop_to(self, depth: int) -> None:
        for e in self._stack[depth:]:
            self._at[self.tag[e]].pop()
        del self._stack[depth:]
        while self._block_at[-1] >= depth:
            self._block_at.pop()

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if tag in _CLOSES_P and self.tag[self._stack[self._block_at[-1]]] == "p":
            self._pop_to(self._block_at[-1])
        if tag in _ENDS:
            ends, within = _ENDS[tag]
            bound = self._depth(*within)
            while (depth := self._depth(*ends)) > bound:
                self._pop_to(depth)
                if tag != "tr":
                    break
        if tag in _VOID:
            if tag == "br":
                self._text.append(" ")
            return
        names, bad = "", tag in _BOILERPLATE
        if attributes and not attributes.isspace():
            found = {}
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            bad |= "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(found.get("style", "")))
            # A paragraph or heading is boilerplate by its class only: its id is often made of its words.
            kinds = [found.get("class", "")] if tag == "p" or tag in _HEADINGS else [found.get(k, "") for k in ("class", "id", "role")]
            names = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
            own = (tag == "p" or tag in _HEADINGS) and self._depth("article", "main")  # those of an article are never judged by name
            if not bad and not own and tag not in ("html", "body", "article", "main"):
                bad = any(_boilerplate(name) for kind in kinds for name in kind.split())
        if tag == "header":
            bad = bad or not self._at.get("article")
        above = self._stack[-1]
        self.parent.append(above)
        self.tag.append(tag)
        self.names.append(names)
        self.dropped.append(bad or self.dropped[above])
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag in _BLOCK:
            self._block_at.append(len(self._stack))
        self._stack.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        depth = self._depth(tag)
        if depth and (tag in _BLOCK or self._depth("table", "article", "body") <= depth):
            self._pop_to(depth)

    def _read(self, page: str) -> None:
        at, n, last = 0, len(page), page.rfind(">")
        lower = None
        while at < n:
            begin = page.find("<", at) if at <= last else -1  # beyond the last ">" all is text
            while 0 <= begin < last and not (page[begin + 1] in "!?/" or page[begin + 1].isalpha()):
                begin = page.find("<", begin + 1)
            if begin > last:
                begin = -1
            piece = page[at:begin] if begin >= 0 else page[at:]
            if piece:
                text = html.unescape(piece) if "&" in piece else piece
                self._text.append(text)
                if self._at.get("a"):
                    self._linked += len(text)
            if begin < 0:
                break
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = n if end < 0 else end + 3
                continue
            m = _TAG.match(page, begin)
            if not m:  # a declaration, or "</" without a name
                at = page.find(">", begin) + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in _RAW:
                lower = page.lower() if lower is None else lower
                if len(lower) != n:  # a letter whose lower case is longer
                    lower = re.sub("[A-Z]", lambda x: x[0].lower(), page)
                end = lower.find(f"</{tag}", at)
                at = n if end < 0 else end
            else:
                self._open(tag, m[3])
        self._flush()


def _drop_forms(tree: _Tree) -> None:
    """Drop the forms but for those that are wrapped around the page or its article."""
    forms = {e for e, tag in enumerate(tree.tag) if tag == "form" and not tree.dropped[e]}
    if not forms:
        return
    size, holds = [0] * len(tree.tag), [tag in ("article", "main") for tag in tree.tag]
    for element, text, _ in tree.blocks:
        size[element] += 0 if tree.dropped[element] else len(text)
    for e in range(len(tree.tag) - 1, 0, -1):
        size[tree.parent[e]] += size[e]
        holds[tree.parent[e]] |= holds[e]
    for e in range(1, len(tree.tag)):
        fold = e in forms and not holds[e] and size[e] < FORM_SHARE * size[0]
        tree.dropped[e] |= fold or tree.dropped[tree.parent[e]]


def extract_blocks(page: str | None) -> list[str]:
    """The blocks of the main text, in page order."""
    tree = _Tree(page or "")
    _drop_forms(tree)
    size, linked, points = ([0.0] * len(tree.tag) for _ in range(3))
    for element, text, in_links in tree.blocks:
        size[element] += len(text)
        linked[element] += in_links
        if len(text) < MIN_BLOCK or tree.dropped[element] or tree.tag[element] in _HEADINGS:
            continue
        share, e = 1.0 + text.count(",") + min(len(text) / 100, 3), tree.parent[element]
        while e > 0 and share >= 0.1:
            points[e] += share
            share, e = share / 2, tree.parent[e]
        points[element] += 0 if tree.tag[element] == "p" else 1.0
    for e in range(len(tree.tag) - 1, 0, -1):  # children come after their parents
        size[tree.parent[e]] += size[e]
        linked[tree.parent[e]] += linked[e]
    live = [e for e in range(1, len(tree.tag)) if points[e] > 0 and not tree.dropped[e] and tree.tag[e] in _BLOCK]
    score = {}
    for e in live:
        base = points[e] + _TAG_POINTS.get(tree.tag[e], 0) + (25 if tree.names[e] and _POSITIVE.search(tree.names[e]) else 0)
        score[e] = base * (1 - min(1.0, linked[e] / max(1.0, size[e])))
    if not score:
        best = next((e for kind in ("article", "main", "body") for e in range(1, len(tree.tag)) if tree.tag[e] == kind and not tree.dropped[e]), 0)
        chosen = {best}
    else:
        best = max(score, key=lambda e: (score[e], -e))
        chosen = {best}
        for e, s in score.items():
            if tree.parent[e] == tree.parent[best] and s >= max(10, SIBLING_SHARE * score[best]) and (tree.tag[e] == tree.tag[best] or tree.tag[e] == "p" or tree.tag[e] in _CONTAINERS and linked[e] <= SIBLING_LINKS * size[e]):
                chosen.add(e)
    out = []
    inside = [False] * len(tree.tag)
    for e in range(len(tree.tag)):
        inside[e] = e in chosen or (tree.parent[e] >= 0 and inside[tree.parent[e]])
    for element, text, _ in tree.blocks:
        if tree.dropped[element]:
            continue
        if inside[element] or (tree.parent[element] == tree.parent[best] and tree.tag[element] in ("p", "h1", "h2") and best and len(text) >= 80):
            out.append(text)
    return out


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text (blocks joined by an empty line) and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(extract_blocks(x.as_py())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = bounded_batches(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.toDF(id_col, url_col, "text", "n_chars")
