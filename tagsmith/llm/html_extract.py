"""Main text of HTML pages by minimum cut.

A page becomes blocks of text with their DOM paths. A linear classifier turns a block's features (elements and
class names on its path, links, length) into a margin, and the margin, bounded by CERTAIN, into costs of calling it content or
boilerplate: the capacities of its edges to the two terminals. Blocks that follow each other, and blocks near each other in the DOM, are joined by smoothness edges.
The minimum cut of that graph is the cheapest labelling; blocks on the content side are the text, in page order.

Nodes whose terminal outweighs all their smoothness edges are on its side in every minimum cut; they are folded
into their neighbours' terminals first, and max-flow runs on what is left.

Class words that name a place beside the text (sidebar, nav, ...) say nothing about an element that holds a main or an
article, nor do names like has-sidebar, comments-open or page-with-sidebar, nor a form around a main or an article. Of a main's
or an article's own names only whole ones count (comment, not comment-list). If the cut leaves nothing of a page, it is
cut again with the prior of a page that is all text, where a short block is no evidence against text, and then with forms
as none either; menus, notices and the like still are.

Defined cases: null or empty html gives an empty text; text outside any element is a block of the body; unclosed and
stray tags are repaired by nesting rules (body and text end an open head, blocks an open button or select); ties of the
cut go to boilerplate; pages of any size and depth are taken whole, in time linear in their tags; other columns are kept out; repeated rows are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser
from math import tanh

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import mapped, table

_BLOCK = {*"address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()}
_VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
#: Elements whose text is never text of the page.
_SILENT = {*"script style noscript template head title svg math iframe object audio video canvas select option datalist textarea button map".split()}
_CLOSES_P = _BLOCK - {"body", "html"}
_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_WHITE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")

#: Evidence for content (positive) and boilerplate, by elements and by words in class, id and role of the path.
_ELEMENTS = {"article": 3.0, "main": 2.5, "nav": -8.0, "aside": -8.0, "footer": -7.0, "form": -8.0, "dialog": -8.0, "menu": -6.0, "h1": 1.0, "h2": 0.6, "h3": 0.6, "p": 0.8, "blockquote": 0.6, "pre": 0.8, "figcaption": 0.3}
_BAD = {*"ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation navigationbar breadcrumb breadcrumbs footer cookie cookies consent gdpr notice alert alertdialog popup modal overlay comment comments disqus reply replies respond share sharing social related recommended subscribe newsletter signup login search widget toolbar pagination pager masthead complementary contentinfo".split()}
_GOOD = {*"article content main post entry story body text maincontent".split()}
#: Those of _BAD that name a place in a layout.
_PLACES = {*"sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead banner sticky toolbar widget search ads ad".split()}
#: Class names with one of these say what a layout has or lacks, not what the element is.
_LAYOUT = {*"with has no without layout grid wrapper container page columns enabled disabled open closed allowed active ready on off work works".split()}
#: Elements whose start a head may hold; any other start ends it.
_IN_HEAD = {*"head title meta link base script style noscript template".split()}
_PHRASE_ONLY = {*"button select option datalist".split()}
#: Bound of a block's terminal capacity, in the units of the edges.
CERTAIN = 3.0
#: Weight of edges between neighbours in the page, and of those to the last block with the same parent.
ADJACENT, PROXIMITY = 0.9, 0.6


class _Block:
    __slots__ = ("links", "node", "parent", "tag", "text")

    def __init__(self, text: str, node: int, parent: int, tag: str, links: float):
        self.text, self.node, self.parent, self.tag, self.links = text, node, parent, tag, links


class _Blocks(HTMLParser):
    """Blocks of text, and the elements as arrays: parent, depth, own evidence, whether a main or an article is inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.depth, self.own, self.place, self.form, self.holds = [0], [0], [0.0], [0.0], [0.0], [False]
        self.stack: list[tuple[str, int, bool]] = []  # tag, element, silent
        self.scopes: list[tuple[str, int, dict[str, int]]] = [("body", 0, {})]  # open blocks and the inline elements open in each
        self.open: dict[str, int] = {}
        self.blocks: list[_Block] = []
        self.parts: list[str] = []
        self.linked = self.length = self.links = 0

    def _flush(self):
        text = _WHITE.sub(" ", "".join(self.parts)).strip()
        if text:
            tag, node, _ = self.scopes[-1]
            outer = self.scopes[-2][1] if len(self.scopes) > 1 else 0
            self.blocks.append(_Block(text, self.stack[-1][1] if self.stack else 0, outer, tag, self.linked / max(1, self.length)))
        self.parts.clear()
        self.linked = self.length = 0

    def _element(self, tag, attrs) -> int:
        own, place = _ELEMENTS.get(tag, 0.0), 0.0
        if tag == "header":
            own = 0.5 if self.open.get("article") or self.open.get("main") else -7.0
        if tag not in ("body", "html"):
            words = [_TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) for k, v in attrs if k in ("class", "id", "role") and v for name in v.split()]
            text_root = tag in ("main", "article")
            bad = {w for ws in words if not _LAYOUT & {*ws} and (len(ws) == 1 or not text_root) for w in ws if w in _BAD}
            if bad:
                own, place = own - 8.0, 8.0 if bad <= _PLACES else 0.0
            elif any(w in _GOOD for ws in words for w in ws):
                own += 1.0
            if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
                own, place = own - 8.0, 0.0
            if text_root and not bad:
                i = self.stack[-1][1] if self.stack else 0
                while i and not self.holds[i]:
                    self.holds[i] = True
                    i = self.parent[i]
        form = -_ELEMENTS["form"] if tag == "form" else 0.0
        up = self.stack[-1][1] if self.stack else 0
        self.form.append(form)
        self.parent.append(up), self.depth.append(self.depth[up] + 1), self.own.append(own), self.place.append(place + form), self.holds.append(False)
        return len(self.parent) - 1

    def _pop(self, at: int):
        gone = self.stack[at:]
        if any(t in _BLOCK for t, *_ in gone):
            self._flush()
        for t, *_ in reversed(gone):
            self.links -= t == "a"
            self.open[t] -= 1
            if t in _BLOCK:
                self.scopes.pop()
            else:
                self.scopes[-1][2][t] -= 1
        del self.stack[at:]

    def _close(self, tag: str):
        """Pop up to the innermost open tag."""
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        self._pop(at)

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag in ("td", "th"):
            self.parts.append(" ")
        if tag not in _IN_HEAD and self.open.get("head"):
            self._close("head")
        if tag in _BLOCK:
            self._flush()
            for t in _PHRASE_ONLY:
                if self.scopes[-1][2].get(t):
                    self._close(t)
        if tag in _CLOSES_P and self.scopes[-1][0] == "p":
            self._close("p")
        if tag in _SAME and self.open.get(tag):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._pop(i)
                    break
                if self.stack[i][0] in _SAME[tag]:
                    break
        if tag in _VOID:
            return
        self.links += tag == "a"
        silent = tag in _SILENT or bool(self.stack and self.stack[-1][2])
        node = self._element(tag, attrs)
        self.stack.append((tag, node, silent))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in _BLOCK:
            self.scopes.append((tag, node, {}))
        else:
            inline = self.scopes[-1][2]
            inline[tag] = inline.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _BLOCK and self.stack and self.stack[-1][0] == tag:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag):
        # an inline end tag does not close blocks
        if tag not in _VOID and (self.open.get(tag) if tag in _BLOCK else self.scopes[-1][2].get(tag)):
            self._close(tag)

    def handle_data(self, data):
        if self.open.get("head") and self.stack[-1][0] == "head" and data.strip():
            self._close("head")
        if self.stack and self.stack[-1][2]:
            return
        self.parts.append(data)
        n = len(data.strip())
        self.length += n
        if self.links:
            self.linked += n

    def finish(self):
        self.close()
        self._flush()
        return self.blocks

    def evidence(self, forms: bool = False) -> list[float]:
        """Of each element, that of its path; elements come after their parents. forms: a form is none."""
        out = [0.0] * len(self.parent)
        for i in range(1, len(out)):
            back = self.place[i] if self.holds[i] else self.form[i] if forms else 0.0
            out[i] = out[self.parent[i]] + self.own[i] + back
        return out


def _margin(block: _Block, path_evidence: float, all_text: bool = False) -> float:
    """Evidence that a block is content: the classifier's margin. all_text: the prior of a page that is all text."""
    size = min(len(block.text), 400) / 400
    if all_text:
        return path_evidence + 1.2 * size - 3.0 * block.links + 0.5
    few = 0.8 if block.tag in ("li", "tr", "div", "body") and len(block.text) < 40 else 0.0
    return path_evidence + 1.2 * size - 3.0 * block.links * (1 - 0.5 * size) - few - 1.0


def _edges(page: _Blocks) -> dict[tuple[int, int], float]:
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(page.blocks):
        if i:
            # steps up from either block to their common element; blocks come in page order, so all steps are at most two an element
            a, b, up = page.blocks[i - 1].node, block.node, [0, 0]
            while a != b:
                deeper = page.depth[b] > page.depth[a]
                a, b = (a, page.parent[b]) if deeper else (page.parent[a], b)
                up[deeper] += 1
            out[i - 1, i] = ADJACENT / (1 + max(up))
        if block.parent in last:
            e = (last[block.parent], i)
            out[e] = out.get(e, 0.0) + PROXIMITY
        last[block.parent] = i
    return out


def minimum_cut(margin: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: sum of |margin| of nodes labelled against their sign, and of edges between labels. True is content."""
    n = len(margin)
    need = list(margin)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(need[i]) <= sum(near[i].values()) + 1e-12:
            continue
        label[i] = need[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            need[j] += w if label[i] else -w
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow([need[i] for i in rest], {(x, y): near[i][j] for x, i in enumerate(rest) for y, j in enumerate(rest[x + 1 :], x + 1) if j in near[i]} if len(rest) < 64 else _renumber(rest, near)), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _renumber(rest: list[int], near: list[dict[int, float]]) -> dict[tuple[int, int], float]:
    at = {i: x for x, i in enumerate(rest)}
    return {(at[i], at[j]): w for i in rest for j, w in near[i].items() if at[i] < at[j]}


def _max_flow(need: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Shortest augmenting paths with levels; a node is content if the source still reaches it."""
    n = len(need)
    s, t = n, n + 1
    graph: list[list[list]] = [[] for _ in range(n + 2)]  # [to, capacity, index of the reverse edge]

    def join(a, b, there, back):
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i, x in enumerate(need):
        join(s, i, max(x, 0.0), 0.0)
        join(i, t, max(-x, 0.0), 0.0)
    for (a, b), w in edges.items():
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, c, _ in graph[a]:
                if c > 1e-12 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        while True:
            path, a = [], s
            while a != t:
                while at[a] < len(graph[a]):
                    e = graph[a][at[a]]
                    if e[1] > 1e-12 and level[e[0]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] == len(graph[a]):
                    if a == s:
                        break
                    level[a] = -1
                    a = path.pop()[0]
                    continue
                path.append((a, at[a]))
                a = graph[a][at[a]][0]
            if a != t:
                break
            flow = min(graph[x][i][1] for x, i in path)
            for x, i in path:
                e = graph[x][i]
                e[1] -= flow
                graph[e[0]][e[2]][1] += flow


def labelled(html: str, all_text: bool = False, forms: bool = False) -> list[tuple[str, float, bool]]:
    """(text, terminal capacity: positive for content, label) of each block of a page.

    all_text: the prior of a page that is all text; forms: a form is no evidence.
    """
    page = _Blocks()
    page.feed(html)
    if not page.finish():
        return []
    paths = page.evidence(forms)
    need = [CERTAIN * tanh(_margin(b, paths[b.node], all_text) / CERTAIN) for b in page.blocks]
    kept = minimum_cut(need, _edges(page))
    return [(b.text, x, k) for b, x, k in zip(page.blocks, need, kept, strict=True)]


def main_text(html: str) -> str:
    for all_text, forms in ((False, False), (True, False), (True, True)):
        texts = [text for text, _, kept in labelled(html, all_text, forms) if kept]
        if texts:
            break
    return "\n\n".join(texts)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id_col, the columns of keep, text, n_chars."""

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 200):
                some = b.slice(low, 200)
                texts = [main_text(h or "") for h in some.column(some.num_columns - 1).to_pylist()]
                arrays = [*some.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*some.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(id_col, *keep, F.col(html_col).cast("string").alias("__html"))
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType(rows.schema.fields[:-1]).add("text", StringType()).add("n_chars", LongType())
    return mapped(rows, run, schema)


def op6_mincut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(table(spark, sf_dir, "pages"))
