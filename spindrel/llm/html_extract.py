"""HTML extraction by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "template", "title")}
_HIDDEN = frozenset("script style noscript template head title".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_BLOCK_NOT_P = _BLOCK - {"p"}
_CLOSES_P = _BLOCK - {"br", "body", "td", "th", "tr", "li", "dd", "dt"}
_SELF_CLOSING = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_LINK = frozenset(("a", "button", "select"))
_SPACE = re.compile(r"\s+")


class Dom:
    """Elements in document order (a child after its parent), as parallel lists. Node 0 is the root."""

    def __init__(self, source: str):
        self.tag, self.parent = ["#root"], [-1]
        #: (node, text) in order; None for the text where a block starts or ends
        self.pieces: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        """One pass over the source; what is open is known by name, so that each tag costs the same however deep it stands."""
        stack, at, n = [0], 0, len(source)
        open_: dict[str, list[int]] = {}  # places in the stack, by name
        blocks: list[int] = []  # places in the stack of blocks other than p
        quotes = True  # whether quotes shield a > in tags; no longer once one is never closed
        last = {q: source.rfind(q) for q in "\"'"}

        def pop(to: int) -> None:
            while len(stack) > to:
                name = self.tag[stack.pop()]
                open_[name].pop()
                if name in _BLOCK_NOT_P:
                    blocks.pop()

        begin = 0  # of the text that is being read
        while True:
            lt = source.find("<", at)
            if lt < 0 or lt + 1 == n:
                break
            mark, name, closing, empty = source[lt + 1], "", False, False
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                end = n if end < 0 else end + 3
            elif mark in "!?":
                end = source.find(">", lt) + 1
                if not end:
                    break
            else:
                closing = mark == "/"
                match = _NAME.match(source, lt + 1 + closing)
                if not match:
                    at = lt + 1
                    continue
                name, end = match[0].lower(), 0
                p = match.end()
                while quotes:
                    stop = _QUOTE_OR_END.search(source, p)
                    if stop and stop[0] == ">":
                        end = stop.end()
                        break
                    if not stop or stop.start() == last[stop[0]]:
                        quotes = False
                        break
                    p = source.find(stop[0], stop.end()) + 1
                if not end:
                    end = source.find(">", match.end()) + 1
                    if not end:
                        break
                empty = source[end - 2] == "/"
            if lt > begin:
                self.pieces.append((stack[-1], source[begin:lt]))
            at = begin = end
            if not name:
                continue
            if closing:
                if open_.get(name):
                    if name in _BLOCK:
                        self.pieces.append((stack[-1], None))
                    pop(open_[name][-1])
                continue
            if name in _CLOSES_P:
                if open_.get("p") and open_["p"][-1] > (blocks[-1] if blocks else 0):
                    pop(open_["p"][-1])
            elif name in _SELF_CLOSING:
                ends, scope = _SELF_CLOSING[name]
                inner = max((open_[e][-1] for e in ends if open_.get(e)), default=0)
                if inner > max((open_[e][-1] for e in scope if open_.get(e)), default=0):
                    pop(inner)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            if name in _BLOCK:
                self.pieces.append((node, None))
            if name in _RAW:
                close = _RAW[name].search(source, at)
                self.pieces.append((node, source[at : close.start() if close else n]))
                at = begin = close.end() if close else n
            elif name not in _VOID and not empty:
                open_.setdefault(name, []).append(len(stack))
                if name in _BLOCK_NOT_P:
                    blocks.append(len(stack))
                stack.append(node)
        if begin < n:
            self.pieces.append((stack[-1], source[begin:]))


def densities(dom: Dom) -> tuple[list[float], list[float], int]:
    """Composite text density and density sum of every node, and the body's number.

    Of a node: C characters, T tags, LC characters and LT tags in links. The
    density is C/T times the logarithm of (C/LC)(T/LT), to the base
    ln(C/(C-LC) LC + LC_body/C_body C + e): text in links makes it small.
    Zeros in denominators count as one; a base of one (no links at all) gives the natural logarithm.
    """
    n = len(dom.tag)
    hidden, linked = [False] * n, [False] * n
    for i in range(1, n):
        p = dom.parent[i]
        hidden[i] = hidden[p] or dom.tag[i] in _HIDDEN
        linked[i] = linked[p] or dom.tag[i] in _LINK
    c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in dom.pieces:
        if text and not hidden[node]:
            size = 0 if text.isspace() else len(text)
            c[node] += size
            if linked[node]:
                lc[node] += size
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        if hidden[i]:
            continue
        c[p] += c[i]
        lc[p] += lc[i]
        t[p] += t[i] + 1
        lt[p] += lt[i] + (1 if linked[i] else 0)
    body = next((i for i in range(n) if dom.tag[i] == "body"), 0)
    share = lc[body] / (c[body] or 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if c[i]:
            base = math.log(c[i] / ((c[i] - lc[i]) or 1) * lc[i] + share * c[i] + math.e)
            ratio = c[i] / (lc[i] or 1) * ((t[i] or 1) / (lt[i] or 1))
            density[i] = c[i] / (t[i] or 1) * math.log(ratio) / math.log(base) if base > 1 and ratio > 0 else c[i] / (t[i] or 1) * math.log(max(ratio, 1e-9))
        if i:
            total[dom.parent[i]] += density[i]
    return density, total, body


def extract(source: str | None) -> tuple[str, int, float, float] | None:
    """Main text, nodes, threshold and density sum of the chosen subtree."""
    if source is None:
        return None
    dom = Dom(source)
    density, total, body = densities(dom)
    n = len(dom.tag)
    inside = [False] * n
    inside[body] = True
    best = body
    for i in range(body + 1, n):
        inside[i] = inside[dom.parent[i]]
        if inside[i] and total[i] > total[best]:
            best = i
    threshold, i = density[best], best
    while i != body:
        i = dom.parent[i]
        threshold = min(threshold, density[i])
    # below the body, every node that reaches the threshold gives its subtree of the greatest sum, so that blocks
    # beside the best one in its wrapper count; a lone leaf (an advertisement, a footer) has no sum and gives none
    chosen: set[int] = set()
    if best == body:
        chosen.add(body)
    else:
        head = [i if total[i] > 0 else -1 for i in range(n)]
        for i in range(n - 1, body, -1):
            p = dom.parent[i]
            # of equal sums the first in the document wins
            if head[i] >= 0 and (head[p] < 0 or total[head[i]] > total[head[p]] or (total[head[i]] == total[head[p]] and head[i] < head[p])):
                head[p] = head[i]
        chosen = {head[i] for i in range(body + 1, n) if inside[i] and density[i] >= threshold and density[i] > 0 and head[i] >= 0}
    kept = [False] * n
    for i in range(n):
        kept[i] = i in chosen or (i > 0 and kept[dom.parent[i]] and dom.tag[i] not in _HIDDEN)
    parts: list[str] = []
    for node, text in dom.pieces:
        if kept[node] and dom.tag[node] not in _HIDDEN:
            parts.append("\n" if text is None else _SPACE.sub(" ", html.unescape(text)))
    lines = (_SPACE.sub(" ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x), n - 1, threshold, total[best]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [extract(x) or (None, None, None, None) for x in batch["html"].to_pylist()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch["page_id"], *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64(), pa.float64()))]], names=["page_id", "text", "n_nodes", "threshold", "density_sum"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_nodes, threshold, density_sum of every page: its main text.

    Every node of the DOM has a composite text density, every parent the sum of
    its children's. The node of the greatest sum is the centre of the content; the
    least density on its path up to the body is the threshold; each node under the
    body that reaches it, however deep, gives its own subtree of the greatest sum,
    so that content in several blocks is found and menus aren't. Text comes by
    block, entities decoded, white space collapsed.

    - A null page gives nulls; an empty one, or one without text, an empty text.
    - Broken markup (unclosed, crossed, cut off) is read as browsers do in the
      main: an open paragraph or item ends at the next, unknown ends are passed
      over, a bracket that opens no tag, or a tag that is never closed, is text;
      once a quote in a tag is never closed, tags end at their first >.
    - Without tags the whole text is the content. Depth and length have no limit,
      and time is in proportion to length. Ids must be integers or cast to them.
    - Of equal sums the first node in the document wins.
    - Repeated rows give repeated rows; extra columns are dropped before anything
      is computed. An empty table gives no rows.

    One pass without a shuffle.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(_run, "page_id long, text string, n_nodes int, threshold double, density_sum double")
