"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element; a line in an excluded element (menus, headers, footers, side bars,
notices, adverts, forms, scripts, styles, reader comments) weighs nothing, any other its length. The weights are summed over a
sliding window of lines. On every page the text is where these sums are: a surge is where the sum rises over a threshold, the
page's highest sum divided by ``STEEPNESS``, a dive where it falls to it again, and the highest sum tells the main text. Text
between the first surge and the last dive is kept, short lines within it too. Where the highest sum lies in an ``article`` or
``main`` element, the element's borders take the place of these points, for it and for each other such element with a surge.

Names (class, id, role) only hint, as ``has-sidebar`` may stand on the wrapper of a whole page. So an element isn't excluded
by its names where it holds a ``main`` element, nor, on a page whose articles all lie in such elements, where it holds one of
the articles with the fewest of them around, if that gives more text; with names of what others write (comments, related
texts, adverts) only if there is no other text. An open head ends where its content does: at any other element or at text.

Null html counts as empty: text '' and n_chars 0. Broken markup never fails: an unclosed element ends with its parent, a tag
without an end is no text, and where a quote in a tag stays open to the page's end, quotes no longer hide a ``>``. The time
is linear in the page's length. Repeated rows stay; an empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import map_batches, table

WINDOW, STEEPNESS = 3, 16
#: A quote opens a value after an equals sign only; the second form is for pages where one stays open.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_BLIND = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "select", "button", "object", "canvas", "math")}
#: Elements that start and end a line; fixed values of HTML.
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav header footer aside form menu dialog head label".split())
#: Words of class, id and role names that mark what is not main text.
_MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget warning alert".split())
#: Those of them that are also words of any text: they count where they are half of a name's words.
_WEAK = frozenset("alert header hidden notice notices related replies reply search share sharing skip social warning widget".split())
#: Those of them whose articles are other texts than the page's.
_OTHERS = frozenset("ad ads advert advertisement adverts comment comments consent cookie cookies disqus hidden modal popup promo promoted related replies reply sponsor sponsored".split())
_HEAD = frozenset("base head link meta noscript script style template title".split())
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WHOLE = ("html", "body", "article", "main")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _excluded(tag: str, attrs: str) -> bool:
    return tag in _OUT or bool(attrs and tag not in _WHOLE and _HIDDEN.search(attrs))


def _marks(tag: str, attrs: str) -> set[str]:
    """What the names of an element say that it is, other than main text."""
    if tag in _WHOLE or not attrs:
        return set()
    found: set[str] = set()
    for m in _NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORD.findall(name)]
            marks = _MARKS.intersection(words)
            if marks - _WEAK or 2 * len(marks) >= len(words):
                found |= marks
    return found


class Marked:
    """Elements that are excluded by their names, each by its number and that of the next one around it; -1 is none."""

    def __init__(self):
        self.around: list[int] = []
        self.others: list[bool] = []
        self.lifted: list[bool] = []

    def add(self, around: int, others: bool) -> int:
        self.around.append(around)
        self.others.append(others)
        self.lifted.append(False)
        return len(self.around) - 1

    def lift(self, e: int) -> None:
        while e >= 0 and not self.lifted[e]:
            self.lifted[e], e = True, self.around[e]

    def standing(self) -> list[tuple[bool, int]]:
        """For every element, of it and those around it that stand: whether one holds others' texts, and their number; the last is that of -1."""
        out = [(False, 0)] * (len(self.around) + 1)
        for e, around in enumerate(self.around):
            others, n = out[around]
            out[e] = (others, n) if self.lifted[e] else (others or self.others[e], n + 1)
        return out


def _markup(page: str):
    """(text before, closes, tag, attributes, end) of every tag, then the last text; comments and declarations are passed over."""
    pattern, at, start, n = _TAG, 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            mark = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(mark, at + (4 if mark == "-->" else 2))
            to = n if end < 0 else end + len(mark)
            yield page[start:at], False, "", "", to
            at = start = to
        elif after == "/" or after.isalpha() and after.isascii():
            if (m := pattern.match(page, at)) is None and pattern is _TAG and _BLIND.match(page, at):
                pattern, m = _BLIND, _BLIND.match(page, at)
            if m is None and not page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                at += 1
                continue
            to = yield page[start:at], *((bool(m[1]), m[2].lower(), m[3], m.end()) if m else (False, "", "", n))
            at = start = to or (m.end() if m else n)
        else:
            at += 1
    yield page[start:], False, "", "", n


def lines_of(page: str) -> tuple[list[tuple[str, bool, int, int]], list[tuple[bool, int]], Marked]:
    """(text, weighs but for names, article, marked element) of every line, (is main, marked element) of every article, and the marked elements."""
    lines: list[tuple[str, bool, int, int]] = []
    articles: list[tuple[bool, int]] = []
    marked = Marked()
    stack: list[tuple[str, bool, int, int]] = []  # (tag, excluded, article around, marked element around)
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    out, inside, mark = 0, -1, -1

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                lines.append((text, not out, inside, mark))

    def pop() -> None:
        nonlocal out, inside, mark
        tag, o, inside, mark = stack.pop()
        opened[tag] -= 1
        out -= o

    tags = _markup(page)
    item = next(tags, None)
    while item is not None:
        text, closes, tag, attrs, at = item
        skip = None
        if text:
            if stack and stack[-1][0] == "head" and not text.isspace():
                pop()
            buffer.append(text)
        if tag in _BLOCK:
            flush()
        if closes:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag:
            if stack and stack[-1][0] == "head" and tag not in _HEAD:
                pop()
            if tag in _RAW:
                if not attrs.endswith("/"):
                    end = _RAW[tag].search(page, at)
                    skip = end.end() if end else len(page)
            elif tag not in _VOID and not attrs.endswith("/"):
                if tag == "p" and opened["p"]:  # an open paragraph ends where a block begins
                    while stack[-1][0] in ("b", "i", "em", "strong", "span", "a"):
                        pop()
                if tag in ("p", "li") and stack and stack[-1][0] == tag:
                    pop()
                o, names = _excluded(tag, attrs), _marks(tag, attrs)
                stack.append((tag, o, inside, mark))
                opened[tag] += 1
                if tag in ("article", "main") and not out:
                    articles.append((tag == "main", mark))
                    inside = len(articles) - 1 if inside < 0 else inside  # the outermost one counts
                if names:
                    mark = marked.add(mark, bool(names & _OTHERS))
                out += o
        try:
            item = tags.send(skip)
        except StopIteration:
            item = None
    flush()
    return lines, articles, marked


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, articles, marked = lines_of(page)
    for main, e in articles:
        if main:
            marked.lift(e)
    standing = marked.standing()
    fewest = min((standing[e] for _, e in articles), default=(False, 0))
    text = _kept(lines, standing)
    if fewest[1] and not (text and fewest[0]):
        for _, e in articles:
            if standing[e] == fewest:
                marked.lift(e)
        text = max(text, _kept(lines, marked.standing(), within=True), key=len)
    return text


def window_sums(weights: list[int]) -> list[int]:
    """Sum of the weights of the ``WINDOW`` lines that end at each line."""
    sums, total = [], 0
    for i, w in enumerate(weights):
        total += w - (weights[i - WINDOW] if i >= WINDOW else 0)
        sums.append(total)
    return sums


def _kept(lines: list[tuple[str, bool, int, int]], standing: list[tuple[bool, int]], within: bool = False, sums_of=window_sums) -> str:
    """The main text; with ``within`` only if it is in an article."""
    weights = [len(t) if weighs and not standing[e][1] else 0 for t, weighs, _, e in lines]
    sums = sums_of(weights)
    peak = max(sums, default=0)
    if not peak:
        return ""
    over = [i for i, s in enumerate(sums) if s * STEEPNESS > peak]  # from a surge to the next dive, each
    # the heaviest line of the highest window is the page's main text
    last = sums.index(peak)
    top = max(range(max(0, last - WINDOW + 1), last + 1), key=lambda i: weights[i])
    if lines[top][2] < 0:
        if within:
            return ""
        first, end = max(0, over[0] - WINDOW + 1), over[-1]
        return " ".join(lines[i][0] for i in range(first, end + 1) if weights[i])
    surged = {lines[i][2] for i in over if weights[i]} - {-1}
    return " ".join(t for (t, _, a, _), w in zip(lines, weights) if w and a in surged)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


#: A plain rule for pages of one closed article without elements to leave out; SQL has no such thing as the method.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '') AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(?:p|h[1-6]|br|ul|ol|li|div|pre|hr)(?:\s[^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g') AS text FROM a),
u AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM u
"""
