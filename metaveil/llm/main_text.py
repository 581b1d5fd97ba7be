"""The main text of web pages: a maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and runs of words. Words score positive and tags negative, by weights learned from
labelled pages (EXAMPLES, invented for this purpose, each marked where its article begins and ends): the score of a word is a
sum of log-odds, how words stand in articles and elsewhere, by the block they are in, by their being part of a link, and by the
kind of marked element around them. One linear scan (keep a running sum, start anew when it falls below zero) finds the best
contiguous region; nothing outside of it is kept. Of marked elements within the region, those that score negative are left out.

Marked are the elements of ASIDE, headers outside of articles, hidden ones, and those with a class, id or role of MARKS. A mark
only lowers scores. It is void where its element holds an article or main element or, if the page has none, more than half of
its unlinked words; the mark of a class also where the element holds a first heading. A heading that says nothing but COMMENTS
marks what follows it in its parent. An article or main element keeps its own: unmarked words and tags in it score nothing
below zero, so that lists of links there don't part it; where one holds the first heading, unmarked text outside scores as if
it were marked. Only what is no text at all (scripts, styles and the other RAW elements, comments, tags) goes without a score.

Defined cases: null, empty and text-less pages give an empty text; unclosed and stray tags are allowed, and take linear time; a
quotation mark that nothing closes is an ordinary character; without any markup the whole text is one block; a null page_id
or url stays null; rows that repeat a page_id each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.common import small_batches, struct, with_columns

TEXTS = struct(page_id="bigint", url="string", text="string", n_chars="bigint")

#: Elements whose content is no text and no markup.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")
#: Elements that are marked by their name.
ASIDE = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "head", "fieldset", "object", "canvas", "audio", "video"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "input", "picture", "source",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Names, of classes, ids and roles, and parts of such names between hyphens and underscores, that mark an element.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion cookie cookies consent "
    "gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations sidebar side aside menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toc footer "
    "header masthead topbar comment comments reply replies respond disqus discussion widget widgets search toolbar complementary "
    "contentinfo outbrain taboola".split()
)
#: Parts of names that turn the meaning of the rest: an element "with-sidebar" is none.
TURNS = {"with", "has", "no", "without", "left", "right", "is", "post", "entry", "article"}

#: Headings of what readers have written, in the languages of the tables, with or without their number.
COMMENTS = re.compile(
    r"\(?\d*\)?\s*(?:(?:reader|user|leser|usuario)s?\W?\s*)?(?:comments?|replies|responses|discussion|kommentare?|antworten|commentaires?|réponses|réactions|comentarios?|respuestas)\s*[:(]?\s*\d*\)?\s*:?", re.I
)
HEADINGS = ("h2", "h3", "h4", "h5", "h6")

OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def mark_of(tag: str, attributes: str, inside: bool) -> str:
    """name (by its tag), class, or nothing. inside: in an article or main element."""
    if tag in ASIDE or tag == "header" and not inside:
        return "name"
    if tag in ("html", "body", "article", "main") or not attributes:
        return ""
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and value == "true":
            return "name"
        for name in value.split():
            parts = {p for p in re.split(r"[^a-z]+", name) if p}
            if parts & MARKS and not parts & TURNS:
                return "class"
    return ""


class Tags:
    """Goes through the tags and texts of a page in linear time."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'"}
        self.quotes = True

    def end(self, at: int) -> int:
        """The place after a tag whose name ends at that place; -1 if the page ends before."""
        i = at
        while self.quotes:
            m = STOP.search(self.page, i)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            i = self.page.find(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
        self.quotes = False  # what seemed a quoted value runs to the end of the page: from here on each > ends a tag
        return self.page.find(">", at) + 1 or -1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """kind ("tag", "/tag", "text"), name or decoded text, attributes."""
        page, at, start = self.page, 0, 0
        while m := OPENING.search(page, at):
            if m[1]:
                end = page.find("-->", m.end())
                end = end + 3 if end >= 0 else len(page)
            elif m[2]:
                end = page.find(">", m.end()) + 1 or len(page)
            else:
                end = self.end(m.end())
                if end < 0:
                    break
            if m.start() > start:
                yield "text", html.unescape(page[start : m.start()]), ""
            at = start = end
            if m[4]:
                name = m[4].lower()
                yield "/tag" if m[3] else "tag", name, page[m.end() : end - 1]
                if name in RAW and not m[3]:
                    stop = RAW_END[name].search(page, at)
                    at = start = stop.end() if stop else len(page)
        if start < len(page):
            yield "text", html.unescape(page[start:]), ""


class Step(NamedTuple):
    kind: str
    value: str
    words: int
    block: str
    link: bool
    mark: int  # index of the innermost marked element, -1: none
    place: str  # in an article or main element, out of the one with the first heading, or nothing


class Marked:
    """A marked element: what it holds, and whether its mark is void."""

    def __init__(self, kind: str, outer: int):
        self.kind, self.outer = kind, outer
        self.words, self.article, self.heading = 0, False, False


def steps(page: str) -> tuple[list[Step], list[Marked]]:
    """What stands on a page, and its marked elements."""
    found, marked = [], []
    stack: list[tuple[str, int]] = []  # open elements, and the mark outside of each
    opened: Counter[str] = Counter()
    mark, block, words, headed, heading = -1, "", 0, False, -1

    def inside() -> str:
        return "in" if opened["article"] + opened["main"] > 0 else "out"

    def close(depth: int) -> None:
        nonlocal mark
        while len(stack) > depth:
            name, outer = stack.pop()
            opened[name] -= 1
            if mark != outer:
                inner, mark = marked[mark], outer
                if mark >= 0:
                    marked[mark].words += inner.words
                    marked[mark].article |= inner.article
                    marked[mark].heading |= inner.heading

    for kind, value, attributes in Tags(page):
        if kind == "text":
            n, link = len(value.split()), opened["a"] > 0
            if not link:
                words += n
                if mark >= 0:
                    marked[mark].words += n
            found.append(Step("text", value, n, block, link, mark, inside()))
            continue
        if kind == "/tag":
            if value in HEADINGS and heading >= 0 and stack and stack[-1][0] == value:
                if COMMENTS.fullmatch(" ".join(s.value for s in found[heading:] if s.kind == "text").strip()):
                    close(len(stack) - 1)
                    marked.append(Marked("comments", mark))
                    mark = len(marked) - 1
                    found[heading:] = [s._replace(mark=mark) for s in found[heading:]]
                    found.append(Step(kind, value, 0, value, opened["a"] > 0, mark, inside()))
                    heading = -1
                    continue
                heading = -1
            if opened[value]:
                close(max(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == value) if stack[-1][0] != value else len(stack) - 1)
        else:
            if value in ("p", "li") and stack and stack[-1][0] == value:
                close(len(stack) - 1)
            if value not in VOID and value not in RAW and not attributes.endswith("/"):
                kind_ = mark_of(value, attributes, opened["article"] + opened["main"] > 0)
                stack.append((value, mark))
                opened[value] += 1
                if kind_:
                    marked.append(Marked(kind_, mark))
                    mark = len(marked) - 1
            if mark >= 0:
                marked[mark].article |= value in ("article", "main")
                marked[mark].heading |= value == "h1"
            headed |= value == "h1" and inside() == "in"
            heading = len(found) if value in HEADINGS else heading
            block = block if value in INLINE else value
        found.append(Step(kind, value, 0, block, opened["a"] > 0, mark, inside()))
    close(0)
    if not headed:
        found = [s._replace(place="") if s.place == "out" else s for s in found]
    articles = any(s.kind == "tag" and s.value in ("article", "main") for s in found)
    for m in marked:
        if m.article or m.kind != "comments" and not articles and 2 * m.words > words or m.kind == "class" and m.heading:
            m.kind = ""
    for m in marked:  # outer elements stand before their inner ones
        if not m.kind and m.outer >= 0:
            m.kind = marked[m.outer].kind
    return found, marked


#: Labelled pages: what stands between the two comments is the article.
BEGIN, END = "<!--begin-->", "<!--end-->"
EXAMPLES = (
    f"<html><head><title>A walk</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>{BEGIN}<article><h1>A walk along the river</h1><p>The path starts behind the old mill and follows the water for about an hour.</p><p>In spring the meadows are <b>flooded</b>, so boots are of use.</p><p>Take some bread along.</p></article>{END}<footer>&copy; Walks <a href='/i'>Imprint</a></footer></body></html>",
    f"<html><body><div><a href='/'>Start</a> | <a href='/about'>About us</a> | <a href='/c'>Contact</a></div><div>{BEGIN}<h1>Bread without kneading</h1><div><p>Mix flour, water, salt and very little yeast the evening before.</p><p>Bake it hot, in a closed pot, until the crust is dark.</p><ul><li>flour of any kind</li><li>a pinch of yeast</li></ul><p>Let it cool.</p></div>{END}</div><div><h3>More</h3><ul><li><a href='/1'>Soup</a></li><li><a href='/2'>Cake</a></li><li><a href='/3'>Salad</a></li></ul></div></body></html>",
    f"<html><body><header><a href='/'>Paper</a> of the valley</header><div class='menu'><a href='/s'>Sports</a><a href='/w'>Weather</a></div>{BEGIN}<main><h2>Council votes on the bridge</h2><p>After a long debate the council has voted to repair the bridge.<br>Work begins in May.</p><blockquote>We waited for ten years, said the mayor.</blockquote><table><tr><th>cost</th><td>two million</td></tr></table><p>See the <a href='/plan'>plan</a> for details.</p></main>{END}<aside><h4>Most read</h4><ol><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ol></aside><form>Your address <input name='q'><button>Go</button></form></body></html>",
    f"<html><body><table><tr><td><a href='/x'>X</a></td><td><a href='/y'>Y</a></td></tr></table>{BEGIN}<div><h1>On slow reading</h1><p>Reading slowly is a habit that one has to learn again.</p><p>The page does not run away, and the sentence is patient with its reader.</p><pre>note: take a pencil</pre></div>{END}<div class='comments'><p>Nice text, thank you!</p><p>I read fast, and I do not mind it at all.</p></div><div><a href='/p'>Previous</a> <a href='/n'>Next</a></div></body></html>",
    f"<html><body><div class='cookie-notice'><p>We use cookies to remember you. Do you agree?</p><button>Yes</button></div><div class='page with-sidebar'>{BEGIN}<div class='post-header'><h1>Keeping bees in town</h1></div><div>A hive on the roof needs shade at noon and water nearby.<p>Bees fly three miles for lime trees in bloom.</p></div>{END}<div class='sidebar'><h3>About</h3><p>I write about gardens and bees.</p><ul><li><a href='/b'>Bees</a></li><li><a href='/r'>Roofs</a></li></ul></div></div><footer><p>All rights reserved.</p></footer></body></html>",
    f"<html><body><nav><a href='/'>Home</a> <a href='/all'>All texts</a></nav><section>{BEGIN}<h1>A stone bridge</h1><p>It was built in four years by thirty masons.</p><h2>The arches</h2><p>Each arch has sixty stones, and none of them is cut alike.</p><dl><dt>span</dt><dd>twenty metres</dd></dl><figure><figcaption>The bridge from the south</figcaption></figure>{END}</section><section class='related'><h3>Related</h3><p><a href='/t'>Towers of the coast</a></p><p><a href='/w'>Walls</a></p></section><div class='ad'>Buy stones cheaply, today only, at our shop in the north.</div></body></html>",
    f"<html><body><center><a href='/'>Index</a></center>{BEGIN}<h1>Notes on rain</h1>Rain falls when drops have grown too heavy for the air that holds them.<br>On the hills it falls first.<p>A gauge is read each morning at seven.<ol><li>empty the gauge</li><li>write down what it held</li></ol>{END}<div class='comment'>First!</div><div class='comment'>My gauge broke last winter, what now?</div><form><p>Leave a reply</p></form><address><a href='/me'>Me</a></address></body></html>",
)


class Weights(NamedTuple):
    word: float
    block: dict[str, float]
    link: dict[bool, float]
    mark: dict[str, float]
    tag: dict[str, float]

    def of(self, step: Step, marked: list[Marked]) -> float:
        kind = marked[step.mark].kind if step.mark >= 0 else ""
        own = step.place == "in" and not kind
        if step.kind != "text":
            score = self.tag.get(step.value if step.kind == "tag" else f"/{step.value}", 0.0)
            return max(score, 0.0) if own else score
        kind = {"comments": "class"}.get(kind, kind) or ("name" if step.place == "out" else "")
        words = min(step.words, 1) if kind else step.words  # a long advert parts an article no more than a short one
        score = words * (self.word + self.block.get(step.block, 0.0) + self.link[step.link] + self.mark[kind])
        return max(score, 0.0) if own else score


@cache
def weights() -> Weights:
    """Log-odds of words in articles, by block, link and mark, and what a tag adds to them: at most nothing, at least minus one word."""
    counts: dict[str, dict[bool, Counter]] = defaultdict(lambda: {True: Counter(), False: Counter()})
    for page in EXAMPLES:
        found, marked = steps(page)
        whole = steps(page.replace(BEGIN, "<begin>").replace(END, "<end>"))[0]
        good = False
        rest = iter(found)
        for step in whole:
            if step.value in ("begin", "end") and step.kind == "tag":
                good = step.value == "begin"
                continue
            step = next(rest)
            if step.kind == "text":
                kind = marked[step.mark].kind if step.mark >= 0 else ""
                for feature, value in (("word", ""), ("block", step.block), ("link", step.link), ("mark", kind)):
                    counts[feature][good][value] += step.words
            else:
                counts["tag"][good][step.value if step.kind == "tag" else f"/{step.value}"] += 1

    def odds(feature: str, prior: float) -> dict:
        yes, no = counts[feature][True], counts[feature][False]
        return {k: math.log((yes[k] + 1) / (no[k] + 1)) - prior for k in {*yes, *no}}

    word = odds("word", 0.0)[""]
    tags = {k: max(-word, min(0.0, v)) for k, v in odds("tag", 0.0).items()}
    return Weights(word, odds("block", word), odds("link", word), {"name": 0.0, "class": 0.0} | odds("mark", word), tags)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; the longest of equals that start first; empty if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and best > 0 and found[0] == start:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None) -> str:
    known = weights()
    found, marked = steps(page or "")
    scores = [known.of(s, marked) for s in found]
    a, b = best_region(scores)
    sums = [0.0] * len(marked)
    for step, score in zip(found[a:b], scores[a:b]):
        if step.mark >= 0:
            sums[step.mark] += score
    left_out = [bool(m.kind) and s < 0 for m, s in zip(marked, sums)]
    for k, m in enumerate(marked):
        left_out[k] |= m.outer >= 0 and left_out[m.outer]
    blocks, run = [], []
    for step in found[a:b]:
        if step.kind == "text":
            if step.mark < 0 or not left_out[step.mark]:
                run.append(step.value)
        elif step.value == "br":
            run.append(" ")
        elif step.value not in INLINE:
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    return "\n".join(t for t in (" ".join(x.split()) for x in blocks) if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(TEXTS)
    for batch in batches:
        texts = [extract(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    return with_columns(pages, page_id="bigint", url="string", html="string").mapInArrow(_extract, TEXTS)
