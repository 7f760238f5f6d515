"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass judges each block by itself:
blocks in boilerplate elements, or made of links, are bad; long blocks with many stop words are
good; blocks that are long but have few stop words are bad outside the article element; the
rest, mostly short ones, are undecided. Stop words are those of STOPS and the words that a share
of COMMON of the corpus's pages hold, in whatever language; where hardly any block of a page has
some, its language is unknown and length and links alone decide. Where that leaves a page without a good
block, undecided blocks of over SHORT characters with some stop words are good. The second pass
gives each undecided block the label of its nearest decided neighbours: when both agree, theirs;
when they differ, the nearer one's, and at equal distance the label of where it stands (good in an
article or main element, bad elsewhere); with none, that label as well. In an article or main
element only links are bad, and undecided blocks beside them stay good, whatever their length and
language. Where a page has an article or main element with text other than links, what stands
outside it is bad.

White space inside a block becomes one space; line breaks count as white space. Text of a
boilerplate element inside a line, as a span with a class of adverts, is left out of its block.
Defined cases: null and empty html, and html without text, give an empty string; tags that are
never closed end with their container or with the page; an unclosed comment, script or style lasts
to the end of the page; rows with equal page_id are extracted each for itself; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import blocks_of, table, tidied

LONG = 200
SHORT = 70
MANY_STOPS, SOME_STOPS = 0.30, 0.15
LINKS = 0.5
#: Words that so large a share of pages hold are stop words, LEARNED of them at most; of up to LETTERS letters.
COMMON = 0.02
LEARNED = 2_000
LETTERS = 5

# Elements by kind, words of class, id and role that mark boilerplate, and stop words.
BLOCK = set(
    "address article aside blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template "
    "textarea tfoot th thead title tr ul video".split()
)
DROPPED = set("aside button canvas dialog footer form frameset head iframe menu nav noscript object optgroup option search select svg template textarea title video".split())
MAIN = {"article", "main"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARKS = set(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disclaimer disqus "
    "footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
STOPS = set(
    "a an and are as at be but by for from has he in is it not of on or that the they this to was were with you "
    "aber als auch auf aus das dass dem den der des die ein eine er es für hat ich im ist mit nicht sie sich sind und von war wie wird zu "
    "au aux ce dans de des du elle en est et il je la le les ne par pas plus pour que qui se sont sur un une vous "
    "al como con del el es ha las lo los más no para pero por su una y".split()
)

EDGES = ".,;:!?\"'()"

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_ANY_TAG = re.compile(r"<[^>]*>")
_PART = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    dropped: bool
    main: bool


def _marks(name: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is the article."""
    dropped, main = name in DROPPED or (name == "header" and not in_main), name in MAIN
    for key, value in _NAMED.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            dropped |= name not in ("html", "body") and not MARKS.isdisjoint(_PART.split(value))
        elif key == "role":
            dropped |= value in ROLES
            main |= value == "main"
        elif key == "itemprop":
            main |= value == "articlebody"
        else:
            dropped |= key == "hidden" or value == "true"
    return dropped, main


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    # Open elements: name, boilerplate, article, and whether they stand in a line.
    stack: list[tuple[str, bool, bool, bool]] = []
    held: list[str] = []
    links, in_link, silent, at = 0, False, False, 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(Block(text, links, any(s[1] for s in stack), any(s[2] for s in stack)))
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw and not silent:
            text = unescape(raw)
            held.append(text)
            if in_link:
                links += len("".join(text.split()))

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            # An element in a line ends in its block, but a link can hold blocks.
            if name not in BLOCK and name != "a" and not stack[i][3]:
                return

    def state() -> None:
        nonlocal in_link, silent
        in_link = any(s[0] == "a" for s in stack)
        silent = any(s[1] and s[3] for s in stack)

    while m := _TAG.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1])
        if not m[3]:
            continue
        name = m[3].lower()
        if name == "br":
            held.append(" ")
        if name in BLOCK:
            flush()
        if m[2]:
            close(name)
            state()
            continue
        if name in RAW and not m[4].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        if name == "a" and in_link:  # links don't nest
            close("a")
        if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            for x in ("p", "li") if name == "li" else ("p",):
                # What is left open in the paragraph's line ends with it.
                k = len(stack)
                while k and stack[k - 1][3] and stack[k - 1][0] != "a":
                    k -= 1
                if k and stack[k - 1][0] == x:
                    del stack[k - 1 :]
        dropped, main = _marks(name, m[4], any(s[2] for s in stack))
        stack.append((name, dropped, main, name not in BLOCK))
        state()
    say(html[at:] if not html[at:].startswith("<") else "")
    flush()
    return out


GOOD, BAD, OPEN = 1, 0, None


def stop_share(text: str, stops: frozenset[str] | set[str] = STOPS) -> float:
    words = text.split()
    return sum(w.strip(EDGES).lower() in stops for w in words) / len(words)


def first_pass(b: Block, stops: float, known: bool = True) -> int | None:
    """The label of a block with this share of stop words, in a language whose stop words are known or not."""
    if b.dropped:
        return BAD
    size = len(b.text)
    if b.link_chars / max(1, sum(map(len, b.text.split()))) > LINKS:
        return BAD
    if size < SHORT:
        return OPEN
    if size >= LONG and (stops >= MANY_STOPS or not known):
        return GOOD
    if stops >= SOME_STOPS or b.main or not known:
        return OPEN
    return BAD


def second_pass(found: list[Block], labels: list[int | None]) -> list[int]:
    last: list[tuple[int, int] | None] = []
    near = None
    for i, x in enumerate(labels):
        near = (i, x) if x is not None else near
        last.append(near)
    out, near = [], None
    for i in range(len(labels) - 1, -1, -1):
        near = (i, labels[i]) if labels[i] is not None else near
        if labels[i] is not None:
            out.append(labels[i])
            continue
        before, after, own = last[i], near, int(found[i].main)
        if own:
            out.append(GOOD)
        elif before is None or after is None:
            one = before or after
            out.append(own if one is None else one[1])
        elif before[1] == after[1]:
            out.append(before[1])
        else:
            a, b = i - before[0], after[0] - i
            out.append(own if a == b else before[1] if a < b else after[1])
    return out[::-1]


def main_text(html: str | None, stops: frozenset[str] | set[str] = STOPS) -> str:
    # Boilerplate elements are no neighbours: a caption beside an advert isn't one.
    found = [b for b in blocks(html or "") if not b.dropped]
    shares = [stop_share(b.text, stops) for b in found]
    # A language whose stop words are unknown: none of the page's texts has some.
    known = any(x >= SOME_STOPS and len(b.text) >= SHORT for b, x in zip(found, shares, strict=True))
    labels = [first_pass(b, x, known) for b, x in zip(found, shares, strict=True)]
    if any(b.main and x != BAD for b, x in zip(found, labels, strict=True)):
        kept = [i for i, b in enumerate(found) if b.main]
        found, labels = [found[i] for i in kept], [labels[i] for i in kept]
    elif GOOD not in labels:
        labels = [GOOD if x is OPEN and len(b.text) >= SHORT and (s >= SOME_STOPS or not known) else x for b, x, s in zip(found, labels, shares, strict=True)]
    return "\n\n".join(b.text for b, x in zip(found, second_pass(found, labels), strict=True) if x == GOOD)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, pages and rows seen: short words by the number of pages that hold them; the word "" counts pages."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "pages"])
        counts.clear()
        return made

    for batch in batches:
        for html in batch.column(0):
            words = {w.strip(EDGES).lower() for w in _ANY_TAG.sub(" ", html.as_py() or "").split() if len(w) <= LETTERS + 2}
            counts.update(w for w in words if len(w) <= LETTERS and w.isalpha())
            counts[""] += 1
            if len(counts) > 200_000:
                yield out()
    yield out()


def stop_words(pages: DataFrame) -> frozenset[str]:
    """STOPS and the words that a share of COMMON of the pages hold: LEARNED at most, the most frequent first."""
    found = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(tidied(_common), "word string, pages long").groupBy("word").agg(F.sum("pages").alias("pages"))
    total = found.where("word = ''").first()
    if total is None or not total.pages:
        return frozenset(STOPS)
    rows = found.where((F.col("word") != "") & (F.col("pages") >= COMMON * total.pages) & (F.col("pages") >= 20)).orderBy(F.desc("pages"), "word").limit(LEARNED).collect()
    return frozenset(STOPS | {r.word for r in rows})


def _extracted(stops):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks_of(batch, 2):
                texts = [main_text(h.as_py(), stops.value) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return tidied(run)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    stops = pages.sparkSession.sparkContext.broadcast(stop_words(pages))
    return rows.mapInArrow(_extracted(stops), "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
