"""Main text of web pages: site templates are found by hashing element subtrees and counting them per host, then left out.

A page is parsed twice, and never shuffled for the counting: the first pass sends only (host, hash of the content, subtree
hash), made distinct so that copies of a page count as one; the second leaves out the subtrees that recur, and what tags and roles mark as no article.
Names of classes and ids are a suspicion that the text has to bear out: see _named and _chosen.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, small_batches, table, texts

#: A subtree is template if it stands on so many pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.25
#: A subtree of more than this share of an article's text is that text, however often it recurs.
MAIN_SHARE = 0.6
#: Elements that hold blocks of text apart. The fixed values are HTML's own names.
BLOCKS = frozenset(
    "address article aside blockquote body center details dd dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
SKIPPED = frozenset("head nav footer aside form script style textarea title noscript iframe xmp noframes noembed template svg select option dialog menu search canvas audio video".split())
#: A named element stays if it holds so much text and more than MAIN_SHARE of it all, and less than half of that in links.
MAIN_CHARS, LINKED = 200, 0.5
#: Words of class and id, and roles, that menus, headers, footers, sidebars, notices, adverts, forms and reader comments have.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup popover modal overlay newsletter subscribe subscription signup login sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead comment comments commentlist disqus reply replies respond share sharing social related recommended widget widgets toolbar skip hidden".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Inside an article only these may be left out as template: a paragraph that many pages quote is still text.
CONTAINERS = frozenset("div section ul ol dl table menu details figure header".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "legend", "dd", "dt", "li", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
BARRIERS = frozenset("article aside section div main table ul ol dl blockquote form nav header footer td th body html".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-hidden|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_COMMENT_END, _ABRUPT = re.compile(r"--!?>"), re.compile(r"-?>")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hidden(tag: str) -> bool:
    """Whether attributes hide an element or give it a role that is no article's."""
    if "=" not in tag and "hidden" not in tag.lower():
        return False
    for name, value in _MARK.findall(tag):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDING.search(value) or name == "role" and value in ROLES:
            return True
    return False


def _named(tag: str, in_article: bool) -> str:
    """What class and id say of an element: c, reader comments; d, comments as one word of a longer name; x, a whole name is
    suspicious, as in "ad" or "cookie-banner"; y, a name only has a suspicious word, as in "site-footer" but "no-sidebar" and "share-price" too; or nothing."""
    if "=" not in tag:
        return ""
    found = set()
    for name, value in _MARK.findall(tag):
        if name.lower() in ("class", "id"):
            for token in value.strip("\"'").lower().split():
                words = [w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()]
                marks = [w for w in words if w in MARKS or w == "header" and not in_article]
                if words and words[0] in COMMENTS:
                    found.add("c" if len(marks) == len(words) else "d")
                elif marks:
                    found.add("x" if len(marks) == len(words) else "y")
    return min(found, default="")


class _Element:
    __slots__ = ("name", "skipped", "first", "parts", "article", "held", "kind", "number", "head")

    def __init__(self, name: str, skipped: int, first: int, article: bool, held: tuple[int, int] | None = None, kind: str = "", number: int = 0):
        self.name, self.skipped, self.first, self.article, self.held, self.kind, self.number = name, skipped, first, article, held, kind, number
        self.head = False  # holds a main heading
        self.parts: list[bytes] = []


def _tag_end(page: str, at: int) -> int:
    """Where the tag that starts at `at` ends, quoted > not counted; -1 if it never does."""
    end = page.find(">", at)
    if end < 0:
        return end
    head = page[at:end]
    for quote in "\"'":
        if head.count(quote) % 2 and head.rfind("=") >= 0 and head[head.rfind("=") :].lstrip("= \t\n").startswith(quote):
            close = page.find(quote, end)
            if close >= 0 and (later := page.find(">", close)) >= 0:
                return later
    return end


def parse(page: str, template: frozenset[int] | set[int] = frozenset(), hashes: set[int] | None = None, bodies: list[bytes] | None = None, again: bool = False) -> str:
    """The text of a page's article, as parsed() finds it."""
    return parsed(page, template, hashes, bodies, again)[0]


def _chosen(blocks: list[tuple[str, str, int, float]], named: list[tuple[int, int, str, int, bool]]) -> list[bool]:
    """Which blocks (scope, text, number of the article or main around it, characters in links) stay once the named elements (first
    and last block, kind, number, whether it holds a main heading) go that the text bears out.

    Comments go with all that is in them. Of suspicious elements an article or main inside is spared. A whole suspicious name takes an element away unless it
    is most of the page's text and no list of links; a suspicious word in a name only if half of its text or more is links and no main heading is in it; a
    word for comments in a longer name unless a main heading is in it. Where nothing would stay, only comments go.
    """
    sizes = [len(t) for _, t, _, _ in blocks]
    total = sum(sizes)
    stays = [True] * len(blocks)
    for a, b, kind, _, _ in named:
        if kind == "c":
            stays[a:b] = [False] * (b - a)
    sure = list(stays)
    for a, b, kind, number, head in named:
        size, links = sum(sizes[a:b]), sum(x for _, _, _, x in blocks[a:b])
        if kind == "c" or kind == "d" and head or kind == "y" and (head or not size or links < LINKED * size):
            continue
        if kind == "x" and size >= MAIN_CHARS and size > MAIN_SHARE * total and links < LINKED * size:
            continue
        for k in range(a, b):
            stays[k] &= kind != "d" and blocks[k][2] > number
    return stays if any(stays) else sure


def _scope(blocks: list[tuple[str, str, int, float]], stays: list[bool]) -> str:
    """a if the page's text is that of its articles, m if that of main, else empty: the whole page. A main with more text outside its articles than all articles have is the text."""
    size = {s: sum(len(t) for (x, t, _, _), y in zip(blocks, stays, strict=True) if y and x == s) for s in "am"}
    return "m" if size["m"] > size["a"] else "a" if size["a"] else ""


def _without(blocks: list[tuple[str, str, int, float]], chosen: list[bool], cuts: list[tuple[int, int]], keep: str) -> list[bool]:
    """Which blocks stay once the template subtrees (ranges of blocks) are cut.

    In an article or main a subtree of more than MAIN_SHARE of its text is no template but the text; on other pages
    the cuts are left undone where they would leave nothing.
    """
    wanted = [c and (b[0] == keep or not keep or keep == "m" and b[0] == "a") for b, c in zip(blocks, chosen, strict=True)]
    sizes = [len(b[1]) if w else 0 for b, w in zip(blocks, wanted, strict=True)]
    total, stays = sum(sizes), list(wanted)
    for a, b in cuts:
        if not keep or sum(sizes[a:b]) <= MAIN_SHARE * total:
            stays[a:b] = [False] * (b - a)
    return stays if keep or any(stays) else wanted


def parsed(page: str, template: frozenset[int] | set[int] = frozenset(), hashes: set[int] | None = None, bodies: list[bytes] | None = None, again: bool = False) -> tuple[str, int, int, int]:
    """(text of a page's article without the subtrees whose hashes are in template; characters that templates, names and tags took away, of these
    those of scripts and styles not counted); hashes, if given, gets those of all its block elements, and bodies that of the body, or of the page if it has none.

    again: article and main are read inside a form too. Where a page has no text otherwise, it is parsed again so.
    """
    blocks: list[tuple[str, str, int, float]] = []  # scope (a for article, m for main, empty for the rest), text, number of the landmark, characters in links
    cuts: list[tuple[int, int]] = []  # the blocks of template subtrees
    named: list[tuple[int, int, str, int, bool]] = []
    landmarks: list[int] = []
    inline: list[str] = []
    raw_chars = raw_links = tag_chars = number = 0
    stack = [_Element("", 0, 0, False)]
    opened: Counter[str] = Counter()
    skipping = surely = 0  # open elements that are left out; those of them that are so beyond doubt
    at, n = 0, len(page)
    scope = ""

    def flush() -> None:
        nonlocal raw_chars, raw_links
        if inline:
            text = " ".join(entities.unescape("".join(inline)).split())
            if text:
                blocks.append((scope, text, landmarks[-1] if landmarks else 0, len(text) * raw_links / max(1, raw_chars)))
            inline.clear()
            raw_chars = raw_links = 0

    def text_until(end: int) -> None:
        nonlocal raw_chars, raw_links, tag_chars
        if end > at:
            raw = page[at:end]
            if hashes is not None or template:
                if packed := raw.strip():
                    stack[-1].parts.append(packed.encode("utf-8", "surrogatepass"))
            size = len(raw) if not raw.isspace() else 0
            if not skipping:
                inline.append(raw)
                raw_chars += size
                raw_links += size if opened["a"] else 0
            elif stack[-1].name not in ("script", "style"):
                tag_chars += size

    def close() -> None:
        nonlocal skipping, surely, scope
        e = stack.pop()
        opened[e.name] -= 1
        if e.name in BLOCKS:
            flush()
        if hashes is not None or template:
            digest = xxhash.xxh64_digest(e.name.encode() + b"\0" + b"\1".join(e.parts))
            stack[-1].parts.append(digest)
            if bodies is not None and e.name == "body":
                bodies.append(digest)
            if e.name in BLOCKS and e.parts and e.name not in ("html", "body", "article", "main"):
                number = int.from_bytes(digest, "big", signed=True)
                if hashes is not None:
                    hashes.add(number)
                if number in template and (not e.article or e.name in CONTAINERS):
                    cuts.append((e.first, len(blocks)))
        if e.kind:
            named.append((e.first, len(blocks), e.kind, e.number, e.head))
        if e.head:
            stack[-1].head = True
        if landmarks and landmarks[-1] == e.number:
            landmarks.pop()
        if e.held is not None:
            skipping, surely = e.held
        elif e.skipped:
            skipping -= 1
            surely -= e.skipped > 1
        if e.name in ("article", "main"):
            scope = "a" if opened["article"] else "m" if opened["main"] else ""

    while at < n:
        i = page.find("<", at)
        if i < 0 or i == n - 1:
            text_until(n)
            break
        c = page[i + 1]
        if c in "!?":
            text_until(i)
            if page.startswith("<!--", i):
                m = _ABRUPT.match(page, i + 4) or _COMMENT_END.search(page, i + 4)
                at = m.end() if m else n
            else:
                end = page.find(">", i)
                at = end + 1 if end >= 0 else n
            continue
        m = _NAME.match(page, i + 1)
        if not m:  # a < that begins no tag
            text_until(i)
            at = i
            if not skipping:
                inline.append("<")
            at = i + 1
            continue
        end = _tag_end(page, i)
        text_until(i)
        if end < 0:  # the page ends within a tag
            break
        at, name, tag = end + 1, m[1].lower(), page[i + 1 : end]
        if c == "/":
            if opened[name] > 0:
                while stack[-1].name != name:
                    close()
                close()
            elif name in BLOCKS:
                flush()
            continue
        if name == "br":
            if not skipping:
                inline.append(" ")
            continue
        if name in CLOSES_P and opened["p"] > 0:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].name == "p" or stack[d].name in BARRIERS), 0)
            if depth and stack[depth].name == "p":
                while len(stack) > depth:
                    close()
        if name in SIBLINGS and any(opened[s] > 0 for s in SIBLINGS[name]):
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].name in SIBLINGS[name] or stack[d].name in BARRIERS - {"td", "th"}), 0)
            if depth and stack[depth].name in SIBLINGS[name]:
                while len(stack) > depth:
                    close()
        if name in ("td", "th") and not skipping:
            inline.append(" ")
        if name in BLOCKS:
            flush()
        if name in VOID or tag.endswith("/") and name in ("svg", "math"):
            continue
        in_article = opened["article"] + opened["main"] > 0
        if name in ("html", "body", "main"):
            skipped = 0
        elif name in SKIPPED or name == "header" and not in_article or name == "button" and opened["form"]:
            skipped = 1 if again and name == "form" else 2
        else:
            skipped = 2 if _hidden(tag) else 0
        kind = _named(tag, in_article) if not skipped and name not in ("html", "body", "main") else ""
        if kind and name not in BLOCKS:  # part of a line: nothing that statistics could weigh
            kind, skipped = "", 2 if kind in "cx" else 0
        number += 1
        landmark = name in ("article", "main") and not skipped
        free = landmark and skipping and not surely
        stack.append(_Element(name, skipped, len(blocks), in_article, (skipping, surely) if free else None, kind, number))
        opened[name] += 1
        if free:  # what is around it is a form
            skipping = 0
        if landmark and kind not in ("c", "d"):
            landmarks.append(number)
        stack[-1].head = name == "h1"
        skipping += skipped > 0
        surely += skipped > 1
        if name in ("article", "main"):
            scope = "a" if opened["article"] else "m"
        if name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else n
    while len(stack) > 1:
        close()
    flush()
    if bodies is not None and not bodies:
        bodies.append(xxhash.xxh64_digest(b"\1".join(stack[0].parts)))
    chosen = _chosen(blocks, named)
    keep = _scope(blocks, chosen)
    stays, all_of = (_without(blocks, chosen, some, keep) for some in (cuts, []))
    text = "\n\n".join(b[1] for b, s in zip(blocks, stays, strict=True) if s)
    if not text and not again and hashes is None and "form" in opened:  # a form may wrap the whole body
        return parsed(page, template, again=True)
    taken = sum(len(b[1]) for b, s, w in zip(blocks, stays, all_of, strict=True) if w and not s)
    return text, taken, sum(len(b[1]) for b, c in zip(blocks, chosen, strict=True) if not c), tag_chars


def host_of(url_col: str) -> Column:
    """What the templates are counted by: the URL's host in lower case; empty for null and malformed URLs, whose pages are alike one host."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^[^:]*://([^/?#]*)", 1))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hashes): the subtrees of pages (host, html) that stand on min_pages pages of the host and on min_share of them.

    Pages with equal bodies and blocks are copies and count as one; a page counts once for a subtree. A host's list is
    bounded: if pages have e elements on average, at most e / min_share can be that frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple[str, int]] = set()
            rows: list[tuple[str, int, int | None]] = []
            for host, raw in zip(b.column(0).to_pylist(), texts(b, "html"), strict=True):
                found: set[int] = set()
                bodies: list[bytes] = []
                parse(raw.decode(), hashes=found, bodies=bodies)
                blocks = b"".join(h.to_bytes(8, "big", signed=True) for h in sorted(found))
                content = int.from_bytes(xxhash.xxh64_digest(b"".join(bodies) + blocks), "big", signed=True)
                if (host, content) not in seen:
                    seen.add((host, content))
                    rows += [(host, content, h) for h in (None, *found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["host", "content", "hash"])

    small_batches(pages.sparkSession)
    counts = pages.select("host", "html").mapInArrow(run, "host string, content long, hash long").distinct()
    counts = counts.groupBy("host", "hash").agg(F.count("content").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= min_pages))
    counts = materialise(pages.sparkSession, counts, "subtrees")
    total = materialise(pages.sparkSession, counts.where("hash is null").select("host", F.col("n").alias("total")), "hosts")  # of known size, so that few hosts meet the counts without a shuffle
    often = counts.where("hash is not null").join(total, "host").where(F.col("n") >= min_share * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


#: Characters that templates, class names and tags take away.
TAKEN = ("template_chars", "name_chars", "tag_chars")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, url, text, and the characters TAKEN away by templates, class names and tags, scripts and styles not counted) for every page.

    Where a page has article elements its text is theirs, or that of main if main has more outside them, or else of the whole page but for what tags, roles, names and templates keep out.

    Null and empty html give an empty text. Null ids and repeated rows keep their rows; pages with a null URL share
    one host; an empty table gives no rows; other columns are ignored. Text is cut nowhere.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    found = materialise(spark, templates(rows, min_pages, min_share), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(3).to_pylist()
            out = [parsed(raw.decode(), frozenset(t or ())) for raw, t in zip(texts(b, "html"), known, strict=True)]
            counts = [pa.array([r[k] for r in out], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in out], pa.string()), *counts], names=["id", "url", "text", *TAKEN])

    return rows.join(found, "host", "left").select("id", "url", "html", "hashes").mapInArrow(run, "id long, url string, text string, " + ", ".join(f"{c} long" for c in TAKEN))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and how much of the page each kind of rule took away."""
    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), *TAKEN)
