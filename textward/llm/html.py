"""Main-text extraction by consensus host paths.

1. Each page is parsed into blocks of text, each with the path of its containers, generalised to tags and classes
   (digits become ``0``, ids are left out: ``html>body>div.content-0>article``). Furniture is left out: menus,
   headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts, styles.
2. Every container is scored: the characters of its text outside links, weighted by its paragraphs and
   punctuation, less what its links hold; of containers around the best with about its score the outermost is taken,
   then the innermost that holds all its text outside links, so the outer one stays whenever it adds text.
3. In Spark the pages of a host vote for generalised paths, each with its score's share. Votes are summed per
   (host, path) with partial aggregation, so a hot host costs one row a task.
4. Each page is extracted again with its host's winning path: the text of all its containers of that path. A page
   without one falls back on its own best container.

The winners (one short row per host) are broadcast only if their count is at most ``HOSTS_BROADCAST``; beyond, they
are joined on (host, salt) with the hot hosts' pages spread over ``SALTS`` salts.

Defined cases: a null or empty page, and one of furniture alone, gives an empty text; a null url is a host of its
own (``''``); white space (Unicode's, decoded references too) inside a block becomes one space, ``br`` included; blocks join by one line feed in page
order; unclosed and misnested tags end where HTML ends them; rows with one page_id are extracted row by row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import bound_batches, materialise, trimmed

#: Hosts whose winning paths may be broadcast (about 200 bytes each); spread of a host's pages beyond that.
HOSTS_BROADCAST, SALTS = 100_000, 64

#: Fixed values of HTML: elements without an end tag, with raw text, that begin a block, that close an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("caption dd dt li tbody td tfoot th thead tr option optgroup legend html head body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"table", "td", "th"}}
#: Furniture by tag, by role, and by word of a class or id.
FURNITURE = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select textarea input label dialog menu object embed audio video title head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login social share sharing "
    "comment comments disqus respond reply replies related recommended pagination pager widget toolbar skip".split()
)
#: Words that with those make a name of furniture inside an article too, where one of those alone doesn't: a
#: ``share-buttons`` is one there, a ``share-price`` isn't.
PARTS = frozenset(
    "area bar block body bottom box btn button buttons center column container content count form global head heading icon icons inner inline item items label left "
    "link links list main meta middle module outer page panel post posts primary right row secondary section site slot small space stories story tag tags text thread title top "
    "unit wrap wrapper articles article user reader readers author date time google dfp native".split()
)
#: A class of these words around the whole article says nothing against it.
MAIN = frozenset("article main content body post entry story text".split())

#: Attributes up to the end of a tag: quotes count behind an equals sign only; one that is never closed ends with the tag.
_ATTRIBUTES = r"(?>[^\"'>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+"
TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>", re.S)
#: The begin of a tag or declaration that has no end.
UNENDED = re.compile(r"<(?=[a-zA-Z/!?])")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
LETTER = re.compile(r"[^\W_]")
GAP = re.compile(r"\s+")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


class Element:
    __slots__ = ("article", "chars", "furniture", "key", "linked", "marks", "parent", "paras", "path", "tag")

    def __init__(self, tag: str, key: str, parent: Element | None, furniture: bool):
        self.tag, self.key, self.parent = tag, key, parent
        self.furniture = furniture or (parent is not None and parent.furniture)
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.path = f"{parent.path}>{key}" if parent is not None else key
        self.chars = self.linked = self.paras = self.marks = 0


def _words(name: str) -> list[str]:
    return [re.sub(r"\d+$", "", w.lower()) for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", name) if w]


def _describe(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The generalised tag-class name, and whether it is furniture. ``inside`` an article a class must be furniture by all its words."""
    classes, names, furniture = "", [], tag in FURNITURE
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "0", c.lower()) for c in value.split()}))
            if name in ("class", "id"):
                names += [w for x in value.split() if (w := _words(x))]
            elif name == "role":
                furniture |= value.lower() in ROLES
            elif name == "hidden" or value == "true":
                furniture = True
    if names and tag not in ("html", "body", "article", "main"):
        words = {w for x in names for w in x}
        if inside:
            furniture |= any(WORDS.intersection(x) and (WORDS | PARTS).issuperset(w for w in x if w) for x in names)
        elif words & WORDS and not (tag in ("div", "section") and words & MAIN and not words & {"comment", "comments", "ad", "ads", "related"}):
            furniture = True
    return (f"{tag}.{classes}" if classes else tag), furniture


def parse(page: str | None) -> list[tuple[Element, str, int]]:
    """Blocks in page order: the container, the text, the characters inside links (all, if no letter is outside)."""
    blocks: list[tuple[Element, str, int]] = []
    root = top = Element("#root", "", None, False)
    held: list[str] = []
    owner, linked, in_link, plain = root, 0, 0, False

    def flush() -> None:
        nonlocal linked, plain
        if held:
            text = GAP.sub(" ", entities.unescape("".join(held))).strip()
            if text and not owner.furniture:
                blocks.append((owner, text, min(linked, len(text) - 1) if plain or not linked else len(text)))
            held.clear()
        linked, plain = 0, False

    def put(piece: str) -> None:
        nonlocal owner, linked, plain
        if top.furniture:
            return
        if not held:
            home = top
            while home.tag not in BLOCK and home.parent is not None:
                home = home.parent
            owner = home
        held.append(piece)
        if in_link:
            linked += len(piece)
        else:
            plain = plain or LETTER.search(piece) is not None

    def close(to: Element) -> None:
        nonlocal top, in_link
        while top is not to:
            if top.tag == "a":
                in_link = max(0, in_link - 1)
            top = top.parent

    at, page = 0, page or ""
    # searched anew from ``at``: after a raw element no token may reach out of its content
    while m := TOKEN.search(page, at):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            found = top
            while found.tag != tag and found.parent is not None and (tag in BLOCK or found.tag not in BLOCK):
                found = found.parent
            if found.tag == tag:
                close(found.parent)
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            for one in ("p",) if tag in ENDS_P and tag != "p" else (tag,) if tag in CLOSES else ():
                found = top
                while found.parent is not None and found.tag not in CLOSES[one] and found.tag not in SCOPE[one] and not (one == "p" and found.tag in ENDS_P - {"p"}):
                    found = found.parent
                if found.tag in CLOSES[one]:
                    close(found.parent)
        key, furniture = _describe(tag, m[3], top.article)
        if not (m[3].endswith("/") and tag not in BLOCK):
            top = Element(tag, key, top, furniture)
            in_link += tag == "a"
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                top = top.parent
    tail = UNENDED.search(page, at)
    if at < (end := tail.start() if tail else len(page)):
        put(page[at:end])
    flush()
    return blocks


def score(blocks: list[tuple[Element, str, int]]) -> dict[Element, float]:
    """The containers' scores."""
    for owner, text, linked in blocks:
        e: Element | None = owner
        while e is not None:
            e.chars += len(text)
            e.linked += min(linked, len(text))
            e.paras += owner.tag in ("p", "pre", "blockquote", "li") or len(text) > 80
            e.marks += text.count(".") + text.count(",")
            e = e.parent
    out: dict[Element, float] = {}
    for owner, _, _ in blocks:
        e = owner
        while e is not None:
            if e not in out and e.tag in CONTAINERS:
                out[e] = (e.chars - 2 * e.linked) * (1 + 0.1 * min(e.paras, 10) + 0.01 * min(e.marks, 50)) * BONUS.get(e.tag, 1.0)
            e = e.parent
    return out


#: Elements that may hold an article, and what speaks for them.
CONTAINERS = frozenset("article main section div td body blockquote center".split())
BONUS = {"article": 1.6, "main": 1.4, "body": 0.7}


def best(blocks: list[tuple[Element, str, int]]) -> tuple[str, float, float]:
    """The page's best container's path, its score, and the share of the page's score."""
    scores = score(blocks)
    if not scores:
        return "", 0.0, 0.0
    top = max(scores.values())
    # of containers with about the best score the outermost around the best one, then inward while every text outside links is held
    winner = max(scores, key=lambda e: (scores[e], -e.path.count(">")))
    *_, winner = (e for e in _around(winner) if e is winner or scores.get(e, 0.0) >= 0.9 * top > 0)
    texts = {e: 0 for e in scores}
    for owner, text, linked in blocks:
        for e in _around(owner) if linked < len(text) else ():
            if e in texts:
                texts[e] += 1
    inner = [e for e, s in scores.items() if texts[winner] and texts[e] == texts[winner] and s >= 0.9 * top and winner in _around(e)]
    winner = max(inner, key=lambda e: e.path.count(">"), default=winner)
    return winner.path, max(0.0, scores[winner]), 1.0


def _around(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def extract(blocks: list[tuple[Element, str, int]], path: str | None) -> str:
    """The text of the containers of ``path``; of the page's best one if it has none."""
    for wanted in (path, best(blocks)[0]):
        out = []
        for owner, text, _ in blocks if wanted else ():
            e: Element | None = owner
            while e is not None:
                if e.path == wanted:
                    out.append(text)
                    break
                e = e.parent
        if out:
            return "\n".join(out)
    return "\n".join(t for _, t, _ in blocks)


VOTES = "host string, path string, score double"
TEXTS = "page_id long, url string, text string, n_chars long"


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST, 1)).alias("host"),
    )


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n_pages, score: what the pages of each host voted for."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            rows = [(h, p, s) for h, t in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) for p, s, _ in (best(parse(t)),) if p]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["host", "path", "score"])

    cast = _pages(pages).select("host", "html").mapInArrow(run, VOTES)
    return cast.groupBy("host", "path").agg(F.count("*").alias("n_pages"), F.sum(F.log1p("score")).alias("score"))


def winners(pages: DataFrame) -> DataFrame:
    """host and its winning path: most votes by the logarithm of the score, so one long page doesn't decide."""
    ballot = votes(pages).groupBy("host").agg(F.max(F.struct("score", "n_pages", "path")).alias("w"))
    return ballot.select("host", F.col("w.path").alias("path"))


def extract_pages(pages: DataFrame, hosts_broadcast: int = HOSTS_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    bound_batches(spark)
    chosen = materialise(winners(pages), "paths")
    rows = _pages(pages)
    if chosen.count() <= hosts_broadcast:
        joined = rows.join(F.broadcast(chosen), "host", "left")
    else:
        spread = chosen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, ["host", "_salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            out = [extract(parse(t), p) for t, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, TEXTS)
