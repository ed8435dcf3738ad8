"""Main text of web pages by templates deduced from the pages of a host.

A token is an open tag or a close tag at its place in the tree, or a whole run of text at its place. Its occurrence vector
says how often it stands on each page of the host; tokens with equal vectors are an equivalence class. Classes that occur
on enough pages and whose elements open and close together are valid; nested by their paths they are the host's template,
and what stands between template elements are its slots. The slots of one element, the main one, are extracted.

A vector isn't kept, only two sums over its pages of hashes of (page, count): equal vectors have equal sums. So a host of
any number of pages needs a row for each token, summed in each task first.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, begin, stored

#: Elements without an end tag, of inline content, of text that isn't markup, and of which a new one ends the last.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var")
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noframes", "noembed")
#: Elements within a line of text whose own content isn't text of it; they don't end a block.
WITHIN = ("script", "style", "textarea", "iframe", "noscript", "template", "object", "svg", "math", "canvas", "button", "input", "select", "label", "audio", "video", "map")
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Small blocks: their end tags don't reach out of the element around them, and a p ends where another block begins.
SMALL = ("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "option", *INLINE)
BREAKS_NOTHING = frozenset((*INLINE, *WITHIN))

#: Elements that are never main text, and words of class, id or role that say so of any other.
EXCLUDED_TAGS = ("head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "button", "input", "select", "textarea", "label", "fieldset", "dialog", "menu", "audio", "video", "map", "title")
EXCLUDED_WORDS = (
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "masthead", "footer", "contentinfo", "sidebar", "aside", "complementary",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "alert", "dialog",
    "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "widget", "widgets", "pagination", "pager",
)
#: Of these a header within the article is its own heading and stays.
HEADERS = ("header", "banner")
#: Elements that can't be excluded by a word, and words of containers of main text, the surer ones first.
NEVER = ("html", "body", "article", "main")
MAIN_WORDS = (("article", "articlebody", "main"), ("content", "post", "entry", "story"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*))>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: Share of a host's pages that a template's class occurs on, pages that tell template text, and the share of words that
#: an element without a telling name must hold.
SUPPORT, LEAST_PAGES, SHARE = 0.5, 3, 0.7


class Run(NamedTuple):
    """Text within one block: its path, the number of its block, whether it is a link's, and the text with references decoded."""

    path: str
    block: int
    linked: bool
    text: str


class Element(NamedTuple):
    tag: str
    path: str
    excluded: bool
    inner: bool  # in an article or main element


def _named(attributes: str) -> tuple[str, set[str]]:
    """An element's name in paths (numbers of two or more digits count as one) and the words of its class, id and role."""
    if not attributes:
        return "", set()
    names: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        names += (m[2] or m[3] or m[4] or "").split()
    if not names:
        return "", set()
    key = "".join(f".{n}" for n in sorted({re.sub(r"\d{2,}", "0", n.replace("/", "_")) for n in names}))
    return key, {w for n in names for w in re.split(r"[^a-z]+", CAMEL.sub("-", n).lower()) if w}


def parsed(page: str) -> tuple[list[Run], Counter, Counter]:
    """Runs of text outside excluded elements, and how often each path opens and is closed by an end tag."""
    runs: list[Run] = []
    opens, closes = Counter({"": 1}), Counter({"": 1})
    stack = [Element("", "", False, False)]
    block, at, link, raw = 0, 0, False, ""

    def text(piece: str) -> None:
        top = stack[-1]
        if piece and not top.excluded:
            runs.append(Run(top.path, block, link, references.unescape(piece)))

    while at < len(page):
        if raw:  # up to its own end tag, whatever stands there
            m = re.compile(rf"</{raw}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at, raw = (m.end() if m else len(page)), ""
            stack.pop()
            continue
        m = TOKEN.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        inline, apart = tag in INLINE, tag not in BREAKS_NOTHING
        if apart:
            block, link = block + (tag != "br"), False
        if m[1]:
            link = link and tag != "a"
            depth = len(stack) - 1
            while depth and stack[depth].tag != tag and (tag not in SMALL or stack[depth].tag in SMALL):
                depth -= 1
            if depth and stack[depth].tag == tag:
                if not inline:
                    closes[stack[depth].path] += 1
                del stack[depth:]
            continue
        if apart and tag not in VOID:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ENDED_BY.get(tag, ()) or stack[depth].tag == "p":
                    del stack[depth:]
                elif stack[depth].tag not in SMALL:
                    break
        link = link or tag == "a"
        if tag in VOID:
            if tag == "br" and not stack[-1].excluded:
                runs.append(Run(stack[-1].path, block, link, " "))
            continue
        up = stack[-1]
        key, words = _named(m[3])
        inner = up.inner or tag in ("article", "main") or "main" in words
        bad = tag in EXCLUDED_TAGS or (tag not in NEVER and any(w in EXCLUDED_WORDS and not (inner and w in HEADERS) for w in words))
        bad = bad or (not inner and (tag == "header" or "header" in words and tag not in NEVER))
        here = up if inline and not bad else Element(tag, f"{up.path}/{tag}{key}", up.excluded or bad, inner)
        if not (inline or up.excluded):
            opens[here.path] += 1
        stack.append(here if here.tag == tag else here._replace(tag=tag))
        if tag in RAW:
            raw = tag
    return runs, opens, closes


def words_of(runs: list[Run]) -> Counter:
    """Words outside links by path."""
    found: Counter = Counter()
    for r in runs:
        if not r.linked:
            found[r.path] += len(r.text.split())
    return found


def joined(runs: list[Run]) -> list[tuple[str, str, int]]:
    """(path, text, words outside links) of each block, white space as one space, blocks without text left out."""
    blocks: dict[int, list[Run]] = {}
    for r in runs:
        blocks.setdefault(r.block, []).append(r)
    told = ((rs[0].path, " ".join("".join(r.text for r in rs).split()), sum(len(r.text.split()) for r in rs if not r.linked)) for rs in blocks.values())
    return [found for found in told if found[1]]


def text_hash(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}") >> 1


def chosen(paths: set[str], words: dict[str, int]) -> tuple[str, bool]:
    """The main element among paths, and whether its name tells that it is; words are those directly in each path.

    An article comes before an element whose role, class or id tells main text, and those before the deepest element with
    SHARE of all words; of one kind, the one with most words, then the first.
    """
    below: Counter = Counter()
    for path, n in words.items():
        at = path
        while at:
            below[at] += n
            at = at.rpartition("/")[0]
        below[""] += n

    def most(found: list[str]) -> list[str]:
        return sorted((p for p in found if below[p]), key=lambda p: (-below[p], p))

    last = {p: p.rpartition("/")[2] for p in paths}
    tiers: list[Callable[[str], bool]] = [lambda p: last[p].split(".")[0] == "article", lambda p: last[p].split(".")[0] == "main"]
    tiers += [lambda p, telling=telling: any(w in telling for n in last[p].split(".")[1:] for w in re.split(r"[^a-z]+", CAMEL.sub("-", n).lower()) + [n.lower()]) for telling in MAIN_WORDS]
    for tier in tiers:
        if found := most([p for p in paths if p and tier(p)]):
            return found[0], True
    deep = [p for p in paths if below[p] and below[p] >= SHARE * below[""]]
    return max(deep, key=lambda p: (p.count("/"), below[p], p), default=""), False


# --- the host's template ---


TOKENS = "host string, kind string, path string, hash long, times long, words long, a long, b long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each page: open tags (<), end tags (>) and runs of text (t), with two hashes of (page, times)."""
    begin("html_extraction")
    for batch in batches:
        out: list[tuple] = []
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            runs, opens, closes = parsed(page)
            words, of_page = words_of(runs), xxhash.xxh64_intdigest(page)
            texts = Counter(joined(runs))
            rows = [("<", p, 0, n, words[p]) for p, n in opens.items()] + [(">", p, 0, n, 0) for p, n in closes.items()]
            rows += [("t", p, text_hash(p, t), n, w * n) for (p, t, w), n in texts.items()]
            for kind, path, hash_, times, n in rows:
                h = xxhash.xxh64_intdigest(f"{of_page} {times}")
                out.append((host, kind, path, hash_, times, n, h & 0x7FFFFFFF, h >> 33))
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds = [pa.string()] * 3 + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in TOKENS.split(", ")])


def template(tokens: pd.DataFrame) -> tuple[str, list[int]]:
    """The main element's path and the hashes of template text, from a host's tokens that occur on enough pages.

    A class is valid if it holds the open tag of an element whose end tag is in it too, or is missing everywhere as in
    markup without end tags, and if the element around is in the template: classes nest from the root down. Template text
    is in the class of an element around it; a host of nothing but template text, as of copies of one page, has none.
    """
    pages = int(tokens.loc[(tokens["kind"] == "<") & (tokens["path"] == ""), "support"].max())
    vector = {(r.kind, r.path): (r.support, r.a, r.b) for r in tokens.itertuples() if r.kind != "t"}
    single = {r.path for r in tokens.itertuples() if r.kind == "<" and r.times == r.support}
    valid = {""}
    for path in sorted((p for k, p in vector if k == "<" and p), key=lambda p: p.count("/")):
        end = vector.get((">", path))
        if (end is None or end == vector["<", path]) and path.rpartition("/")[0] in valid:
            valid.add(path)
    words = {r.path: int(r.words) for r in tokens.itertuples() if r.kind == "<"}

    def around(path: str) -> Iterator[str]:
        while path:
            yield path
            path = path.rpartition("/")[0]

    told = [r for r in tokens.itertuples() if r.kind == "t" and pages >= LEAST_PAGES]
    fixed = [r for r in told if any(p in valid and vector["<", p] == (r.support, r.a, r.b) for p in around(r.path))]
    main, telling = chosen(valid & single, words)
    if telling:
        return main, []
    for r in fixed:
        words[r.path] -= int(r.words)
    slots = {p: max(0, n) for p, n in words.items()}
    return (chosen(valid & single, slots)[0], [r.hash for r in fixed]) if any(slots.values()) else (main, [])


def templates(own: Scratch, pages: DataFrame) -> DataFrame:
    """host, main, fixed: the template of each host in pages (host, html)."""
    rows = pages.select("host", "html").mapInArrow(_tokens, TOKENS)
    tokens = own.keep(rows.groupBy("host", "kind", "path", "hash").agg(F.count("*").alias("support"), *(F.sum(c).alias(c) for c in ("times", "words", "a", "b"))))
    hosts = tokens.where("kind = '<' and path = ''").select("host", F.col("support").alias("pages"))
    # tokens on half of a host's pages are no more than twice what a page has
    often = own.keep(tokens.join(hosts, "host").where(F.col("support") >= SUPPORT * F.col("pages")).drop("pages"))

    def deduced(group: pd.DataFrame) -> pd.DataFrame:
        main, fixed = template(group)
        return pd.DataFrame([(group["host"].iloc[0], main, fixed)], columns=["host", "main", "fixed"])

    return own.keep(often.groupBy("host").applyInPandas(deduced, "host string, main string, fixed array<long>"))


# --- extraction ---


def main_text(blocks: list[tuple[str, str, int]], main: str | None, fixed: set[int]) -> str:
    """Blocks within the main element but for template text, joined by empty lines."""
    kept = [t for p, t, _ in blocks if (not main or p == main or p.startswith(f"{main}/")) and text_hash(p, t) not in fixed]
    return "\n\n".join(kept)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as compressed blocks, to be dealt out by host."""
    begin("html_extraction")
    for batch in batches:
        packed = []
        for page in batch["html"].to_pylist():
            runs, opens, _ = parsed(page)
            packed.append(zlib.compress(json.dumps([joined(runs), words_of(runs), [p for p, n in opens.items() if n == 1]], ensure_ascii=False).encode(errors="surrogatepass"), 1))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("page_id", "url", "host")), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "packed"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("html_extraction")
    for batch in batches:
        texts = []
        for packed, main, fixed in zip(*(batch[c].to_pylist() for c in ("packed", "main", "fixed")), strict=True):
            blocks, words, once = json.loads(zlib.decompress(packed).decode(errors="surrogatepass"))
            if main and main not in once:  # a page that doesn't follow its host's template tells its own
                main, fixed = chosen(set(once), words)[0], []
            texts.append(main_text(blocks, main, set(fixed or ())))
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages (page_id, url, html).

    text is the main text: blocks in page order with an empty line between, white space in a block as one space, character
    references decoded; empty where the page has none, and for a null html. Menus, headers and footers of pages, sidebars,
    notices, adverts, forms, comments, scripts and styles go, by their elements or the words that name them; what a host
    repeats on its pages goes where the main element's name doesn't tell that all in it is text. Pages without a host (a
    null url, too) are one group. Repeated rows stay, ids may be null, other columns are ignored, and an empty table gives
    an empty one. Tags in any order or never closed are read as far as they go, whole pages of any length.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    hosted = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    with Scratch(pages.sparkSession) as own:
        found = templates(own, hosted)
        id_ = hosted.schema["page_id"].dataType.simpleString()
        packed = hosted.mapInArrow(_packed, f"page_id {id_}, url string, host string, packed binary")
        met = packed.join(found, "host", "left").select("page_id", "url", "packed", "main", "fixed")
        return stored(met.mapInArrow(_extracted, f"page_id {id_}, url string, text string, n_chars long"))
