"""HTML extraction: a linear-chain CRF labels DOM leaf blocks as main text or not.

A page is read into leaf blocks: runs of text between block-level tags, each
with its open ancestors (tag, class, id, role). Features are these tags and
names, properties of the text (size, ending, share of links) and of the blocks
before and after; Viterbi decodes the page, with blocks that the markup itself
sets apart (a form, a sidebar, comments, ...) held at "not main". The model is
trained on pages whose own markup labels them: blocks under ``article`` or
``main`` are main text unless an inner element marks them as something else. No
feature holds that verdict. Each page is learned as it is and with lists,
quotes, tables, forms, comments and sidebars put in and around its article;
either with and without the two labelling elements, and every fourth page without
what sets blocks apart, so that pages without such markup are read by
their other cues. Tags are left out at random, so that none decides alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape, unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf

#: At most so many pages are learned from, the first by hash of their id, none longer than so many characters.
TRAIN_PAGES, TRAIN_CHARS = 300, 100_000
#: Share of tags and names that a training block is read without.
DROPPED = 0.15
#: What blocks that are held at "not main" lack in log-odds.
HELD = -1e6
BUCKETS = 1 << 14

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg math iframe object head title textarea select button option".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Tags and name parts that mark what is not main text.
ASIDE_TAGS = set("nav footer aside form header dialog menu figcaption".split()) | SILENT
ASIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|comments?|disqus|reply|replies|respond|menu|nav\w*|footer|header|masthead|cookies?|consent|notice|newsletter|subscribe|share|social|related|breadcrumbs?|pagination|popup|modal|login|signup|widget|contentinfo|complementary|gdpr|toolbar)(?:$|[\s_-])", re.I)
# Name parts that speak of another element: a wrapper with a sidebar isn't one.
OF_OTHERS = re.compile(r"(?:has|with|without|no|hide|show)[_-]?(?:side-?bar|ads?|header|footer|nav\w*|comments?|menu|banner)", re.I)
# Inside an article a header holds its title.
TITLES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|reply|replies|respond|related)(?:$|[\s_-])", re.I)
ARTICLE_TAGS = {"article", "main"}
LABELLING = {f"a:{t}" for t in ARTICLE_TAGS}
HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}


@dataclass
class Block:
    text: str
    said: str  # what the markup says: main, aside or none
    up: tuple[str, ...]  # distinct features of the open ancestors, shared by blocks that have the same
    last: str
    depth: int
    linked: int  # characters inside links


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks in page order. An open element costs the same at any depth, so deep pages stay linear."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, list[str]]] = []  # tag, what the markup says inside, features
    active: dict[str, int] = {}
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "up": ()}
    at, n = 0, len(html)

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                if state["up"] is None:
                    state["up"] = tuple(active)
                outer = next((t for t, _, _ in reversed(stack) if t not in INLINE), "")
                blocks.append(Block(text, stack[-1][1] if stack else "none", state["up"], outer, len(stack), state["linked"]))
            parts.clear()
        state["linked"] = 0

    def close(k: int) -> None:
        for tag, _, features in stack[k:]:
            state["links"] -= tag == "a"
            for f in features:
                active[f] -= 1
                if not active[f]:
                    del active[f]
                    state["up"] = None
        del stack[k:]

    def add(text: str) -> None:
        parts.append(text)
        if state["links"]:
            state["linked"] += len(text)

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(html, at)
            at = end.start() if end else n
            continue
        if tag in IMPLIED_END:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in IMPLIED_END[tag]:
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in INLINE | {"p", "div", "article", "main", "section"}:
            continue
        names = " ".join(a or b or c for a, b, c in NAME.findall(m[3])) if m[3] else ""
        hidden = bool(m[3]) and bool(HIDDEN.search(m[3]))
        features = [] if tag in INLINE else [f"a:{tag}", *(f"v:{v.lower()}" for v in names.split()), *(["h:"] if hidden else [])]
        for f in features:
            if f not in active:
                state["up"] = None
            active[f] = active.get(f, 0) + 1
        state["links"] += tag == "a"
        stack.append((tag, marked(stack[-1][1] if stack else "none", tag, names, hidden), features))
    flush()
    return blocks


def marked(outside: str, tag: str, names: str, hidden: bool) -> str:
    """What the markup says inside an element, given what it says outside of it.

    "main", "none", "aside", or "beside": an element that only its name marks,
    such as a wrapper named for the sidebar that it also holds, in which an
    article still counts.
    """
    if outside == "aside" or tag in ("html", "body"):
        return outside
    if hidden or tag in SILENT or (tag in ASIDE_TAGS and not (tag == "header" and outside == "main")):
        return "aside"
    if names:
        names = OF_OTHERS.sub(" ", names)
        if outside == "main" or tag in ARTICLE_TAGS:
            names = TITLES.sub(" ", names)
        if ASIDE_NAMES.search(names):
            return "aside" if outside == "main" or tag in ARTICLE_TAGS or READERS.search(names) else "beside"
    return "main" if tag in ARTICLE_TAGS else outside


def own_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    return [f"t:{b.last}", f"n:{min(words.bit_length(), 8)}", f"e:{b.text[-1] in '.!?…:;'}", f"c:{'©' in b.text}", f"l:{min(4 * b.linked // max(len(b.text), 1), 4)}"]


def sets_apart(feature: str) -> bool:
    """Whether a tag or name marks what is not main text."""
    return feature[2:] in ASIDE_TAGS if feature[1:2] == ":" and feature[0] in "at" else bool(ASIDE_NAMES.search(OF_OTHERS.sub(" ", feature[2:])))


def page_features(blocks: list[Block], hide: bool = False, bare: bool = False) -> list[list[int]]:
    """Feature buckets of each block; ``hide`` reads the elements that label training pages as divs, ``bare`` those that set blocks apart."""
    own = [own_features(b) for b in blocks]
    out, known = [], {}
    for i, b in enumerate(blocks):
        if b.up not in known:
            up = ["a:div" if hide and f in LABELLING or bare and f[0] == "a" and sets_apart(f) else f for f in b.up if not (bare and f[0] == "v" and sets_apart(f))]
            known[b.up] = [crc32(f.encode()) % BUCKETS for f in dict.fromkeys(up)]
        said = own[i] + [f"d:{min(b.depth, 8)}", f"w:{i * 8 // len(blocks)}"]
        said += [f"<{f}" for f in own[i - 1]] if i else ["<"]
        said += [f">{f}" for f in own[i + 1]] if i + 1 < len(blocks) else [">"]
        if hide:
            said = [re.sub("t:(?:article|main)$", "t:div", f) for f in said]
        out.append(known[b.up] + [crc32(f.encode()) % BUCKETS for f in said] + [BUCKETS])
    return out


def varied(html: str, blocks: list[Block]) -> str:
    """A training page with other elements put in and around its article: what its own markup labels stays labelled."""
    texts = [escape(b.text[:400]) for b in blocks if b.said == "main"] or ["x"]
    rng = np.random.default_rng(crc32(html.encode()))
    say = lambda: texts[rng.integers(len(texts))]
    bit = lambda most: say()[: rng.integers(1, most + 1)].strip() or "y"
    inside = [
        lambda: f"<ul><li>{say()}</li><li>{say()}</li></ul>", lambda: f"<ol><li><p>{say()}</p></li><li>{bit(60)}</li></ol>", lambda: f"<blockquote>{say()}</blockquote>", lambda: f"<blockquote><p>{say()}</p></blockquote>",
        lambda: f"<table><tr><th>{bit(20)}</th><td>{bit(30)}</td></tr></table>", lambda: f"<h2>{bit(40)}</h2>", lambda: f"<h3>{bit(30)}</h3><p>{say()}</p>", lambda: f"<pre>{say()}</pre>", lambda: f"<dl><dt>{bit(20)}</dt><dd>{say()}</dd></dl>",
        lambda: f"<ul><li><a href=x>{bit(25)}</a></li><li><a href=y>{bit(15)}</a></li></ul>", lambda: f"<div><p>{say()}</p></div>", lambda: f"<section><h2>{bit(30)}</h2><p>{say()}</p></section>", lambda: f"<p><a href=x>{bit(30)}</a> {say()}</p>", lambda: f"<div>{say()}</div>",
        lambda: f'<form><p>{bit(40)}</p><label>{bit(20)}</label></form>', lambda: f'<aside class="related"><h3>{bit(20)}</h3><ul><li>{bit(40)}</li></ul></aside>', lambda: f'<div class="ad">{bit(60)}</div>',
    ]
    around = [
        lambda: f'<div id="comments"><h2>{bit(15)}</h2><ul><li>{say()}</li><li><p>{say()}</p></li></ul></div>', lambda: f'<section class="comments"><p>{say()}</p><blockquote>{bit(80)}</blockquote></section>', lambda: f"<aside><h3>{bit(20)}</h3><p>{say()}</p></aside>",
        lambda: f'<div class="sidebar"><ul><li>{bit(50)}</li></ul><p>{say()}</p></div>', lambda: f"<form><p>{bit(50)}</p></form>", lambda: f'<div class="newsletter"><p>{bit(80)}</p></div>', lambda: f"<header><h1>{bit(30)}</h1></header>", lambda: f"<div><p>{bit(40)}</p></div>" if rng.random() < 0.1 else "",
    ]
    some = lambda makers, most: "".join(makers[rng.integers(len(makers))]() for _ in range(rng.integers(1, most)))
    few = rng.random() < 0.3  # a short article
    if rng.random() < 0.5:  # nothing between the menu and the article
        html = re.sub(r"(</(?:nav|header)>)(?:(?!</?(?:article|main)\b).)*(?=<(?:article|main)\b)", r"\1", html, count=1, flags=re.I | re.S)

    def opened(m: re.Match) -> str:
        return some(around, 3) + m[0] + (f"<h1>{bit(50)}</h1><p>{bit(90)}</p>" + some(inside, 4) if few else "")

    if rng.random() < 0.15:
        return f"<article><p>{say()}</p></article>" if rng.random() < 0.5 else f"<article>{some(inside, 3)}</article>"
    if rng.random() < 0.4:  # an article by itself, or nearly so
        found = re.search(r"<(article|main)\b.*</\1>", html, re.I | re.S)
        html = found[0] if found else html
    out = re.sub(r"<(?:article|main)\b[^>]*>", opened, html, count=1, flags=re.I)
    out = re.sub(r"</p>", lambda m: m[0] + (some(inside, 3) if rng.random() < 0.3 else ""), out, flags=re.I)
    if few:
        out = re.sub(r"(<(?:article|main)\b[^>]*><h1>.*?</h1><p>.*?</p>).*(?=</(?:article|main)>)", lambda m: m[1] + some(inside, 5), out, count=1, flags=re.I | re.S)
    return re.sub(r"</(?:article|main)>", lambda m: m[0] + some(around, 3), out, count=1, flags=re.I)


def held(blocks: list[Block]) -> np.ndarray:
    """Log-odds that keep blocks which the markup sets apart at "not main"."""
    return np.array([HELD if b.said in ("aside", "beside") else 0.0 for b in blocks])


def train(pages: list[str]) -> crf.Model:
    token, feature, labels, starts, offset = [], [], [], [0], []
    for html in pages:
        read = leaf_blocks(html or "")
        if not any(b.said == "main" for b in read):
            continue  # pages without such markup teach nothing
        rng = np.random.default_rng(crc32(html.encode()) ^ 1)
        for blocks in (read, leaf_blocks(varied(html, read))):
            for hide, bare in ((False, False), (True, False), *[(True, True)] * (blocks is read and len(starts) % 4 == 1)):
                for f, b in zip(page_features(blocks, hide, bare), blocks, strict=True):
                    f = [x for x, stays in zip(f, rng.random(len(f)) >= DROPPED, strict=True) if stays or x == BUCKETS]
                    feature += f
                    token += [len(labels)] * len(f)
                    labels.append(b.said == "main")
                offset.append(np.zeros(len(blocks)) if bare else held(blocks))
                starts.append(len(labels))
    return crf.fit(np.array(token, np.int64), np.array(feature, np.int64), np.array(labels, np.int64), np.array(starts), BUCKETS + 1, np.concatenate([np.zeros(0), *offset]))


def extract(model: crf.Model, pages: list[str]) -> list[str]:
    """Main text of each page: its main blocks in order, joined by one line feed."""
    read = [leaf_blocks(h or "") for h in pages]
    emission: list[float] = []
    starts = [0]
    for blocks in read:
        emission += (np.array([model.weights[f].sum() for f in page_features(blocks)]) + held(blocks)).tolist()
        starts.append(len(emission))
    e, starts = np.array(emission, float), np.array(starts)
    y = model.viterbi(e, crf.Chains(starts)) if len(e) else np.zeros(0, bool)
    return ["\n".join(b.text for b, keep in zip(blocks, y[a:b_], strict=True) if keep) for blocks, a, b_ in zip(read, starts[:-1], starts[1:], strict=True)]


def fit_extractor(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_chars: int = TRAIN_CHARS) -> crf.Model:
    """Learns from at most ``train_pages`` different pages, of at most ``train_chars`` characters, that hold an article or main element; their hashes are chosen first, so that only these pages come to the driver."""
    pick = pages.where(F.col("html").rlike("(?i)<(article|main)\\b") & (F.char_length("html") <= train_chars)).select("html", F.xxhash64("page_id", "html").alias("h"))
    chosen = [r.h for r in pick.select("h").distinct().orderBy("h").limit(train_pages).collect()]
    rows = pick.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).orderBy("h").toPandas()
    return train(list(rows["html"]))


def extract_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; whole pages, null html gives an empty text.

    Repeated rows each give their row. With no page to learn from, every
    block's odds are even and no text is taken. Columns besides page_id, url
    and html are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit_extractor(pages, train_pages))  # a fixed number of weights

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([t for lo in range(0, len(html), 256) for t in extract(shared.value, list(html[lo : lo + 256]))], dtype=object)

    out = pages.select("page_id", "url", text(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
