"""HTML extraction (6): boosted trees over DOM nodes with a hierarchical decoding.

A page becomes a tree of block elements. Every block has features: size and density of its
subtree, link share, attribute tokens, tag, depth, and statistics of its siblings. Gradient
boosted trees (logistic loss) give each block the probability of being main text. They are
trained on a bounded sample of pages (``MAX_PAGES``, the first by a keyed hash), labelled by
what mark-up says where it says something (article, nav, footer, class names) and by density
elsewhere; for half of the training rows the telling mark-up is hidden, so that the trees
also work where it is missing. Decoding maximises the log likelihood over the tree under one
rule: below a dropped block nothing is kept.

Edge cases: null and empty pages give the empty text; unclosed, crossed and unknown tags,
cut-off pages and text without any tag are parsed as far as they go; pages are read whole;
rows that repeat an id give a row each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import html
import json
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES, TREES, DEPTH, RATE, BINS = 400, 40, 4, 0.3, 24

# Fixed values of HTML: elements without content, raw text, inline elements, implied ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe object canvas textarea select title head option".split())
SKIP_RAW = set("script style textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("html body table ul ol dl div article section main aside nav header footer form".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?:.*?)\]\]>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|([^<]+|<)", re.S)
ATTR = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Attribute tokens that tell what a block is.
KINDS = {
    "navigation": set("nav navbar navigation menu menubar breadcrumb breadcrumbs topnav pagination pager toc skip".split()),
    "header": set("header masthead banner topbar logo branding".split()),
    "footer": set("footer copyright colophon bottom legal contentinfo".split()),
    "side": set("sidebar side aside widget related recommended recommendations trending popular more complementary rail".split()),
    "comment": set("comment comments commentlist disqus reply replies respond discussion".split()),
    "advert": set("ad ads advert advertisement adverts sponsor sponsored promo promotion banner-ad adsense outbrain taboola".split()),
    "notice": set("cookie cookies notice consent gdpr popup modal overlay newsletter subscribe subscription signup alert paywall dialog".split()),
    "share": set("share sharing social tags tag meta byline".split()),
    "form": set("form search login register contact".split()),
    "content": set("content article post entry story main body text articlebody maincontent blog".split()),
}
BAD_KINDS = [k for k in KINDS if k not in ("content", "share")]
BAD_TAGS = set("nav header footer aside form button menu dialog".split())
GOOD_TAGS = {"article", "main"}
TAGS = (("h1", "h2", "h3", "h4", "h5", "h6"), ("p",), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody"), ("div",), ("section",), ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "button", "fieldset"), ("blockquote", "pre", "figure"))
N_TELLING = len(TAGS) + 2 * len(KINDS) + 2


class Node:
    __slots__ = ("tag", "tokens", "parent", "depth", "kids", "own", "link", "n_tags", "text", "links", "blocks", "marks", "at", "parts")

    def __init__(self, tag, tokens, parent, at):
        self.tag, self.tokens, self.parent, self.at = tag, tokens, parent, at
        self.depth = parent.depth + 1 if parent else 0
        self.kids, self.parts = [], []
        self.own = self.link = self.n_tags = self.text = self.links = self.blocks = self.marks = 0


def _tokens(attrs: str) -> tuple[frozenset, bool]:
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return frozenset(), False
    words, hidden = set(), False
    for name, a, b, c in ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name != "style":
            words.update(w for part in value.split() for w in (part, *re.split(r"[-_:]+", part)) if w)
    return frozenset(words), hidden


def parse(page: str) -> list[Node]:
    """Block elements in page order, the first being the root; text parts are (order, text)."""
    root = Node("html", frozenset(), None, 0)
    nodes, stack = [root], [(root, "html")]  # (block that takes text, open element)
    links = order = pos = 0
    low = None
    end = len(page)
    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if m[7] is not None:
                node = stack[-1][0]
                text = html.unescape(m[7]) if "&" in m[7] else m[7]
                node.parts.append((order, text))
                n = len(text.split()) and len(text.strip())
                node.own += n
                node.marks += sum(map(text.count, ".,;:!?"))
                if links:
                    node.link += n
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    if any(t == "a" for _, t in stack[k:]) and tag != "a":
                        links = 0
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][1] not in INLINE or stack[k][1] in ("table",) and tag not in SCOPE:
                    break
            if tag not in INLINE:
                order += 1
            continue
        stack[-1][0].n_tags += 1
        if tag in VOID:
            if tag == "br":
                stack[-1][0].parts.append((order, " "))
            elif tag == "hr":
                order += 1
            continue
        if tag in SKIP_RAW or tag in RAW and tag != "head":
            if low is None:
                low = page.lower()
            stop = low.find("</" + tag, pos) if len(low) == end else page.find("</" + tag, pos)
            pos = end if stop < 0 else stop
            close = page.find(">", pos)
            pos = end if close < 0 else close + 1
            continue
        if tag == "html" or tag == "head":
            continue
        if tag in INLINE:
            links += tag == "a"
            stack.append((stack[-1][0], tag))
            continue
        order += 1
        shut = CLOSES.get(tag, set()) | {"p"}
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in shut:
                del stack[k:]
                links = 0
                break
            if stack[k][1] in SCOPE or stack[k][1] in ("td", "th", "li", "blockquote") and tag not in CLOSES:
                break
        words, hidden = _tokens(attrs)
        node = Node(tag, words | {"hidden-block"} if hidden else words, stack[-1][0], pos)
        stack[-1][0].kids.append(node)
        nodes.append(node)
        stack.append((node, tag))
    return nodes


def features(nodes: list[Node], size: int) -> tuple[np.ndarray, np.ndarray]:
    """One row a block, telling mark-up first; and each block's weak label."""
    for n in reversed(nodes):
        n.text, n.links, n.blocks = n.own, n.link, 1
        for k in n.kids:
            n.text += k.text
            n.links += k.links
            n.blocks += k.blocks
            n.n_tags += k.n_tags
            n.marks += k.marks
    whole = max(nodes[0].text, 1)
    rows, labels = [], []
    above: dict[int, tuple] = {}
    for n in nodes:
        kinds = [1.0 if n.tokens & words else 0.0 for words in KINDS.values()]
        up = above.get(id(n.parent), ([0.0] * len(KINDS), False, False))
        kinds_up = [max(a, b) for a, b in zip(kinds, up[0])]
        in_article = up[2] or n.tag in GOOD_TAGS
        # a header or footer inside an article still is no main text
        in_bad = up[1] or n.tag in BAD_TAGS or "hidden-block" in n.tokens
        above[id(n)] = (kinds_up, in_bad, in_article)
        density, link_share = n.text / (n.n_tags + 1), n.links / max(n.text, 1)
        sib = n.parent.kids if n.parent else [n]
        if len(sib) > 1:
            others = len(sib) - 1
            sib_text, sib_link = (n.parent.text - n.parent.own - n.text) / others, (n.parent.links - n.parent.link - n.links) / max(n.parent.text - n.parent.own - n.text, 1)
        else:
            sib_text = sib_link = 0.0
        tell = [1.0 if n.tag in group else 0.0 for group in TAGS] + kinds + kinds_up + [float(in_bad), float(in_article)]
        rest = [math.log1p(n.text), math.log1p(n.own), link_share, math.log1p(density), n.marks / max(n.text, 1), n.text / whole, n.text / max(n.parent.text, 1) if n.parent else 1.0, n.depth, math.log1p(n.blocks), math.log1p(len(sib)), math.log1p(max(sib_text, 0)), sib_link, n.at / max(size, 1)]
        rows.append(tell + rest)
        bad_token = any(kinds_up[i] for i, k in enumerate(KINDS) if k in BAD_KINDS)
        if in_bad or bad_token:
            labels.append(0.0)
        elif in_article:
            labels.append(1.0)
        else:
            labels.append(1.0 if link_share < 0.3 and (n.text >= 200 or n.own >= 80 or n.tag in ("h1", "body", "html")) else 0.0)
    return np.array(rows, np.float32), np.array(labels)


# ---- boosted trees -----------------------------------------------------------------------
def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict:
    """Gradient-boosted trees with logistic loss on binned features."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = {"base": math.log(share / (1 - share)), "trees": []}
    if len(set(y.tolist())) < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    score = np.full(len(y), model["base"])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        leaf = np.zeros(len(y), np.int64)
        feature, cut = [-1] * (2**depth - 1), [0.0] * (2**depth - 1)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            where, at = np.full(width, -1), np.zeros(width, np.int64)
            local = leaf - first
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * (BINS + 1) + binned[:, j]
                gs, hs = (np.bincount(key, w, width * (BINS + 1)).reshape(width, -1).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1))[:, : len(c)]
                gain[(hs[:, : len(c)] < 1) | ((ht - hs)[:, : len(c)] < 1)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best[better], where[better], at[better] = gain[np.arange(width), k][better], j, k[better]
            for w in range(width):
                if where[w] >= 0:
                    feature[first + w], cut[first + w] = int(where[w]), float(cuts[where[w]][at[w]])
            j = where[local]
            right = (j >= 0) & (binned[np.arange(len(y)), np.maximum(j, 0)] > at[local])
            leaf = 2 * leaf + 1 + right
        local = leaf - (2**depth - 1)
        value = RATE * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + 1)
        score += value[local]
        model["trees"].append([feature, cut, value.tolist()])
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    score, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, cut, value in model["trees"]:
        feature, cut, leaf = np.array(feature), np.array(cut, np.float32), np.zeros(len(x), np.int64)
        while leaf[0] < len(feature):
            f = feature[leaf]
            leaf = 2 * leaf + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[leaf]))
        score += np.array(value)[leaf - len(feature)]
    return score


def decode(nodes: list[Node], odds: np.ndarray) -> str:
    """The best choice of kept blocks in which every kept block's ancestors are kept."""
    gain = {}
    for n, o in zip(reversed(nodes), odds[::-1]):
        own = float(o) * (0.2 + math.log1p(n.own)) if n.own else 0.05 * float(o)
        gain[id(n)] = own + sum(max(0.0, gain[id(k)]) for k in n.kids)
    kept: list[tuple[int, str]] = []
    todo = [nodes[0]]
    while todo:
        n = todo.pop()
        if n is nodes[0] or n.tag == "body" or gain[id(n)] > 0:
            if n.own and (gain[id(n)] > 0):
                kept += n.parts
            todo += n.kids
    kept.sort(key=lambda p: p[0])
    out, last, run = [], None, []
    for order, text in [*kept, (None, "")]:
        if order != last and run:
            block = " ".join("".join(run).split())
            if block:
                out.append(block)
            run = []
        run.append(text)
        last = order
    return "\n".join(out)


def sample_pages(pages: DataFrame, html_col: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """(h): the first distinct pages by hash; only the hashes are made distinct over all pages."""
    rows = pages.select(F.col(html_col).alias("h"), F.xxhash64(html_col).alias("k")).where("h is not null")
    first = rows.select("k").distinct().orderBy("k").limit(max_pages)
    return rows.join(F.broadcast(first), "k", "left_semi").dropDuplicates(["k", "h"]).orderBy("k", "h").limit(max_pages).select("h")


def train(pages: DataFrame, id_col: str, html_col: str, max_pages: int = MAX_PAGES) -> dict:
    sample = sample_pages(pages, html_col, max_pages)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = [np.empty((0, N_TELLING + 13), np.float32)], [np.empty(0)]
        for page in pdf["h"]:
            x, y = features(parse(page), len(page))
            xs.append(x)
            ys.append(y)
        x, y = np.concatenate(xs), np.concatenate(ys)
        blind = x.copy()
        blind[:, :N_TELLING] = 0
        return pd.DataFrame({"model": [json.dumps(fit(np.concatenate([x, blind]), np.concatenate([y, y])))]})

    made = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "model string").first()  # max_pages rows at most
    return json.loads(made["model"]) if made else {"base": 0.0, "trees": []}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_pages: int = MAX_PAGES) -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``."""
    model = train(pages, id_col, html_col, max_pages)

    def texts(page_list: list[str]) -> list[str]:
        parsed = [parse(p) for p in page_list]
        xs = [features(nodes, len(p))[0] for nodes, p in zip(parsed, page_list)]
        odds = predict(model, np.concatenate(xs))
        cuts = np.cumsum([len(x) for x in xs])
        return [decode(nodes, odds[e - len(nodes) : e]) for nodes, e in zip(parsed, cuts)]

    def run(batches):
        for b in batches:
            out, held, size = [], [], 0
            for page in b.column(2).to_pylist():
                held.append(page or "")
                size += len(held[-1])
                if size > 1 << 21:
                    out += texts(held)
                    held, size = [], 0
            out += texts(held) if held else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("h"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
