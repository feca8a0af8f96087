"""Operator 2, HTML extraction: gradient-boosted trees over the features of DOM nodes, decoded over the tree.

Every node gets features of its subtree and place: text, share of the page's text, text to tags, link text, punctuation,
paragraphs, depth, place and size among its siblings, the text before it. Its tag and the tokens of its class, id and role are
hashed, and each hash has a weight, the log ratio of article to other nodes with it, learned from one half of the training
pages; the weights of a node, of its parent and the extremes of its ancestors' are features too. A token that training
never saw weighs nothing, and structure decides. Boosted trees, fitted to the other half, give the odds that a node belongs to
the article. Decoding gives each node one of three states: outside, article, or dropped inside the article. A child of outside
may be outside or begin the article; a child of the article may belong to it or be dropped; all below a dropped node is
dropped. The best assignment of the whole tree is found from the leaves up, so no node is article below one that is not.

The tables hold no labels for pages. The model is trained here on pages that `layouts` composes by chance with known labels
(a fixed number, LAYOUTS), in families that differ in what holds the article: `article`, `main`, a named block, a block with a
name that says nothing, a table cell, the body itself, or nothing at all (text that stands in no element). The names in NAMES are words of the training pages, as any are.
Labelled pages may be given instead. `measured` tells how well families that a model has not seen are read.

Cases: null html is empty and gives an empty text; so do pages without an article; unclosed, crossed and cut-off tags and
character references are read as browsers do in the simple cases; repeated rows each get their row; an empty table gives an
empty result; other columns are kept. Texts are whole: nothing is shortened.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted
from .common import lean
from .dom import INLINE, Tree, attributes

LAYOUTS = 800
FAMILIES = ("article", "main", "named", "coded", "table", "bare", "loose")
BUCKETS = 1 << 14
EXTRA = 24

#: Words that training pages use in class, id and role.
NAMES = {
    "body": "article content post entry story main text body page prose", "menu": "nav menu navbar breadcrumb breadcrumbs toolbar tabs pagination pager skip toc navigation", "head": "header head masthead topbar banner logo hero", "foot": "footer foot bottom copyright colophon legal contentinfo",
    "side": "sidebar side aside related recommended rail widget widgets complementary trending popular", "ad": "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion adsense banner-ad outbrain taboola", "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay paywall newsletter subscribe signup banner dialog",
    "comment": "comment comments commentlist discussion replies reply disqus respond responses", "share": "share sharing social tools meta byline tags", "form": "form search login contact poll survey",
}
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*")
_ALPHABETS = ("etaoinshrdlucmf", "etaoinshrdlucmf", "оеаинтсрвлкмдпу", "αοιετσνηυρπκμλς", "的一是了我不人在他有这个上们来", "éàçèêïôùüñaeiou")


@lru_cache(100_000)
def _hashes(tag: str, raw: str) -> tuple[int, tuple[int, ...]]:
    """The bucket of a tag, and those of the tokens of its attributes, whole and in parts."""
    bucket = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS
    found = attributes(raw)
    out = set()
    for key in ("class", "id", "role", "itemprop"):
        for part in found.get(key, "").split():
            out |= {bucket("=" + t) for t in {part.lower(), *re.split(r"[-_]+", part.lower()), *(x.lower() for x in _SPLIT.findall(part))} if t}
    return bucket("<" + tag), tuple(sorted(out))


def weights(pages: list[tuple[Tree, list[bool]]]) -> np.ndarray:
    """Log ratio of article to other nodes by bucket, shrunk to 0 where few nodes have it; below a node of the other kind nothing counts."""
    seen = np.zeros((2, BUCKETS))
    for tree, marks in pages:
        for i in range(1, len(marks)):
            tag, tokens = _hashes(tree.tag[i], tree.attrs[i])
            seen[int(marks[i]), [tag, *tokens]] += 1
    share = seen.sum(1, keepdims=True)
    return np.log((seen[1] / max(share[1, 0], 1) + 1e-3) / (seen[0] / max(share[0, 0], 1) + 1e-3)).astype(np.float32) * (seen.sum(0) > 2)


def features(tree: Tree, weight: np.ndarray) -> np.ndarray:
    """One row for each node."""
    n = len(tree.tag)
    parent = tree.parent
    chars, marks, linked, tags, paras, starts = ([0] * n for _ in range(6))
    total = 0
    for node, s in tree.text:
        if s:
            k = len(s) if not s.isspace() else 0
            chars[node] += k
            total += k
            marks[node] += sum(map(s.count, ".,。、，·"))
    depth, order, kids = [0] * n, [0] * n, [0] * n
    x = np.zeros((n, EXTRA), np.float32)
    tag_w, low, high = np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
    up_low, up_high, up_tag = np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
    last = [0] * n  # of each node: its last child so far
    before = [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        order[i] = kids[p]
        kids[p] += 1
        before[i], last[p] = last[p], i
        t, own = _hashes(tree.tag[i], tree.attrs[i])
        tag_w[i] = weight[t]
        if own:
            w = weight[list(own)]
            low[i], high[i] = min(w.min(), 0), max(w.max(), 0)
        up_low[i], up_high[i], up_tag[i] = min(up_low[p], low[p]), max(up_high[p], high[p]), min(up_tag[p], tag_w[p])
    own_chars = np.array(chars, np.float32)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if tree.tag[i] == "a":
            linked[i] = chars[i]
        chars[p] += chars[i]
        marks[p] += marks[i]
        linked[p] += linked[i]
        tags[p] += tags[i] + 1
        paras[p] += paras[i] + (tree.tag[i] == "p")
    c, t, k, link = (np.array(v, np.float32) for v in (chars, tags, kids, linked))
    up = np.array([max(p, 0) for p in parent])
    prev = np.array(before)
    following = np.zeros(n, np.int64)
    following[prev[prev > 0]] = np.flatnonzero(prev > 0)
    begins = np.zeros(n, np.float32)  # the share of text before the node among its siblings
    for i in range(1, n):
        begins[i] = begins[before[i]] + c[before[i]] if before[i] else 0
    for j, v in enumerate((
        np.minimum(depth, 20), np.log1p(c), c / max(chars[0], 1), c / np.maximum(c[up], 1), np.log1p(c / (t + 1)), link / np.maximum(c, 1), np.array(marks, np.float32) / np.maximum(c, 1),
        np.minimum(paras, 50), np.minimum(k, 50), np.array(order, np.float32) / np.maximum(k[up], 1), np.minimum(k[up], 50), np.log1p(own_chars), tag_w, low, high, up_low, up_high, up_tag, tag_w[up],
        np.where(prev > 0, np.log1p(c[prev]), -1), np.where(following > 0, np.log1p(c[following]), -1), begins / np.maximum(c[up], 1), link[up] / np.maximum(c[up], 1), np.log1p(c[up] / np.maximum(k[up], 1)),
    )):
        x[:, j] = v
    return x


@dataclass
class Model:
    """Weights of hashed names, and the trees over features that use them."""

    weight: np.ndarray
    trees: Boosted

    def odds(self, trees: list[Tree]) -> list[np.ndarray]:
        cut = np.cumsum([len(t.tag) for t in trees])[:-1]
        return np.split(self.trees.margin(np.concatenate([features(t, self.weight) for t in trees])), cut)


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Whether each node is article, in the best assignment in which no article node stands below one that is not.

    Beginning an article costs one unit of odds, so that one region is preferred to many.
    """
    n = len(parent)
    o = np.clip(odds, -8, 8).tolist()
    outside, article, dropped = ([0.0] * n for _ in range(3))
    for i in range(n - 1, -1, -1):  # children follow their parents
        outside[i] -= o[i]
        dropped[i] -= o[i]
        article[i] += o[i]
        if i:
            p = parent[i]
            outside[p] += max(outside[i], article[i] - 1)
            article[p] += max(article[i], dropped[i])
            dropped[p] += dropped[i]
    state = [0] * n
    out = np.zeros(n, bool)
    for i in range(n):
        s = 0 if i == 0 else state[parent[i]]
        if s == 0 and i:
            s = int(article[i] - 1 > outside[i])
        elif s == 1:
            s = 1 if article[i] >= dropped[i] else 2
        state[i] = s
        out[i] = s == 1
    return out


def main_text(tree: Tree, article: np.ndarray) -> str:
    """Text of the article's blocks in page order; blanks in a block become one space, blocks are joined by one."""
    block = [0] * len(tree.tag)
    for i in range(1, len(block)):
        block[i] = block[tree.parent[i]] if tree.tag[i] in INLINE else i
    out, at = [], -1
    for node, s in tree.text:
        if article[node]:
            if block[node] != at or s is None:
                out.append(" ")
                at = block[node]
            if s:
                out.append(s)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def layouts(n: int = LAYOUTS, seed: int = 5, families: tuple[str, ...] = FAMILIES) -> list[tuple[str, list[bool]]]:
    """Pages composed by chance of articles and of what surrounds them, with the label of every node in page order.

    What tells an article from the rest is a page's own: tags that say what they hold or not, names that say it, names that
    do not, or none. Without either, what surrounds the article is told by its form only: lists of links and short lines.
    """
    r = random.Random(seed)
    out = []
    for _ in range(n):
        family = r.choice(families)
        speaking = r.random() < (0.4 if family in ("coded", "table", "bare") else 0.75)  # names that say what they hold
        semantic = r.random() < (0.5 if family in ("coded", "table", "bare", "named") else 1.0)
        letters = r.choice(_ALPHABETS)
        parts: list[str] = []
        labels: list[bool] = [False]

        def words(lo: int, hi: int) -> str:
            k = r.randint(lo, hi)
            s = " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) + r.choice(["", "", "", "", ",", ".", "!!", "***", " |"]) for _ in range(k))
            return s.upper() if r.random() < 0.1 else s[:1].upper() + s[1:]

        def tag(name: str, inside, attrs: str = "", is_main: bool = False, close: bool = True) -> None:
            parts.append(f"<{name}{attrs}>")
            labels.append(is_main)
            if callable(inside):
                inside()
            else:
                parts.append(inside)
            if close:
                parts.append(f"</{name}>")

        def code() -> str:
            return "".join(r.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(r.randint(2, 7)))

        def named(kind: str) -> str:
            if not speaking:
                return r.choice(["", f' class="{code()}"', f' id="{code()}-{code()}"', f' class="{code()} {code()}"'])
            t = r.choice(NAMES[kind].split())
            return f' {r.choice(["class", "id"])}="{r.choice([t, t, t, f"site-{t}", f"{t}-box", f"{t} block", f"{code()} {t}"])}"'

        def links(lo: int, hi: int) -> None:
            def item() -> None:
                tag("a", words(1, 3), ' href="/x"')

            if r.random() < 0.8:
                tag("ul", lambda: [tag("li", item) for _ in range(r.randint(lo, hi))])
            else:
                for _ in range(r.randint(lo, hi)):
                    item()
                    parts.append(r.choice([" ", " | ", " - "]))

        def prose(lo: int, hi: int, is_main: bool) -> None:
            plain = r.random() < 0.1 and is_main  # text in blocks that are no paragraphs
            for _ in range(r.randint(lo, hi)):
                x = r.random()
                if plain and x > 0.3:
                    tag("div", words(8, 80), r.choice(["", f' class="{code()}"']), is_main)
                elif x < 0.08:
                    tag("h2", words(1, 6), "", is_main)
                elif x < 0.14:
                    tag("ul", lambda: [tag("li", words(1, 12), "", is_main) for _ in range(r.randint(1, 5))], "", is_main)
                elif x < 0.2:
                    tag("blockquote", lambda: tag("p", words(2, 20), "", is_main), "", is_main)
                elif x < 0.4:
                    def rich() -> None:
                        tag("b", words(1, 40), "", is_main, r.random() < 0.7)
                        parts.append(words(0, 20))

                    tag("p", rich, "", is_main, r.random() < 0.7)
                elif x < 0.5:
                    def linked() -> None:
                        parts.append(words(1, 20))
                        tag("a", words(1, 4), ' href="/y"', is_main)

                    tag("p", linked, "", is_main)
                else:
                    tag("p", words(1, r.choice([4, 30, 120])), "", is_main, r.random() < 0.85)

        def block(name: str) -> str:
            return name if semantic else "div"

        def noise(kind: str) -> None:
            told = speaking or semantic and kind in ("menu", "header", "footer", "side")  # by a name or a tag
            if kind == "menu":
                tag(*((block("nav"), lambda: links(2, 8), r.choice(["", named("menu")])) if r.random() < 0.6 else (r.choice(["div", "ul"]), lambda: links(2, 8), named("menu"))))
            elif kind == "header":
                tag(*((block("header"), lambda: tag("h1" if r.random() < 0.3 and semantic else "div", words(1, 8)), r.choice(["", named("head")])) if r.random() < 0.6 else ("div", lambda: tag("h1" if r.random() < 0.3 and speaking else "div", words(1, 6)), named("head"))))
            elif kind == "footer":
                tag(*((block("footer"), words(2, 25 if told else 8), r.choice(["", named("foot")])) if r.random() < 0.6 else ("div", lambda: tag("p" if told else "small", words(2, 25 if told else 8)), named("foot"))))
            elif kind == "side":
                if told:
                    tag(*((block("aside"), lambda: (tag("h3", words(1, 4)), prose(0, 3, False), links(1, 6)), named("side")) if r.random() < 0.5 else (r.choice(["div", "section"]) if speaking else "aside", lambda: (prose(1, 3, False), links(1, 6)), named("side"))))
                else:
                    tag("div", lambda: (tag("h3", words(1, 3)), links(2, 8)), named("side"))
            elif kind in ("ad", "notice"):
                if told:
                    tag(r.choice(["div", "div", "section", "p", "aside", "span"]), words(1, 60) if r.random() < 0.6 else lambda: prose(1, 2, False), named(kind))
                else:
                    tag("div", lambda: tag("a", words(1, 8), ' href="/z"'), named(kind))
            elif kind == "comment" and told:
                tag(r.choice(["div", "section", "ol", "ul"]), lambda: [tag(r.choice(["div", "li", "article"]), lambda: (tag("b", words(1, 2)), tag("p", words(2, 60))), named("comment")) for _ in range(r.randint(1, 6))], named("comment"))
            elif kind == "share":
                tag("div", lambda: links(1, 4), named("share"))
            elif kind == "form":
                tag("form", lambda: (tag("label", words(1, 5)), tag("button", words(1, 2)), tag("p", words(1, 12)) if r.random() < 0.5 else None), r.choice(["", named("form")]))
            elif kind == "code":
                tag(r.choice(["script", "style"]), "var t=1;")

        def inside() -> None:
            if r.random() < 0.7:
                tag("h1", words(1, 10), "", True)
            prose(2 if family in ("coded", "table", "bare") else 1, r.choice([2, 4, 12]), True)
            for kind in r.sample(["ad", "share", "side", "form", "notice", "comment"], r.choice([0, 0, 0, 1, 2])):
                noise(kind)
                prose(0, 3, True)

        def article() -> None:
            if family == "bare":
                inside()
                return
            if family == "table":
                def row() -> None:
                    if r.random() < 0.5:
                        tag("td", lambda: links(2, 8), named("menu"))
                    tag("td", inside, r.choice(["", f' class="{code()}"', ' valign="top"']), True)

                tag("table", lambda: tag("tr", row), r.choice(["", ' width="100%"']))
                return
            name = family if family in ("article", "main") else r.choice(["div", "section", "div"])
            if family == "named":
                t = r.choice(NAMES["body"].split())
                attrs = f' {r.choice(["class", "id"])}="{r.choice([t, t, f"{t}-body", f"site-{t}", f"{code()} {t}"])}"'
            else:
                attrs = r.choice(["", f' class="{code()}"', f' class="{r.choice("c col row w".split())}-{r.randint(1, 12)}"']) if family == "coded" or r.random() < 0.2 else ""
            if r.random() < 0.3:
                tag(r.choice(["div", "section"]), lambda: (noise("menu") if r.random() < 0.3 else None, tag(name, inside, attrs, True), noise(r.choice(["side", "comment", "ad"])) if r.random() < 0.5 else None), r.choice(["", ' class="wrap"', ' id="page"', ' class="container"', f' class="{code()}"']))
            else:
                tag(name, inside, attrs, True)

        def page() -> None:
            tag("head", lambda: (tag("title", words(2, 8)), noise("code")))

            def body() -> None:
                for kind in r.sample(["header", "menu", "notice", "ad", "side", "form", "code", "share"], r.randint(0, 5)):
                    noise(kind)
                if r.random() < 0.95:
                    article()
                for kind in r.sample(["footer", "comment", "ad", "side", "form", "menu", "code", "notice"], r.randint(0, 5)):
                    noise(kind)

            tag("body", body)

        def loose() -> None:
            """No page around it: text that stands in no element, among blocks."""
            for kind in r.sample(["menu", "header", "ad", "form"], r.choice([0, 0, 0, 1, 2])):
                noise(kind)
            for _ in range(r.choice([1, 1, 2, 3, 4])):
                labels.append(True)  # the paragraph that such text opens
                parts.append(words(*r.choice([(1, 4), (2, 120), (20, 120), (60, 120)])))
                if r.random() < 0.4:
                    tag(r.choice(["b", "a", "em"]), words(1, 5), "", True)
                    parts.append(words(0, 20))
                if r.random() < 0.4:
                    tag("p", words(3, 60), "", True)
                if r.random() < 0.6:
                    tag("h2", words(1, 6), "", True)
                else:
                    tag("hr", "", "", False, False)
            for kind in r.sample(["footer", "comment", "menu", "form", "ad"], r.choice([0, 0, 0, 1, 2])):
                noise(kind)

        if family == "loose":
            loose()
            out.append(("".join(parts), labels))
            continue
        tag("html", page)
        out.append(("<!DOCTYPE html>" + "".join(parts), labels))
    return out


def fit(pages: list[tuple[str, list[bool]]]) -> Model:
    """A model of labelled pages: html, and whether each node (in page order, the page itself first) is article.

    A page that tag closing reads otherwise, and so has no certain labels, is left out.
    """
    trees = [(t, m) for t, m in ((Tree(p), m) for p, m in pages) if len(t.tag) == len(m)]
    weight = weights(trees[::2])
    rest = trees[1::2] or trees
    return Model(weight, Boosted(trees=60).fit(np.concatenate([features(t, weight) for t, _ in rest]), np.concatenate([m for _, m in rest]).astype(float)))


@lru_cache(1)
def trained(n: int = LAYOUTS) -> Model:
    """The model of n composed layouts."""
    return fit(layouts(n))


def measured(model: Model, pages: list[tuple[str, list[bool]]]) -> tuple[float, float]:
    """Precision and recall of the characters of main texts, over labelled pages."""
    right = given = want = 0
    for page, marks in pages:
        tree = Tree(page)
        if len(tree.tag) != len(marks):
            continue
        found = decode(tree.parent, model.odds([tree])[0])
        for node, s in tree.text:
            n = len((s or "").strip())
            right += n * bool(found[node] and marks[node])
            given += n * bool(found[node])
            want += n * bool(marks[node])
    return right / max(given, 1), right / max(want, 1)


def extract(pages: DataFrame, model: Model | None = None, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns `keep`) with the main text and its number of code points, n_chars."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # some thousand numbers

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                trees = [Tree(h or "") for h in batch.column("_html").to_pylist()]
                texts = [main_text(t, decode(t.parent, o)) for t, o in zip(trees, shared.value.odds(trees), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f"_k{i}") for i in range(len(kept))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return pages.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)), F.col(html).alias("_html")).mapInArrow(run, schema)
