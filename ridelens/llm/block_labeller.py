"""Main text of web pages: a recurrent labeller over the sequence of a page's text blocks.

A page becomes the sequence of its leaf blocks. Each block is a vector: signed hashes of its tag path
(tags, class and id words), signed hashes of its words, and a few numbers. A bidirectional LSTM in numpy
reads the whole sequence, so that every block is judged in the context of the whole page.

It is trained on the driver from a bounded sample of the pages: blocks of pages that mark their article
by a semantic tag are labelled by it, and the same blocks are set into made-up layouts (other
containers, menus, notices, forms, reader comments), where each block's origin gives its label.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import pack, register, schema_of, table

PATH_DIMS, WORD_DIMS, NUMBERS = 128, 32, 7
WIDTH = 24
PAGES, LONGEST_PAGE, LAYOUTS = 300, 60_000, 1500  # bounds of the sample: pages, characters of one; made-up pages
LONGEST_LESSON = 150  # blocks of a page that is learned from, at most

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_NAME = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE |= frozenset("object canvas math maction menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics "
                     "svg circle defs ellipse g line path polygon polyline rect symbol text textPath tspan use".lower().split())
_RAW = frozenset("script style template textarea title iframe".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ALIKE = {"li": "li", "dt": "dd dt", "dd": "dd dt", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}


@dataclass
class Block:
    text: str
    path: list[str]  # tags and words of class and id, outermost first
    offset: int  # of its first character in the page
    link: float  # share of its characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space as single spaces, empty ones left out.

    Text of scripts, styles and other raw elements is no block. A line break inside a block is white space.
    Unclosed elements end with the one around them.
    """
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    begin = linked = 0
    links, seen = 0, False

    def flush() -> None:
        nonlocal linked, seen
        if parts:
            raw = "".join(parts)
            text = " ".join(entities.unescape(raw).split())
            if text:
                path = [x for tag, words in stack if tag not in _INLINE or words for x in (tag, *words)]
                out.append(Block(text, path, begin, min(1.0, linked / len(raw))))
            parts.clear()
        linked, seen = 0, False

    def add(text: str, at: int) -> None:
        nonlocal begin, linked, seen
        if text:
            if not seen and not text.isspace():
                begin, seen = at, True
            parts.append(text)
            linked += len(text) if links else 0

    def pop_to(index: int) -> None:
        nonlocal links
        for tag, _ in stack[index:]:
            links -= tag == "a"
        del stack[index:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        add(page[at : m.start()], at)
        at = m.end()
        closing, name, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not name:
            continue
        tag = name.lower()
        if tag == "br":
            add(" ", m.start())
            continue
        block = tag not in _INLINE
        if closing:
            at_open = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at_open >= 0 and (block or all(stack[i][0] in _INLINE for i in range(at_open, len(stack)))):
                if block:
                    flush()
                pop_to(at_open)
            elif block:
                flush()
            continue
        if tag in _RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            if block:
                flush()
            if end is None:  # one that is never closed ends with the element around it
                around = next((t for t, _ in reversed(stack) if t not in _INLINE), None)
                end = around and re.compile(f"(?=</{re.escape(around)}\\s*>)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if block:
            flush()
            if tag in _CLOSES_P:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)
                if i >= 0 and all(t in _INLINE for t, _ in stack[i + 1 :]):
                    pop_to(i)
            for other in _ALIKE.get(tag, "").split():
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE), -1)
                if i >= 0 and stack[i][0] == other:
                    pop_to(i)
        if tag not in _VOID and not attrs.endswith("/"):
            words = [w for k, a, b, c in _ATTR.findall(attrs) if k.lower() in ("class", "id", "role", "itemprop") for w in _NAME.findall((a or b or c).lower())] if attrs else []
            if "hidden" in attrs or "display:none" in attrs.replace(" ", ""):
                words.append("hidden")
            stack.append((tag, ["." + w for w in words]))
            links += tag == "a"
    add(page[at:], at)
    flush()
    return out


class Hasher:
    """Signed buckets of names and words; remembers the words of a task up to a bound."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def ids(self, words: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > 200_000:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        return [seen[w] for w in words]

    def vectors(self, seq: list[Block]) -> np.ndarray:
        """A row per block."""
        n = len(seq)
        out = np.zeros((n, PATH_DIMS + WORD_DIMS + NUMBERS))
        for begin, dims, lists in ((0, PATH_DIMS, [[*b.path, *(f"{x}/{y}" for x, y in zip(b.path[-4:], b.path[-3:]))] for b in seq]), (PATH_DIMS, WORD_DIMS, [b.text.lower().split() for b in seq])):
            size = np.array([len(x) for x in lists])
            h = np.array(self.ids([w for x in lists for w in x]), np.int64)
            row = np.repeat(np.arange(n), size)
            sign = 1.0 - 2.0 * (h >> 20 & 1)
            sums = np.bincount(row * dims + h % dims, sign, n * dims).reshape(n, dims)
            scale = 2.0 / np.sqrt(np.maximum(size, 1)) if begin == 0 else 1.0 / np.maximum(size, 1)
            out[:, begin : begin + dims] = sums * scale[:, None]
        length = np.array([len(b.text) for b in seq], float)
        around = np.r_[0.0, length, 0.0]
        out[:, -NUMBERS:] = np.stack([np.log1p(length) / 6, np.array([b.link for b in seq]), np.arange(n) / max(1, n - 1), np.array([b.text[-1] in ".!?…" for b in seq], float),
                                      np.array([len(b.path) for b in seq]) / 10, np.log1p(around[:-2]) / 6, np.log1p(around[2:]) / 6], 1)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output per block; all weights in one dictionary."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        n = PATH_DIMS + WORD_DIMS + NUMBERS
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, n**-0.5, (n, 4 * WIDTH))
            self.w[f"h{d}"] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * WIDTH))
            self.w[f"c{d}"] = np.r_[np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH)]
        self.w["out"] = rng.normal(0, 0.1, (2 * WIDTH + n, 1))
        self.w["bias"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (pages, blocks, WIDTH) of one direction; padding leaves the state as it is."""
        pages, length, _ = x.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((pages, WIDTH)), np.zeros((pages, WIDTH))
        out = np.zeros((pages, length, WIDTH))
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = pre[:, t] + h @ self.w[f"h{d}"]
            i, f, o = _sigmoid(a[:, :WIDTH]), _sigmoid(a[:, WIDTH : 2 * WIDTH]), _sigmoid(a[:, 2 * WIDTH : 3 * WIDTH])
            g = np.tanh(a[:, 3 * WIDTH :])
            m = mask[:, t, None]
            new = f * c + i * g
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, new))
            c = m * new + (1 - m) * c
            h = m * (o * np.tanh(new)) + (1 - m) * h
            out[:, t] = h
        return out

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None), x], 2)
        return _sigmoid((both @ self.w["out"])[..., 0] + self.w["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy per block and its gradients by back-propagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, "f", kept["f"]), self._run(x, mask, "b", kept["b"]), x], 2)
        p = _sigmoid((both @ self.w["out"])[..., 0] + self.w["bias"])
        n = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        err = ((p - y) * mask / n)[..., None]
        grad = {"out": np.einsum("ptk,pto->ko", both, err), "bias": err.sum((0, 1))}
        for k, d in enumerate("fb"):
            dh_out = err * self.w["out"][k * WIDTH : (k + 1) * WIDTH, 0]
            dpre = np.zeros((*x.shape[:2], 4 * WIDTH))
            dh, dc = np.zeros((len(x), WIDTH)), np.zeros((len(x), WIDTH))
            dw = np.zeros_like(self.w[f"h{d}"])
            for t, i, f, o, g, c, h, new in reversed(kept[d]):
                m = mask[:, t, None]
                dh = dh + dh_out[:, t]
                th = np.tanh(new)
                dnew = m * (dh * o * (1 - th * th) + dc)
                da = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), m * dh * th * o * (1 - o), dnew * i * (1 - g * g)], 1)
                dpre[:, t] = da
                dw += h.T @ da
                dh = da @ self.w[f"h{d}"].T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
            grad[f"h{d}"], grad[f"c{d}"], grad[f"x{d}"] = dw, dpre.sum((0, 1)), np.einsum("ptk,pto->ko", x, dpre)
        return loss, grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 5, size: int = 32, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        starts, step = np.arange(0, len(pages), size), 0
        for _ in range(epochs):
            for s in rng.permutation(starts):
                x, mask, y = _pad([p[0] for p in pages[s : s + size]], [p[1] for p in pages[s : s + size]])
                _, grad = self.gradients(x, mask, y)
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self


def _pad(rows: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask, y = np.zeros((len(rows), longest, rows[0].shape[1])), np.zeros((len(rows), longest)), np.zeros((len(rows), longest))
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
        if labels is not None:
            y[i, : len(r)] = labels[i]
    return x, mask, y


_MAIN = ("article", "main")
_ASIDE = frozenset("nav header footer aside form button select menu dialog head .ad .ads .advert .sidebar .comments .comment .cookie .notice .banner .promo .menu .hidden .related .share .newsletter .navigation .contentinfo .complementary".split())


def weak_labels(seq: list[Block]) -> np.ndarray | None:
    """1 for blocks inside a semantic article and no side part; None if the page marks no article."""
    if not any(t in _MAIN for b in seq for t in b.path):
        return None
    return np.array([float(any(t in _MAIN for t in b.path) and not any(t in _ASIDE for t in b.path[next(i for i, t in enumerate(b.path) if t in _MAIN) :])) for b in seq])


def layout(rng: np.random.Generator, story: list[str], stories: list[list[str]], small: list[str]) -> list[tuple[str, int]]:
    """A made-up page as pieces of HTML with their labels, from the blocks of real pages."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    maybe = lambda p: rng.random() < p
    safe = entities.escape
    little = lambda: safe(pick(*small))
    words = lambda k: safe(" ".join(pick(*pick(*stories)).split()[: int(rng.integers(1, k))]))
    text = lambda: safe(pick(*pick(*stories)))

    def links(tag: str, attrs: str) -> str:
        items = "".join(f'<li><a href="/x">{words(5)}</a></li>' for _ in range(int(rng.integers(2, 9))))
        return f"<{tag}{attrs}><ul>{items}</ul></{tag}>"

    def side(kind: str) -> str:
        if kind == "menu":
            return links(pick("nav", "div"), pick("", ' class="menu"', ' id="navigation"', ' class="nav top"', ' class="breadcrumb"')) if maybe(0.8) else links("nav", "")
        if kind == "header":
            return f'<header class="{pick("top", "site-header", "masthead")}"><div>{words(6)}</div><p>{little()}</p></header>' if maybe(0.6) else f'<div id="header"><p>{little()}</p></div>'
        if kind == "footer":
            return f'<footer>&copy; {words(4)} &middot; {little()}</footer>' if maybe(0.6) else f'<div class="{pick("footer", "site-footer", "bottom")}"><p>{little()}</p><p>&copy; {words(4)}</p></div>'
        if kind == "sidebar":
            body = "".join(f"<p>{text() if maybe(0.4) else little()}</p>" for _ in range(int(rng.integers(1, 4))))
            return pick(f"<aside>{body}</aside>", f'<div class="{pick("sidebar", "side", "widget", "related", "recommended")}"><h3>{words(4)}</h3>{body}</div>', links("aside", ""))
        if kind == "notice":
            name = pick("cookie", "cookie-notice", "notice", "banner", "consent", "alert", "popup", "subscribe", "newsletter", "paywall")
            return f'<{(t := pick("div", "section", "aside"))} {pick("class", "id")}="{name}"><p>{little()}</p>{"<button>" + words(3) + "</button>" if maybe(0.5) else ""}</{t}>'
        if kind == "ad":
            return f'<div {pick("class", "id")}="{pick("ad", "ads", "advert", "sponsored", "promo", "adbox")}">{"<p>" + text() + "</p>" if maybe(0.4) else little()}</div>'
        if kind == "form":
            options = "".join(f"<option>{words(3)}</option>" for _ in range(3))
            return f'<form action="/s"><label>{words(4)}</label><input name="q">{"<select>" + options + "</select>" if maybe(0.4) else ""}<p>{little()}</p><button>{words(3)}</button></form>'
        body = "".join(f'<{(t := pick("li", "div", "article" if maybe(0.2) else "div"))} class="comment"><b>{words(3)}</b><p>{text()}</p></{t}>' for _ in range(int(rng.integers(1, 6))))
        return f'<{(t := pick("section", "div", "ol"))} {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "responses", "replies")}"><h3>{words(4)}</h3>{body}</{t}>'

    kinds = ("menu", "header", "ad", "notice", "form", "sidebar", "comments", "footer")
    out: list[tuple[str, int]] = [(f'<!DOCTYPE html><html><head><title>{words(9)}</title><style>p{{x}}</style></head><body>', 0)]
    for kind in kinds[:6]:
        if maybe(0.45):
            out.append((side(kind), 0))
    wrap = pick("article", "main", "article", "div class=content", "div class=post", "div id=main", "section class=story", "div class=entry-content", "div class=article-body", "div role=main", "div")
    name = wrap.split()[0]
    outer = maybe(0.3)
    out.append((("<main><div class=wrap>" if maybe(0.5) else "<div class=page>") if outer else "", 0))
    out.append((f"<{wrap}>", 0))
    for i, block in enumerate(story):
        body = safe(block)
        if i == 0 and maybe(0.8):
            out.append((f"<h1>{body}</h1>", 1))
            continue
        if maybe(0.06):
            out.append((side(pick("ad", "ad", "sidebar", "notice", "form")), 0))
        shape = pick("p", "p", "p", "p", "h2", "blockquote", "li", "div", "b")
        out.append((f"<p><b>{body}<br>" if shape == "b" else f"<ul><li>{body}</li></ul>" if shape == "li" else f"<p>{body}</p>" if shape != "p" and len(block) > 400 else f"<{shape}>{body}</{shape}>", 1))
    inside = maybe(0.3)
    if inside:
        out.append((side(pick("comments", "sidebar", "form", "ad", "footer")), 0))
    out.append((f"</{name}>", 0))
    for kind in (kinds[6], *kinds[2:6], kinds[7]):
        if maybe(0.5 if kind in ("comments", "footer") else 0.25):
            out.append((side(kind), 0))
    out.append(("</body></html>" if maybe(0.9) else "", 0))
    return out


def train(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> Labeller | None:
    """A labeller from sampled pages; None if none of them marks its article."""
    rng, hasher = np.random.default_rng(seed), Hasher()
    rows, stories, small = [], [], []
    for page in pages:
        seq = blocks(page)
        y = weak_labels(seq) if seq else None
        if y is None:
            continue
        rows.append((hasher.vectors(seq), y))
        story = [b.text for b, v in zip(seq, y) if v]
        stories += [story] if story else []
        small += [b.text for b, v in zip(seq, y) if not v]
    if not stories:
        return None
    small = small or [" ".join(s[0].split()[:4]) for s in stories]
    for _ in range(layouts):
        story = stories[int(rng.integers(len(stories)))]
        story = story[: int(rng.integers(1, len(story) + 1))] if len(story) > 40 or rng.random() < 0.3 else story
        pieces = layout(rng, story, stories, small)
        ends = np.cumsum([len(h) for h, _ in pieces])
        seq = blocks("".join(h for h, _ in pieces))
        if seq:
            which = np.searchsorted(ends, [b.offset for b in seq], "right")
            rows.append((hasher.vectors(seq), np.array([float(pieces[i][1]) for i in which])))
    return Labeller().fit([r for r in rows if len(r[1]) <= LONGEST_LESSON])


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = PAGES) -> Labeller | None:
    """Trained on the `most` pages with the lowest id hashes, of those of at most `LONGEST_PAGE` characters, and on
    `LAYOUTS` pages made from their texts; pages of more than `LONGEST_LESSON` blocks teach nothing."""
    few = pages.where(F.length(html_col) <= LONGEST_PAGE).select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(most)
    got = pages.where(F.length(html_col) <= LONGEST_PAGE).select(F.col(id_col).alias("i"), F.col(html_col).alias("page")).join(F.broadcast(few.select("i").distinct()), "i").orderBy("i").limit(2 * most).collect()
    return train([r["page"] for r in got])


def extract(pages: DataFrame, model: Labeller | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col`, `url_col`, text, n_chars, n_blocks of every row: the blocks labelled as main text, in page order, one line each.

    A null or empty page, and one without a main block, gives an empty text. Without a model (no page to learn
    from) the semantic tags decide, and pages without any keep all blocks outside side parts. Whole pages are
    read, nothing is capped; other columns are ignored.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model)
    struct, arrow = schema_of("__id long, __url string, text string, n_chars long, n_blocks long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = Hasher(), shared.value
        for batch in batches:
            seqs = [blocks(p or "") for p in batch.column(2).to_pylist()]
            texts = [""] * len(seqs)
            order = sorted((i for i, s in enumerate(seqs) if s), key=lambda i: len(seqs[i]))
            for part in _groups(order, [len(s) for s in seqs]):
                if m is not None:
                    x, mask, _ = _pad([hasher.vectors(seqs[i]) for i in part])
                    main = m.predict(x, mask) > 0.5
                else:
                    rule = [weak_labels(seqs[i]) for i in part]
                    main = [r if r is not None else [not any(t in _ASIDE for t in b.path) for b in seqs[i]] for i, r in zip(part, rule)]
                for i, keep in zip(part, main):
                    texts[i] = "\n".join(b.text for b, k in zip(seqs[i], keep) if k)
            yield pack(arrow, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, [len(t) for t in texts], [len(s) for s in seqs]])

    out = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(run, struct)
    return out.withColumnsRenamed({"__id": id_col, "__url": url_col})


def _groups(order: list[int], size: list[int], most: int = 20_000) -> Iterator[list[int]]:
    """Runs of pages of rising length whose padded blocks stay below `most` (a longer page alone)."""
    part: list[int] = []
    for i in order:
        if part and size[i] * (len(part) + 1) > most:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


@register("op7_block_labeller")
def op7_block_labeller(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_labeller(pages)).select("page_id", "url", "text", "n_chars")
