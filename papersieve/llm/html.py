"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text that no block-level tag interrupts. Each block is
described by the tags, classes and ids of its ancestors and by its text; the field weighs these
features and the labels of neighbouring blocks. It is trained in numpy on labelled pages (elements
that are main text carry ``data-main``, which is no feature), and Viterbi decoding picks the best
sequence of labels for every page.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import blocks

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Element kinds of the HTML standard.
RAW = {"script", "style", "textarea", "title", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# svg and math hold elements of their own, among which '/>' ends one, until a tag of HTML or one that holds HTML
FOREIGN, HOLDS_HTML = {"svg", "math"}, {"foreignobject", "annotation-xml"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
ENDS_FOREIGN = CLOSES_P | {
    "b", "big", "body", "br", "center", "code", "dd", "dt", "em", "embed", "head", "i", "img", "li", "meta", "ruby", "s", "small",
    "span", "strike", "strong", "sub", "sup", "tt", "u", "var",
}
SIBLINGS = {"option": {"option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "aside", "nav"}


def leaf_blocks(page: str | None) -> list[tuple[tuple, str, int, int]]:
    """(path, text, characters, characters in links) of every leaf block with text, in page order.

    ``path`` holds (tag, words of class, id and role, hidden, data-main) of the open elements.
    References are decoded and white space is one blank. Unclosed and stray tags are put right as
    browsers do in the plain cases.
    """
    page = page or ""
    stack: list[tuple] = []
    out: list[tuple[tuple, str, int, int]] = []
    text: list[str] = []
    path: tuple | None = None
    linked = links = within = 0

    def close() -> None:
        nonlocal path, linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((path or (), joined, len(joined), linked))
        text.clear()
        path, linked = None, 0

    def add(raw: str) -> None:
        nonlocal path, linked
        if not raw:
            return
        decoded = entities.unescape(raw)
        if path is None and not decoded.isspace():
            path = tuple(e for e in stack[:foreign()] if e[0] not in INLINE)
        text.append(decoded)
        if links:
            linked += len(decoded.strip())

    def foreign() -> int | None:
        """Where in the stack the svg or math begins that is open here, if its own elements are."""
        if not within:
            return None
        at = None
        for i, e in enumerate(stack):
            at = None if e[0] in HOLDS_HTML else i if at is None and e[0] in FOREIGN else at
        return at

    def pop(to: int) -> None:
        nonlocal links, within
        for e in stack[to:]:
            links -= e[0] == "a"
            within -= e[0] in FOREIGN
        del stack[to:]

    at = 0
    while True:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            outer = foreign()
            if outer is not None and (depth is None or depth >= outer) and name not in ENDS_FOREIGN:
                if depth is not None:
                    pop(depth)
                continue
            if name not in INLINE:
                close()
            if depth is not None and (name not in INLINE or all(e[0] in INLINE for e in stack[depth:])):
                pop(depth)
            continue
        outer = foreign()
        if outer is not None and name in ENDS_FOREIGN:
            pop(outer)
            outer = None
        if outer is not None or name in FOREIGN:
            attributes = found[3]
            if attributes.endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</(?:({re.escape(name)})|{stack[outer][0]})\b[^>]*>", re.I).search(page, at)
                if end and end[1]:
                    at = end.end()
                    continue
            stack.append((name, *_described(attributes)))
            within += name in FOREIGN
            links += name == "a"
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            close()
            continue
        if name == "br":
            add(" ")
            continue
        if name not in INLINE:
            close()
            ends = SIBLINGS.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if name not in VOID:
            attributes = found[3]
            stack.append((name, *_described(attributes)) if attributes.strip(" /") else (name, (), False, False))
            links += name == "a"
    close()
    return out


@lru_cache(maxsize=10_000)
def _described(attributes: str) -> tuple[tuple[str, ...], bool, bool]:
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    named = " ".join(got.get(k, "") for k in ("class", "id", "role", "itemprop"))
    words = tuple(sorted({w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", named)}))
    hidden = "hidden" in got or "none" in re.sub(r"[^a-z:]", "", got.get("style", "").lower()).partition("display:")[2][:4]
    return words, hidden or got.get("aria-hidden") == "true", "data-main" in got


@lru_cache(maxsize=10_000)
def path_features(path: tuple) -> tuple[str, ...]:
    out = {"in:" + e[0] for e in path} | {"is:" + w for e in path for w in e[1]}
    if path:
        out |= {"leaf:" + path[-1][0], "pair:" + "/".join(e[0] for e in path[-2:])}
    if any(e[2] for e in path):
        out.add("hidden")
    return tuple(sorted(out))


def text_features(text: str, size: int, linked: int) -> list[str]:
    out = [f"size:{min(8, size.bit_length())}", f"links:{min(4, 5 * linked // max(1, size))}"]
    if text[-1] in ".!?…\"”»":
        out.append("ends")
    if text.count(",") > 1:
        out.append("commas")
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    return out


class Field:
    """Two labels, 0 and 1 (main text); a weight for each feature and label, and for each pair of labels."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.pair = np.zeros((2, 2))
        self.start = 0.0

    def unary(self, page_blocks: list[tuple]) -> list[float]:
        """How much the features of each block speak for label 1 against 0."""
        get = self.weight.get
        paths = {p: sum(get(f, 0.0) for f in path_features(p)) for p in {b[0] for b in page_blocks}}
        return [get("all", 0.0) + paths[p] + sum(get(f, 0.0) for f in text_features(t, n, a)) for p, t, n, a in page_blocks]

    def decode(self, page_blocks: list[tuple]) -> list[int]:
        """The best sequence of labels (Viterbi); of equal ones that with label 0 first."""
        if not page_blocks:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        score, back = (0.0, self.start), []
        for i, u in enumerate(self.unary(page_blocks)):
            if i:
                a0, b0 = score[0] + p00, score[1] + p10
                a1, b1 = score[0] + p01, score[1] + p11
                back.append((int(b0 > a0), int(b1 > a1)))
                score = (max(a0, b0), max(a1, b1))
            score = (score[0], score[1] + u)
        labels = [int(score[1] > score[0])]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]

    def fit(self, pages: list[tuple[list[tuple], list[int]]], rounds: int = 60, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Maximum conditional likelihood by Adam over all pages, gradients from forward-backward."""
        names: dict[str, int] = {"all": 0}
        rows = []
        for page_blocks, labels in pages:
            rows.append((
                [
                    np.array([0] + [names.setdefault(f, len(names)) for f in (*path_features(p), *text_features(t, n, a))])
                    for p, t, n, a in page_blocks
                ],
                np.array(labels),
            ))
        size = len(names)
        x = np.zeros(size + 5)
        m, v = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, rounds + 1):
            grad = decay * len(rows) * x
            for found, labels in rows:
                if not found:
                    continue
                u = np.array([x[f].sum() for f in found])
                pair = x[size : size + 4].reshape(2, 2)
                node = np.stack([np.zeros(len(u)), u], axis=1)
                node[0, 1] += x[size + 4]
                forward, backward = node.copy(), np.zeros_like(node)
                for i in range(1, len(u)):
                    forward[i] += np.logaddexp(forward[i - 1, 0] + pair[0], forward[i - 1, 1] + pair[1])
                for i in range(len(u) - 2, -1, -1):
                    nxt = node[i + 1] + backward[i + 1]
                    backward[i] = np.logaddexp(pair[:, 0] + nxt[0], pair[:, 1] + nxt[1])
                total = np.logaddexp(*forward[-1])
                one = np.exp(forward[:, 1] + backward[:, 1] - total)
                for f, p, y in zip(found, one, labels):
                    grad[f] += p - y
                grad[size + 4] += one[0] - labels[0]
                if len(u) > 1:
                    both = forward[:-1, :, None] + pair + (node[1:] + backward[1:])[:, None, :] - total
                    grad[size : size + 4] += np.exp(both).sum(axis=0).ravel()
                    np.add.at(grad, size + labels[:-1] * 2 + labels[1:], -1)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weight = dict(zip(names, x[:size].tolist()))
        self.pair, self.start = x[size : size + 4].reshape(2, 2).copy(), float(x[size + 4])


def labelled_pages() -> list[str]:
    """Pages in the usual layouts, every element of their main text marked ``data-main``."""
    sentence = "The river rose in the night, and by morning the lower fields lay under water for a mile."
    long = " ".join([sentence, "Nobody had seen it so high before, not even the oldest of the farmers.", sentence])
    article = [
        f"<h1>High water in the valley</h1><p>{long}</p><p>{sentence}</p><p>So it went.</p><p>{long}</p>",
        f"<h1>Rain</h1><p>{sentence}<p>{long}<p>It stopped.",
        f"<header><h1>What the flood left</h1></header><p>{long}</p><h2>The fields</h2><ul><li>{sentence}</li><li>Mud.</li></ul><blockquote>{sentence}</blockquote>",
        f"<h1>Notes</h1><div>{long}</div><div>{sentence}</div><pre>water = high</pre><table><tr><td>Level</td><td>3 m</td></tr></table><figure><figcaption>The bridge, seen from the mill.</figcaption></figure>",
        f"<p>{long}</p>", "<p>Short.</p>", f"<h1>One</h1><h2>Two</h2><p>{sentence} {long} {long}</p>",
    ]
    wraps = [
        "<article data-main>{}</article>", "<main><article data-main>{}</article></main>", "<div class='content' data-main>{}</div>",
        "<div id='main-content'><div class='post-body' data-main>{}</div></div>", "<main data-main>{}</main>",
        "<section class='article-text entry' data-main>{}</section>", "<div role='main' data-main>{}</div>",
        "<article data-main>{}<aside data-not><p>Read also: more on rivers.</p></aside></article>",
        "<article data-main>{}<div class='ad' data-not>Buy our boats now, cheap and dry.</div></article>",
        "<article data-main>{}<section class='comments' data-not><h3>2 comments</h3><div class='comment'><p>" + sentence
        + "</p></div><div class='comment'><p>I saw it too, a sad day.</p></div></section></article>",
        "<article data-main>{}<form class='newsletter' data-not><label>Your mail</label><button>Subscribe</button></form></article>",
        "<article data-main>{}<footer data-not>Filed under weather by the editors.</footer></article>",
        "<article data-main>{}<nav class='pagination' data-not><a href='/2'>Next page</a></nav></article>",
    ]
    menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/m'>More, and more</a></li></ul></nav>"
    tops = [
        menu, "<header><div class='logo'>Valley Post</div>" + menu + "</header>", "<div id='header'><a href='/'>Valley Post</a></div>",
        "<div class='menu'><a href='/'>Home</a> <a href='/s'>Sport</a></div><div class='ad'>Dry feet or your money back.</div>",
        "<div class='cookie-notice'>We use cookies. By going on you agree to that.</div>" + menu,
        "<div class='banner ad'>Boats of every size, order today.</div>" + menu + "<div class='ad'>Pumps. Now cheaper, in every shop.</div>",
        "<div role='navigation'><a href='/a'>A</a><a href='/b'>B</a></div><div class='breadcrumb'><a href='/'>Home</a> » News</div>",
        "<div class='sponsored promo'><p>" + sentence + "</p></div>", "<div role='alert' class='notice'>This site will be down on Monday.</div>",
    ]
    sides = [
        "", "<aside><h3>Related</h3><ul><li><a href='/x'>Low water</a></li></ul></aside>", "<div class='sidebar widget'><p>Most read of the week</p><a href='/y'>Mills</a></div>",
        "<section id='comments'><h2>Comments</h2><article class='comment'><p>" + sentence + "</p></article><p class='comment-body'>Well said, neighbour.</p></section>",
        "<form action='/s'><label>Search</label><button>Go</button></form><div class='social share'><a href='/t'>Share this</a></div>",
        "<div class='related-posts'><h3>More</h3><p>" + sentence + "</p></div>", "<div class='newsletter subscribe popup modal'><p>Get our letter every day, it is free.</p></div>",
    ]
    ends = [
        "<footer>&copy; Valley Post &middot; All rights reserved.</footer>", "<footer><p>Copyright Valley Post.</p><p>" + sentence + "</p><a href='/i'>Imprint</a></footer>",
        "<div class='footer'><p>Valley Post, Mill Lane 2.</p></div>", "<div id='footer' class='legal disclaimer'>Terms and privacy</div>", "",
        "<footer>&copy; valley.example &middot; " + sentence + " Rivers.\nMills.</footer>",
    ]
    head = "<!DOCTYPE html><html><head><title>High water</title><script>var p='<p>';</script></head><body>"
    pages = []
    for i, (wrap, body) in enumerate(itertools.product(wraps, article)):
        top, side, end = tops[i % len(tops)], sides[i % len(sides)], ends[(i // 2) % len(ends)]
        order = (top, wrap.format(body), side) if i % 3 else (top, side, wrap.format(body))
        pages.append(head + "".join(order) + end + "</body></html>")
    controls = "<header><select><option>English<option>Deutsch</select></header><form><select><option>1990</option><option>All years</option></select></form>"
    for i in range(len(article)):
        order = (controls, "<noscript>Please turn on scripts to see this page.</noscript>", wraps[i].format(article[i]), controls)
        pages.append(head + "".join(order) + ends[i % len(ends)] + "</body></html>")
    return pages


def labels_of(page: str) -> tuple[list[tuple], list[int]]:
    """Blocks and labels of a labelled page; ``data-not`` takes an element out of the main text again."""
    found, labels = leaf_blocks(page), []
    outside = leaf_blocks(re.sub(r"<(\w+)([^>]*) data-not>.*?</\1>", "", page, flags=re.S))
    left = [(b[1], any(e[3] for e in b[0])) for b in outside]
    for path, text, _, _ in found:
        main = any(e[3] for e in path) and (text, True) in left
        if main:
            left.remove((text, True))
        labels.append(int(main))
    return [(tuple((t, w, h, False) for t, w, h, _ in path), text, n, a) for path, text, n, a in found], labels


def train(pages: list[str] | None = None) -> Field:
    field = Field()
    field.fit([labels_of(p) for p in (pages or labelled_pages())])
    return field


def main_text(field: Field, page: str | None) -> str:
    found = leaf_blocks(page)
    return "\n".join(b[1] for b, label in zip(found, field.decode(found)) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; ``text`` is the main text, empty where there is none.

    The whole page is read. A null or empty page has no text; text outside any tag is a block like
    others. Equal rows give equal rows, an empty table an empty one; other columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or train())

    def work(batches):
        for block in blocks(batches, "html"):
            text = [main_text(sent.value, p) for p in block.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("page_id"), block.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
