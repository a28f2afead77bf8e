"""Main text of web pages: a linear-chain conditional random field over the leaf
blocks of the page, decoded by Viterbi.

A leaf block is the text between two block-level tag boundaries (inline tags and
<br> do not end a block).  Its features are the tags and the class and id words
of its ancestors and properties of its text.  The model has two labels (article
or not), one weight per feature and label, and label transitions; it is trained
by maximum likelihood on the labelled pages of ``labelled_pages`` (layouts whose
article blocks are marked, filled with text of many lengths).  Training takes
the same bounded pages at any input size; every input page is decoded whole.

Defined results: null html = empty html; pages without text or without article
blocks give the empty string and 0; unclosed tags, comments and quotes end with
the page; scripts, styles, templates and titles are not text; one result row per
input row, repeated and null ids included; other columns are not read.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed lists of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe select".split())
BLOCK = frozenset(
    "html body head p div article section nav header footer aside main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre form fieldset legend figure figcaption address hr "
    "details summary dialog menu center button label option".split())
#: class and id words by what they tell
CUES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pager pagination skip toolbar topbar",
    "head": "header masthead logo topheader branding",
    "foot": "footer foot copyright colophon legal bottom imprint credits",
    "side": "sidebar side aside rail widget related recommended trending popular more tags archive archives",
    "notice": "cookie cookies consent notice gdpr banner alert popup modal overlay toast warning message paywall",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted adbox dfp outbrain taboola",
    "form": "form search newsletter subscribe subscription signup login register contact",
    "talk": "comment comments reply replies respond discussion disqus thread",
    "share": "share sharing social follow byline meta dateline author",
    "good": "content article post entry main story body text blog page prose",
}
_CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
_PHRASES = re.compile(r"©|copyright|all rights reserved|cookie|subscribe|sign up|newsletter|advertis|sponsored|"
                      r"privacy policy|terms of|log in|click here|read more|share this|leave a reply", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)/?>"
                  r"|<[!?/][^>]*(?:>|\Z)", re.S)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
#: marks article blocks of labelled pages; never a feature
MARK = "data-article"


class Block:
    __slots__ = ("text", "active", "parent", "links", "main")

    def __init__(self, text: str, active: list[str], parent: str, links: int, main: bool):
        self.text, self.active, self.parent, self.links, self.main = text, active, parent, links, main


@functools.lru_cache(maxsize=4096)
def _tag_features(tag: str, attributes: str) -> tuple[str, ...]:
    words = _WORD.findall(" ".join(_CLASS.findall(attributes)).lower()) if attributes else ()
    return (f"in:{tag}", *sorted({f"cue:{_CUE[w]}" for w in words if w in _CUE}))


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    active: Counter = Counter()
    pieces: list[str] = []
    state = {"links": 0, "in_link": 0, "main": 0}

    def end_block() -> None:
        if pieces:
            text = " ".join(html_lib.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                parent = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")
                out.append(Block(text, list(active), parent, state["links"], state["main"] > 0))
            state["links"] = 0

    def pop() -> None:
        tag, feats, main = stack.pop()
        for f in feats:
            active[f] -= 1
            if not active[f]:
                del active[f]
        state["main"] -= main
        state["in_link"] -= tag == "a"

    opened: Counter = Counter()
    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            pieces.append(text)
            if state["in_link"]:
                state["links"] += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[1] in ("!", "?"):
            continue
        if m[1] == "/":
            if tag in BLOCK:
                end_block()
            if opened[tag]:
                while True:
                    top = stack[-1][0]
                    opened[top] -= 1
                    pop()
                    if top == tag:
                        break
            continue
        if tag in RAW:
            if not page[m.start():at].endswith("/>"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else size
            if tag in ("script", "style", "title", "template", "noscript", "iframe") and not opened["svg"]:
                end_block()
            continue
        if tag in BLOCK:
            end_block()
            if opened["p"] and tag != "p" or tag == "p" and opened["p"]:
                _close_to(stack, opened, pop, "p")
            elif tag == "li" and stack and stack[-1][0] == "li":
                opened["li"] -= 1
                pop()
        if tag == "br":
            pieces.append(" ")
        if tag in VOID:
            continue
        # long attributes are read whole, beside the cache
        feats = (_tag_features if len(m[3]) < 400 else _tag_features.__wrapped__)(tag, m[3])
        main = MARK in m[3]
        stack.append((tag, feats, main))
        opened[tag] += 1
        active.update(feats)
        state["main"] += main
        state["in_link"] += tag == "a"
    end_block()
    return out


def _close_to(stack: list, opened: Counter, pop, tag: str) -> None:
    while True:
        top = stack[-1][0]
        opened[top] -= 1
        pop()
        if top == tag:
            return


def block_features(b: Block) -> list[str]:
    n = b.text.count(" ") + 1
    share = b.links / max(1, len(b.text))
    out = ["bias", "parent:" + b.parent,
           "words:" + ("1" if n < 4 else "2" if n < 12 else "3" if n < 40 else "4"),
           "links:" + ("0" if b.links == 0 else "1" if share < 0.5 else "2")]
    if b.text[-1] in ".!?…:":
        out.append("ends")
    if n < 30 and _PHRASES.search(b.text):
        out.append("phrase")
    return out + b.active


#: layouts: {p} paragraph, {s} short phrase, {c} sentence, {n} several links, {P} paragraphs
_LAYOUTS = [
    "<html><head><title>{s}</title></head><body><nav><ul>{n}</ul></nav><div class=ad>{c}</div>"
    "<article data-article><h1>{s}</h1><p><b>{p}<br>{P}</article><footer>&copy; {s} &middot; {c}</footer></body></html>",
    "<body><header><a href=/>{s}</a><p>{c}</p></header><main><h1 data-article>{s}</h1><div data-article>{P}</div>"
    "</main><aside><h3>{s}</h3><ul>{n}</ul><p>{c}</p></aside><footer><p>{c}</p></footer>",
    "<body><div id=header><div class=logo>{s}</div><div class=menu>{n}</div></div><div id=content data-article>"
    "<h2>{s}</h2>{P}</div><div id=sidebar><h4>{s}</h4>{n}<p>{p}</p></div><div id=footer>{s} | {s}</div>",
    "<body><div class='cookie-notice'><p>{c}</p><button>OK</button></div><div class=post><h1 data-article>{s}</h1>"
    "<div class='byline meta'>{s}</div><div class=entry-content data-article>{P}<ul><li>{c}</li><li>{c}</li></ul>{P}</div>"
    "</div><div id=comments class=comments><h3>{s}</h3><div class=comment><p>{p}</p></div><div class=comment><p>{p}</p></div></div>",
    "<body><nav class=breadcrumbs>{n}</nav><article data-article><header><h1>{s}</h1></header>{P}<blockquote><p>{c}</p>"
    "</blockquote>{P}</article><section class=comments><h2>{s}</h2><p>{p}</p><p>{c}</p></section><form><label>{s}</label>"
    "<p>{c}</p></form><footer>{n}</footer>",
    "<body><header><nav>{n}</nav></header><main><article><h1 data-article>{s}</h1><section data-article>{P}<h2>{s}</h2>{P}"
    "</section><div class='advert sponsored'><p>{p}</p></div><section data-article>{P}</section></article></main>"
    "<aside class=related>{n}<p>{c}</p></aside><div class=notice><p>{p}</p></div>",
    "<body><table><tr><td class=menu>{n}</td><td class=text data-article><h1>{s}</h1><p>{p}</p><p>{p}</p><p>{c}</p></td>"
    "<td class=side><p>{c}</p>{n}</td></tr></table><div class=copyright>{c}</div>",
    "<body><div class=page><div class=topbar>{n}</div><h1 data-article>{s}</h1><div data-article>{P}</div><p data-article>{s}</p>"
    "<div class=share>{n}</div><form class=newsletter><p>{c}</p><input><button>{s}</button></form><div class=footer>{c}</div></div>",
    "<body><article data-article><h1>{s}</h1><p>{s}</p><p>{p}</p><p>{s}</p><h3>{s}</h3><pre>{p}</pre><ol><li>{s}</li><li>{c}</li></ol>"
    "<table><tr><th>{s}</th><td>{s}</td></tr></table></article><section id=comments><article class=comment><p>{p}</p></article>"
    "<article class=comment><p>{c}</p></article></section><footer><ul>{n}</ul><p>{s}</p></footer>",
    "<body><section class='alert banner'><p>{c}</p></section><main data-article><p>{p}</p><p>{c}</p><p>{p}</p></main>"
    "<aside><form><p>{s}</p></form><p>{p}</p></aside>",
    "<body><nav>{n}</nav><form action=/s><p>{c}</p></form><aside><p>{p}</p><p>{p}</p></aside><footer><p>{p}</p></footer>",
    "<body><div class=ad><p>{p}</p></div><div class=story-body data-article><p>{p}</p>{P}<p>{s}</p></div><div class=ad>{p}</div>"
    "<div class=related>{n}</div><div class=replies><p>{p}</p><p>{p}</p></div>",
    "<body><nav>{n}</nav><article><h1 data-article>{s}</h1><section data-article>{P}</section><aside><p>{p}</p></aside>"
    "<section data-article>{P}</section><footer><p>{p}</p>{n}</footer></article>",
    "<body><dialog open><p>{c}</p><button>{s}</button></dialog><article><h1 data-article>{s}</h1><p data-article>{p}</p><form><p>{c}</p>"
    "</form><p data-article>{p}</p><div class=cookie-notice><p>{p}</p></div><p data-article>{c}</p></article><footer>{s}</footer>",
    "<body><article><h1 data-article>{s}</h1><p data-article>{p}</p><aside>{c}</aside><p data-article>{p}</p><p data-article>{c}</p>"
    "<form>{s}</form><div class=notice>{c}</div><p data-article>{s}</p><footer>{c}</footer></article><dialog>{c}</dialog>",
    "<body><div>{n}</div><div data-article><h1>{s}</h1><p>{p}</p><p>{p}</p></div><div>{n}</div>",
    "<body><div><a href=/>{s}</a> <a href=/y>{s}</a></div><div data-article><h1>{s}</h1>{P}</div><div><a href=/z>{s}</a></div>",
]
LABELLED_FILLS = 12


def labelled_pages(fills: int = LABELLED_FILLS, seed: int = 11) -> list[str]:
    """Pages whose article blocks carry the mark, from every layout with texts of
    one word to a hundred."""
    rng = random.Random(seed)
    letters = "aeiounrtlsd"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 4, hi: int = 18) -> str:
        return words(lo, hi).capitalize() + "."

    def paragraph() -> str:
        return " ".join(sentence(1, 20) for _ in range(rng.choice((1, 1, 2, 4, 7))))

    fill = {
        "{p}": paragraph, "{c}": sentence,
        "{s}": lambda: words(1, 8).capitalize() + rng.choice(("", "", ".")),
        "{n}": lambda: "".join(f"<li><a href=/x>{words(1, 3)}</a></li>" for _ in range(rng.randint(2, 7))),
        "{P}": lambda: "".join(f"<p>{rng.choice((paragraph, sentence, lambda: words(1, 3)))()}</p>"
                               for _ in range(rng.randint(1, 6))),
    }
    return [re.sub(r"\{[pcsnP]\}", lambda m: fill[m[0]](), layout) for layout in _LAYOUTS for _ in range(fills)]


class Crf:
    """Weights by feature name and label, and transitions from label to label
    (label 2 is the start)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.gain = {n: float(weights[i, 1] - weights[i, 0]) for n, i in names.items()}
        self.moves = moves.tolist()

    def decode(self, found: list[Block]) -> list[int]:
        """The most probable label sequence (Viterbi)."""
        if not found:
            return []
        get, (m0, m1, start) = self.gain.get, self.moves
        best0, best1, back = 0.0, 0.0, []
        for i, b in enumerate(found):
            gain = sum(get(f, 0.0) for f in block_features(b))
            if i == 0:
                best0, best1 = start[0], start[1] + gain
                continue
            from0, from1 = (best0 + m0[0], best1 + m1[0]), (best0 + m0[1], best1 + m1[1])
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            best0, best1 = max(from0), max(from1) + gain
        label = int(best1 > best0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[str], rounds: int = 400, rate: float = 0.1, ridge: float = 2e-3) -> Crf:
    """Maximum likelihood by gradient ascent (Adam), forward-backward over all
    pages at once."""
    found = [b for b in map(blocks_of, pages) if b]
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in block_features(b)] for b in p] for p in found]
    n, t = len(found), max(map(len, found))
    x = np.zeros((n, t, len(names)))
    y = np.zeros((n, t), dtype=int)
    on = np.zeros((n, t), dtype=bool)
    for i, p in enumerate(rows):
        for j, feats in enumerate(p):
            x[i, j, feats] = 1
            y[i, j], on[i, j] = found[i][j].main, True
    w, a = np.zeros((len(names), 2)), np.zeros((3, 2))
    gold_w = np.stack([x[on & (y == k)].sum(0) for k in (0, 1)], 1)
    gold_a = np.zeros((3, 2))
    np.add.at(gold_a, (2, y[:, 0]), 1)
    both = on[:, 1:]
    np.add.at(gold_a, (y[:, :-1][both], y[:, 1:][both]), 1)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]

    def lse(z: np.ndarray, axis: int) -> np.ndarray:
        m = z.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(z - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for r in range(1, rounds + 1):
        e = x @ w
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = e[:, 0] + a[2]
        for j in range(1, t):
            step = lse(forward[:, j - 1, :, None] + a[None, :2], 1) + e[:, j]
            forward[:, j] = np.where(on[:, j, None], step, forward[:, j - 1])
        for j in range(t - 2, -1, -1):
            step = lse(a[None, :2] + (e[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(on[:, j + 1, None], step, 0)
        total = lse(forward[:, -1], 1)
        p = np.exp(forward + backward - total[:, None, None]) * on[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + a[None, None, :2] + (e + backward)[:, 1:, None, :]
                      - total[:, None, None, None]) * both[:, :, None, None]
        grad_w = gold_w - np.einsum("ntf,ntk->fk", x, p) - ridge * n * w
        grad_a = gold_a - np.vstack([pair.sum((0, 1)), p[:, 0].sum(0)]) - ridge * n * a
        for k, (value, grad) in enumerate(((w, grad_w / n), (a, grad_a / n))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    return Crf(names, w, a)


@functools.lru_cache(maxsize=1)
def model() -> Crf:
    return fit(labelled_pages())


def main_text(page: str, crf: Crf) -> str:
    found = blocks_of(page)
    return "\n".join(b.text for b, k in zip(found, crf.decode(found)) if k)


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """page_id, url, text (main text, empty if none), n_chars of every page."""
    crf = crf or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, crf) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
