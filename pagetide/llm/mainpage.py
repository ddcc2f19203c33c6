"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into its leaf blocks: runs of text between block-level tags, in page order. Each
block has features from the tags and class words of its ancestors and from its text. The field
has two states, article and other; its weights tie features to states and states to their
followers, and the best sequence is found by Viterbi.

It is trained on labelled pages: layouts written out below with the part that each block plays,
filled with texts of a bounded sample of the given pages. So it has seen what the given pages
lack: pages without semantic tags, side bars, notices, forms and comments.

Cases: a null or empty html gives an empty text; unclosed and stray tags are tolerated; text
outside any tag is a block; a page without article text gives an empty text; repeated rows are
read alike; with no pages to sample, layouts are filled with a fixed sentence; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frames

# Fixed values of the language.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no text.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
# A start tag ends the open elements of these that no element of the second list stands around.
_CELL, _ROW = ("caption", "colgroup", "td", "th"), ("caption", "colgroup", "td", "th", "tr")
_PART = (*_ROW, "tbody", "tfoot", "thead")
CLOSES = {"tr": (_ROW, ("table",)), "td": (_CELL, ("table",)), "th": (_CELL, ("table",))} | {
    n: (_PART, ("table",)) for n in ("caption", "colgroup", "tbody", "tfoot", "thead")} | {
    n: (("option", n), ("select", "datalist")) for n in ("option", "optgroup")}
_ENDS_P = (("p",), ("button", "caption", "marquee", "table", "td", "th", *sorted(SILENT)))
ENDS_PARAGRAPH = frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form "
                           "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
# A list item ends the open one of these, unless another element of ITEM_BOUNDS is open inside it.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
ITEM_BOUNDS = frozenset("article aside blockquote body button caption center colgroup dd details dir dl dt fieldset "
                        "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html iframe li listing main "
                        "marquee menu nav ol pre search section select summary table tbody td textarea tfoot th thead "
                        "title tr ul xmp".split()) | SILENT
ROLE_WORDS = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal newsletter "
    "subscribe signup form search login nav menu navbar breadcrumb breadcrumbs sidebar side aside widget related "
    "recommended share social comment comments reply respond discussion footer header masthead copyright legal "
    "article content post entry body main story text page title author byline meta tags pager pagination toolbar "
    "disclaimer warning gdpr privacy feedback reviews rating teaser outbrain".split())

# Layouts are filled with text from so many characters each of so many pages.
SAMPLE_PAGES = 300
SAMPLE_CHARACTERS = 6000
LAYOUT_COPIES = 12

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                  r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-label|itemprop)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: its text and where it stands, that is the names and class words of all open
    elements, the innermost one, and the innermost that is not inline."""

    tags: frozenset[str]
    roles: frozenset[str]
    inner: str
    leaf: str
    text: str = ""
    linked: int = 0
    pieces: list[str] = field(default_factory=list)


def leaf_blocks(source: str | None) -> list[Block]:
    """Blocks with text, in page order. One pass over the tags; work is linear in the page, however
    deep it nests: what is open is looked up by name, and elements share the sets of their parents."""
    out: list[Block] = []
    if not source:
        return out
    stack: list[str] = []
    above: list[tuple[frozenset[str], frozenset[str], str, str]] = [(frozenset(), frozenset(), "", "none")]
    # Places in the stack: of each name, and of the bounds of list items.
    places: dict[str, list[int]] = defaultdict(list)
    bounds: list[int] = []
    silent = links = 0
    current: Block | None = None

    def add(raw: str) -> None:
        nonlocal current
        if silent or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(*above[-1])
            out.append(current)
        current.pieces.append(raw)
        if links:
            current.linked += len(raw)

    def leave(depth: int) -> None:
        nonlocal silent, links, current
        while len(stack) > depth:
            name = stack.pop()
            above.pop()
            places[name].pop()
            if name in ITEM_BOUNDS:
                bounds.pop()
            silent -= name in SILENT or name == "title"
            links -= name == "a"
            if name not in INLINE:
                current = None

    def end(names: tuple[str, ...], around: tuple[str, ...]) -> None:
        inside = max((places[n][-1] for n in around if places.get(n)), default=-1)
        depth = min((places[n][-1] for n in names if places.get(n) and places[n][-1] > inside), default=-1)
        if depth >= 0:
            leave(depth)

    at = 0
    while at < len(source):
        found = _TAG.search(source, at)
        if found is None:
            add(source[at:])
            break
        add(source[at:found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if places.get(name):
                leave(places[name][-1])
            elif name not in INLINE:
                current = None
            continue
        if name in CLOSES:
            end(*CLOSES[name])
        if name in ITEMS and bounds and stack[bounds[-1]] in ITEMS[name]:
            leave(bounds[-1])
        if name in ENDS_PARAGRAPH and places.get("p"):
            end(*_ENDS_P)
        if name not in INLINE:
            current = None
        if name in VOID:
            if name == "br":
                add(" ")
            continue
        own = set()
        if found[3]:
            for key, value in _ATTRIBUTE.findall(found[3]):
                key = key.lower()
                if key in ("class", "id", "role", "aria-label", "itemprop"):
                    own.update(w for w in _WORDS.findall(value.lower()) if w in ROLE_WORDS)
                elif key == "hidden" or "display:none" in value.replace(" ", "").lower():
                    own.add("hidden")
        if found[3].rstrip().endswith("/") and name not in RAW:
            continue
        tags, roles, _, leaf = above[-1]
        above.append((tags if name in tags else tags | {name}, roles if own <= roles else roles | own, name,
                      leaf if name in INLINE else name))
        places[name].append(len(stack))
        if name in ITEM_BOUNDS:
            bounds.append(len(stack))
        stack.append(name)
        silent += name in SILENT or name == "title"
        links += name == "a"
        if name in RAW:
            after = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            stop = after.start() if after else len(source)
            add(source[at:stop])
            at = stop
    for block in out:
        block.text = " ".join(html.unescape("".join(block.pieces)).split())
    return [b for b in out if b.text]


_NOTICE_WORDS = re.compile(r"\b(cookies?|privacy|subscribe|newsletter|sign up|log ?in|copyright|all rights reserved|"
                           r"click here|read more|advertisement|sponsored|share|terms|accept)\b", re.I)


def block_features(blocks: Sequence[Block]) -> list[list[str]]:
    out = []
    heading = next((i for i, b in enumerate(blocks) if b.inner == "h1"), -1)
    for i, b in enumerate(blocks):
        text, n = b.text, len(b.text)
        words = text.count(" ") + 1
        share = b.linked / max(1, sum(map(len, b.pieces)))
        tags, leaf = b.tags - {"html", "body"}, b.leaf
        f = [f"in {t}" for t in tags] + [f"role {r}" for r in b.roles] + [f"leaf {leaf}"]
        f.append("words " + ("1" if words < 3 else "3" if words < 8 else "8" if words < 20 else "20" if words < 50 else "50"))
        f.append("links " + ("0" if share == 0 else "some" if share < 0.3 else "half" if share < 0.7 else "all"))
        f.append("stop" if text[-1] in ".!?…\"»" else "no stop")
        if "©" in text or text.lower().startswith("copyright"):
            f.append("copyright")
        if _NOTICE_WORDS.search(text):
            f.append("notice words")
        if "|" in text or "·" in text or "»" in text or "›" in text:
            f.append("separators")
        if sum(map(str.isdigit, text)) > 0.2 * n:
            f.append("digits")
        f.append("before title" if i < heading else "after title" if heading >= 0 else "no title")
        if "article" in tags or "main" in tags:
            f.append("semantic")
            f.append(f"semantic {leaf}")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights: state by feature, and state by next state. State 1 is article."""

    place: dict[str, int]
    emit: np.ndarray
    follow: np.ndarray

    def scores(self, blocks: Sequence[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for i, f in enumerate(block_features(blocks)):
            at = [p for p in map(self.place.get, f) if p is not None]
            out[i] = self.emit[at].sum(axis=0) + self.emit[-1]
        return out

    def decode(self, blocks: Sequence[Block]) -> list[int]:
        """The best sequence of states, by Viterbi."""
        if not blocks:
            return []
        scores = self.scores(blocks).tolist()
        (aa, ab), (ba, bb) = self.follow.tolist()
        zero, one = scores[0]
        came = []
        for s0, s1 in scores[1:]:
            from0, from1 = zero + aa >= one + ba, zero + ab > one + bb
            zero, one = (zero + aa if from0 else one + ba) + s0, (zero + ab if from1 else one + bb) + s1
            came.append((0 if from0 else 1, 0 if from1 else 1))
        state = int(one > zero)
        out = [state]
        for step in reversed(came):
            state = step[state]
            out.append(state)
        return out[::-1]


def train_field(pages: Sequence[tuple[list[Block], list[int]]], rounds: int = 250, ridge: float = 0.01) -> Field:
    """Maximum likelihood with a ridge, by gradient ascent (Adam); expectations by forward and
    backward passes over all pages at once."""
    names = sorted({n for blocks, _ in pages for f in block_features(blocks) for n in f})
    place = {n: i for i, n in enumerate(names)}
    size = max(len(b) for b, _ in pages)
    x = np.zeros((len(pages), size, len(names) + 1), dtype=np.float32)
    y = np.zeros((len(pages), size), dtype=np.int64)
    there = np.zeros((len(pages), size), dtype=bool)
    for p, (blocks, states) in enumerate(pages):
        for i, f in enumerate(block_features(blocks)):
            x[p, i, [place[n] for n in f]] = 1
            x[p, i, -1] = 1
        y[p, :len(states)] = states
        there[p, :len(states)] = True
    flat = x.reshape(-1, x.shape[2])
    seen = np.zeros((len(pages), size, 2))
    np.put_along_axis(seen, y[..., None], 1.0, axis=2)
    seen *= there[..., None]
    pair = there[:, 1:] & there[:, :-1]
    seen_pairs = np.einsum("pia,pib,pi->ab", seen[:, :-1], seen[:, 1:], pair)
    w, t = np.zeros((x.shape[2], 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        s = (flat @ w.astype(np.float32)).reshape(len(pages), size, 2).astype(float)
        ahead, back = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for i in range(1, size):
            nxt = np.logaddexp.reduce(ahead[:, i - 1, :, None] + t, axis=1) + s[:, i]
            ahead[:, i] = np.where(there[:, i, None], nxt, ahead[:, i - 1])
        for i in range(size - 2, -1, -1):
            prev = np.logaddexp.reduce(t + (s[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
            back[:, i] = np.where(there[:, i + 1, None], prev, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        state = np.exp(ahead + back - total[:, None, None]) * there[..., None]
        both = np.exp(ahead[:, :-1, :, None] + t + (s + back)[:, 1:, None, :] - total[:, None, None, None])
        grad_w = flat.T @ (seen - state).reshape(-1, 2) / len(pages) - ridge * w
        grad_t = (seen_pairs - np.einsum("piab,pi->ab", both, pair)) / len(pages) - ridge * t
        for k, (value, grad) in enumerate(((w, grad_w), (t, grad_t))):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * grad * grad
            value += 0.1 * (moments[k] / (1 - 0.9 ** step)) / (np.sqrt(moments[k + 2] / (1 - 0.999 ** step)) + 1e-8)
    return Field(place, w, t)


# Labelled layouts. A block in double braces is filled in; its first letter says what it is:
# A article paragraph, H article heading, L article list item or quotation, and in lower case
# other parts: m menu entry, s side bar, n notice, d advert, f form, c comment, t footer, b header.
LAYOUTS = (
    "<header><div class='logo'>{{b}}</div><nav><ul><li><a href='/'>{{m}}</a><li><a>{{m}}</a><li><a>{{m}}</a></ul></nav></header>"
    "<main><article><h1>{{H}}</h1><p>{{A}}</p><p>{{A}}</p><blockquote>{{L}}</blockquote><p>{{A}}</p></article></main>"
    "<aside class='sidebar'><h3>{{m}}</h3><p>{{s}}</p><ul><li><a>{{m}}</a></ul></aside><footer><p>{{t}}</p></footer>",
    "<div class='cookie-notice'><p>{{n}}</p><button>{{m}}</button></div><div id='menu'><a>{{m}}</a><div><a>{{m}}</a></div></div>"
    "<div id='content'><h1>{{H}}</h1><p>{{A}}<p>{{A}}<h2>{{H}}</h2><p>{{A}}<ul><li>{{L}}<li>{{L}}</ul></div>"
    "<div id='comments'><h3>{{m}}</h3><div class='comment'><p>{{c}}</p></div><div class='comment'><p>{{c}}</p></div></div>"
    "<div id='footer'>{{t}}</div>",
    "<nav><a>{{m}}</a></nav><div class='ad'>{{d}}</div><article><h1>{{H}}</h1><p>{{A}}</p><div class='ad'>{{d}}</div><p>{{A}}</p>"
    "<p>{{A}}</p><section class='comments'><h2>{{m}}</h2><p>{{c}}</p><p>{{c}}</p></section></article><footer>{{t}}</footer>",
    "<div class='header'><h2>{{b}}</h2><p>{{b}}</p></div><div class='post'><h2>{{H}}</h2><div class='entry-content'><p>{{A}}</p><p>{{A}}</p>"
    "</div><form class='newsletter'><p>{{f}}</p><label>{{m}}</label><input></form></div><div class='widget'><p>{{s}}</p></div>"
    "<div class='footer'><p>{{t}}</p></div>",
    "<ul class='breadcrumb'><li><a>{{m}}</a><li><a>{{m}}</a></ul><div class='banner'><p>{{n}}</p></div><main><h1>{{H}}</h1>{{A}}<br><p>{{A}}"
    "<aside><p>{{s}}</p></aside><p>{{A}}</main><form action='/s'><p>{{f}}</p><select><option>{{m}}<option>{{m}}</select><button>{{m}}</button></form>"
    "<footer><ul><li><a>{{m}}</a><li><a>{{m}}</a></ul>{{t}}</footer>",
    "<nav><ul><li><a>{{m}}</a></li><li><a>{{m}}</a></li></ul></nav><div class='ad'>{{d}}</div><article><h1>{{H}}</h1><p><b>{{A}}<br><p>{{A}}</p>"
    "<p>{{A}}</p></article><footer>{{t}}</footer>",
    "<nav><ul><li><a>{{m}}</a></li></ul></nav><div class='ad'>{{d}}</div><article><h1>{{H}}</h1><p>{{A}}</p></article><footer>{{t}}",
    "<header><h1>{{b}}</h1><p>{{b}}</p><nav><a>{{m}}</a> <a>{{m}}</a></nav></header><div role='main'><h2>{{H}}</h2><p>{{A}}</p><p>{{A}}</p>"
    "<table><tr><td>{{L}}</td><td>{{L}}</td></tr></table><pre>{{L}}</pre></div><section id='related'><h3>{{m}}</h3><p><a>{{s}}</a></p></section>"
    "<section id='respond'><form><p>{{f}}</p><textarea>{{m}}</textarea></form></section><footer><small>{{t}}</small></footer>",
    "<div role='alert' class='notice'><p>{{n}}</p></div><article><header><h1>{{H}}</h1></header><p>{{A}}</p><figure><figcaption>{{L}}</figcaption>"
    "</figure><p>{{A}}</p><footer><p>{{t}}</p></footer></article><div class='share'><a>{{m}}</a></div><ol class='comment-list'><li><p>{{c}}</p>"
    "<li><p>{{c}}</p></ol><aside class='promo'><p>{{d}}</p></aside>",
    "<table><tr><td><a>{{m}}</a><br><a>{{m}}</a></td></tr></table><div class='story-body'><div>{{A}}</div><div>{{A}}</div><div>{{A}}</div></div>"
    "<div class='sponsored'><div>{{d}}</div></div><div class='copyright'>{{t}}</div>",
    "<section class='popup modal'><p>{{n}}</p><form><input><button>{{m}}</button></form></section><section class='article-body'><h1>{{H}}</h1>"
    "<p>{{A}}</p><p>{{A}}</p></section><section class='sidebar'><p>{{s}}</p><p>{{s}}</p></section><section class='discussion'><p>{{c}}</p></section>",
    "<div><h1>{{H}}</h1><p>{{A}}</p><p>{{A}}</p><p>{{A}}</p></div><div><a>{{m}}</a> | <a>{{m}}</a> | <a>{{m}}</a></div><p>{{t}}</p>",
)
_NOTICES = ("We use cookies to improve this site.", "Subscribe to our newsletter.", "Sign up for news by mail",
            "Log in to read more", "This site stores data as the privacy terms say. Accept?")
_FOOTERS = ("© 2024 {}", "Copyright {}. All rights reserved.", "© {} · {}", "{} | Terms | Privacy", "© {} &middot; {}")
_FILLER = "The quick brown fox jumps over the lazy dog."


def fill_layout(layout: str, texts: Sequence[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A labelled page: its blocks and their states."""
    def sentence() -> str:
        return texts[rng.integers(len(texts))]

    def few(low: int, high: int) -> str:
        return " ".join(sentence().split()[:rng.integers(low, high + 1)]).rstrip(".,")

    marks: list[tuple[str, int]] = []

    def fill(match) -> str:
        kind = match[1]
        text = {
            "A": lambda: " ".join(sentence() for _ in range(rng.integers(1, 5))), "H": lambda: few(3, 10),
            "L": lambda: few(3, 30), "m": lambda: few(1, 3), "b": lambda: few(2, 8), "s": sentence,
            "n": lambda: _NOTICES[rng.integers(len(_NOTICES))] if rng.random() < 0.6 else sentence(),
            "d": sentence, "f": lambda: _NOTICES[rng.integers(len(_NOTICES))] if rng.random() < 0.6 else few(3, 12),
            "c": sentence, "t": lambda: _FOOTERS[rng.integers(len(_FOOTERS))].format(few(1, 3), sentence()),
        }[kind]()
        marks.append((f"mark{len(marks)}x", int(kind.isupper())))
        return f"{marks[-1][0]} {text}" if "&middot;" in text else f"{marks[-1][0]} {html.escape(text, quote=False)}"

    page = re.sub(r"\{\{(\w)\}\}", fill, layout)
    state_of = dict(marks)
    blocks = leaf_blocks(f"<html><body>{page}</body></html>")
    states = []
    for b in blocks:
        states.append(max((state_of[m] for m in re.findall(r"mark\d+x", b.text)), default=0))
        b.text = re.sub(r"mark\d+x ?", "", b.text) or "x"
    return blocks, states


def train(pages: DataFrame, size: int = SAMPLE_PAGES, characters: int = SAMPLE_CHARACTERS) -> Field:
    """A field trained on labelled layouts, filled with sentences of the first ``characters`` of at
    most ``size`` of the pages."""
    # Bounded by ``size`` identifiers, then by one row each of at most ``characters``; the text only
    # fills layouts.
    picked = pages.where("page_id is not null and html is not null").select("page_id").orderBy(
        F.xxhash64("page_id"), "page_id").limit(size).distinct()
    rows = pages.join(F.broadcast(picked), "page_id", "left_semi").groupBy("page_id").agg(
        F.min(F.substring("html", 1, characters)).alias("h")).orderBy(F.xxhash64("page_id")).select("h").collect()
    texts = []
    for row in rows:
        for block in (b for b in leaf_blocks(row["h"]) if "p" in b.tags):
            texts += [s.strip() + "." for s in block.text.split(". ") if s.count(" ") >= 4]
    rng = np.random.default_rng(3)
    labelled = [fill_layout(layout, texts or [_FILLER], rng) for layout in LAYOUTS for _ in range(LAYOUT_COPIES)]
    return train_field(labelled)


def main_text(source: str | None, model: Field) -> str:
    blocks = leaf_blocks(source)
    return "\n\n".join(b.text for b, state in zip(blocks, model.decode(blocks)) if state)


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                text = [main_text(h, shared.value) for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text,
                                    "n_chars": [len(t) for t in text]})

    return frames(pages.select("page_id", "url", "html"), run,
                  "page_id long, url string, text string, n_chars long")
