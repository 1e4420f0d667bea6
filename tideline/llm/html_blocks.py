"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between the tags of block elements,
in page order. Each block has a vector of its hashed tag path (elements with
their class, id and role words), its hashed words and a few counts. A
bidirectional LSTM in numpy reads the vectors of the whole page and gives every
block the probability that it belongs to the article, so that a block's label
depends on all blocks before and after it. The blocks labelled as main text,
joined by line feeds, are the page's text.

It is trained on at most `sample` pages of the table, chosen by a hash of their
page_id and labelled by the names on their tag paths, and on three times as many
(300 at least) put together from their texts in other layouts (side columns, notices, adverts,
forms, comments, articles without an article element), whose labels are known.
Pages are labelled whole; nothing of a page is dropped but what the labels say.

Defined cases: null or empty html, or html without text, gives an empty text;
scripts, styles, comments, titles and other raw elements have no blocks; markup
that ends early ends with the page; repeated page_ids are pages of their own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import only, small_batches
from tideline.llm.textvec import mix, slices

#: HTML elements by kind, and words in class, id and role that name a part of a page.
CODE = frozenset(["script", "style"])
RAW = frozenset("script style noscript template iframe textarea title".split())
SKIPPED = frozenset("svg math object canvas select button".split())
SELF_CLOSING = frozenset("svg math iframe object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("ul ol dl table div section article main aside nav header footer form body blockquote".split())
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article main content post entry story".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent footer form header login masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination popup promo promotion related reply replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_NAMED = re.compile(r"""(?<![\w:-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
PATH, WORDS, COUNTS, HIDDEN = 192, 32, 8, 24
GROUP_BLOCKS = 20_000  # pages are labelled in groups of about so many blocks; a longer page is read in stretches of as many


class Element:
    """An open element of a page, linked to the one around it; all blocks within share it, however deep they lie."""

    __slots__ = ("parent", "tag", "words", "scope", "skipped", "shown", "main", "other")

    def __init__(self, parent: Element | None, tag: str, words: tuple[str, ...], scope: int):
        self.parent, self.tag, self.words = parent, tag, words
        self.scope = scope  # place of the innermost element that bounds implied end tags
        self.skipped = (parent.skipped if parent else 0) + (tag in SKIPPED)  # drawings and the like, from the root down to here
        self.shown = self if not self.skipped else parent.shown if parent else None  # the innermost element outside them
        # Whether the names say main text: inside a main part, and in no other part within or around that.
        self.main, self.other = (parent.main, parent.other) if parent else (False, False)
        if tag in OTHER_TAGS or OTHER_WORDS.intersection(words):
            self.other = self.other or self.main or tag != "header"
        elif tag in MAIN_TAGS or MAIN_WORDS.intersection(words):
            self.main = True

    def path(self) -> tuple[str, ...]:
        """ "tag word word" for each element, outermost first."""
        out, at = [], self
        while at:
            out.append(" ".join((at.tag, *at.words)))
            at = at.parent
        return tuple(reversed(out))


@dataclass
class Block:
    within: Element | None  # the innermost open element
    text: str
    linked: float  # share of the text inside links


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; time and memory are linear in the page, however deep its elements are nested.

    What scripts, styles and the other raw elements hold is passed over up to their end tag; without one, a script or
    style goes on to the end of the page, of the others only the tag goes. Drawings, formulas, buttons and the like have
    no blocks either; they are elements like others, so what their parent's end leaves open ends there.
    """
    out: list[Block] = []
    stack: list[Element] = []  # block elements
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    links = 0
    parts: list[str] = []
    in_links = 0
    page = page or ""
    at = 0
    unclosed: set[str] = set()  # raw elements that have no end tag from here on

    def flush() -> None:
        nonlocal in_links
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", entities.unescape(raw)).strip()
            if text:
                out.append(Block(stack[-1].shown if stack else None, text, in_links / len(raw)))
            parts.clear()
            in_links = 0

    def close(i: int) -> None:
        if not stack[i].skipped:
            flush()
        for e in stack[i:]:
            places[e.tag].pop()
        del stack[i:]

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while m := _TOKEN.search(page, at):
        skipped = stack[-1].skipped if stack else 0
        if m.start() > at and not skipped:
            parts.append(page[at : m.start()])
            in_links += (m.start() - at) * (links > 0)
        at = m.end()
        if not m[2]:
            continue
        tag, closing, alone = m[2].lower(), bool(m[1]), m[3].endswith("/")
        if tag in RAW:
            if closing or alone and tag not in CODE:
                continue
            if tag in ("title", "textarea"):
                flush()
            end = None if tag in unclosed else _END[tag].search(page, at)
            if end is None:
                unclosed.add(tag)
            at = end.end() if end else len(page) if tag in CODE else at
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in INLINE or alone and tag in SELF_CLOSING:
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                parts.append(" " if tag != "wbr" else "")
            else:
                flush()
            continue
        if tag not in SKIPPED and not skipped:
            flush()
            links = 0
        scope = stack[-1].scope if stack else -1
        if closing:
            i = innermost((tag,))
            if i >= 0 and (tag not in SKIPPED or i > scope):
                close(i)
            continue
        if closed := CLOSED_BY.get(tag):
            i = innermost(closed)
            if i > scope:
                close(i)
        elif tag not in SKIPPED and stack and stack[-1].tag == "p":
            close(len(stack) - 1)
        words = tuple(w for n in _NAMED.finditer(m[3] or "") for w in re.split(r"[^a-z]+", (n[1] or n[2] or n[3] or "").lower()) if w)
        around = stack[-1] if stack else None
        scope = len(stack) if tag in SCOPE else around.scope if around else -1
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(around, tag, words, scope))
    if at < len(page) and not (stack and stack[-1].skipped):
        parts.append(page[at:])
    flush()
    return out


def named_label(block: Block) -> bool:
    """Whether the names around a block say that it is main text."""
    return bool(block.within and block.within.main and not block.within.other)


def _text_hash(x: str) -> int:
    h = 0xCBF29CE484222325
    for b in x.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h ^ h >> 29


def _add(v: np.ndarray, name: str, sign: int = 1) -> None:
    h = _text_hash(name)
    v[h % PATH] += sign if h >> 40 & 1 else -sign
    v[(h >> 20) % PATH] += sign if h >> 41 & 1 else -sign


class OpenPath:
    """The elements around a place in a page, and the sum of what their tags (each once) and names add."""

    def __init__(self):
        self.sum = np.zeros(PATH, np.float32)
        self.open: list[Element] = []
        self.place: dict[Element | None, int] = {None: -1}
        self.tags: Counter[str] = Counter()

    def move(self, to: Element | None) -> np.ndarray:
        """Go to another place; its vector."""
        new, e = [], to
        while e not in self.place:
            new.append(e)
            e = e.parent
        while len(self.open) > self.place[e] + 1:
            self._step(self.open.pop(), -1)
        for e in reversed(new):
            self.place[e] = len(self.open)
            self.open.append(e)
            self._step(e, 1)
        row = self.sum.copy()
        for w in to.words if to else ():
            _add(row, f"own:{w}")
        last = [e.tag for e in self.open[-3:]]
        for n in (1, 2, 3):
            _add(row, f"end:{'/'.join(last[-n:])}")
        return row

    def _step(self, e: Element, sign: int) -> None:
        if sign < 0:
            del self.place[e]
        if self.tags[e.tag] == (sign < 0):  # the first to come or the last to go
            _add(self.sum, f"t:{e.tag}", sign)
        self.tags[e.tag] += sign
        for w in e.words:
            _add(self.sum, f"w:{w}", sign)


class Vectors:
    """Vectors of blocks. Tag paths come again and again, so theirs are kept, by numbers that stand for whole paths."""

    def __init__(self):
        self.numbers: dict[tuple[int, str, tuple[str, ...]], int] = {}  # number around, tag, words
        self.rows: dict[int, np.ndarray] = {}
        self.next = 1

    def paths(self, blocks: list[Block]) -> list[np.ndarray]:
        """Hashed tags and names of all elements around each block, names of the innermost, the last one to three tags.

        Paths not met before are worked out from the one before them. They come in page order, so an element is entered and left once.
        """
        out, here = [], OpenPath()
        known: dict[Element | None, int] = {None: 0}
        for block in blocks:
            e, new = block.within, []
            while e not in known:
                new.append(e)
                e = e.parent
            number = known[e]
            for e in reversed(new):
                key = (number, e.tag, e.words)
                if (number := self.numbers.get(key, -1)) < 0:
                    if len(self.numbers) > 20_000:
                        self.numbers.clear()
                        self.rows.clear()
                    number = self.numbers[key] = self.next
                    self.next += 1
                known[e] = number
            if (row := self.rows.get(number)) is None:
                row = self.rows[number] = here.move(block.within)
            out.append(row)
        return out

    def of(self, pages: list[list[Block]], stretch: tuple[int, int] | None = None) -> np.ndarray:
        """One row for each block of all pages in order; or for a stretch of the blocks of one page."""
        every = [b for page in pages for b in page]
        if stretch:
            every = every[stretch[0] : stretch[1]]
        out = np.zeros((len(every), PATH + WORDS + COUNTS), np.float32)
        if not every:
            return out
        out[:, :PATH] = self.paths(every)
        bins = np.zeros(len(every) * WORDS)
        words = np.zeros(len(every))
        for s in slices(pa.array([b.text for b in every], pa.large_string())):
            bucket = (mix(s.hashes(s.start, s.end), 3) >> np.uint64(59)).astype(np.int64)
            bins += np.bincount(s.doc * WORDS + bucket, minlength=len(bins))
            words += np.bincount(s.doc, minlength=len(words))
        out[:, PATH : PATH + WORDS] = np.log1p(bins).reshape(-1, WORDS) / 4
        size = np.array([len(b.text) for b in every])
        place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages])
        count = np.repeat([len(p) for p in pages], [len(p) for p in pages])
        if stretch:
            place, count = place[stretch[0] : stretch[1]], count[stretch[0] : stretch[1]]
        stops = np.array([b.text.count(".") + b.text.count(",") for b in every])
        ends = np.array([b.text[-1] in ".!?:;\"'" for b in every])
        out[:, PATH + WORDS :] = np.stack([np.log1p(size) / 8, [b.linked for b in every], np.log1p(words) / 6, stops / np.maximum(1, words), ends, place, np.log1p(count) / 6, np.ones(len(every))], 1)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """A bidirectional LSTM with one logit for each step; batches are padded, (time, page, feature)."""

    def __init__(self, seed: int = 7, size: int = PATH + WORDS + COUNTS, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h = hidden
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"{n}{d}": draw(*shape) for d in "fb" for n, shape in (("x", (size, 4 * hidden)), ("r", (hidden, 4 * hidden)))}
        for d in "fb":
            self.p[f"c{d}"] = np.r_[np.ones(hidden), np.zeros(3 * hidden)].astype(np.float32)  # forget, input, output, cell
        self.p |= {"o": draw(2 * hidden, 1), "oc": np.zeros(1, np.float32)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, state: list | None = None) -> np.ndarray:
        """The hidden states of one direction; `state` (hidden, cell) is where it starts, and then where it ends."""
        steps, n, h = x.shape[0], x.shape[1], self.h
        z_in = (x.reshape(steps * n, -1) @ self.p[f"x{d}"]).reshape(steps, n, 4 * h) + self.p[f"c{d}"]
        hid, cell = state or (np.zeros((n, h), np.float32), np.zeros((n, h), np.float32))
        out = np.zeros((steps, n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + hid @ self.p[f"r{d}"]
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = gates[:, :h] * cell + gates[:, h : 2 * h] * g
            tan = np.tanh(new)
            if keep is not None:
                keep.append((t, hid, cell, gates, g, tan, m))
            cell = np.where(m, new, cell)
            hid = np.where(m, gates[:, 2 * h :] * tan, hid)
            out[t] = hid
        if state is not None:
            state[:] = hid, cell
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, d, None if kept is None else kept.setdefault(d, [])) for d in "fb"], 2)
        if kept is not None:
            kept["both"] = both
        return (both @ self.p["o"])[:, :, 0] + self.p["oc"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss over real blocks."""
        kept: dict = {}
        err = ((_sigmoid(self.logits(x, mask, kept)) - y) * mask / max(1, mask.sum())).astype(np.float32)
        g = {"o": np.einsum("tnh,tn->h", kept["both"], err)[:, None], "oc": np.array([err.sum()], np.float32)}
        h = self.h
        for k, d in enumerate("fb"):
            d_out = err[:, :, None] * self.p["o"][k * h : (k + 1) * h, 0]
            dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
            dr = np.zeros_like(self.p[f"r{d}"])
            dh, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, hid, cell, gates, gg, tan, m in reversed(kept[d]):
                dh = dh + d_out[t]
                f, i, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dn = np.where(m, dc + dh * o * (1 - tan * tan), 0)
                dz = np.concatenate([dn * cell * f * (1 - f), dn * gg * i * (1 - i), np.where(m, dh * tan, 0) * o * (1 - o), dn * i * (1 - gg * gg)], 1)
                dz_all[t] = dz
                dr += hid.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.p[f"r{d}"].T
                dc = np.where(m, dn * f, dc)
            flat = dz_all.reshape(-1, 4 * h)
            g |= {f"x{d}": x.reshape(len(flat), -1).T @ flat, f"r{d}": dr, f"c{d}": flat.sum(0)}
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        by_size = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        batches = [by_size[i : i + batch] for i in range(0, len(by_size), batch)]
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                x, mask = padded([pages[i] for i in batches[b]])
                y = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(batches[b]):
                    y[: len(labels[i]), k] = labels[i]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (0.5 if epoch > epochs * 0.6 else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def label_pages(self, found: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out = [np.zeros(0, bool)] * len(found)
        short = [i for i, page in enumerate(found) if len(page) <= GROUP_BLOCKS]
        x = vectors.of([found[i] for i in short])
        ends = np.cumsum([0, *[len(found[i]) for i in short]])
        for i, on in zip(short, self.label([x[a:b] for a, b in zip(ends, ends[1:], strict=False)]), strict=True):
            out[i] = on
        for i, page in enumerate(found):
            if len(page) > GROUP_BLOCKS:
                out[i] = self.label_long(page, vectors)
        return out

    def label_long(self, page: list[Block], vectors: Vectors) -> np.ndarray:
        """As label, for one page in stretches: the states go from one to the next, the vectors of one are in memory at once."""
        cuts = [(a, min(a + GROUP_BLOCKS, len(page))) for a in range(0, len(page), GROUP_BLOCKS)]
        logits = np.full(len(page), self.p["oc"][0], np.float32)
        for k, (d, order) in enumerate((("f", cuts), ("b", cuts[::-1]))):
            state = [np.zeros((1, self.h), np.float32), np.zeros((1, self.h), np.float32)]
            for a, b in order:
                x = vectors.of([page], (a, b))[:, None, :]
                hidden = self._pass(x, np.ones((b - a, 1), bool), d, None, state)
                logits[a:b] += hidden[:, 0] @ self.p["o"][k * self.h : (k + 1) * self.h, 0]
        return logits > 0

    def label(self, pages: list[np.ndarray], batch: int = 128) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = max(1, min(batch, 200_000 // max(1, len(pages[order[min(at + batch, len(order)) - 1]]))))
            some = order[at : at + n]
            at += n
            x, mask = padded([pages[i] for i in some])
            on = self.logits(x, mask) > 0
            for k, i in enumerate(some):
                out[i] = on[: len(pages[i]), k]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), PATH + WORDS + COUNTS), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = True
    return x, mask


HELD = "\x01"  # marks main text in made-up pages


def made_up_page(rng: np.random.Generator, texts: list[str]) -> str:
    """A page in some other layout, of the given texts; its main text is marked."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    some = lambda p: rng.random() < p
    text = lambda: entities.escape(pick(*texts), quote=False)
    short = lambda: " ".join(text().split(" ")[: int(rng.integers(1, 9))])
    links = lambda: "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(int(rng.integers(2, 8)))) + "</ul>"

    def named(tag: str, *words: str) -> tuple[str, str]:
        word = pick(*words)
        word = pick(word, word, f"{word}-box", f"site-{word}", f"{word} wide")
        return f'<{tag} {pick("class", "class", "id")}="{word}">', f"</{tag}>"

    def wrap(pair: tuple[str, str], body: str) -> str:
        return pair[0] + body + pair[1]

    prose = lambda n: "".join(f"<p>{text()}</p>" for _ in range(n))
    say = lambda: pick(f"<p>{text()}</p>", short(), f"<p>{short()}</p>", text())

    def comments() -> str:
        one = lambda: pick(f'<div class="comment"><p>{text()}</p></div>', f'<li class="comment"><b>{short()}</b><p>{text()}</p></li>', f'<div class="reply">{text()}</div>', f"<p>{text()}</p>")
        return wrap(named(pick("div", "section", "ol", "aside"), "comments", "comment", "commentlist", "replies", "respond"), pick("", f"<h3>{short()}</h3>") + "".join(one() for _ in range(int(rng.integers(1, 6)))))

    other = [
        lambda: wrap(named("div", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored"), say()),
        lambda: wrap(named("div", "cookie", "cookies", "consent", "notice", "popup", "modal", "notices"), say()),
        lambda: wrap(named("div", "share", "social", "sharing", "related", "pagination", "breadcrumb", "toolbar"), pick(links(), say())),
        lambda: wrap(pick(named("form", "newsletter", "subscribe", "search", "login"), ("<form>", "</form>"), named("div", "newsletter", "subscribe", "form")), f"<label>{short()}</label><input><p>{short()}</p>" + pick("", say())),
        lambda: wrap(pick(named("aside", "sidebar", "related", "widget"), ("<aside>", "</aside>"), named("div", "sidebar", "widget", "related")), pick("", f"<h3>{short()}</h3>") + pick(links(), prose(2), say())),
    ]
    other += [lambda: wrap(named(pick("p", "p", "section"), "notice", "ad", "advert", "promo", "sponsored", "share", "related", "cookie"), pick(text(), short()))]
    body = []
    title = HELD + short()
    for _ in range(int(rng.integers(1, 7))):
        body.append(pick(f"<p>{HELD}{text()}</p>", f"<p>{HELD}{text()}</p>", f"<p>{HELD}{text()}</p>", f"<h2>{HELD}{short()}</h2><p>{HELD}{text()}</p>", f"<ul><li>{HELD}{text()}</li><li>{HELD}{short()}</li></ul>", f"<blockquote>{HELD}{text()}</blockquote>", f"<p><b>{HELD}{text()}<br><p>{HELD}{text()}</p>", f"<div>{HELD}{text()}</div>", f"<table><tr><td>{HELD}{short()}</td><td>{HELD}{text()}</td></tr></table>"))
        if some(0.35):
            body.append(other[int(rng.integers(len(other)))]())
    if some(0.2):
        body.append(comments())
    main = f"{pick('<h1>', '<h1>', '<h2>')}{title}</h1>" + "".join(body)
    main = main.replace("</h1>", "</h2>", 1) if main.startswith("<h2>") else main
    if some(0.2):
        main = f"<header>{main.split('</h', 1)[0]}</h1></header>" + main.split(">", 2)[2] if main.startswith("<h1>") else main
    main = wrap(pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), named("div", "content", "post", "entry", "article", "story", "main"), named("section", "content", "article", "story"), ("<div>", "</div>"), named("article", "post", "entry")), main)
    around = [other[int(rng.integers(len(other)))]() for _ in range(int(rng.integers(0, 4)))]
    cut = int(rng.integers(0, len(around) + 1))
    top = wrap(pick(("<header>", "</header>"), named("div", "header", "masthead", "topbar")), say()) if some(0.4) else ""
    menu = wrap(pick(("<nav>", "</nav>"), named("div", "nav", "menu", "navigation", "navbar"), named("ul", "menu", "nav")), links()) if some(0.8) else ""
    foot = wrap(pick(("<footer>", "</footer>"), named("div", "footer")), say() + pick("", links(), prose(1))) if some(0.8) else ""
    shell = pick(("", ""), ("<div>", "</div>"), named("div", "wrapper", "page", "container", "layout"))
    return "<html><body>" + shell[0] + pick(top + menu, menu + top) + "".join(around[:cut]) + main + (comments() if some(0.3) else "") + "".join(around[cut:]) + foot + shell[1] + "</body></html>"


def train(pages: DataFrame, sample: int = 400, seed: int = 7) -> Lstm:
    """Fit on at most `sample` pages of the table and three made-up pages for each."""
    chosen = only(pages, "page_id", "html").filter(F.col("html").isNotNull()).select("page_id", F.xxhash64("page_id", "html").alias("h")).orderBy("h").limit(sample)
    rows = only(pages, "page_id", "html").join(F.broadcast(chosen), "page_id").filter(F.xxhash64("page_id", "html") == F.col("h")).orderBy("h").limit(sample).collect()
    real = [b for b in (blocks_of(r.html) for r in rows) if b]
    labels = [np.array([named_label(b) for b in page], np.float32) for page in real]
    texts = [b.text for page in real for b in page if len(b.text) > 20] or ["Some text."]
    rng = np.random.default_rng(seed)
    for _ in range(3 * max(100, len(real))):
        page = blocks_of(made_up_page(rng, texts))
        labels.append(np.array([HELD in b.text for b in page], np.float32))
        for b in page:
            b.text = b.text.replace(HELD, "") or "x"
        real.append(page)
    vectors = Vectors()
    model = Lstm(seed)
    model.fit([vectors.of([page]) for page in real], labels)
    return model


def main_text(pages: DataFrame, model: Lstm) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some 30,000 floats

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for whole in batches:
            begin, found = 0, []
            for row, page in enumerate(whole.column(2), 1):
                found.append(blocks_of(page.as_py()))
                if row < whole.num_rows and len(found) < 256 and sum(map(len, found)) < GROUP_BLOCKS:
                    continue
                batch, begin = whole.slice(begin, len(found)), row
                on = shared.value.label_pages(found, vectors)
                texts = ["\n".join(b.text for b, yes in zip(page, marks, strict=True) if yes) for page, marks in zip(found, on, strict=True)]
                found = []
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return only(pages, "page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
