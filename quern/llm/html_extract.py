"""Main text of web pages by a recurrent block labeller.

A page is parsed into leaf blocks in page order. Each block becomes a vector: its path of tags
and class, id and role words, hashed and fading with distance from the leaf; its words, hashed;
and a few ratios. A bidirectional LSTM in numpy reads the whole page's blocks and labels each;
the text of blocks labelled main is the result.

The labeller is fitted when the query runs, on at most SAMPLE pages of the table (those with the
smallest hashes of their ids, of at most SAMPLE_BYTES) whose elements mark their article, labelled
by these elements and never by class names (what a name within the article might say is left out),
and on MADE pages put together from the sample's paragraphs with menus, notices, forms, comments
and so on in varied markup, whose labels are known. That bounded sample is all the driver sees.

Scale: one pass over the pages, no shuffle; a batch of pages is in memory at a time.
"""

from __future__ import annotations

import html as html_
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, lowest

#: What the labeller is fitted on: at most so many pages of the table, of at most so many bytes and blocks each, and so many made pages.
SAMPLE, SAMPLE_BYTES, SAMPLE_BLOCKS, MADE = 200, 100_000, 400, 500
#: Made pages draw their paragraphs from at most so many of the sample's, and their words from the first so many of each.
MADE_PARAGRAPHS, MADE_WORDS = 2000, 40
PATH, WORDS, MORE = 96, 24, 8
WIDTH = PATH + WORDS + MORE
HIDDEN = 16
FADE = 0.8

# fixed values: elements of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr output picture q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr"
    " audio canvas object video math mfrac mi mmultiscripts mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
DROPPED = set("script style noscript template title iframe svg annotation annotation-xml".split())
RAW = set("script style title iframe noscript template".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# a quote opens a value only right after the equals sign; one that is never closed doesn't swallow what follows the tag
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>?""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "linked", "main")

    def __init__(self, path: list[tuple[int, ...]], text: str, linked: int, main: int):
        self.path, self.text, self.linked, self.main = path, text, linked, main


def _slot(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind}{name}".encode()) % PATH


_known: dict[tuple[str, str], tuple] = {}


def _element(tag: str, attributes: str) -> tuple:
    """Tag, hashed slots, class, id and role words."""
    key = (tag, attributes)
    if key not in _known:
        if len(_known) > 20_000:
            _known.clear()
        names = {p for m in _NAMES.finditer(attributes) for p in _PART.findall((m[1] or m[2] or m[3] or "").lower())}
        _known[key] = (tag, (_slot("<", tag), *(_slot(".", n) for n in sorted(names))), names)
    return _known[key]


# fixed values: elements that hold no article text
_ASIDE_TAGS = set("nav header footer aside form button select textarea menu dialog".split())


def _mark(stack: list[tuple]) -> int:
    """1 where the page's elements say article, 0 where they say something else, -1 where a name within the article might."""
    inside = 0
    for tag, _, names in stack:
        if tag in _ASIDE_TAGS and not (tag == "header" and inside):
            return 0
        if tag in ("article", "main") and not inside:
            inside = -1 if names else 1
        elif names and inside:
            inside = -1
    return inside


def parse(page: str, marks: bool = False) -> list[Block]:
    """The page's leaf blocks that hold text: character references decoded, white space turned into one space."""
    out: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    state = {"path": None, "linked": 0, "main": -1, "links": 0}

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(state["path"], text, state["linked"], state["main"]))
            parts.clear()
        state["path"], state["linked"] = None, 0

    def say(raw: str) -> None:
        if "&" in raw:
            raw = html_.unescape(raw)
        if state["path"] is None:
            if not raw.strip():
                return
            state["path"] = [slots for _, slots, _ in stack]
            state["main"] = _mark(stack) if marks else -1
        parts.append(raw)
        if state["links"]:
            state["linked"] += len(raw)

    def leave(depth: int) -> None:
        for tag, _, _ in stack[depth:]:
            if tag == "a":
                state["links"] -= 1
            if tag not in INLINE:
                flush()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                say(" ")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag == "head":
            flush()
            continue
        if tag in DROPPED:  # it leaves the block around it whole
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = close.end() if close else (end if tag in RAW else at)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or stack[depth][0] in CLOSED_BY.get(tag, ()):
                    leave(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if tag in VOID:
            continue
        if m[3].endswith("/") and tag not in INLINE:
            continue
        stack.append(_element(tag, m[3]))
        state["links"] += tag == "a"
    leave(0)
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for i, b in enumerate(blocks):
        weight = 1.0
        for slots in reversed(b.path):
            for s in slots:
                x[i, s] += weight
            weight *= FADE
            if weight < 0.01:
                break
    raw = np.frombuffer(" ".join(b.text for b in blocks).encode(), np.uint8)
    sizes = np.array([len(b.text.encode()) for b in blocks])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    hashes, at = hash_words(raw)
    owner = np.searchsorted(starts, at, side="right") - 1
    slot = (hashes >> np.uint64(20)).astype(np.int64) % WORDS
    sign = np.where(hashes & np.uint64(1), 1.0, -1.0)
    words = np.bincount(owner, minlength=len(blocks))
    bag = np.bincount(owner * WORDS + slot, weights=sign, minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = bag / np.sqrt(np.maximum(words, 1))[:, None]
    stops = np.bincount(owner, weights=np.isin(raw[np.maximum(np.append(at[1:], len(raw) + 1) - 2, 0)], list(b".,;:!?")), minlength=len(blocks))
    more = x[:, PATH + WORDS :]
    more[:, 0] = np.log1p(words) / 3
    more[:, 1] = [min(b.linked / max(len(b.text), 1), 1.0) for b in blocks]
    more[:, 2] = stops / np.maximum(words, 1) * 4
    more[:, 3] = words > 12
    more[:, 4] = np.arange(len(blocks)) / max(len(blocks) - 1, 1)
    more[:, 5] = [b.text[:1].isupper() for b in blocks]
    more[:, 6] = [b.text[-1:] in ".!?\"”" for b in blocks]
    more[:, 7] = 1.0
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logit per block; weights in self.w."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w |= {f"w{d}": init(width, 4 * hidden), f"u{d}": init(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.w[f"c{d}"][hidden : 2 * hidden] = 1.0
        self.w |= {"o": init(2 * hidden, 1), "p": np.zeros(1, np.float32)}

    def _run(self, z: np.ndarray, mask: np.ndarray, u: np.ndarray):
        """States of one direction: z (T, B, 4H) holds the inputs' part."""
        steps, size, _ = z.shape
        n = self.hidden
        h, c = np.zeros((size, n), np.float32), np.zeros((size, n), np.float32)
        kept = []
        for t in range(steps):
            g = z[t] + h @ u
            s = _sigmoid(g[:, : 3 * n])
            i, f, o, a = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
            new = f * c + i * a
            m = mask[t][:, None]
            squashed = np.tanh(new)
            kept.append((h, c, i, f, o, a, squashed, m))
            h, c = np.where(m, o * squashed, h), np.where(m, new, c)
            z[t, :, :n] = h
        return z[:, :, :n], kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        zf, zb = x @ self.w["wf"] + self.w["cf"], x[::-1] @ self.w["wb"] + self.w["cb"]
        hf, kf = self._run(zf, mask, self.w["uf"])
        hb, kb = self._run(zb, mask[::-1], self.w["ub"])
        h = np.concatenate([hf, hb[::-1]], axis=2)
        return (h @ self.w["o"])[:, :, 0] + self.w["p"][0], (h, kf, kb)

    def _back(self, d: str, dh_out: np.ndarray, kept, x: np.ndarray, grads: dict) -> None:
        n, u = self.hidden, self.w[f"u{d}"]
        dh, dc = np.zeros(dh_out.shape[1:], np.float32), np.zeros(dh_out.shape[1:], np.float32)
        du, dw, db = np.zeros_like(u), np.zeros_like(self.w[f"w{d}"]), np.zeros(4 * n, np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h0, c0, i, f, o, a, squashed, m = kept[t]
            total = dh + dh_out[t]
            dnew = np.where(m, dc + total * o * (1 - squashed**2), 0)
            do = np.where(m, total * squashed, 0)
            g = np.concatenate([dnew * a * i * (1 - i), dnew * c0 * f * (1 - f), do * o * (1 - o), dnew * i * (1 - a**2)], axis=1)
            du += h0.T @ g
            dw += x[t].T @ g
            db += g.sum(0)
            dh, dc = g @ u.T + np.where(m, 0, total), np.where(m, dnew * f, dc)
        grads[f"u{d}"], grads[f"w{d}"], grads[f"c{d}"] = du, dw, db

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean logistic loss over the blocks with y >= 0, and its gradients."""
        logit, (h, kf, kb) = self.forward(x, mask)
        known = mask & (y >= 0)
        n = max(int(known.sum()), 1)
        p = _sigmoid(logit)
        loss = -float(np.where(known, np.log(np.where(y == 1, p, 1 - p) + 1e-9), 0).sum()) / n
        d = (np.where(known, p - y, 0) / n).astype(np.float32)[:, :, None]
        grads = {"o": np.tensordot(h, d, ((0, 1), (0, 1))), "p": d.sum((0, 1))}
        dh = d @ self.w["o"].T
        self._back("f", dh[:, :, : self.hidden], kf, x, grads)
        self._back("b", dh[::-1, :, self.hidden :], kb, x[::-1], grads)
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.01, size: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        pages = sorted(pages, key=lambda p: len(p[1]))
        batches = [pages[i : i + size] for i in range(0, len(pages), size)]
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                x, mask = pad([p[0] for p in batches[k]])
                y, _ = pad([p[1][:, None] for p in batches[k]])
                x *= rng.random((1, x.shape[1], WIDTH)) > 0.1  # a slot at times hidden: no single name decides
                _, grads = self.gradients(x, mask, y[:, :, 0])
                step += 1
                for name, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)

    def label(self, pages: list[np.ndarray], size: int = 128) -> list[np.ndarray]:
        """For each page's vectors: which blocks are main."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < size and len(pages[order[to]]) * (to - at) < 20_000:
                to += 1
            x, mask = pad([pages[i] for i in order[at:to]])
            logit, _ = self.forward(x, mask)
            for j, i in enumerate(order[at:to]):
                out[i] = logit[: len(pages[i]), j] >= 0
            at = to
        return out


def pad(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(a) for a in arrays)
    out, mask = np.zeros((steps, len(arrays), arrays[0].shape[1]), np.float32), np.zeros((steps, len(arrays)), bool)
    for j, a in enumerate(arrays):
        out[: len(a), j], mask[: len(a), j] = a, True
    return out, mask


# fixed values: names for the parts of made pages
_MENUS = ("nav", 'ul class="menu"', 'div class="navigation"', 'div id="nav"', 'div role="navigation"', "header", 'ol class="breadcrumb"')
_HEADERS = ("header", 'div class="header"', 'div id="masthead"', 'div role="banner"')
_SIDES = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'section class="related"', 'div class="widget"', 'div class="promo"')
_NOTICES = ('div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="popup"', 'p class="notice"', 'div class="newsletter"', 'div role="alert"')
_ADVERTS = ('div class="ad"', 'div class="advert"', 'div class="sponsored"', 'div id="ad-1"', 'ins class="ads"', 'section class="advertisement"')
_FORMS = ("form", 'form class="search"', 'form id="login"', 'form class="signup"', 'form action="/subscribe"')
_COMMENTS = ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="discussion"', 'div id="disqus"', 'section class="replies"')
_FOOTERS = ("footer", 'div class="footer"', 'div id="footer"', 'div role="contentinfo"')
_ARTICLES = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'section class="article-body"', 'div class="entry"', 'div itemprop="articleBody"', "div", 'td class="body"')


def made_pages(paragraphs: list[str], n: int, seed: int = 11) -> list[list[Block]]:
    """Pages with known labels, put together from paragraphs; the parser gives their blocks.

    Every text is made with a private-use character in front that says whether it is main.
    """
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    words = [w for p in paragraphs for w in p.split()[:MADE_WORDS]] or ["word"]
    paragraphs = paragraphs or ["A few words."]
    marks = ("\ue000", "\ue001")
    is_main = 0

    def some(low: int, high: int) -> str:
        return marks[is_main] + " ".join(pick(words) for _ in range(rng.integers(low, high)))

    def para(low: int = 4, high: int = 60) -> str:
        return marks[is_main] + pick(paragraphs) if rng.random() < 0.6 else some(low, high) + "."

    def wrap(opening: str, body: str) -> str:
        return f"<{opening}>{body}</{opening.split()[0]}>"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{some(1, 4)}</a></li>' if rng.random() < 0.8 else f'<a href="/x">{some(1, 3)}</a> ' for _ in range(n))

    def comment() -> str:
        return wrap(pick(("div class='comment'", "li", "article class='comment'")), f"<b>{some(1, 3)}</b> <p>{para()}</p>")

    def other(kind: str) -> str:
        nonlocal is_main
        is_main = 0
        often = rng.random() < 0.6
        if kind == "menu":
            return wrap(pick(_MENUS), f"<ul>{links(rng.integers(2, 9))}</ul>")
        if kind == "header":
            return wrap(pick(_HEADERS), f"<h1>{some(1, 5)}</h1><p>{some(2, 9)}</p>" if often else some(1, 8))
        if kind == "side":
            return wrap(pick(_SIDES), f"<h3>{some(1, 4)}</h3>" + (f"<ul>{links(rng.integers(2, 6))}</ul>" if often else f"<p>{para()}</p>"))
        if kind == "notice":
            return wrap(pick(_NOTICES), f"{some(4, 25)} <button>{some(1, 3)}</button>" if often else f"<span>{some(4, 20)}</span>")
        if kind == "advert":
            return wrap(pick(_ADVERTS), some(3, 15) + "." if often else f"<p>{para()}</p>")
        if kind == "form":
            return wrap(pick(_FORMS), f"<label>{some(1, 4)}</label><input name=q><p>{some(1, 10)}</p><select><option>{some(1, 2)}</option></select><button>{some(1, 3)}</button>")
        if kind == "comments":
            return wrap(pick(_COMMENTS), f"<h3>{some(1, 3)}</h3>" + "".join(comment() for _ in range(rng.integers(1, 5))))
        return wrap(pick(_FOOTERS), f"&copy; {some(1, 4)} &middot; {some(3, 14)}" if often else f"<p>{some(2, 12)}</p><ul>{links(rng.integers(1, 5))}</ul>")

    def body() -> str:
        nonlocal is_main
        is_main = 1
        out = [f"<h1>{some(3, 12)}</h1>"] if rng.random() < 0.8 else []
        for r in rng.random(rng.integers(1, 12)):
            if r < 0.6:
                out.append(f"<p>{para()}</p>")
            elif r < 0.75:
                out.append(f"<p><b>{para()}<br>")
            elif r < 0.82:
                out.append(f"<h2>{some(1, 8)}</h2>")
            elif r < 0.88:
                out.append("<ul>" + "".join(f"<li>{some(2, 20)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif r < 0.92:
                out.append(f"<blockquote>{para()}</blockquote>")
            elif r < 0.96:
                out.append(f"<div>{para()}</div>")
            else:
                out.append(f"<table><tr><td>{some(1, 5)}</td><td>{some(1, 5)}</td></tr></table>")
        return "".join(out)

    pages = []
    for _ in range(n):
        before = [other(k) for k in rng.permutation(["menu", "header", "notice", "advert", "side", "form"]) if rng.random() < 0.5]
        after = [other(k) for k in ("side", "advert", "comments", "form", "notice", "menu") if rng.random() < 0.4]
        after += [other("footer")] if rng.random() < 0.9 else []
        article = body()
        if rng.random() < 0.4:  # something else within the article, at times more of it behind
            article += other(pick(("advert", "side", "notice", "form", "comments"))) + (body() if rng.random() < 0.5 else "")
        inside = "".join(before) + wrap(pick(_ARTICLES) if rng.random() < 0.6 else "article", article) + "".join(after)
        blocks = parse(wrap(pick(("body", 'div class="wrapper"', 'div id="page"')), inside))
        for b in blocks:
            b.main = int(marks[1] in b.text)
            b.text = b.text.replace(marks[0], "").replace(marks[1], "").strip() or "."
        pages.append(blocks)
    return pages


def train_labeller(pages: list[str], made: int = MADE) -> Labeller:
    """Fitted on given pages that mark their article, and on made ones."""
    parsed = [parse(p, marks=True) for p in pages]
    marked = [p for p in parsed if any(b.main == 1 for b in p)]
    paragraphs = [b.text for p in parsed for b in p if b.main == 1 and b.path]
    known = [p for p in marked if len(p) <= SAMPLE_BLOCKS] + [p for p in made_pages(paragraphs[:MADE_PARAGRAPHS], made) if p]
    labeller = Labeller()
    labeller.fit([(features(p), np.array([b.main for b in p], np.float32)) for p in known])
    return labeller


def extract_main(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), order: str = "page_id", sample: int = SAMPLE) -> DataFrame:
    """The columns in keep, text and n_chars (its code points) of each row of pages.

    Null and blank pages give empty text; repeated rows give as many rows. Broken markup is read
    as far as it goes: a tag without an end, an unclosed element or a stray end tag loses no text.
    """
    spark = pages.sparkSession
    h = F.xxhash64(F.col(order))
    some = pages.where(lowest(h, pages.count(), sample) & (F.octet_length(html) <= SAMPLE_BYTES))
    chosen = some.select(h.alias("h"), F.xxhash64(html).alias("g"), F.col(html).alias("html")).dropDuplicates(["h", "g"]).orderBy("h", "g").limit(sample)
    labeller = train_labeller([r["html"] for r in chosen.collect()])  # at most `sample` pages of SAMPLE_BYTES
    shared = spark.sparkContext.broadcast(labeller)
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars long"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                parsed = [parse(p or "") for p in part.column(len(keep)).to_pylist()]
                marks = shared.value.label([features(p) if p else np.empty((0, WIDTH), np.float32) for p in parsed])
                texts = ["\n".join(b.text for b, m in zip(p, own) if m) for p, own in zip(parsed, marks)]
                arrays = [part.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, schema)
