"""Main text of HTML pages by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags. A block is read as two hashed vectors (the
names, classes and ids on its whole tag path; its words) and a few numbers. A bidirectional LSTM in numpy reads
the blocks of the whole page in order and labels each as article or not; the article blocks are the text.

The network is trained here, on the driver, on a bounded sample of pages (``SAMPLE`` pages of at most
``SAMPLE_BYTES`` bytes) whose markup says which blocks are article, and on the same blocks dealt into other
page layouts. Scale: pages are labelled where they are read, nothing is shuffled; the weights (some 100 kB)
go to the tasks. A page of any length is labelled whole; work and memory are linear in it, however its tags nest
and whether they end or not.
"""

from __future__ import annotations

import functools
import html as entities
import logging
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, schema_with, thinned

LOG = logging.getLogger(__name__)

SAMPLE = 160
SAMPLE_BYTES = 40_000
PATH_SIZE, WORD_SIZE, NUMBERS = 256, 32, 4
HIDDEN = 20

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
RAW = "script|style"
UNSEEN = frozenset("head title noscript template iframe object svg canvas".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements whose end tag may be omitted: what a start tag closes, up to the next of STOPS, or in cells up to the table.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
STOPS = (CLOSES_P - {"address", "div", "p"}) | UNSEEN | frozenset("html body li dt dd option optgroup select datalist button td th tr tbody thead tfoot caption".split())
CELLS = ("td", "th", "caption", "colgroup")
CLOSES_CELLS = {"td": CELLS, "th": CELLS, "tr": ("tr", *CELLS)} | dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", *CELLS))

#: What stands at a place of a page; where the attributes of a tag end is for ``Tags`` to say.
TOKEN = re.compile(rf"<!--(?:.*?-->|.*)|<(?:{RAW})(?=[\s/>])(?P<raw>)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)|<[!?/][^>]*+>|(?P<text>[^<]++|<)", re.DOTALL | re.IGNORECASE)
PLAIN = re.compile("[^>\"']*+")
OPEN = re.compile(rf"<!--|<(?:{RAW})(?=[\s/>])", re.IGNORECASE)
LOOSE = re.compile("<[^<]*+")
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")

#: What weak labels take for something other than the article, as elements and as parts of class names and ids.
OTHER_ELEMENTS = frozenset("nav aside footer header form menu button select dialog".split())
OTHER_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer header login menu nav navigation newsletter notice popup promo related replies reply share sharing sidebar signup social sponsor sponsored subscribe widget".split())


@functools.lru_cache(maxsize=1 << 14)
def traits(element: str) -> tuple[int, bool, bool]:
    """Of an element: a bit for each of its hashed parts, whether it is an article's, whether it is something other."""
    name, *words = element.split(".")
    mask = 0
    for part in filter(None, (name, *words)):
        mask |= 1 << bucket(part, PATH_SIZE)
    return mask, name in ("article", "main"), name in OTHER_ELEMENTS or not OTHER_NAMES.isdisjoint(words)


class Place:
    """The end of a tag path: an element like ``div.ad`` (a name and the words of class, id and role) under another place.

    Paths share what they have in common, so a block costs the same however deep it stands, and equal paths are one place.
    """

    __slots__ = ("element", "inside", "mask", "other", "over", "under")

    def __init__(self, element: str, over: Place | None):
        self.element, self.over = element, over
        self.mask, self.inside, self.other = traits(element)
        if over is not None:
            self.mask |= over.mask
            self.inside |= over.inside
            self.other |= over.other
        self.under: dict[str, Place] | None = None

    def place(self, element: str) -> Place:
        """The place of an element under this one."""
        if self.under is None:
            self.under = {}
        if (found := self.under.get(element)) is None:
            found = self.under[element] = Place(element, self)
        return found

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at is not None and at.over is not None:
            out.append(at.element)
            at = at.over
        return tuple(reversed(out))


def place_of(path: Sequence[str]) -> Place:
    at = Place("", None)
    for element in path:
        at = at.place(element)
    return at


class Tags:
    """Where the tags of a page end: at the first > outside quotes. Attempts that failed are not walked again.

    Two attempts that reach the same > or quote outside quotes go on alike, so it is enough to note where one that
    failed has been; at any place there are three ways to go on at most (outside, in either kind of quotes).
    """

    def __init__(self, page: str):
        self.page, self.lost, self.seen = page, set(), (0, -1)

    def end(self, at: int) -> int:
        """The place after the > of a tag whose attributes begin at a place; -1 if it never ends. Places are asked in rising order."""
        page, been = self.page, []
        while True:
            if self.seen[0] <= at <= self.seen[1]:
                stop = self.seen[1]
            else:
                stop = PLAIN.match(page, at).end()
                if not been:
                    self.seen = (at, stop)
            if stop in self.lost:
                break
            been.append(stop)
            if stop == len(page):
                break
            if page[stop] == ">":
                return stop + 1
            at = page.find(page[stop], stop + 1) + 1
            if not at:
                break
        self.lost.update(been)
        return -1


def blocks(page: str | None) -> list[tuple[Place, str, int]]:
    """(place, text, characters of it in links) of each block with text, in page order.

    Content of scripts,
    styles, the head and the like is no text. The head ends at its end tag, at the body, or at the first thing
    that may not stand in it; the text of another hidden element is dropped when its end tag comes, so one that
    never ends hides nothing. Character references are decoded, white space becomes one space.
    """
    page = page or ""
    path: list[Place] = [place_of(())]  # one more than names
    names: list[str] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where on the path the open elements of a name are
    solid: list[int] = []  # places of elements that are not inline
    stops: list[int] = []  # places of elements that an omitted end tag does not reach over
    hidden: list[tuple[int, int, list[str], int]] = []  # place, and what there was before the element
    out, text, linked = [], [], 0

    def close() -> None:
        nonlocal text, linked
        if text and (plain := " ".join("".join(text).split())):
            out.append((path[-1], plain, min(linked, len(plain))))
        text, linked = [], 0  # another list: the one before may have to come back

    def cut(to: int, ended: bool = False) -> None:
        """Take the elements from a place on off the path; ``ended``: the one there has ended, so what it hides goes."""
        nonlocal text, linked
        for name in names[to:]:
            places[name].pop()
        del names[to:], path[to + 1 :]
        for kind in (solid, stops):
            while kind and kind[-1] >= to:
                kind.pop()
        while hidden and hidden[-1][0] >= to:
            place, n, before, count = hidden.pop()
            if ended and place == to:
                del out[n:]
                text, linked = before, count

    def add(raw: str) -> None:
        nonlocal linked
        plain = entities.unescape(raw)
        if names and names[-1] == "head" and plain.strip():
            cut(len(names) - 1, True)
        text.append(plain)
        if places["a"]:
            linked += len(plain)

    at, tags, last = 0, Tags(page), page.rfind(">")
    while at < len(page):
        if at > last:  # no further tag ends
            m = OPEN.search(page, at)
            add(page[at : m.start() if m else len(page)])
            break
        m = TOKEN.match(page, at)
        end = tags.end(m.end()) if m and m["name"] is not None else m.end() if m else -1
        if end < 0 and m and m["end"]:
            at = page.find(">", at) + 1
            continue
        if end < 0:  # a tag that never ends is text
            m = LOOSE.match(page, at)
            add(m[0])
            at = m.end()
            continue
        at = end
        if m["text"] is not None:
            add(m["text"])
        elif m["raw"] is not None:
            name = re.match(r"<(\w+)", m[0])[1]
            ends = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = page.find(">", ends.end()) + 1 if ends else 0
            at = at or len(page)
        elif m["name"] is not None:
            name, attrs = m["name"].lower(), page[m.end() : at - 1]
            empty = name in VOID or attrs.rstrip().endswith("/")
            if name in UNSEEN and not m["end"]:
                if empty:
                    continue
                before = len(out), text, linked
            if name not in INLINE:
                close()
            if m["end"]:
                if places[name] and not (name in INLINE and solid and solid[-1] > places[name][-1]):  # an inline end does not close blocks
                    cut(places[name][-1], True)
                continue
            if places["head"] and (name == "body" or (names[-1] == "head" and name not in IN_HEAD)):
                cut(places["head"][-1], True)
            if name in CLOSES_P and solid and names[solid[-1]] == "p":
                cut(solid[-1])
            if name in CLOSES:
                while stops and names[stops[-1]] in CLOSES[name]:
                    cut(stops[-1])
            elif name in CLOSES_CELLS:
                table = places["table"][-1] if places["table"] else -1
                for other in CLOSES_CELLS[name]:
                    while places[other] and places[other][-1] > table:
                        cut(places[other][-1])
            if not empty:
                words = NAME.findall(" ".join(x or y or z for x, y, z in ATTRIBUTE.findall(attrs)).lower()) if attrs else []
                place = len(names)
                path.append(path[-1].place(".".join([name, *words])))
                names.append(name)
                places[name].append(place)
                if name not in INLINE:
                    solid.append(place)
                if name in STOPS:
                    stops.append(place)
                if name in UNSEEN:
                    hidden.append((place, *before))
    close()
    return out


def weak_labels(found: list[tuple[Place, str, int]]) -> list[int] | None:
    """1 for blocks that the markup places in the article; None if it names none."""
    out = [int(place.inside and not place.other) for place, _, _ in found]
    return out if any(out) else None


def bucket(key: str, size: int) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % size


def features(found: list[tuple[Place, str, int]], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row a block: hashed tag path, hashed words (shares), length, share of links, words, place on the page. The blocks may be a part of a page: the first's number and that of all."""
    total = total or len(found)
    x = np.zeros((len(found), PATH_SIZE + WORD_SIZE + NUMBERS), np.float32)
    masks = np.frombuffer(b"".join(place.mask.to_bytes(PATH_SIZE // 8, "little") for place, _, _ in found), np.uint8)
    x[:, :PATH_SIZE] = np.unpackbits(masks.reshape(-1, PATH_SIZE // 8), axis=1, bitorder="little")
    for k, (_, text, linked) in enumerate(found):
        words = text.split()
        got = [bucket(w, WORD_SIZE) for w in words]
        x[k, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount(got, minlength=WORD_SIZE) / len(words)
        x[k, -NUMBERS:] = np.log1p(len(text)) / 8, linked / len(text), np.log1p(len(words)) / 6, (first + k) / total
    return x


class Labeller:
    """A bidirectional LSTM with one logistic output a block."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN, size: int = PATH_SIZE + WORD_SIZE + NUMBERS):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"out": rng.standard_normal((2 * hidden, 1)).astype(np.float32) * 0.1, "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p[f"x{side}"] = rng.standard_normal((size, 4 * hidden)).astype(np.float32) * 0.15
            self.p[f"h{side}"] = rng.standard_normal((hidden, 4 * hidden)).astype(np.float32) * 0.15
            self.p[f"c{side}"] = np.repeat(np.float32([0, 1, 0, 0]), hidden)

    @staticmethod
    def gates(z: np.ndarray, h: int) -> tuple[np.ndarray, ...]:
        s = 0.5 * (np.tanh(0.5 * z[:, : 3 * h]) + 1)
        return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, tape: list | None = None, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """States (pages, blocks, hidden) of one direction, and the last state and cell; padding passes the state on. What training needs goes onto the tape."""
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        z = (x.reshape(n * steps, -1) @ self.p[f"x{side}"]).reshape(n, steps, 4 * h) + self.p[f"c{side}"]
        state, cell = start or (np.zeros((n, h), np.float32), np.zeros((n, h), np.float32))
        out = np.zeros((n, steps, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            i, f, o, g = self.gates(z[:, t] + state @ self.p[f"h{side}"], h)
            m = mask[:, t, None]
            fresh = f * cell + i * g
            c = m * fresh + (1 - m) * cell
            tc = np.tanh(c)
            new = m * (o * tc) + (1 - m) * state
            if tape is not None:
                tape.append((t, i, f, o, g, cell, tc, state, m))
            state, cell = new, c
            out[:, t] = state
        return out, (state, cell)

    def forward(self, x: np.ndarray, mask: np.ndarray, tapes: tuple[list | None, list | None] = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self.run(x, mask, side, tape)[0] for side, tape in zip("fb", tapes, strict=True)], axis=2)
        return 1 / (1 + np.exp(-np.clip((both @ self.p["out"])[..., 0] + self.p["bias"], -30, 30))), both

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tapes: tuple[list, list] = ([], [])
        got, both = self.forward(x, mask, tapes)
        d = ((got - y) * mask / mask.sum()).astype(np.float32)
        out = {"out": (both * d[..., None]).sum(axis=(0, 1))[:, None], "bias": np.array([d.sum()], np.float32)}
        h = self.hidden
        for side, tape, lo in zip("fb", tapes, (0, h), strict=True):
            dz_all = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
            dh = np.zeros((x.shape[0], h), np.float32)
            dc, whh = np.zeros_like(dh), np.zeros_like(self.p[f"h{side}"])
            for t, i, f, o, g, before, tc, state, m in reversed(tape):
                total = dh + d[:, t, None] * self.p["out"][lo : lo + h, 0]
                dnew = total * m
                dcell = dc + dnew * o * (1 - tc * tc)
                live = dcell * m
                dz = np.concatenate([live * g * i * (1 - i), live * before * f * (1 - f), dnew * tc * o * (1 - o), live * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                whh += state.T @ dz
                dh = dz @ self.p[f"h{side}"].T + total * (1 - m)
                dc = live * f + dcell * (1 - m)
            flat = dz_all.reshape(-1, 4 * h)
            out |= {f"x{side}": x.reshape(len(flat), -1).T @ flat, f"h{side}": whh, f"c{side}": flat.sum(axis=0)}
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.01, size: int = 24, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda k: len(pages[k][0]))
            groups = [order[k : k + size] for k in range(0, len(order), size)]
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[j][0] for j in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for row, j in enumerate(groups[k]):
                    y[row, : len(pages[j][1])] = pages[j][1]
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] = (self.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def label(self, pages: list[list[tuple[Place, str, int]]], cells: int = 1 << 15, long: int = 1 << 12) -> list[np.ndarray]:
        """True for article blocks, of the blocks of each page. Pages of like length are padded together, ``cells`` blocks at a time; one of more than ``long`` blocks is read in parts."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            if len(pages[order[at]]) > long:
                out[order[at]] = self.label_long(pages[order[at]], long)
                at += 1
                continue
            to = at + 1
            while to < len(order) and len(pages[order[to]]) <= long and (to + 1 - at) * len(pages[order[to]]) <= cells:
                to += 1
            got, _ = self.forward(*padded([features(pages[k]) for k in order[at:to]]))
            for row, k in enumerate(order[at:to]):
                out[k] = got[row, : len(pages[k])] >= 0.5
            at = to
        return out

    def label_long(self, page: list[tuple[Place, str, int]], part: int) -> np.ndarray:
        """label() of one page, ``part`` blocks at a time in either direction: states are carried over, and of a block one number a direction is kept."""
        score = np.full(len(page), self.p["bias"][0], np.float32)
        for side, weights in zip("fb", np.split(self.p["out"], 2), strict=True):
            state = None
            cuts = range(0, len(page), part)
            for lo in cuts if side == "f" else reversed(cuts):
                x = features(page[lo : lo + part], lo, len(page))[None]
                states, state = self.run(x, np.ones(x.shape[:2], np.float32), side, start=state)
                score[lo : lo + part] += (states[0] @ weights)[:, 0]
        return score >= 0


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for k, page in enumerate(pages):
        x[k, : len(page)] = page
        mask[k, : len(page)] = 1
    return x, mask


# Layouts for further training pages: (path, weight) of what may stand around an article, and paths of articles.
AROUND = ("nav.ul.li.a", "nav div.a", "header h1", "header p", "div.ad", "div.advert p", "aside p", "aside ul li a", "div.sidebar p", "div.cookie.notice p", "div.notice p", "form label", "form button", "div.newsletter form p", "section.comments p", "div.comment p", "div.comments article p", "div.related ul li a", "div.share a", "ul.menu li a", "div.breadcrumb a", "footer p", "footer div", "footer")
ARTICLES = ("article p", "article section p", "main p", "main article p", "main div p", "div.content p", "div.post.body p", "div.article p", "article div.entry p", "div.main p")


def other_layouts() -> list[str]:
    """Paths of what is no article: the list above, and the elements and names that weak labels know."""
    inner = ("p", "a", "ul li", "div", "span")
    named = [f"div.{name} {inner[k % 5]}" for k, name in enumerate(sorted(OTHER_NAMES))] + [f"section.{name} {inner[(k + 2) % 5]}" for k, name in enumerate(sorted(OTHER_NAMES))]
    return [*AROUND, *named, *(f"{name} {x}" for name in sorted(OTHER_ELEMENTS) for x in inner)]


def relaid(found: list[tuple[Place, str, int]], labels: list[int], rng: random.Random, articles: Sequence[str] = ARTICLES, around_paths: Sequence[str] | None = None) -> tuple[list, list[int]]:
    """The blocks of a page in another layout: its article under another path, other blocks before, within and after."""
    around_paths = around_paths or (AROUND if rng.random() < 0.5 else other_layouts())
    kind = rng.choice(articles).split()
    body = [b for b, y in zip(found, labels, strict=True) if y]
    rest = [b[1] for b, y in zip(found, labels, strict=True) if not y] or ["..."]
    words = [w for t in rest for w in t.split()]

    def around(n: int, under: tuple[str, ...] = ()) -> list:
        out = []
        for _ in range(n):
            path = rng.choice(around_paths).replace(".ul.li.a", " ul li a").replace("div.a", "div a").split()
            long = path[-1] == "p" and rng.random() < 0.5
            text = rng.choice(body)[1] if long else " ".join(rng.choices(words, k=rng.randint(1, 8)))
            for _ in range(rng.randint(1, 4)):
                out.append((place_of(("html", "body", *under, *path)), text, len(text) if path[-1] == "a" else 0))
        return out

    out, marks = around(rng.randint(1, 4)), []
    marks += [0] * len(out)
    inner = rng.randint(0, len(body)) if rng.random() < 0.3 else -1
    for k, (place, text, linked) in enumerate(body):
        if k == inner:
            extra = around(1, ("article",))
            out += extra
            marks += [0] * len(extra)
        last = place.element if place.element.split(".")[0] in ("h1", "h2", "h3", "li", "b", "blockquote", "pre", "td") else kind[-1]
        out.append((place_of(("html", "body", *kind[:-1], last)), text, linked))
        marks.append(1)
    after = around(rng.randint(1, 4))
    return out + after, marks + [0] * len(after)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Train on a bounded sample of pages (page_id, html): those with the smallest hashes, without pages of more than SAMPLE_BYTES bytes."""
    short = pages.select("page_id", "html").filter(F.octet_length("html").between(1, SAMPLE_BYTES))  # first: the share is of those that may be taken
    rows = thinned(short, ["page_id"], sample).orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()
    rng, made = random.Random(9), []
    for row in rows:
        found = blocks(row.html)
        labels = weak_labels(found)
        if labels is not None:
            for page, marks in [(found, labels), (found, labels), *(relaid(found, labels, rng) for _ in range(4))]:
                made.append((features(page), np.array(marks, np.float32)))
    if not made:  # no page says what its article is: train on layouts of invented blocks
        LOG.warning("none of %d training pages says what its article is: training on invented blocks", len(rows))
        for k in range(sample):
            body = [(place_of(("article", "p")), " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(5, 60))), 0) for _ in range(rng.randint(2, 12))]
            page, marks = relaid([*body, (place_of(("nav",)), "menu home about", 0)], [1] * len(body) + [0], rng)
            made.append((features(page), np.array(marks, np.float32)))
    model = Labeller()
    model.fit(made)
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """pages with ``text`` instead of html: the article blocks, one space between; empty for null, empty and blockless pages. A column named text is replaced."""
    keep = [f for f in pages.schema if f.name not in ("html", "text")]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in parts(whole, "html", 2 << 20):
                found = [blocks(t) for t in batch.column("html").to_pylist()]
                marks = own.label(found)
                texts = [" ".join(b[1] for b, y in zip(x, mark, strict=True) if y) for x, mark in zip(found, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(texts, pa.string())], [*(f.name for f in keep), "text"])

    return pages.mapInArrow(run, schema_with(keep, "text string"))
