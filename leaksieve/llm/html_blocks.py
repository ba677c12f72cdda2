"""Main text of web pages: a recurrent labeller over their blocks.

A page is cut into blocks, the runs of text between block-level tags. Each has a
vector of its tag path (tags, classes and ids, hashed), its words (hashed) and a few
measures. A bidirectional LSTM in numpy reads the whole sequence of a page,
so that a block is judged by what stands around it, and a logistic unit keeps
or drops it.

There are no labels to learn from. The teacher is the markup that states its
purpose: blocks inside ``article`` or ``main`` against those inside ``nav``, ``footer``,
``aside``, ``form`` and the like. A sample of pages is learned as it is and again with its
blocks laid out anew at random, in containers that other sites use; so the
network learns names and positions that the sample itself doesn't have.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sent
from .words import Memory

#: Pages that are learned from at most, and characters of each.
SAMPLE_PAGES = 400
SAMPLE_CHARS = 60_000
LAYOUTS = 3
PATH_DIMS, WORD_DIMS, MEASURES = 48, 32, 7
INPUT = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
EPOCHS = 12
#: Blocks that the network reads in one batch of pages; a longer page is a batch of its own.
BATCH_BLOCKS = 8192

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Levels that a block's path has at most; tags that open below it hold no level of their own, as in browsers.
MAX_DEPTH = 512
#: What is between these is never text of the page.
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object".split())
CLOSED_BY = {
    "p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
#: Words of tags, classes and ids by which the teacher knows a block's purpose.
KEEP = frozenset("article main".split())
DROP = frozenset(
    "nav footer aside form header menu sidebar ad ads advert advertisement banner promo sponsor sponsored cookie cookies notice consent alert "
    "comment comments reply replies respondent breadcrumb breadcrumbs share social related newsletter subscribe login search widget popup modal "
    "copyright pagination pager toolbar navbar button select".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]{0,63}+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|[^<]+|<", re.DOTALL
)
_HEAD = re.compile(r"</?[a-zA-Z][^\s/>]{0,63}+")
_QUOTE_OR_END = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_PART = re.compile(r"[a-zA-Z]+")


_known_names, _known_paths = Memory(), Memory()


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    names = _known_names.get((tag, attributes))
    if names is None:
        parts = [part.lower() for found in _NAMED.findall(attributes) for part in _PART.findall("".join(found))]
        names = _known_names[tag, attributes] = (tag, *parts)
    return names


class _Ends:
    """Which tags of a page end, from one pass over its quotes and angle brackets: a tag that doesn't is not looked through again."""

    def __init__(self, page: str) -> None:
        self._marks = [found.start() for found in _QUOTE_OR_END.finditer(page)]
        self._ended = [False] * (len(self._marks) + 1)
        later: dict[str, int] = {}
        for k in range(len(self._marks) - 1, -1, -1):
            sign = page[self._marks[k]]
            # A quote ends where the next of its kind is, and what follows that decides.
            self._ended[k] = sign == ">" or sign in later and self._ended[later[sign] + 1]
            later[sign] = k

    def ended(self, attributes_at: int) -> bool:
        return self._ended[bisect_left(self._marks, attributes_at)]


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int = 0


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, white space run together, character references decoded; raw parts left out.

    Takes time in proportion to the page, whatever its markup: a ``<`` of a tag that never ends is text.
    """
    out: list[Block] = []
    # Of each open tag its names, and how many levels of the path lie outside of it.
    stack: list[tuple[str, tuple[str, ...], int]] = []
    path: list[tuple[str, ...]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked, at, links = 0, 0, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(tuple(path), joined, min(linked, len(joined))))
        text, linked = [], 0

    def close(first: int) -> None:
        nonlocal links
        for tag, _, outside in reversed(stack[first:]):
            opened[tag] -= 1
            links -= tag == "a"
            del path[outside:]
        del stack[first:]

    size, last = len(page), page.rfind(">")
    marks: _Ends | None = None
    while at < size:
        head = _HEAD.match(page, at) if marks or at > last else None
        unended = head and (at > last or not marks.ended(head.end())) or at > last and page.startswith(("<!", "<?"), at) and not page.startswith("<!--", at)
        found = None if unended else _TOKEN.match(page, at)
        at = at + 1 if unended else found.end()
        tag = None if unended else found.group(2)
        if tag is None:
            piece = "<" if unended else found.group()
            if piece == "<" and marks is None and at <= last:
                marks = _Ends(page)
            if piece[0] != "<" or len(piece) == 1:
                text.append(piece)
                if links:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if found.group(1):
            if tag in BLOCK_TAGS:
                flush()
            for i in range(len(stack) - 1 if opened[tag] else -1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in BLOCK_TAGS and tag not in BLOCK_TAGS:
                    break
            continue
        if tag in RAW_TAGS and not found.group(3).endswith("/"):
            if tag in BLOCK_TAGS:
                flush()
            shut = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = shut.end() if shut else size
            continue
        if tag in BLOCK_TAGS:
            flush()
            ends = CLOSED_BY.get(tag, frozenset({"p"}))
            while stack and (stack[-1][0] in ends or stack[-1][0] not in BLOCK_TAGS and any(name in ends for name, *_ in stack[-3:])):
                close(len(stack) - 1)
        elif tag == "br":
            text.append(" ")
        if tag not in VOID_TAGS and not found.group(3).endswith("/") and len(stack) < MAX_DEPTH:
            names = _names(tag, found.group(3))
            stack.append((tag, names, len(path)))
            opened[tag] += 1
            if tag in BLOCK_TAGS or len(names) > 1:
                path.append(names)
            links += tag == "a"
    flush()
    return out


class _Cells(Memory):
    """The cell of each word: below ``WORD_DIMS`` it counts up, from there on down."""

    def __missing__(self, word: str) -> int:
        self[word] = cell = zlib.crc32(word.lower().encode("utf-8", "replace")) % (2 * WORD_DIMS)
        return cell


_cells = _Cells(1 << 17)


def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    known = _known_paths.get(path)
    if known is not None:
        return known
    out = np.zeros(PATH_DIMS, np.float32)
    names = {name for names in path for name in names} - {"html", "body"}
    for name in names:
        # Names of known purpose share two cells, so that one that wasn't seen in training counts like those that were.
        if name in KEEP:
            out[0] += 1
        elif name in DROP:
            out[1] += 1
        code = zlib.crc32(f"path:{name}".encode("utf-8", "replace"))
        out[2 + (code >> 1) % (PATH_DIMS - 2)] += 1 if code & 1 else -1
    out = _known_paths[path] = np.clip(out, -2, 2)
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUT), np.float32)
    for i, block in enumerate(blocks):
        out[i, :PATH_DIMS] = _path_vector(block.path)
        words = block.text.split(" ")
        row = out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS]
        # A word says most by whether it is there; a block's vector has length 1 at most.
        seen = np.bincount([_cells[word] for word in set(words)], minlength=2 * WORD_DIMS)
        row[:] = seen[:WORD_DIMS] - seen[WORD_DIMS:]
        row /= max(1.0, float(np.sqrt(row @ row)))
        size = len(block.text)
        stops = sum(block.text.count(c) for c in ".,;!?")
        out[i, PATH_DIMS + WORD_DIMS :] = (
            np.log1p(len(words)) / 4, np.log1p(size) / 8, block.linked / size, min(1.0, 8 * stops / size),
            i / max(1, len(blocks) - 1), len(block.path) / 8, block.text[-1] in ".!?:;\"'",
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM with a logistic unit; sequences of a batch are padded to the longest."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)

        def made(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.weights = {"out": made(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.weights |= {f"{side}x": made(INPUT, 4 * HIDDEN), f"{side}h": made(HIDDEN, 4 * HIDDEN), f"{side}b": bias}

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, kept: list | None) -> np.ndarray:
        steps, rows, _ = x.shape
        ahead = x @ self.weights[f"{side}x"] + self.weights[f"{side}b"]
        h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        out = np.zeros((steps, rows, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = ahead[t] + h @ self.weights[f"{side}h"]
            i, f, o = (_sigmoid(z[:, n * HIDDEN : (n + 1) * HIDDEN]) for n in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            new = f * c + i * g
            shown = np.tanh(new)
            if kept is not None:
                kept.append((t, i, f, o, g, c, shown, h, on))
            c = np.where(on, new, c)
            h = np.where(on, o * shown, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The probability of each block (step, row) to be kept."""
        both = np.concatenate([self._run(x, mask, side, None) for side in "fb"], axis=2)
        return _sigmoid(both @ self.weights["out"] + self.weights["bias"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, side, kept[side]) for side in "fb"], axis=2)
        score = _sigmoid(both @ self.weights["out"] + self.weights["bias"])[..., 0]
        error = ((score - target) * weight / max(1e-9, float(weight.sum())))[..., None].astype(np.float32)
        out = {"out": np.einsum("trh,tro->ho", both, error), "bias": error.sum((0, 1))}
        down = error @ self.weights["out"].T
        for side, part in (("f", down[..., :HIDDEN]), ("b", down[..., HIDDEN:])):
            wx, wh = self.weights[f"{side}x"], self.weights[f"{side}h"]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros(part.shape[1:], np.float32), np.zeros(part.shape[1:], np.float32)
            for t, i, f, o, g, c, shown, h, on in reversed(kept[side]):
                dh = dh + part[t]
                live_h, live_c = np.where(on, dh, 0), np.where(on, dc, 0)
                dnew = live_c + live_h * o * (1 - shown**2)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live_h * shown * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
                gx += x[t].T @ dz
                gh += h.T @ dz
                gb += dz.sum(0)
                dh = np.where(on, dz @ wh.T, dh)
                dc = np.where(on, dnew * f, dc)
            out |= {f"{side}x": gx, f"{side}h": gh, f"{side}b": gb}
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 2) -> None:
        """Adam over batches of (vectors, targets, weights) of a page each."""
        rng = random.Random(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][0]) // 8, rng.random()))
            batches = [order[i : i + batch] for i in range(0, len(order), batch)]
            rng.shuffle(batches)
            for chosen in batches:
                x, mask = padded([pages[i][0] for i in chosen])
                target, weight = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
                for row, i in enumerate(chosen):
                    target[: len(pages[i][1]), row], weight[: len(pages[i][2]), row] = pages[i][1], pages[i][2]
                step += 1
                for name, slope in self.gradients(x, mask, target, weight).items():
                    first[name] += 0.1 * (slope - first[name])
                    second[name] += 0.01 * (slope**2 - second[name])
                    size = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8
                    self.weights[name] = self.weights[name] - rate * first[name] / (1 - 0.9**step) / size


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for row, page in enumerate(pages):
        x[: len(page), row], mask[: len(page), row] = page, True
    return x, mask


def taught(block: Block) -> float | None:
    """1 to keep, 0 to drop, None where the markup doesn't say; the innermost name that says decides, a drop over a keep."""
    for names in reversed(block.path):
        if DROP.intersection(names):
            return 0.0
        if KEEP.intersection(names):
            return 1.0
    return None


_CONTENT = ("article", "main", 'div class="content"', 'div class="post-body"', 'div id="story"', 'section class="entry"', 'div class="text"', "div")
_OTHER = {
    "top": ("nav", 'div class="menu"', "header", 'ul class="navbar"', 'div id="masthead"', 'div class="top-links"', 'div class="breadcrumbs"'),
    "side": ('div class="ad"', "aside", 'div class="sidebar"', 'div class="notice"', 'div class="cookie-banner"', 'div class="promo"', 'div class="related"', "form"),
    "end": ("footer", 'div class="footer"', 'div class="comments"', 'section id="comments"', 'div class="copyright"', 'div class="share"', "form", 'div class="newsletter"'),
}


def _wrapped(holder: str, texts: Iterable[str], rng: random.Random, linked: bool) -> str:
    tag = holder.split(" ")[0]
    inner = rng.choice(("p", "div", "li")) if linked else rng.choice(("p", "p", "div"))
    shown = (f'<a href="#">{html.escape(t)}</a>' if linked else html.escape(t) for t in texts)
    return f"<{holder}>" + "".join(f"<{inner}>{t}</{inner}>" for t in shown) + f"</{tag}>"


def relaid(blocks: list[Block], rng: random.Random) -> list[tuple[Block, float]]:
    """A page's kept and dropped texts laid out anew in containers drawn at random, with what each is."""
    kept = [b.text for b in blocks if taught(b) == 1.0]
    if not kept:
        return []
    words = " ".join(kept).split(" ")

    def phrase(low: int, high: int) -> str:
        start = rng.randrange(len(words))
        return " ".join(words[start : start + rng.randint(low, high)]) or words[0]

    parts: list[tuple[str, float]] = []
    if rng.random() < 0.9:
        parts.append((_wrapped(rng.choice(_OTHER["top"]), [phrase(1, 2) for _ in range(rng.randint(2, 9))], rng, True), 0.0))
    if rng.random() < 0.6:
        parts.append((_wrapped(rng.choice(_OTHER["side"]), [phrase(4, 25)], rng, False), 0.0))
    middle = rng.randint(0, len(kept))
    holder = rng.choice(_CONTENT)
    head = f"<{rng.choice(('h1', 'h2'))}>{html.escape(phrase(2, 8))}</h1>"
    parts.append((f"<{holder}>{head if rng.random() < 0.7 else ''}" + "".join(f"<p>{html.escape(t)}</p>" for t in kept[:middle]), 1.0))
    if rng.random() < 0.4:
        parts.append((_wrapped(rng.choice(_OTHER["side"][:6]), [phrase(4, 25)], rng, False), 0.0))
    parts.append(("".join(f"<p>{html.escape(t)}</p>" for t in kept[middle:]) + f"</{holder.split(' ')[0]}>", 1.0))
    for _ in range(rng.randint(1, 3)):
        linked = rng.random() < 0.3
        parts.append((_wrapped(rng.choice(_OTHER["end"]), [phrase(2, 30) for _ in range(rng.randint(1, 4))], rng, linked), 0.0))
    marked: list[tuple[Block, float]] = []
    page = ""
    for part, label in parts:
        page += part
        now = blocks_of(f"<html><body>{page}")
        marked = [(b, marked[i][1] if i < len(marked) else label) for i, b in enumerate(now)]
    return marked


def lesson(marked: list[tuple[Block, float | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = np.array([label is not None for _, label in marked], np.float32)
    return vectors([b for b, _ in marked]), np.array([label or 0.0 for _, label in marked], np.float32), known


def fit_labeller(pages: DataFrame, html_column: str = "html") -> BlockLabeller:
    """A labeller trained on at most ``SAMPLE_PAGES`` pages, those whose html has the smallest hashes.

    Pages whose markup states nothing teach nothing. Without any lesson the
    labeller goes by the two cells of stated purpose alone.
    """
    page = F.substring(F.col(html_column).cast("string"), 1, SAMPLE_CHARS).alias("page")
    chosen = pages.select(page, F.xxhash64(html_column).alias("at")).filter("page <> ''").orderBy("at", "page").limit(SAMPLE_PAGES).collect()
    rng = random.Random(1)
    lessons = []
    for row in chosen:
        blocks = blocks_of(row["page"])
        marked = [(b, taught(b)) for b in blocks]
        if {0.0, 1.0} <= {label for _, label in marked}:
            lessons.append(lesson(marked))
        for _ in range(LAYOUTS):
            if again := relaid(blocks[:60], rng):
                lessons.append(lesson(again))
    labeller = BlockLabeller()
    if lessons:
        labeller.fit(lessons)
    else:
        labeller.weights = {k: np.zeros_like(v) for k, v in labeller.weights.items()}
        # Each direction has one cell that opens for a stated purpose to keep and shuts for one to drop.
        for side in "fb":
            labeller.weights[f"{side}x"][0, 3 * HIDDEN], labeller.weights[f"{side}x"][1, 3 * HIDDEN] = 4, -8
            labeller.weights[f"{side}b"][: HIDDEN] = labeller.weights[f"{side}b"][2 * HIDDEN : 3 * HIDDEN] = 9
            labeller.weights[f"{side}b"][HIDDEN : 2 * HIDDEN] = -9
        labeller.weights["out"][[0, HIDDEN], 0] = 4
    return labeller


def labelled(pages: list[str | None], labeller: BlockLabeller) -> list[list[tuple[Block, float]]]:
    """The blocks of each page with their scores; pages of like length are read together."""
    cut = [blocks_of(p) if p else [] for p in pages]
    out: list[list[tuple[Block, float]]] = [[] for _ in pages]
    order = sorted((i for i in range(len(pages)) if cut[i]), key=lambda i: len(cut[i]))
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last - first + 1) * len(cut[order[last]]) <= BATCH_BLOCKS:
            last += 1
        chosen = order[first:last]
        scores = labeller.scores(*padded([vectors(cut[i]) for i in chosen]))
        for row, i in enumerate(chosen):
            out[i] = list(zip(cut[i], scores[: len(cut[i]), row].tolist(), strict=True))
        first = last
    return out


#: Characters of html that are cut and read together.
_ROOM = 4 << 20


def main_text(labeller: BlockLabeller, page: Column, spark) -> Column:
    """The kept blocks of each page, two line feeds between them; null and empty pages give an empty text."""
    sent = Sent(spark, labeller)

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        out: list[str] = []
        held: list[str | None] = []
        room = 0
        for value in column:
            held.append(value.as_py())
            room += len(held[-1] or "")
            if room > _ROOM:
                out += ["\n\n".join(b.text for b, score in page if score >= 0.5) for page in labelled(held, sent.value)]
                held, room = [], 0
        out += ["\n\n".join(b.text for b, score in page if score >= 0.5) for page in labelled(held, sent.value)]
        return pa.array(out, pa.string())

    return extract.asNondeterministic()(page.cast("string"))


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: id, url, text and its n_chars. Every row returns, equal rows each; pages without a kept block have an empty text."""
    labeller = fit_labeller(pages, html_column)
    text = main_text(labeller, F.col(html_column), pages.sparkSession)
    rows = pages.select(F.col(id_column), F.col(url_column), text.alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
