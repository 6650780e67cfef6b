"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks, the text between the starts and ends of block-level
elements, each with its ancestors. Tag and class names of ancestors, and features of
the text, score a block as main text or not; transition weights tie neighbours, and
Viterbi finds the best labelling of the whole page. Weights are trained by gradient
ascent on the likelihood of ``TRAINING_PAGES`` labelled pages (``html_pages``).

Character references are decoded, white space within a block becomes one space, and
the blocks that are main text are joined by two line feeds.

Text in math, object and noscript elements is text like any other around it. Elements
that are not text (``HIDDEN``) go with all that they hold, further ones of their kind
included.

Defined results: null and empty html, and pages without main text, give empty text;
unclosed and stray tags are read as browsers do for the common cases; an unclosed
comment, script or style hides the rest of the page, as in browsers, any other element
without an end hides nothing; repeated rows agree; page_id and url may be null or
repeated; an empty table gives no rows; other columns, of any name, are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table
from .html_pages import labelled_page

TRAINING_PAGES = 600

#: Fixed values of HTML: elements that end a line of text, elements whose content is not text, elements without an end.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html ins legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style title textarea template iframe noframes noembed xmp svg annotation annotation-xml".split())
#: Elements whose text has no markup, and of these the ones that hide the rest of a page if they do not end.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
UNENDED = frozenset("script style".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an element of the same group ends, up to the nearest of the boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"body", "html", "head", "button", "option", "optgroup", "ins", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}

TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Za-z][a-z]*")


@lru_cache(100)
def _tags_of(name: str, starts: bool) -> re.Pattern:
    close = "/?" if starts else "/"
    return re.compile(rf"<(?P<close>{close}){re.escape(name)}(?=[\s/>])[^>]*?(?P<void>/?)>", re.I)


def end_of(html: str, name: str, at: int) -> int | None:
    """Where a hidden element that starts before ``at`` ends; elements that may hold others of their kind end with the last of them."""
    depth = 1
    for tag in _tags_of(name, name not in RAW).finditer(html, at):
        if tag["close"]:
            depth -= 1
            if not depth:
                return tag.end()
        elif not tag["void"]:
            depth += 1
    return len(html) if name in UNENDED else None


class Block:
    __slots__ = ("tags", "names", "pieces", "linked")

    def __init__(self, tags: tuple[str, ...], names: tuple[str, ...]):
        self.tags, self.names, self.pieces, self.linked = tags, names, [], 0

    @property
    def text(self) -> str:
        return " ".join(unescape("".join(self.pieces)).split())


@lru_cache(50_000)
def name_tokens(rest: str) -> tuple[str, ...]:
    found = [a or b or c for a, b, c in NAMED.findall(rest)]
    return tuple(dict.fromkeys(t.lower() for f in found for t in TOKEN.findall(f)))


def leaf_blocks(html: str) -> list[tuple[Block, str, int]]:
    """The blocks that have text, in page order: (block, text, where it starts in the page)."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out, block, began, links = [], None, 0, 0
    at, size = 0, len(html)

    def add(piece: str, where: int) -> None:
        nonlocal block, began
        if block is None:
            if piece.isspace():
                return
            block, began = Block(tuple(t for t, _ in stack if t in BLOCKS), tuple(n for _, names in stack for n in names)), where
        block.pieces.append(piece)
        if links:
            block.linked += len(piece)

    def close() -> None:
        nonlocal block
        if block is not None:
            text = block.text
            if text:
                out.append((block, text, began))
            block = None

    def cut(to: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[to:])
        del stack[to:]

    while at < size:
        found = TAG.search(html, at)
        if found is None:
            add(html[at:], at)
            break
        if found.start() > at:
            add(html[at : found.start()], at)
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in BLOCKS:
                        close()
                        cut(k)
                    else:
                        links -= name == "a"
                        del stack[k]
                    break
                if stack[k][0] in BLOCKS and name not in BLOCKS:
                    break
            continue
        if name in HIDDEN and not found["rest"].endswith("/"):
            end = end_of(html, name, at)
            at = at if end is None else end
            add(" ", at)
            continue
        if name in EMPTY:
            if name == "hr":
                close()
            else:
                add(" ", at)
            continue
        if name in BLOCKS:
            close()
            if name in ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        cut(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            if name in CLOSES:
                ended, stop = CLOSES[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ended:
                        cut(k)
                        break
                    if stack[k][0] in stop:
                        break
        if not found["rest"].endswith("/"):
            stack.append((name, name_tokens(found["rest"]) if found["rest"] else ()))
            links += name == "a"
    close()
    return out


@lru_cache(100_000)
def context_features(tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, ...]:
    own = tags[-1] if tags else ""
    above = dict.fromkeys(tags)
    return (f"own:{own}", *(f"in:{t}" for t in above if t not in ("html", "body")), *(f"name:{n}" for n in dict.fromkeys(names)))


def text_features(text: str, linked: int) -> tuple[str, ...]:
    n = text.count(" ") + 1
    size = 0 if n < 2 else 1 if n < 5 else 2 if n < 12 else 3 if n < 30 else 4 if n < 80 else 5
    share = linked / max(1, len(text))
    last = text[-1]
    return (f"size:{size}", f"linked:{0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"ends:{'.' if last in '.!?' else 'a' if last.isalnum() else '-'}", f"copyright:{'©' in text}")


class Weights:
    """Scores: of features for main text against the rest, of a start in it, and of each step between the two."""

    def __init__(self, features: dict[str, float], start: float, steps: np.ndarray):
        self.features, self.start, self.steps = features, start, steps.tolist()

    @lru_cache(100_000)  # noqa: B019  one object for each worker
    def context(self, tags: tuple[str, ...], names: tuple[str, ...]) -> float:
        return sum(self.features.get(f, 0.0) for f in context_features(tags, names))

    def decode(self, blocks: list[tuple[Block, str, int]]) -> list[bool]:
        """Viterbi over two labels."""
        if not blocks:
            return []
        get, steps = self.features.get, self.steps
        out_best, in_best, back = 0.0, self.start, []
        for k, (block, text, _) in enumerate(blocks):
            score = self.context(block.tags, block.names) + sum([get(f, 0.0) for f in text_features(text, block.linked)])
            if k:
                to_out = (out_best + steps[0][0], in_best + steps[1][0])
                to_in = (out_best + steps[0][1], in_best + steps[1][1])
                back.append((to_out[1] > to_out[0], to_in[1] > to_in[0]))
                out_best, in_best = max(to_out), max(to_in)
            in_best += score
        label = in_best > out_best
        labels = [label]
        for from_out, from_in in reversed(back):
            label = from_in if label else from_out
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[tuple[str, ...]], list[bool]]], rounds: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Weights:
    """Gradient ascent (Adam) on the likelihood of the pages' labels, by forward and backward sums over all of them at once."""
    index: dict[str, int] = {}
    longest = max(len(labels) for _, labels in pages)
    flat, owner = [], []
    label = np.zeros((len(pages), longest), int)
    mask = np.zeros((len(pages), longest), bool)
    for p, (blocks, labels) in enumerate(pages):
        mask[p, : len(labels)] = True
        label[p, : len(labels)] = labels
        for k, features in enumerate(blocks):
            flat += [index.setdefault(f, len(index)) for f in features]
            owner += [p * longest + k] * len(features)
    flat, owner = np.array(flat), np.array(owner)
    n = len(index)
    w = np.zeros(n + 5)
    moment, spread = np.zeros(n + 5), np.zeros(n + 5)
    for step in range(1, rounds + 1):
        score = np.bincount(owner, w[flat], len(pages) * longest).reshape(len(pages), longest)
        emit = np.stack([np.zeros_like(score), score], -1)
        steps = w[n + 1 :].reshape(2, 2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + [0, w[n]]
        for k in range(1, longest):
            now = np.logaddexp.reduce(forward[:, k - 1, :, None] + steps, axis=1) + emit[:, k]
            forward[:, k] = np.where(mask[:, k, None], now, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            now = np.logaddexp.reduce(steps + (emit[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(mask[:, k + 1, None], now, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        grad = np.zeros(n + 5)
        off = (label - chance[..., 1]) * mask
        grad[:n] = np.bincount(flat, off.ravel()[owner], n)
        grad[n] = off[:, 0].sum()
        both = mask[:, 1:]
        pair = np.exp(forward[:, :-1, :, None] + steps + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:, :-1][both], label[:, 1:][both]), 1)
        grad[n + 1 :] = (seen - pair.sum((0, 1))).ravel()
        grad = grad / len(pages) - decay * w
        moment, spread = 0.9 * moment + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        w += rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Weights({f: float(w[k]) for f, k in index.items()}, float(w[n]), w[n + 1 :].reshape(2, 2))


def labelled_blocks(seed: int) -> tuple[list[tuple[Block, str, int]], list[bool]]:
    pieces = labelled_page(seed)
    edges = np.cumsum([0] + [len(p) for p, _ in pieces])
    blocks = leaf_blocks("".join(p for p, _ in pieces))
    return blocks, [pieces[int(np.searchsorted(edges, at, "right")) - 1][1] for _, _, at in blocks]


@lru_cache(1)
def default_weights(pages: int = TRAINING_PAGES) -> Weights:
    made = [labelled_blocks(k) for k in range(pages)]
    return train([([context_features(b.tags, b.names) + text_features(t, b.linked) for b, t, _ in blocks], labels) for blocks, labels in made if blocks])


def main_text(html: str | None, weights: Weights) -> str:
    blocks = leaf_blocks(html or "")
    return "\n\n".join(text for (_, text, _), label in zip(blocks, weights.decode(blocks), strict=True) if label)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    weights = weights or default_weights()
    shared = pages.sparkSession.sparkContext.broadcast((weights.features, weights.start, np.array(weights.steps)))
    kinds = dict(pages.dtypes)

    def run(batches):
        local = Weights(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(h, local) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op10(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
