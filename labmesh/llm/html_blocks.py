"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags, with the path of
open elements above it. Each block is described by hashed features of its tag
path (names, classes, ids), all its words hashed, and a few sizes. A bidirectional LSTM
in numpy reads the blocks of a page in both directions, so that every block is
labelled with the whole document as context; blocks labelled as main text are
joined. Pages of a batch run together, in groups of similar length, and a stretch of
blocks at a time, so that a long page holds its texts and one number per block.

The weights in `block_weights.npz` come from `block_training`, which fits them on
generated pages. One narrow pass over the pages, no shuffle.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labmesh.llm.common import by_bytes

PATH_BINS = 1024
WORD_BINS = 64
SIZES = 8
INPUTS = PATH_BINS + WORD_BINS + SIZES
BATCH_BLOCKS = 1 << 14
# Blocks of a page that are described and read at once.
STRETCH = 512
# Bytes of pages that are cut into blocks at once; a longer page stands alone.
STEP = 4 << 20

# Elements of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br label".split()
)
VOID = frozenset(
    "area base br col embed frame hr img input link meta param source track wbr".split()
)
# Never text of a page, whatever the labeller says.
SILENT = frozenset(
    "script style template noscript head title iframe object svg math canvas audio video select "
    "option datalist textarea button".split()
)
RAW = frozenset("script style textarea title iframe noembed xmp".split())
# A start of the first closes an open element of the second.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("p",), "table": ("p",),
    "ul": ("p",), "ol": ("p",), "dl": ("p",), "div": ("p",), "section": ("p",), "article": ("p",),
    "aside": ("p",), "nav": ("p",), "header": ("p",), "footer": ("p",), "main": ("p",),
    "form": ("p",), "blockquote": ("p",), "pre": ("p",), "h1": ("p",), "h2": ("p",), "h3": ("p",),
    "h4": ("p",), "h5": ("p",), "h6": ("p",), "hr": ("p",), "figure": ("p",), "body": ("head",),
}
SCOPES = frozenset("ul ol dl table div section article aside nav header footer main body".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def blocks(page: str) -> list[Block]:
    """Texts between block-level tags in order, with what encloses them.

    Character references are decoded, white space is one blank. Comments,
    declarations and elements that are never text are left out. Broken markup is
    read as browsers do: a missing end tag ends with what encloses it.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    parts: list[str] = []
    silent = links = linked = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                found.append(Block(text, path, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal path, silent
        for name, _ in stack[k:]:
            silent -= name in SILENT
        path = stack[k][1]
        del stack[k:]

    while at < size:
        match = _MARKUP.search(page, at)
        text = page[at : match.start() if match else size]
        if text and not silent:
            parts.append(text)
            linked += len(text) if links else 0
        if match is None:
            break
        at = match.end()
        name = match.group(2)
        if name is None:
            continue
        name, ends = name.lower(), bool(match.group(1))
        if name in INLINE:
            if name == "a":
                links = 0 if ends else 1
            elif name in ("br", "wbr") and not silent and name == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        closed = CLOSES.get(name, ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closed:
                close(k)
                break
            if stack[k][0] in SCOPES:
                break
        if name in VOID or match.group(3).endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append((name, path))
        silent += name in SILENT
        marks = [name]
        for kind, *values in _NAMED.findall(match.group(3)):
            value = next((v for v in values if v), "").lower()
            marks += [f".{token}" for token in _TOKEN.findall(value)]
        path = (*path, *marks)
    flush()
    return found


_bins: dict[tuple[str, int], int] = {}


def _bin(word: str, bins: int) -> int:
    key = (word, bins)
    found = _bins.get(key)
    if found is None:
        if len(_bins) > 500_000:
            _bins.clear()
        found = _bins[key] = crc32(word.encode("utf-8", "replace")) % bins
    return found


def path_bins(path: tuple[str, ...]) -> np.ndarray:
    """The inputs that the marks of a path set to 1."""
    return np.array(sorted({_bin(mark, PATH_BINS) for mark in path}), np.int64)


def described(page: list[Block], start: int, end: int) -> np.ndarray:
    """Words and sizes of a stretch of blocks, one row per block."""
    out = np.zeros((end - start, WORD_BINS + SIZES), np.float32)
    for k in range(start, end):
        block = page[k]
        words = block.text.lower().split()
        # All words of the block: root shares, so that the vector has length 1 however long it is.
        counts = np.bincount([_bin(word, WORD_BINS) for word in words], minlength=WORD_BINS)
        row = out[k - start]
        row[:WORD_BINS] = np.sqrt(counts / len(words))
        n = len(block.text)
        row[WORD_BINS:] = (
            np.log1p(n) / 5,
            np.log1p(len(words)) / 5,
            block.linked / n,
            block.text[-1] in ".!?:\"",
            len(block.path) / 10,
            k / len(page),
            n > 80,
            1.0,
        )
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row per block: its path, words and sizes; what the labeller is fitted on."""
    out = np.zeros((len(page), INPUTS), np.float32)
    for k, block in enumerate(page):
        out[k, path_bins(block.path)] = 1.0
    out[:, PATH_BINS:] = described(page, 0, len(page))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def lstm(
    gates: np.ndarray, u: np.ndarray, mask: np.ndarray, h: np.ndarray, c: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of one direction over a stretch, and the state after it.

    `gates` is pages by steps by what the inputs add to the gates; masked steps keep
    the state.
    """
    hidden = u.shape[0]
    out = np.empty((*gates.shape[:2], hidden), np.float32)
    for t in range(gates.shape[1]):
        z = gates[:, t] + h @ u
        i, f, o = (_sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
        new = f * c + i * np.tanh(z[:, 3 * hidden :])
        m = mask[:, t, None]
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        out[:, t] = h
    return out, h, c


def _gates(
    pages: list[list[Block]], start: int, end: int, w: np.ndarray, paths: dict[tuple[str, ...], np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of each page adds to the gates, and which steps a page has."""
    gates = np.zeros((len(pages), end - start, w.shape[1]), np.float32)
    mask = np.zeros(gates.shape[:2], bool)
    for row, page in enumerate(pages):
        stop = min(end, len(page))
        if start >= stop:
            continue
        own = described(page, start, stop) @ w[PATH_BINS:]
        for k in range(start, stop):
            path = page[k].path
            added = paths.get(path)
            if added is None:
                if len(paths) > 4096:
                    paths.clear()
                # Most inputs of a path are 0: the rows of the others are added up.
                added = paths[path] = w[path_bins(path)].sum(axis=0)
            own[k - start] += added
        gates[row, : stop - start] = own
        mask[row, : stop - start] = True
    return gates, mask


def label_pages(pages: list[list[Block]], weights: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Per page the probability of every block to be main text."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    hidden = weights["uf"].shape[0]
    paths: tuple[dict, dict] = ({}, {})
    while order:
        # The longest page sets how many fit beside it.
        longest = len(pages[order[-1]])
        many = max(1, BATCH_BLOCKS // longest)
        group, order = order[-many:], order[:-many]
        own = [pages[k] for k in group]
        scores = np.full((len(group), longest), weights["b"][0], np.float32)
        starts = range(0, longest, STRETCH)
        for side, (w, u, v) in enumerate(
            ((weights["wf"], weights["uf"], weights["v"][:hidden]), (weights["wb"], weights["ub"], weights["v"][hidden:]))
        ):
            h = np.zeros((len(group), hidden), np.float32)
            c = np.zeros_like(h)
            # Backwards the padding comes first and leaves the state at zero.
            turn = slice(None, None, -1 if side else 1)
            for start in reversed(starts) if side else starts:
                end = min(start + STRETCH, longest)
                gates, mask = _gates(own, start, end, w, paths[side])
                states, h, c = lstm(gates[:, turn], u, mask[:, turn], h, c)
                scores[:, start:end] += (states @ v)[:, turn]
        for row, k in enumerate(group):
            out[k] = _sigmoid(scores[row, : len(pages[k])])
    return out


def load_weights(path: str | None = None) -> dict[str, np.ndarray]:
    """The weights of the labeller: a fixed few hundred kilobytes."""
    with np.load(path or os.path.join(os.path.dirname(__file__), "block_weights.npz")) as kept:
        return {name: kept[name].astype(np.float32) for name in kept.files}


def main_texts(pages: list[str], weights: dict[str, np.ndarray]) -> list[str]:
    cut = [blocks(page) for page in pages]
    return [
        "\n".join(block.text for block, p in zip(page, own, strict=True) if p >= 0.5)
        for page, own in zip(cut, label_pages(cut, weights), strict=True)
    ]


def extract_text(
    pages: DataFrame, html: str = "html", text: str = "text", weights: dict | None = None
) -> DataFrame:
    """The rows with the main text of the whole page.

    Main text is the article: blocks in page order joined by a line feed, without
    menus, headers, footers, sidebars, notices, adverts, forms and comments. NULL
    and empty pages, and pages without main text, give an empty text. A column that
    is called like the new one is replaced; repeated rows get equal texts; an empty
    table gives an empty result. A very long page is held as its blocks.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or load_weights())
    kept = [f for f in pages.schema.fields if f.name.lower() != text.lower()]
    names = [f.name for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, html, STEP):
            texts = main_texts([page or "" for page in part.column(html).to_pylist()], shared.value)
            columns = [*(part.column(c) for c in names), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, text])

    return pages.mapInArrow(work, T.StructType([*kept, T.StructField(text, T.StringType())]))
