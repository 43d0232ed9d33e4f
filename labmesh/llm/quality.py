"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text come from one pass over its bytes and words. Trees are
grown level by level on quantile bins and kept as flat arrays, which a whole
batch of documents walks at once in numpy. Training uses a bounded sample of the
labelled rows; scoring is one narrow pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "letters", "upper", "digits", "spaces", "symbols",
    "stops", "bars", "bangs", "beyond_ascii", "word_length", "long_words", "distinct_words",
    "top_word", "repeated_next", "distinct_lines", "symbol_ends", "upper_words", "short_words",
    "top_line",
)

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = True
_PLAIN_ENDS = frozenset(b"#$%&*+<=>@\\^_`{}~!|")


def statistics(text: str | None) -> list[float]:
    """One value per name in STATISTICS; all 0 for NULL and empty texts."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    line_seen: dict[bytes, int] = {}
    for line in lines:
        line_seen[line] = line_seen.get(line, 0) + 1
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(np.log1p(len(lines))),
        counts[_LETTERS].sum() / n,
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        counts[[9, 10, 11, 12, 13, 32]].sum() / n,
        counts[_SYMBOLS].sum() / n,
        (counts[44] + counts[46]) / n_words,
        counts[124] / n_words,
        (counts[33] + counts[63]) / n_words,
        counts[128:].sum() / n,
        float(lengths.sum()) / n_words,
        float((lengths > 12).sum()) / n_words,
        len(seen) / n_words,
        max(seen.values(), default=0) / n_words,
        sum(a == b for a, b in zip(words, words[1:])) / n_words,
        len(line_seen) / n_lines,
        sum(word[-1] in _PLAIN_ENDS for word in words) / n_words,
        sum(word.isupper() and len(word) > 1 for word in words) / n_words,
        float((lengths < 3).sum()) / n_words,
        max(line_seen.values(), default=0) / n_lines,
    ]


def statistics_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 80,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    smallest: int = 10,
    ridge: float = 2.0,
) -> Trees:
    """Boosted trees for labels 0 and 1; without both labels a constant score."""
    if len(y) == 0:
        x, y = np.zeros((1, len(STATISTICS))), np.array([0.5])
    share = float(np.clip(y.mean(), 0.01, 0.99))
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    margin = np.full(len(y), base)
    for _ in range(rounds if 0 < y.mean() < 1 else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        root = len(nodes)
        roots.append(root)
        nodes.append([0, 0.0, root, root, 0.0])
        level = {root: np.arange(len(y))}
        for _ in range(depth):
            below = {}
            for node, rows in level.items():
                g, h = gradient[rows], hessian[rows]
                all_g, all_h = g.sum(), h.sum()
                best = (1e-6, None, None)
                for f, cuts in enumerate(edges):
                    if not len(cuts):
                        continue
                    b = binned[rows, f]
                    size = len(cuts) + 1
                    left_g = np.cumsum(np.bincount(b, g, size))[:-1]
                    left_h = np.cumsum(np.bincount(b, h, size))[:-1]
                    left_n = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gain = (
                        left_g**2 / (left_h + ridge)
                        + (all_g - left_g) ** 2 / (all_h - left_h + ridge)
                        - all_g**2 / (all_h + ridge)
                    )
                    gain[(left_n < smallest) | (len(rows) - left_n < smallest)] = -np.inf
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
                _, f, k = best
                if f is None:
                    continue
                goes_left = binned[rows, f] <= k
                for side in (rows[goes_left], rows[~goes_left]):
                    child = len(nodes)
                    weight = -rate * gradient[side].sum() / (hessian[side].sum() + ridge)
                    nodes.append([0, 0.0, child, child, weight])
                    below[child] = side
                nodes[node][:4] = [f, float(edges[f][k]), len(nodes) - 2, len(nodes) - 1]
            level = below
            if not level:
                break
        tree = Trees(*_flat(nodes, [root]), depth, 0.0)
        margin = margin + _leaf_values(tree, x)
    return Trees(*_flat(nodes, roots), depth, base)


def _flat(nodes: list[list[float]], roots: list[int]) -> tuple[np.ndarray, ...]:
    table = np.array(nodes, float).reshape(-1, 5)
    return (
        table[:, 0].astype(np.int64),
        table[:, 1],
        table[:, 2].astype(np.int64),
        table[:, 3].astype(np.int64),
        table[:, 4],
        np.array(roots, np.int64),
    )


def _leaf_values(tree: Trees, x: np.ndarray) -> np.ndarray:
    rows, node = np.arange(len(x)), np.full(len(x), tree.roots[0])
    for _ in range(tree.depth):
        goes_left = x[rows, tree.feature[node]] <= tree.threshold[node]
        node = np.where(goes_left, tree.left[node], tree.right[node])
    return tree.value[node]


def held_out(id, folds: int = FOLDS):
    """True for the documents whose labels training never sees; a NULL id counts as one."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> Trees:
    """Trees from at most `sample` labelled documents outside the held-out fold.

    Labelled ids are taken in the order of a hash, so the sample is the same in
    every run. Labels that are NULL, and ids whose labels disagree, are left out. Of
    several rows of one id the first by text is taken, NULL last.
    The driver receives one row of statistics per sampled document, and the ids
    that are broadcast are as many.
    """
    named = F.col(f"`{id}`")
    chosen = (
        labels.select(named.alias("__id"), F.col(f"`{label}`").cast("int").alias("__label"))
        .filter(F.col("__label").isin(0, 1) & F.col("__id").isNotNull())
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"), F.max("__label").alias("__other"))
        .filter((F.col("__label") == F.col("__other")) & ~held_out(F.col("__id")))
        .select("__id", "__label")
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    measured = (
        docs.select(named.alias("__id"), F.col(f"`{text}`").alias("__text"))
        .join(F.broadcast(chosen), "__id")
        .groupBy("__id", "__label")
        .agg(F.min("__text").alias("__text"))
        .mapInPandas(
            lambda batches: (
                pd.DataFrame(
                    {
                        "id": b["__id"],
                        "label": b["__label"],
                        "x": list(statistics_of(b["__text"])),
                    }
                )
                for b in batches
            ),
            "id long, label int, x array<double>",
        )
        .toPandas()
        .sort_values(["id"], kind="stable")
    )
    x = np.array(measured["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit_trees(x, measured["label"].to_numpy(float))


def score_quality(
    docs: DataFrame,
    trees: Trees,
    text: str = "text",
    score: str = "score",
) -> DataFrame:
    """The rows with `score` in 0 to 1, higher where label 1 is likelier.

    Only the text is read, whole. NULL and empty texts have all statistics 0 and
    get the score of those. A column that is called like the new one is replaced;
    repeated rows get equal scores; an empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(trees.score(statistics_of(batch)))

    return docs.withColumn(score, scored(F.col(f"`{text}`")))
