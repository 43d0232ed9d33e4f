"""Near-duplicate embeddings by a PCA-ordered tiled comparison.

Vectors are rotated onto the principal axes of a bounded sample. A rotation keeps
every product, so the sample decides only how fast the comparison is. Vectors of a
label are dealt into cells along the two leading axes and large cells into tiles.
Two tiles are compared unless their boxes on the leading axes are too far apart
for the threshold. Within two tiles products accumulate over the leading axes
first; what the remaining axes can add is bounded by the norms of the suffixes
(Cauchy-Schwarz), and a pair is given up once the bound falls below the threshold.
A pair is linked by its cosine in double precision, from the vectors as given.

Equal vectors are one class with a weight. A task returns link counts per vector
and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labmesh.llm.common import in_groups, stored
from labmesh.llm.components import components

SAMPLE = 10_000
TILE = 2048
ROWS = 512
BOX_AXES = 8
STAGES = (8, 16, 32, 64, 128, 256, 512)
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Has components, all of them finite numbers, not all zero."""
    finite = F.forall(
        vector,
        lambda x: F.coalesce(
            ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)
        ),
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, against overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Columns are the axes, the widest first."""
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(axes[:, ::-1])


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that can reach the threshold, by partial products."""
    width = a.shape[1]
    stages = [s for s in STAGES if s < width] + [width]
    done = stages[0]
    partial = a[:, :done] @ b[:, :done].T
    rest_a = np.sqrt((a[:, done:] ** 2).sum(axis=1))
    rest_b = np.sqrt((b[:, done:] ** 2).sum(axis=1))
    i, j = np.nonzero(partial + rest_a[:, None] * rest_b >= threshold - SLACK)
    products, dense = partial[i, j], True
    for stage in stages[1:]:
        if not len(i):
            break
        dense = dense and len(i) > 0.3 * partial.size
        if dense:
            # Most pairs are left: one dense product is cheaper than picking them.
            partial = partial + a[:, done:stage] @ b[:, done:stage].T
            products = partial[i, j]
        else:
            for start in range(0, len(i), 65_536):
                part = slice(start, start + 65_536)
                products[part] += np.einsum(
                    "nd,nd->n", a[i[part], done:stage], b[j[part], done:stage]
                )
        done = stage
        rest_a = np.sqrt((a[:, done:] ** 2).sum(axis=1))
        rest_b = np.sqrt((b[:, done:] ** 2).sum(axis=1))
        alive = products + rest_a[i] * rest_b[j] >= threshold - SLACK
        i, j, products = i[alive], j[alive], products[alive]
    return i, j


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`label` names the smallest position reached so far; the same with links i, j added."""
    while len(i):
        low = np.minimum(label[i], label[j])
        # Hang the labels, not only the positions, so that whole components move.
        for end in (i, j):
            np.minimum.at(label, label[end], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def compare_tiles(group: pd.DataFrame, axes: np.ndarray, threshold: float) -> pd.DataFrame:
    """rep, links, root of the vectors of two tiles (or of one) that have a link."""
    group = group.sort_values("rep", kind="stable")
    reps, weights = group["rep"].to_numpy(), group["weight"].to_numpy()
    kept = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
    rotated = kept @ axes
    one_tile = group["i"].iloc[0] == group["j"].iloc[0]
    first = (group["t"] == group["i"]).to_numpy()
    a = np.flatnonzero(first)
    b = a if one_tile else np.flatnonzero(~first)
    links, label = np.zeros(len(group)), np.arange(len(group))
    for start in range(0, len(a), ROWS):
        rows = a[start : start + ROWS]
        i, j = _links(rotated[rows], rotated[b], threshold)
        i, j = rows[i], b[j]
        if one_tile:
            i, j = i[i < j], j[i < j]
        linked = np.zeros(len(i), bool)
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            linked[part] = np.einsum("nd,nd->n", kept[i[part]], kept[j[part]]) >= threshold
        i, j = i[linked], j[linked]
        links += np.bincount(i, weights[j], len(group)) + np.bincount(j, weights[i], len(group))
        label = _merged(label, i, j)
    touched = np.flatnonzero(links)
    return pd.DataFrame(
        {"rep": reps[touched], "links": links[touched].astype(np.int64), "root": reps[label[touched]]}
    )


def _cells(sample: np.ndarray, labels: np.ndarray, counts: dict[str, int]) -> dict[str, tuple]:
    """Cut points on the two leading axes per label, for cells of about one tile."""
    found = {}
    for label, n in counts.items():
        own = sample[labels == label]
        side = int(math.sqrt(max(n // TILE, 1)))
        if side < 2 or len(own) < 4 * side:
            continue
        first = np.quantile(own[:, 0], np.arange(1, side) / side)
        slabs = np.searchsorted(first, own[:, 0])
        second = [
            np.quantile(own[slabs == k, 1], np.arange(1, side) / side)
            if (slabs == k).any()
            else np.zeros(side - 1)
            for k in range(side)
        ]
        found[label] = (first, np.array(second))
    return found


def near_vectors(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors with equal labels, not NULL, and equal numbers of components are linked
    if their cosine in double precision is `threshold` or more. `n_links` counts
    the other vectors linked directly, `component_id` is the smallest id reachable
    over links, and `kept` marks the vector of that id.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, rows
    with a NULL label and rows with a NULL id link with nothing: 0 links, their own
    id as component (NULL for a NULL id, kept). Repeated rows, and rows that share
    an id, are vectors of their own and link like any others. Other columns are not
    read. An empty table gives an empty result.
    """
    given = vectors.select(
        F.col(f"`{id}`").alias("id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    takes_part = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()

    @F.pandas_udf("binary")
    def unit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [None if v is None else _unit(np.array(v, float)[None])[0].tobytes() for v in batch],
                dtype=object,
            )

    all_rows = stored(
        given.select(
            "id", "label", unit(F.when(takes_part, F.col("vector"))).alias("unit")
        ),
        "units",
    )
    # Vectors of one direction and label are one class, which has a number of its own:
    # ids may repeat over classes. Numbers hold once they are written.
    usable_rows = all_rows.filter(F.col("unit").isNotNull()).withColumn(
        "class", F.concat_ws(":", F.length("unit"), "label")
    )
    classes = stored(
        usable_rows.groupBy("class", "unit")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "vector-classes",
    )
    # The widths of vectors are properties of models, not of rows: a handful.
    widths = [r[0] for r in classes.select(F.length("unit")).distinct().collect()]
    kind = "long"
    found = None
    for width in widths:
        own = classes.filter(F.length("unit") == width)
        part = _linked(own, kind, threshold, sample)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"rep {kind}, links long, root {kind}")
    found = stored(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = (
        classes.select("class", "unit", "rep", "weight", "least")
        .join(counts, "rep", "left")
        .join(reach.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    per_class = linked.join(smallest, "component").select(
        "class",
        "unit",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.col("smallest").alias("component"),
    )
    keyed = all_rows.withColumn("class", F.concat_ws(":", F.length("unit"), "label"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return keyed.join(stored(per_class, "per-class"), ["class", "unit"], "left").select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _linked(classes: DataFrame, kind: str, threshold: float, sample: int) -> DataFrame:
    """rep, links, root for classes of one width."""
    chosen = (
        classes.select("class", "unit", "rep").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()
    )
    rows = np.frombuffer(b"".join(chosen["unit"]), np.float64).reshape(len(chosen), -1)
    axes = principal_axes(rows)
    # Labels that may need more than one cell: fewer than rows / tile, so that the list
    # stays far below the sample times the rows per sampled row.
    large = classes.groupBy("class").count().filter(F.col("count") >= 4 * TILE)
    counts = {r[0]: r[1] for r in large.collect()}
    cells = _cells(rows @ axes, chosen["class"].to_numpy(), counts)
    boxes = min(BOX_AXES, rows.shape[1])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            units = np.frombuffer(b"".join(batch["unit"]), np.float64).reshape(len(batch), -1)
            leading = units @ axes[:, :boxes]
            cell = np.zeros(len(batch), np.int64)
            for name in batch["class"].unique():
                if name in cells:
                    first, second = cells[name]
                    mine = (batch["class"] == name).to_numpy()
                    slab = np.searchsorted(first, leading[mine, 0])
                    inner = (second[slab] < leading[mine, 1][:, None]).sum(axis=1)
                    cell[mine] = slab * len(second) + inner
            out = batch[["class", "rep", "weight", "unit"]].copy()
            out["cell"], out["leading"] = cell, list(leading)
            yield out

    placed = stored(
        classes.mapInPandas(
            place,
            f"class string, rep {kind}, weight long, unit binary, cell long, leading array<double>",
        ),
        "placed",
    )
    sizes = placed.groupBy("class", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    spread = placed.join(stored(sizes, "cells"), ["class", "cell"]).withColumn(
        "t", F.col("cell") * 2**24 + F.pmod(F.xxhash64("rep"), F.col("tiles"))
    )
    axis = range(boxes)
    tiles = stored(
        spread.groupBy("class", "t").agg(
            F.array(*(F.min(F.col("leading")[k]) for k in axis)).alias("low"),
            F.array(*(F.max(F.col("leading")[k]) for k in axis)).alias("high"),
        ),
        "tiles",
    )
    # Vectors of length 1 with cosine c are sqrt(2 - 2 c) apart, on leading axes at most that.
    gaps = [
        F.greatest(
            F.lit(0.0),
            F.col("low")[k] - F.col("other_high")[k],
            F.col("other_low")[k] - F.col("high")[k],
        )
        for k in axis
    ]
    apart = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    others = tiles.select(
        "class",
        F.col("t").alias("u"),
        F.col("low").alias("other_low"),
        F.col("high").alias("other_high"),
    )
    near = (
        tiles.join(others, "class")
        .filter((F.col("t") <= F.col("u")) & (apart <= 2 - 2 * threshold + SLACK))
        .select("class", F.col("t").alias("i"), F.col("u").alias("j"))
    )
    near = stored(near, "tile-pairs")
    sides = near.select("class", F.col("i").alias("t"), "i", "j").unionByName(
        near.filter("i != j").select("class", F.col("j").alias("t"), "i", "j")
    )
    members = spread.select("class", "t", "rep", "weight", "unit").join(sides, ["class", "t"])
    return in_groups(
        members,
        ["class", "i", "j"],
        lambda group: compare_tiles(group, axes, threshold),
        f"rep {kind}, links long, root {kind}",
    )
