"""Tree ensembles as bit masks of leaves (SR-1 for models of many trees).

A node ``x < threshold`` that does not hold rules out the leaves of its ``yes``
side.  For a feature's value all ruled-out leaves of all trees are known from
its place among the feature's thresholds, so they are worked out once:

    mask[feature][tree][place] = leaves that the feature's nodes leave open

Scoring a row is a binary search per feature and, per tree, the AND of one
mask per feature; of the leaves left open the first in order is the one that
a walk from the root reaches.  The place after the last threshold belongs to
missing values: there a node rules out its ``yes`` side where missing goes to ``no``.

Leaves are numbered so that the first has the highest bit, which a double's exponent
gives.  Masks are 64 bits, so a tree has 64 leaves at most.  All of it is numpy
over Arrow batches: a batch costs one gather per feature and a few operations per
tree, where an expression would walk each row through each tree.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAVES = 64
#: Rows worked on at a time.
ROWS = 1024


class LeafMasks:
    """The masks of an ensemble: ``trees`` are dicts of nodes by number, root 0."""

    def __init__(self, trees: Sequence[dict]):
        self.count = len(trees)
        self.leaves = np.zeros((self.count, LEAVES))
        nodes: dict[str, list[tuple[float, int, int, bool]]] = {}
        for t, tree in enumerate(trees):
            order, spans = leaves_in_order(tree)
            if len(order) > LEAVES:
                raise ValueError(f"a tree with {len(order)} leaves")
            for k, leaf in enumerate(order):
                self.leaves[t, LEAVES - 1 - k] = tree[leaf].leaf
            for number, (first, last) in spans.items():  # the leaves of the yes side
                n = tree[number]
                ruled_out = sum(1 << LEAVES - 1 - k for k in range(first, last))
                nodes.setdefault(n.feature, []).append((float(n.threshold), t, ruled_out, n.missing != n.yes))
        self.features = sorted(nodes)
        self.thresholds: list[np.ndarray] = []
        self.masks: list[np.ndarray] = []  # uint64[trees, places] per feature, the last place for missing values
        for f in self.features:
            at = np.unique([x[0] for x in nodes[f]])
            masks = np.full((self.count, len(at) + 2), ~np.uint64(0))
            for threshold, t, ruled_out, missing_is_no in nodes[f]:
                keep = ~np.uint64(ruled_out)
                masks[t, np.searchsorted(at, threshold) + 1:-1] &= keep
                if missing_is_no:
                    masks[t, -1] &= keep
            self.thresholds.append(at)
            self.masks.append(masks)

    def margins(self, columns: Sequence[np.ndarray], base_margin: float) -> np.ndarray:
        """Margins of rows; ``columns`` are the values of ``features``, NaN for missing.

        Leaves are added in the order of the trees, as the other forms do.
        """
        out = np.full(len(columns[0]), float(base_margin))
        trees = np.arange(self.count)[:, None] * LEAVES
        for k in range(0, len(out), ROWS):
            left = None  # one row a tree
            for x, at, masks in zip(columns, self.thresholds, self.masks):
                x = x[k:k + ROWS]
                place = np.where(np.isnan(x), masks.shape[1] - 1, np.searchsorted(at, x, side="right"))
                mask = masks.take(place, axis=1)
                left = mask if left is None else np.bitwise_and(left, mask, out=left)
            top = left & ~(left >> np.uint64(1))  # the highest bit stays, the one below it goes: no rounding up
            bit = np.frexp(top.astype(np.float64))[1] - 1
            leaves = self.leaves.take(trees + bit)
            part = out[k:k + ROWS]
            for row in leaves:
                part += row
        return out


def leaves_in_order(tree: dict) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """A tree's leaves from the all-yes one on, and for each inner node which of them its yes side holds."""
    order: list[int] = []
    spans: dict[int, tuple[int, int]] = {}
    todo: list[tuple[int, int | None]] = [(0, None)]
    while todo:
        number, began = todo.pop()
        n = tree[number]
        if began is not None:  # the yes side is done
            spans[number] = (began, len(order))
            todo.append((n.no, None))
        elif n.feature is None:
            order.append(number)
        else:
            todo += [(number, len(order)), (n.yes, None)]
    return order, spans


def fits(trees: Sequence[dict]) -> bool:
    return all(sum(n.feature is None for n in tree.values()) <= LEAVES for tree in trees)


def margin(trees: Sequence[dict], base_margin: float) -> Column:
    """The margin as a column, worked out in Arrow batches."""
    m = LeafMasks(trees)
    if not m.features:  # no tree has an inner node
        return F.lit(float(base_margin) + float(sum(tree[0].leaf for tree in trees)))

    def each(*columns: pd.Series) -> pd.Series:
        return pd.Series(m.margins([c.to_numpy(np.float64) for c in columns], base_margin))
    return F.pandas_udf(each, "double")(*[F.col(f).cast("double") for f in m.features])
