"""Scoring (SR-1, SR-1b, SR-2, CD-1 … CD-3, NM-3, PR-9, PR-10, JN-3).

A gradient-boosted tree ensemble is given as a node table

    (tree, node, feature, threshold, yes, no, missing, leaf)

with the usual boosted-tree semantics: at an inner node go to ``yes`` when
``x < threshold``, to ``missing`` when ``x`` is NULL/NaN, else to ``no``;
the margin is the sum of the reached leaves plus ``base_margin`` and the
class-1 probability is its logistic.  ``score`` is a projection without a shuffle
in one of three forms with equal results: a small model becomes one nested ``CASE``
Column inside whole-stage codegen; a model over ``CASE_NODES`` nodes, whose
expression would outgrow a compiled method, becomes bit masks of leaves in Arrow
batches (``leaf_masks``); one with a tree of more than 64 leaves becomes arrays of
nodes that higher-order functions walk.  ``ensemble_sql`` emits the model as SQL.

``score_with_model`` is the path for any fitted Python classifier with
``predict_proba``: an Arrow-batched ``mapInPandas``; the model is broadcast
and unpickled once per Python worker.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STATUS_DESERTED
from . import leaf_masks

# Feature order the classifier expects (fixed by the trained model).
FEATURES = ["awar_perio", "Pre_No_Respu", "enqui_perio", "Number_ques", "NF039", "n_of_Tend"]
# Column order of the scored table.
SCORED_OUTPUT = ["ocid", "predict", "proba", "n_of_Tend", "Pre_No_Respu", "awar_perio",
                 "enqui_perio", "Number_ques", "NF039"]
# Labels of the one-tender summary card.
LABEL_DESERTED, LABEL_NORMAL, NO_RECORD = "Desierto", "Normal", "Sin Registro"
# Nodes up to which the model is one CASE expression.
CASE_NODES = 400


@dataclass(frozen=True)
class Node:
    tree: int
    node: int
    feature: str | None = None
    threshold: float | None = None
    yes: int | None = None
    no: int | None = None
    missing: int | None = None
    leaf: float | None = None


def _n(tree, node, feature, threshold, yes, no, missing):
    return Node(tree, node, feature, threshold, yes, no, missing)


def _leaf(tree, node, value):
    return Node(tree, node, leaf=value)


# A small hand-written stand-in ensemble: the fitted model of the source
# system is not published.  Any node table with the same layout can be used.
DEFAULT_ENSEMBLE: list[Node] = [
    _n(0, 0, "n_of_Tend", 1.5, 1, 2, 1),
    _n(0, 1, "Pre_No_Respu", 0.5, 3, 4, 3),
    _leaf(0, 3, 0.35), _leaf(0, 4, 0.8),
    _n(0, 2, "awar_perio", 10.5, 5, 6, 6),
    _leaf(0, 5, -0.6), _leaf(0, 6, -0.1),
    _n(1, 0, "NF039", 0.5, 1, 2, 1),
    _n(1, 1, "enqui_perio", 2.5, 3, 4, 4),
    _leaf(1, 3, 0.25), _leaf(1, 4, -0.3),
    _leaf(1, 2, 0.45),
    _n(2, 0, "Number_ques", 0.5, 1, 2, 1),
    _leaf(2, 1, -0.15),
    _n(2, 2, "awar_perio", 30.5, 3, 4, 3),
    _leaf(2, 3, 0.05), _leaf(2, 4, 0.3),
]


def ensemble_from_table(nodes_df: DataFrame) -> list[Node]:
    """Read a node table ``(tree, node, feature, threshold, yes, no, missing,
    leaf)`` into ``Node``s.  A node table is a model's parameters: as large as
    the model, whatever the data."""
    cols = ["tree", "node", "feature", "threshold", "yes", "no", "missing", "leaf"]
    return [Node(*[r[c] for c in cols]) for r in nodes_df.select(*cols).toLocalIterator()]


def _trees(ensemble: Sequence[Node]) -> dict[int, dict[int, Node]]:
    out: dict[int, dict[int, Node]] = {}
    for n in ensemble:
        out.setdefault(n.tree, {})[n.node] = n
    return dict(sorted(out.items()))


def _goes_yes(x: Column, n: Node) -> Column:
    below = x < F.lit(float(n.threshold))
    if n.missing == n.yes:
        return x.isNull() | F.isnan(x) | below
    return x.isNotNull() & ~F.isnan(x) & below


def _tree_col(nodes: dict[int, Node], nid: int) -> Column:
    n = nodes[nid]
    if n.feature is None:
        return F.lit(float(n.leaf))
    x = F.col(n.feature).cast("double")
    return F.when(_goes_yes(x, n), _tree_col(nodes, n.yes)).otherwise(_tree_col(nodes, n.no))


def margin_col(ensemble: Sequence[Node] = DEFAULT_ENSEMBLE, base_margin: float = 0.0) -> Column:
    if len(ensemble) > CASE_NODES:
        trees = list(_trees(ensemble).values())
        if leaf_masks.fits(trees):
            return leaf_masks.margin(trees, base_margin)
        return _walked_margin(ensemble, base_margin)
    total = F.lit(float(base_margin))
    for nodes in _trees(ensemble).values():
        total = total + _tree_col(nodes, 0)
    return total


def _constant(values: Sequence, kind: str) -> Column:
    """A constant array, given as text so that the plan stays small (the optimizer evaluates it once)."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _walked_margin(ensemble: Sequence[Node], base_margin: float) -> Column:
    """The margin by walking arrays of nodes: constant-size plan, one step per level of a tree."""
    names = sorted({n.feature for n in ensemble if n.feature is not None})
    number = {f: i for i, f in enumerate(names)}
    rows: list[tuple] = []  # feature (-1: leaf), threshold or leaf value, yes, no, missing
    roots, levels = [], 0
    for nodes in _trees(ensemble).values():
        at = {nid: len(rows) + k for k, nid in enumerate(nodes)}
        roots.append(at[0])
        rows += [(-1, float(n.leaf), 0, 0, 0) if n.feature is None else
                 (number[n.feature], float(n.threshold), at[n.yes], at[n.no], at[n.missing]) for n in nodes.values()]
        levels = max(levels, _depth(nodes))
    feature, value, yes, no, missing = (
        _constant(x, kind) for x, kind in zip(zip(*rows), ("int", "double", "int", "int", "int")))
    features = F.array(*[F.col(f).cast("double") for f in names])

    def step(at: Column, _: Column) -> Column:
        x = F.get(features, F.get(feature, at))
        return (F.when(F.get(feature, at) < 0, at).when(x.isNull() | F.isnan(x), F.get(missing, at))
                .when(x < F.get(value, at), F.get(yes, at)).otherwise(F.get(no, at)))

    def leaf(root: Column) -> Column:
        return F.get(value, F.aggregate(F.sequence(F.lit(1), F.lit(max(1, levels))), root, step))
    return F.aggregate(_constant(roots, "int"), F.lit(float(base_margin)), lambda s, r: s + leaf(r))


def _depth(nodes: dict[int, Node]) -> int:
    deep, todo = 0, [(0, 0)]
    while todo:
        nid, d = todo.pop()
        deep = max(deep, d)
        n = nodes[nid]
        if n.feature is not None:
            todo += [(c, d + 1) for c in (n.yes, n.no)]
    return deep


def score(features: DataFrame, ensemble: Sequence[Node] = DEFAULT_ENSEMBLE,
          base_margin: float = 0.0) -> DataFrame:
    """SR-1: add ``proba`` (class 1) and ``predict`` (proba > 0.5), output order PR-10."""
    m = margin_col(ensemble, base_margin)
    out = features.withColumn("proba", F.lit(1.0) / (F.lit(1.0) + F.exp(-m)))
    out = out.withColumn("predict", (F.col("proba") > 0.5).cast("bigint"))
    return out.select(*SCORED_OUTPUT, *[c for c in out.columns if c not in SCORED_OUTPUT])


# --- SQL form of the same model ------------------------------------------------

def _tree_sql(nodes: dict[int, Node], nid: int) -> str:
    n = nodes[nid]
    if n.feature is None:
        return repr(float(n.leaf))
    x = f"CAST({n.feature} AS DOUBLE)"
    if n.missing == n.yes:
        cond = f"({x} IS NULL OR isnan({x}) OR {x} < {float(n.threshold)!r})"
    else:
        cond = f"({x} IS NOT NULL AND NOT isnan({x}) AND {x} < {float(n.threshold)!r})"
    return f"CASE WHEN {cond} THEN {_tree_sql(nodes, n.yes)} ELSE {_tree_sql(nodes, n.no)} END"


def ensemble_sql(ensemble: Sequence[Node] = DEFAULT_ENSEMBLE, base_margin: float = 0.0) -> str:
    """The margin as a SQL expression over the feature columns."""
    parts = [repr(float(base_margin))] + [_tree_sql(t, 0) for t in _trees(ensemble).values()]
    return "(" + " + ".join(parts) + ")"


# --- any Python classifier, Arrow-batched ----------------------------------------

class TreeEnsembleModel:
    """A fitted-model object for ``score_with_model`` built from a node table.

    Exposes ``predict_proba`` / ``predict`` over a 2-D feature array, like the
    common Python classifier interface.
    """

    def __init__(self, ensemble: Sequence[Node] = DEFAULT_ENSEMBLE, base_margin: float = 0.0,
                 features: Sequence[str] = FEATURES):
        self.trees = list(_trees(ensemble).values())
        self.base_margin = base_margin
        self.index = {f: i for i, f in enumerate(features)}

    def _tree(self, nodes: dict[int, Node], X: np.ndarray) -> np.ndarray:
        out = np.empty(len(X))
        todo = [(0, np.arange(len(X)))]
        while todo:
            nid, rows = todo.pop()
            n = nodes[nid]
            if n.feature is None:
                out[rows] = n.leaf
                continue
            x = X[rows, self.index[n.feature]]
            miss = np.isnan(x)
            below = np.where(miss, False, x < n.threshold)
            yes = below | (miss & (n.missing == n.yes))
            todo.append((n.yes, rows[yes]))
            todo.append((n.no, rows[~yes]))
        return out

    def predict_proba(self, X) -> np.ndarray:
        X = np.asarray(X, dtype=float)
        m = np.full(len(X), float(self.base_margin))
        for t in self.trees:
            m = m + self._tree(t, X)
        p = 1.0 / (1.0 + np.exp(-m))
        return np.column_stack([1.0 - p, p])

    def predict(self, X) -> np.ndarray:
        return (self.predict_proba(X)[:, 1] > 0.5).astype(np.int64)


def score_with_model(features: DataFrame, model, key: str = "ocid",
                     feature_cols: Sequence[str] = FEATURES) -> DataFrame:
    """SR-1b: score with any classifier object via ``mapInPandas``.

    Each Arrow batch becomes one feature matrix; ``proba`` is the model's
    class-1 probability and ``predict`` its own ``predict`` (``proba > 0.5`` if
    it has none).  Columns: key, predict, proba, the features.  Filter rows
    *before* calling this — Catalyst cannot push filters through a Python
    operator.
    """
    from pyspark import cloudpickle

    spark = features.sparkSession
    # cloudpickle bytes: the model's class travels by value, so executors need
    # no copy of the module that defines it
    bc = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    cols = list(feature_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle
        data = bc  # one object per worker: it keeps the unpickled model for later tasks
        if not hasattr(data, "pliego_model"):
            data.pliego_model = pickle.loads(data.value)
        m = data.pliego_model
        for pdf in batches:
            X = pdf[cols].astype("float64").to_numpy()
            out = pdf.copy()
            out["proba"] = np.asarray(m.predict_proba(X))[:, 1] if len(pdf) else np.empty(0)
            own = m.predict(X) if len(pdf) and hasattr(m, "predict") else out["proba"].to_numpy() > 0.5
            out["predict"] = np.asarray(own).astype("int64")
            yield out

    rows = features.select(key, *cols)
    out = T.StructType([*rows.schema.fields, T.StructField("proba", T.DoubleType()), T.StructField("predict", T.LongType())])
    scored = rows.mapInPandas(run, out)
    order = [c for c in SCORED_OUTPUT if c in scored.columns and c != key]
    return scored.select(key, *order, *[c for c in cols if c not in order])


# --- presentation rules as columns -------------------------------------------------

def tender_card(scored: DataFrame) -> DataFrame:
    """SR-2 (CD-1, CD-2, NM-3): the one-tender summary as columns."""
    def text_or_none(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(NO_RECORD))

    return scored.select(
        "ocid",
        F.when(F.col("predict") == 1, F.lit(LABEL_DESERTED)).otherwise(F.lit(LABEL_NORMAL))
         .alias("prediction"),
        F.round(F.col("proba") * 100, 2).alias("probability_pct"),
        text_or_none("n_of_Tend").alias("tenderers"),
        text_or_none("Pre_No_Respu").alias("unanswered"),
        F.round("awar_perio").cast("bigint").alias("award_days"),
        F.round("enqui_perio").cast("bigint").alias("enquiry_days"),
    )


def display_table(scored: DataFrame, link_col: str = "Link") -> DataFrame:
    """The scored table's display rules as text columns: counts without
    decimals, probability as a percentage with two decimals, the link as a
    clickable anchor opening a new window."""
    link = F.col(link_col)

    def whole(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNotNull(), F.format_string("%.0f", x))

    return scored.select(
        "ocid", whole("predict").alias("predict"),
        F.format_string("%.2f%%", F.col("proba") * 100).alias("proba"),
        *[whole(c).alias(c) for c in ("n_of_Tend", "Pre_No_Respu", "awar_perio", "enqui_perio",
                                         "Number_ques", "NF039")],
        "Estado",
        F.concat(F.lit('<a target="_blank" href="'), link, F.lit('">'), link, F.lit("</a>"))
         .alias("Link"),
    )


def highlight_flags(scored: DataFrame, status_col: str = "Estado") -> DataFrame:
    """CD-3: the three highlight rules as boolean columns."""
    return scored.select(
        "*",
        (F.col("predict") > 0).alias("flagged"),
        (F.col("n_of_Tend") == 1).alias("single_bidder"),
        (F.col(status_col) == F.lit(STATUS_DESERTED)).alias("deserted"),
    )


def prediction_diff(left: DataFrame, right: DataFrame, key: str = "ocid",
                    cols: Sequence[str] = ("predict", "proba", *FEATURES)) -> DataFrame:
    """JN-3: rows whose values differ between two scored tables (both kept)."""
    l_ = left.select(key, *[F.col(c).alias(f"{c}_self") for c in cols])
    r_ = right.select(key, *[F.col(c).alias(f"{c}_other") for c in cols])
    j = l_.join(r_, key, "inner")
    changed = None
    for c in cols:
        d = ~F.col(f"{c}_self").eqNullSafe(F.col(f"{c}_other"))
        changed = d if changed is None else (changed | d)
    return j.where(changed)


def changed_values(left: DataFrame, right: DataFrame, key: str = "ocid",
                   cols: Sequence[str] = ("predict", "proba", *FEATURES)) -> DataFrame:
    """JN-3 without what stays the same: a row ``(key, field, value_self, value_other)`` per key and changed column.

    One join and one pass; columns that never change do not occur.  Values are doubles.
    """
    l_ = left.select(key, *[F.col(c).cast("double").alias(f"{c}_self") for c in cols])
    r_ = right.select(key, *[F.col(c).cast("double").alias(f"{c}_other") for c in cols])
    both = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_self").alias("value_self"), F.col(f"{c}_other").alias("value_other"))
                     for c in cols])
    changed = F.filter(both, lambda v: ~v["value_self"].eqNullSafe(v["value_other"]))
    return l_.join(r_, key).select(key, F.inline(changed))


class LogisticModel:
    """A linear classifier with weights by feature and a threshold of its own; a missing value counts as its default."""

    def __init__(self, weights: Sequence[float], intercept: float, defaults: Sequence[float], threshold: float):
        self.weights, self.intercept = np.asarray(weights, float), float(intercept)
        self.defaults, self.threshold = np.asarray(defaults, float), float(threshold)

    def predict_proba(self, X) -> np.ndarray:
        X = np.asarray(X, float)
        p = 1 / (1 + np.exp(-(np.where(np.isnan(X), self.defaults, X) @ self.weights + self.intercept)))
        return np.column_stack([1 - p, p])

    def predict(self, X) -> np.ndarray:
        return (self.predict_proba(X)[:, 1] >= self.threshold).astype(np.int64)
