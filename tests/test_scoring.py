"""Tree-ensemble scoring: expression form, Python-model form, presentation rules."""
import math

from pyspark.sql import functions as F

from pliego.operators.scoring import (DEFAULT_ENSEMBLE, FEATURES, TreeEnsembleModel, ensemble_sql, score,
                                      score_with_model, tender_card)

SCHEMA = "ocid string, " + ", ".join(f"{f} double" for f in FEATURES)


def test_all_null_features_take_missing_branches(spark):
    df = spark.createDataFrame([("a",) + (None,) * 6], SCHEMA)
    r = score(df).first()
    # missing branches: tree0 -> node1 -> node3 (0.35); tree1 -> node1 -> node4 (-0.3); tree2 -> node1 (-0.15)
    m = 0.35 - 0.3 - 0.15
    assert abs(r.proba - 1 / (1 + math.exp(-m))) < 1e-12 and r.predict == 0


def test_expression_equals_python_model_and_sql(spark):
    data = [("a", 5.0, 0.0, 1.0, 0.0, 0.0, 1.0), ("b", 40.0, 2.0, 5.0, 3.0, 1.0, 3.0),
            ("c", None, 1.0, None, 2.0, None, None), ("d", float("nan"), 0.0, 2.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    a = {r.ocid: (r.predict, r.proba) for r in score(df).collect()}
    b = {r.ocid: (r.predict, r.proba) for r in score_with_model(df, TreeEnsembleModel()).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-12 for k in a)
    df.createOrReplaceTempView("feat_t")
    c = {r.ocid: round(1 / (1 + math.exp(-r.m)), 9)
         for r in spark.sql(f"SELECT ocid, {ensemble_sql()} AS m FROM feat_t").collect()}
    assert {k: round(v[1], 9) for k, v in a.items()} == c


def test_card_labels(spark):
    df = spark.createDataFrame([("a", 12.0, None, 3.0, 0.0, 0.0, None)], SCHEMA)
    r = tender_card(score(df)).first()
    assert r.tenderers == "Sin Registro" and r.unanswered == "Sin Registro"
    assert r.prediction in ("Desierto", "Normal") and r.award_days == 12


def test_ensemble_from_table_round_trip(spark):
    from dataclasses import astuple

    from pliego.operators.scoring import ensemble_from_table
    rows = [astuple(n) for n in DEFAULT_ENSEMBLE]
    df = spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, yes int, "
                                     "no int, missing int, leaf double")
    assert sorted(map(astuple, ensemble_from_table(df)), key=repr) == sorted(rows, key=repr)


def test_raw_probability_decides(spark):
    from pliego.operators.scoring import Node
    df = spark.createDataFrame([("a",) + (1.0,) * 6], SCHEMA)
    tiny = [Node(0, 0, leaf=2e-10)]
    assert score(df, tiny).first().predict == score_with_model(df, TreeEnsembleModel(tiny)).first().predict == 1


def test_own_key_features_and_predict(spark):
    class Model:
        def predict_proba(self, X):
            return [[1 - x[0], x[0]] for x in X]

        def predict(self, X):
            return [int(x[0] > 0.9) for x in X]
    df = spark.createDataFrame([(7, 0.6, 1.0), (8, 0.95, 2.0)], "k long, u double, w double")
    got = score_with_model(df, Model(), key="k", feature_cols=["u", "w"])
    assert got.columns == ["k", "predict", "proba", "u", "w"]
    assert [tuple(r)[:3] for r in got.orderBy("k").collect()] == [(7, 0, 0.6), (8, 1, 0.95)]


def test_large_ensemble_walks_an_array(spark):
    """100 trees of depth 6: equal to the Python model, without a code-generation error."""
    import numpy as np

    from pliego.operators.scoring import Node
    rng = np.random.default_rng(3)
    nodes = []
    for t in range(100):
        for n in range(63):
            yes, no = 2 * n + 1, 2 * n + 2
            nodes.append(Node(t, n, FEATURES[int(rng.integers(6))], float(rng.normal()), yes, no, yes if rng.random() < .5 else no))
        nodes += [Node(t, n, leaf=float(rng.normal() / 10)) for n in range(63, 127)]
    data = [(str(i), *[None if rng.random() < .1 else float(x) for x in rng.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    a = {r.ocid: (r.predict, r.proba) for r in score(df, nodes, 0.25).collect()}
    b = {r.ocid: (r.predict, r.proba) for r in score_with_model(df, TreeEnsembleModel(nodes, 0.25)).collect()}
    assert all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-12 for k in b) and len(a) == 300


def random_ensemble(rng, trees, depth, uneven=False):
    from pliego.operators.scoring import Node
    nodes = []
    for t in range(trees):
        todo, used = [(0, 0)], 1
        while todo:
            n, level = todo.pop()
            if level == depth or uneven and level and rng.random() < .3:
                nodes.append(Node(t, n, leaf=float(rng.normal() / 10)))
                continue
            yes, no, used = used, used + 1, used + 2
            nodes.append(Node(t, n, FEATURES[int(rng.integers(6))], float(rng.integers(-4, 5)) / 2, yes, no, yes if rng.random() < .5 else no))
            todo += [(yes, level + 1), (no, level + 1)]
    return nodes


def test_leaf_masks_equal_both_other_forms(spark):
    """Values on the thresholds, nulls, NaN and infinities; even and uneven trees, stumps, 64 leaves."""
    import numpy as np

    from pliego.operators import leaf_masks, scoring
    rng = np.random.default_rng(11)
    pool = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, *np.arange(-5, 6) / 2]
    data = [(str(i), *[None if x is None else float(x) for x in (pool[k] for k in rng.integers(0, len(pool), 6))]) for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    for nodes in (random_ensemble(rng, 40, 6), random_ensemble(rng, 60, 6, True), random_ensemble(rng, 5, 1), random_ensemble(rng, 3, 0),
                  random_ensemble(rng, 3, 0) + [scoring.Node(9, 0, leaf=.5)]):
        trees = list(scoring._trees(nodes).values())
        forms = {"masks": leaf_masks.margin(trees, .25), "walk": scoring._walked_margin(nodes, .25) if any(n.feature for n in nodes) else None}
        python = TreeEnsembleModel(nodes, .25).predict_proba(np.array([[np.nan if x is None else x for x in r[1:]] for r in data]))[:, 1]
        got = df.select(*[c.alias(k) for k, c in forms.items() if c is not None]).collect()
        for r, p in zip(got, python):
            assert "walk" not in r or r.masks == r.walk
            assert abs(1 / (1 + math.exp(-r.masks)) - p) < 1e-12


def test_deep_trees_are_walked(spark):
    import numpy as np

    from pliego.operators import leaf_masks, scoring
    nodes = random_ensemble(np.random.default_rng(1), 4, 7)
    assert not leaf_masks.fits(list(scoring._trees(nodes).values())) and len(nodes) > scoring.CASE_NODES
    df = spark.createDataFrame([("a", 1., 2., None, 0., -1., 3.)], SCHEMA)
    a, b = score(df, nodes).first(), score_with_model(df, TreeEnsembleModel(nodes)).first()
    assert abs(a.proba - b.proba) < 1e-12


def test_leaf_masks_keep_up_with_python(spark):
    """100 trees of depth 6 over 200,000 rows: 1.5 times the Python path at most."""
    import time

    import numpy as np
    nodes = random_ensemble(np.random.default_rng(5), 100, 6)
    df = spark.range(200_000, numPartitions=8).select(F.col("id").cast("string").alias("ocid"), *[
        ((F.xxhash64("id", F.lit(k)) % 1000) / 250).alias(f) for k, f in enumerate(FEATURES)])

    def best_of(n, run):
        took = []
        for _ in range(n):
            t = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        return min(took)
    native, python = best_of(3, lambda: score(df, nodes)), best_of(3, lambda: score_with_model(df, TreeEnsembleModel(nodes)))
    print(f"100 trees, 200,000 rows: masks {native:.2f} s, Python {python:.2f} s")
    assert native < 1.5 * python
