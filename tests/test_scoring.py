import math
import random

import pytest
from pyspark.sql import functions as F

from telemetra.functions.trees import with_contributions
from telemetra.operators import scoring
from telemetra.schemas import FEATURES, LEGACY_FEATURES

NAMES = ["p50_latency", "p95_latency", "error_rate"]


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    r = random.Random(2)
    rows = []
    for i in range(600):
        a, b, c = r.random() * 100, r.random() * 200, r.random()
        rows.append((i, a, b, c, int(c + b / 400 + r.random() * 0.3 > 1)))
    df = spark.createDataFrame(rows, "id int, p50_latency double, p95_latency double, error_rate double, label int").repartition(2).cache()
    model = scoring.train(df, NAMES, rounds=6, depth=3, rate=0.3)
    path = str(tmp_path_factory.mktemp("model"))
    scoring.save_model(model, path, NAMES, {"roc_auc": 0.9})
    return df, model, path


def test_contributions_sum_to_the_margin(trained):
    df, model, path = trained
    scored = scoring.with_risk(df, model, NAMES)
    for r in with_contributions(scored, f"{path}/trees", NAMES).collect():
        logit = math.log(r["risk_score"] / (1 - r["risk_score"]))
        assert r["base_score"] + sum(r["contributions"]) == pytest.approx(logit, abs=1e-6)


def test_contributions_equal_subset_enumeration(spark, trained):
    """Shapley values of single trees by walking every feature subset."""
    from itertools import combinations
    from math import factorial

    import numpy as np

    from telemetra.functions.trees import build_leaves, contributions, model_nodes

    df, _, path = trained
    nodes = model_nodes(spark, f"{path}/trees").toPandas()
    x = np.array([list(map(float, r)) for r in df.select(*NAMES).limit(5).collect()])

    def value(tree, node, row, known):
        n = tree[node]
        if n["left"] < 0:
            return 2 * n["weight"] * n["prediction"]
        f = int(n["feature"])
        if f in known:
            return value(tree, n["left"] if row[f] <= n["threshold"] else n["right"], row, known)
        return sum(tree[c]["cover"] / n["cover"] * value(tree, c, row, known) for c in (n["left"], n["right"]))

    base, leaves = build_leaves(nodes)
    got = contributions(x, leaves)
    trees = [t.set_index("id").to_dict("index") for _, t in nodes.groupby("tree")]
    for i, row in enumerate(x):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = 0.0
            for size in range(3):
                w = factorial(size) * factorial(2 - size) / factorial(3)
                for s in combinations(others, size):
                    want += w * sum(value(t, 0, row, {*s, j}) - value(t, 0, row, set(s)) for t in trees)
            assert got[i, j] == pytest.approx(want, abs=1e-9)


def test_only_risky_warm_rows_are_explained(trained):
    df, model, path = trained
    rows = df.withColumn("is_warmed_up", F.col("id") % 2 == 0)
    out = scoring.score(rows, model, NAMES, f"{path}/trees", explain_min_risk=0.5, top_k=2)
    assert out.count() == df.count()
    for r in out.collect():
        expected = 2 if r["is_warmed_up"] and r["risk_score"] >= 0.5 else 0
        assert len(r["top_features"]) == expected
        sizes = [f["abs_contribution"] for f in r["top_features"]]
        assert sizes == sorted(sizes, reverse=True)


def test_model_files_have_hashes(spark, trained):
    from telemetra.sources.tables import model_hash

    rows = model_hash(spark, f"{trained[2]}/trees").collect()
    assert rows and all(len(r["model_hash"]) == 64 for r in rows)


def test_feature_order():
    assert scoring.feature_order(["a"]) == ["a"]
    assert scoring.feature_order(count=11) == LEGACY_FEATURES
    assert scoring.feature_order(count=5) == FEATURES[:5]
    assert scoring.feature_order() == FEATURES


def test_weights_and_importance(spark, trained):
    df, model, path = trained
    weights = {r["label"]: r["weight"] for r in scoring.with_class_weight(df).select("label", "weight").distinct().collect()}
    assert weights[0] == 1.0 and 1.0 < weights[1] <= 4.0
    explained = with_contributions(scoring.with_risk(df, model, NAMES), f"{path}/trees", NAMES)
    imp = scoring.global_importance(explained, NAMES).collect()
    assert sum(r["share"] for r in imp) == pytest.approx(1.0)


def test_cross_validation(spark, trained):
    df, _, _ = trained
    rows = df.withColumn("time", F.timestamp_seconds(F.col("id") * 60 + 1_704_067_200))
    auc = scoring.fold_auc(rows, ["time", "id"], NAMES, folds=2, rounds=2, depth=2, rate=0.3).collect()
    assert [r["fold"] for r in auc] == [1, 2] and all(0.5 < r["auc"] <= 1 for r in auc)


def test_walk_down_the_node_table_equals_the_model(spark, trained):
    from telemetra.functions.trees import margins, model_nodes

    df, model, path = trained
    want = {r["id"]: r["risk_score"] for r in scoring.with_risk(df, model, NAMES).collect()}
    got = margins(df, ["id"], model_nodes(spark, f"{path}/trees"), NAMES).collect()
    assert len(got) == len(want) == 600
    for r in got:
        assert 1 / (1 + math.exp(-r["margin"])) == pytest.approx(want[r["id"]], abs=1e-9)


def big_model(trees, depth, seed):
    """Complete random trees as a node table."""
    import numpy as np
    import pandas as pd

    rng, rows = np.random.default_rng(seed), []
    for tree in range(trees):
        covers = {0: 1000.0}
        for i in range(2 ** (depth + 1) - 1):
            inner = i < 2**depth - 1
            if inner:
                share = rng.uniform(0.1, 0.9)
                covers[2 * i + 1], covers[2 * i + 2] = covers[i] * share, covers[i] * (1 - share)
            rows.append((tree, 0.01, i, 2 * i + 1 if inner else -1, 2 * i + 2 if inner else -1, int(rng.integers(25)) if inner else -1, float(rng.normal()) if inner else 0.0, covers[i], float(rng.normal())))
    return pd.DataFrame(rows, columns=["tree", "weight", "id", "left", "right", "feature", "threshold", "cover", "prediction"])


def test_large_model_in_several_passes(spark, monkeypatch):
    """700 trees of depth 6: the parts sum to the margin, however the trees are dealt into passes."""
    import numpy as np

    from telemetra.functions import trees

    nodes = big_model(700, 6, 1)
    x = np.random.default_rng(0).normal(size=(60, 25))
    names = [f"f{i}" for i in range(25)]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *names])
    table = spark.createDataFrame(nodes)
    monkeypatch.setattr(trees, "PASS_NODES", 40_000)
    got = trees.explain_nodes(rows, table, names).orderBy("id").collect()
    margin = {i: 0.0 for i in range(60)}
    by_tree = {t: own.set_index("id").to_dict("index") for t, own in nodes.groupby("tree")}
    for i, row in enumerate(x):
        for tree in by_tree.values():
            n = tree[0]
            while n["left"] >= 0:
                n = tree[n["left"] if row[n["feature"]] <= n["threshold"] else n["right"]]
            margin[i] += 2 * n["weight"] * n["prediction"]
    base, leaves = trees.build_leaves(nodes)
    whole = trees.contributions(x, leaves)
    for r in got:
        assert r["base_score"] == pytest.approx(base) and r["contributions"] == pytest.approx(whole[r["id"]].tolist(), abs=1e-9)
        assert r["base_score"] + sum(r["contributions"]) == pytest.approx(margin[r["id"]], abs=1e-9)
    assert trees.explain_nodes(rows, table.limit(0), names).first()["contributions"] == [0.0] * 25


def test_polynomial_equals_subsets(spark):
    """Features met several times on a path, against the definition."""
    from itertools import combinations
    from math import factorial

    import numpy as np

    from telemetra.functions import trees

    nodes = big_model(4, 4, 3)
    nodes["feature"] = nodes["feature"].where(nodes["feature"] < 0, nodes["feature"] % 5)
    x = np.random.default_rng(5).normal(size=(7, 5))
    by_tree = [own.set_index("id").to_dict("index") for _, own in nodes.groupby("tree")]

    def value(tree, node, row, known):
        n = tree[node]
        if n["left"] < 0:
            return 2 * n["weight"] * n["prediction"]
        if n["feature"] in known:
            return value(tree, n["left"] if row[n["feature"]] <= n["threshold"] else n["right"], row, known)
        return sum(tree[c]["cover"] / n["cover"] * value(tree, c, row, known) for c in (n["left"], n["right"]))

    got = trees.contributions(x, trees.build_leaves(nodes)[1])
    for i, row in enumerate(x):
        for j in range(5):
            others = [k for k in range(5) if k != j]
            want = sum(
                factorial(len(s)) * factorial(4 - len(s)) / factorial(5) * (value(t, 0, row, {*s, j}) - value(t, 0, row, set(s)))
                for size in range(5) for s in combinations(others, size) for t in by_tree
            )
            assert got[i, j] == pytest.approx(want, abs=1e-9)
