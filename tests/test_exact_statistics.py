"""Exact samples, p-values, silhouettes and medians; leaf-wise trees as a credit model."""
from __future__ import annotations

import hashlib
import itertools
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import SF001
from riskloom.functions import stats
from riskloom.operators import cleaning, drift, explain, modeling, ranks, segments
from riskloom.plans import catalog


@pytest.mark.parametrize("m, n", [(2, 2), (2, 5), (3, 7), (4, 6), (5, 5), (8, 8), (7, 8)])
def test_ks_p_value_equals_all_interleavings(m, n):
    found: dict[int, int] = {}
    for first in itertools.combinations(range(m + n), m):
        seen, i, most = set(first), 0, 0
        for k in range(m + n):
            i += k in seen
            most = max(most, abs(i * n - (k + 1 - i) * m))
        found[most] = found.get(most, 0) + 1
    total = sum(found.values())
    for reach in found:
        want = sum(c for r, c in found.items() if r >= reach) / total
        assert abs(stats.ks_outside(reach / (m * n), m, n) - want) < 1e-12


def test_ks_p_value_of_larger_samples():
    assert stats.ks_outside(0.0, 50, 70) == 1.0
    assert 0 < stats.ks_outside(1.0, 300, 200) < 1e-100              # keeps the digits of small chances
    exact = stats.ks_outside(0.05, 2000, 3000)
    lam = 0.05 * np.sqrt(2000 * 3000 / 5000)
    assert abs(exact - 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam * lam) for k in range(1, 101))) < 1e-3


def test_ks_two_sample_is_exact_up_to_the_stated_size(spark, monkeypatch):
    ref = spark.createDataFrame([(float(i),) for i in range(6)], "x double")
    cur = spark.createDataFrame([(i + 2.5,) for i in range(5)], "x double")
    got = drift.ks_two_sample(ref, cur, ["x"]).first()
    assert got.p_value == pytest.approx(stats.ks_outside(got.ks_stat, 6, 5), abs=1e-15)
    assert drift.ks_two_sample(ref, cur, ["x"], exact=False).first().p_value != got.p_value
    assert drift.ks_two_sample(ref, cur.limit(1), ["x"]).first().p_value is None


def test_chi_square_keeps_nulls_apart_from_the_word_nan(spark):
    ref = spark.createDataFrame([(v,) for v in [None] * 10 + ["nan"] * 10 + ["x"] * 10], "v string")
    cur = spark.createDataFrame([(v,) for v in ["nan"] * 20 + ["x"] * 10], "v string")
    table = np.array([[11, 11, 11], [1, 21, 11]], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert drift.chi_square(ref, cur, ["v"]).first().chi2 == pytest.approx(((table - expected) ** 2 / expected).sum())


def test_sample_is_exact_and_does_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "SAMPLE_CELL", 5)                  # more than one round
    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("x"))
    want = sorted(range(20_000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    for n in (0, 1, 137, 5_000, 19_999, 20_000, 30_000):
        for parts in (1, 13):
            got = sorted(r.id for r in cleaning.sample_rows(df.repartition(parts), n, ["id"]).collect())
            assert got == sorted(want[:n])
    rows = spark.createDataFrame([(1, None)] * 300 + [(2, "b")] * 3, "a int, b string")
    assert cleaning.sample_rows(rows, 250).count() == 250 and cleaning.sample_rows(rows.limit(0), 5).count() == 0
    assert cleaning.sample_rows(df, 100, ["id"], seed=1).exceptAll(cleaning.sample_rows(df, 100, ["id"])).count() > 0


def test_silhouette_equals_its_definition(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((120, 3)), rng.standard_normal((79, 3)) + 3, [[50.0, 0, 0]]])
    c = np.array([0] * 120 + [5] * 79 + [9])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(200):
        own = c == c[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a = far[i, own].sum() / (own.sum() - 1)
        b = min(far[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, c)], "x array<double>, c int").select(array_to_vector("x").alias("v"), "c").repartition(4)
    assert segments.silhouette(df, "v", "c") == pytest.approx(np.mean(want), abs=1e-12)
    assert segments.silhouette(df.where("c = 0"), "v", "c") is None
    assert -1 <= segments.silhouette(df, "v", "c", sample=50) <= 1
    same = df.withColumn("v", array_to_vector(F.array(F.lit(1.0))))
    assert segments.silhouette(same, "v", "c") == 0


def test_medians_are_exact_and_class_weights_ignore_null_labels(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, float("nan"), rng.random()]), float(i % 10), None, [None, 0, 1, 1][i % 4]) for i in range(401)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(5)
    a = [r[0] for r in rows if r[0] is not None and r[0] == r[0]]
    assert ranks.column_medians(df, ["a", "b", "c"]) == {"a": float(np.median(a)), "b": float(np.median([r[1] for r in rows]))}
    weights = {r.y: r[modeling.WEIGHT] for r in modeling.class_weights(df, "y").collect()}
    n0, n1 = sum(r[3] == 0 for r in rows), sum(r[3] == 1 for r in rows)
    assert weights[0] == pytest.approx((n0 + n1) / (2 * n0)) and weights[1] == pytest.approx((n0 + n1) / (2 * n1))


def test_leafwise_trees_as_a_credit_model(spark):
    df = catalog.model_frame(spark, SF001)
    num, cat = cleaning.feature_columns(df)
    m = modeling.train_model(df, num, cat, label="default_future", model_type="leafwise", params={"n_estimators": 8, "num_leaves": 15}, cv=False)
    assert len(m.booster.trees) == 8 and m.metrics_train["roc_auc"] > 0.5
    path = tempfile.mkdtemp(prefix="riskloom-trees-")
    m.save(path)
    again = modeling.CreditModel.load(spark, path)
    keys = ["credit_id", "report_date_as_of", "risk_score"]
    a = modeling.predict_proba(m, df).select(keys)
    assert a.where("risk_score is null or risk_score <= 0 or risk_score >= 1").isEmpty()
    assert a.exceptAll(modeling.predict_proba(again, df).select(keys)).isEmpty()
    rows = catalog.newest_rows(spark, SF001).limit(50).cache()
    from riskloom.operators.boosting import expected_margin
    total = {r.credit_id: r.s for r in explain.contributions(m, rows).groupBy("credit_id").agg(F.sum("contribution").alias("s")).collect()}
    score = {r.credit_id: r.risk_score for r in modeling.predict_proba(m, rows).select("credit_id", "risk_score").collect()}
    for key, s in total.items():
        assert 1 / (1 + np.exp(-(s + expected_margin(m.booster)))) == pytest.approx(score[key], abs=1e-10)
    top = explain.explain_top(m, rows, 5)
    assert top.count() == 5 * rows.count() and top.where("rank = 1 and contribution is null").isEmpty()
    assert len(explain.top_contributions(m, rows, 20).collect()) == 20
    best = modeling.feature_importance(m)
    assert best[0][1] == m.booster.split_counts().max() and len(best) == len(modeling.encoded_feature_names(m))
    assert os.path.exists(path)
