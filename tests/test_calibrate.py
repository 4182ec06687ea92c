"""Calibration and linear heads on small frames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import calibrate as ca


@pytest.mark.parametrize("true", [0.2, 1.0, 8.0])
def test_temperature_recovers_a_known_scale(spark, true):
    """Labels come in the shares that softmax(z / true) gives."""
    rows = []
    for z in ([0.3, 0.0, -0.2], [1.5, 0.4, 0.0], [4.0, 9.0, 0.0] if true > 1 else [0.1, 0.5, 0.0]):
        p = np.exp(np.array(z) / true)
        n = np.rint(p / p.sum() * 20_000).astype(int)
        rows += [(z, y, int(c)) for y, c in enumerate(n)]
    df = spark.createDataFrame(rows, "z array<double>, y int, c int").selectExpr("z", "y", "explode(sequence(1, c)) AS i")
    t = ca.fit_temperature(df, "z", "y").first()
    assert abs(t.temperature / true - 1) < 0.01


def test_temperature_bounds_and_no_rows(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0), ([1.0, 0.0], 0), (None, 0), ([1.0, 0.0], None)], "z array<double>, y int")
    assert math.isclose(ca.fit_temperature(df, "z", "y", bounds=(1e-3, 20.0)).first().temperature, 1e-3)
    assert ca.fit_temperature(df.limit(0), "z", "y").first().temperature is None


def test_temperature_takes_probabilities(spark):
    p = spark.createDataFrame([([0.7, 0.2, 0.1, 0.0],)], "p array<double>").select(
        ca.scale_probabilities(F.col("p"), F.lit(2.0)).alias("q")).first().q
    want = np.exp(np.log(np.array([0.7, 0.2, 0.1, 0.0]) + 1e-10) / 2)
    assert np.allclose(p, want / want.sum())


def plain_curve(xs, ys):
    """Best non-decreasing fit by its min-max formula, at the distinct scores."""
    pts = sorted({x: None for x in xs})
    s = [sum(y for x, y in zip(xs, ys) if x == p) for p in pts]
    n = [sum(1 for x in xs if x == p) for p in pts]
    k = range(len(pts))
    return pts, [max(min(sum(s[i:j + 1]) / sum(n[i:j + 1]) for j in k if j >= at) for i in k if i <= at) for at in k]


def test_isotonic_equals_the_formula_also_on_unseen_scores(spark):
    rng = np.random.default_rng(6)
    train = [(rng.dirichlet([1, 1, 1]).round(2).tolist(), int(rng.integers(0, 3))) for _ in range(150)]
    new = [([0.0, 0.15, 0.85],), ([1.0, 0.0, 0.0],), ([0.333, 0.334, 0.333],), ([0.0, 0.0, 0.0],)] + [(rng.dirichlet([1, 1, 1]).tolist(),) for _ in range(30)]
    curves = ca.fit_isotonic(spark.createDataFrame(train + [(None, 1), ([0.1, 0.2, 0.7], None)], "p array<double>, y int").repartition(4), "p", "y")
    out = ca.apply_isotonic(spark.createDataFrame(new, "p array<double>"), curves, "p").collect()
    for r in out:
        raw = []
        for c in range(3):
            xs, ys = plain_curve([p[c] for p, _ in train], [float(y == c) for _, y in train])
            raw.append(float(np.interp(r.p[c], xs, ys)))
        total = sum(raw)
        assert np.allclose(r.calibrated, [x / total if total > 1e-9 else x for x in raw])


def test_isotonic_knots_by_hand(spark):
    df = spark.createDataFrame([([0.1], 1), ([0.2], 0), ([0.5], 1), ([0.5], 1), ([0.9], 0)], "p array<double>, y int")
    curve = ca.fit_isotonic(df, "p", "y").first()
    assert curve.xs == [0.1, 0.2, 0.5, 0.9] and np.allclose(curve.ys, [0, 1 / 3, 1 / 3, 1])
    df = spark.createDataFrame([([x, 1 - x], 0 if x > 0.3 else 1) for x in (0.1, 0.2, 0.5, 0.9)], "p array<double>, y int")
    one = spark.createDataFrame([([x, 1.0],) for x in (0.15, 0.35, 1.0)], "p array<double>")
    first = ca.fit_isotonic(df, "p", "y").where("class_no = 0")
    got = [r.v for r in one.crossJoin(first).select(ca.on_curve(F.get("p", F.lit(0)), F.col("xs"), F.col("ys")).alias("v")).collect()]
    assert np.allclose(got, [0.0, 0.5, 1.0])


def test_equal_neighbours_leave_their_outer_corners():
    low, high, s, n = ca._pool([1, 2, 3, 4], [1, 2, 3, 4], [0, 0, 1, 2], [1, 1, 1, 2])
    assert (low, high, s, n) == ([1, 3], [2, 4], [0, 3], [2, 3])


def test_linear_head_separates(spark):
    rows = [([float(i % 2), 1.0 - i % 2, 0.1 * i], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "v array<double>, y int")
    w, b = ca.fit_linear_head(df, "v", "y")
    out = df.select("y", ca.linear_head(df, "v", w, b).alias("z")).collect()
    assert all((r.z[1] > r.z[0]) == bool(r.y) for r in out)


def test_text_classifier_reads_words_and_characters(spark):
    # the first two classes differ in words; the others have no word or pair of words in common, only parts
    rows = [("red apple and pear", "fruit"), ("green pear and plum", "fruit"), ("fast car and bus", "ride"), ("slow bus and tram", "ride")] * 6
    rows += [(f"{w}{chr(97 + i)}{chr(97 + i // 2)}", c) for w, c in (("printer", "device"), ("invoice", "money")) for i in range(20)]
    df = spark.createDataFrame([(t, c, i % 4 == 0) for i, (t, c) in enumerate(rows)] + [("unlabelled", None, False), (None, None, True)],
                               "t string, c string, test boolean")
    out = ca.fit_text_classifier(df.where("NOT test"), "t", ["c"], sizes=(500, 500), iterations=15)(df.where("test")).collect()
    known = [r for r in out if r.c is not None]
    assert len(out) == 17 and sum(r.c_label == r.c for r in known) >= 15
    assert all(abs(sum(r.c_probs) - 1) < 1e-6 and r.c_confidence == max(r.c_probs) for r in known)


def test_text_classifier_without_labels(spark):
    df = spark.createDataFrame([("a b", None)], "t string, c string")
    assert ca.fit_text_classifier(df, "t", ["c"], sizes=(10, 10))(df).first().c_label is None


def test_text_classifier_works_in_several_tasks(spark, monkeypatch):
    """Training texts and vectors lie in many partitions; rows without any term are answered, too."""
    seen = []

    class Fit(ca.LogisticRegression):
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return super().fit(df)
    monkeypatch.setattr(ca, "LogisticRegression", Fit)
    rows = [(f"{w} number {i}", c) for i in range(30) for w, c in (("pear", "fruit"), ("bus", "ride"))]
    df = spark.createDataFrame(rows, "t string, c string")
    more = spark.createDataFrame([("pear", 1), ("", 2), (None, 3)], "t string, k int")
    out = ca.fit_text_classifier(df, "t", ["c"], sizes=(50, 50), folds=2, iterations=5)(more).collect()
    assert seen and all(n == spark.sparkContext.defaultParallelism > 1 for n in seen)
    assert sorted(r.k for r in out) == [1, 2, 3] and {r.k: r.c_label for r in out}[1] == "fruit"


def test_least_hashed_rows(spark):
    df = spark.range(500).selectExpr("concat('t', id % 300) AS t", "id")
    want = sorted(r.t for r in df.orderBy(F.xxhash64("t"), "t").limit(77).collect())
    assert sorted(r.t for r in ca._least_hashed(df, "t", 77).collect()) == want
    assert ca._least_hashed(df, "t", 1000).count() == 500 and ca._least_hashed(df.limit(0), "t", 5).count() == 0


def test_tier_one_on_held_out_documents(spark):
    """Both axes, macro F1 of the language and its expected calibration error."""
    from ticketlake.operators import evaluate as ev
    from ticketlake.plans.q_features import q_tier1_logreg
    from ticketlake.session import cut_lineage
    out = cut_lineage(q_tier1_logreg(spark, "/root/testdata/sf0.01"))
    rows = out.collect()
    assert 380 <= len(rows) <= 420 and all(r.label and r.priority_label and 0 < r.priority_confidence <= 1 for r in rows)
    f1 = ev.macro_f1(out, "category", "label").first()[0]
    error = ev.ece(out.withColumn("ok", F.col("category") == F.col("label")), "confidence", "ok").first()[0]
    assert f1 >= 0.9 and error <= 0.1, (f1, error)


def test_all_labelled_rows_train(spark, monkeypatch):
    """counts and models come from every labelled row, not from the rows of smallest hash."""
    seen = []
    whole = ca._vocabularies
    monkeypatch.setattr(ca, "_vocabularies", lambda df, *a: seen.append(df.count()) or whole(df, *a))
    df = spark.range(10_400).select(F.concat(F.when(F.col("id") % 2 == 0, "pear ").otherwise("bus "), F.col("id")).alias("t"),
                                    F.when(F.col("id") % 2 == 0, "fruit").when(F.col("id") < 10_300, "ride").alias("c"))
    predict = ca.fit_text_classifier(df, "t", ["c"], sizes=(20, 20), folds=2, iterations=3)
    assert seen == [df.where("c IS NOT NULL").count()] == [10_350]
    assert {r.c_label for r in predict(df.limit(50)).collect()} == {"fruit", "ride"}
