"""Training across tasks against the same training on one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import metrics, training
from tideline.plans import catalogue


def one_machine(x, y, held, classes, epochs, patience, rate, momentum=0.9, decay=0.0):
    x1 = np.c_[x, np.ones(len(x))]
    w, v = np.zeros((classes, x1.shape[1])), np.zeros((classes, x1.shape[1]))
    best, best_f1, best_epoch, seen = w, -1.0, 0, []
    for epoch in range(1, epochs + 1):
        z = x1[~held] @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[np.arange(len(p)), y[~held]]).mean()
        g = (p - np.eye(classes)[y[~held]]).T @ x1[~held] / (~held).sum()
        g[:, :-1] += decay * w[:, :-1]
        v = momentum * v - rate * g
        w = w + v
        truth, guess = y[held], (x1[held] @ w.T).argmax(1)
        f1 = 0.0
        for c in range(classes):
            hit, sup, gue = ((truth == c) & (guess == c)).sum(), (truth == c).sum(), (guess == c).sum()
            f1 += (2 * hit / (sup + gue) if sup + gue else 0) * sup / max(1, len(truth))
        seen.append((epoch, loss, f1))
        if f1 > best_f1:
            best, best_f1, best_epoch = w, f1, epoch
        if epoch - best_epoch >= patience:
            break
    return best, best_epoch, seen


def rows_of(spark, x, y, held, parts):
    rows = [(i, int(b), bool(h), [float(v) for v in a]) for i, (a, b, h) in enumerate(zip(x, y, held, strict=True))]
    return spark.createDataFrame(rows, "id int, label int, held boolean, features array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_training_on_one_machine(spark, parts):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((3, 6))
    y = rng.integers(0, 3, 600)
    x = centre[y] + rng.standard_normal((600, 6))
    held = rng.random(600) < 0.3
    want, best, seen = one_machine(x, y, held, 3, 40, 4, 0.3, decay=0.01)
    rows = rows_of(spark, x, y, held, parts)
    model = training.fit(rows, F.col("held"), 3, epochs=40, patience=4, rate=0.3, decay=0.01)
    assert len(seen) < 40 and model.best_epoch == best == seen[-1][0] - 4
    np.testing.assert_allclose(model.weights, want, atol=1e-8)
    np.testing.assert_allclose(model.history, seen, atol=1e-8)
    guessed = training.predict(rows.filter("held"), model).withColumnRenamed("label", "truth")
    report = metrics.classification_report(metrics.pair_counts(guessed, "truth", "predicted_label")).filter("name = 'weighted avg'").first()
    assert abs(report.f1 - dict((e, f) for e, _, f in seen)[best]) < 1e-12
    assert [r.epoch for r in training.history(rows, model).filter("best").collect()] == [best]


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, False, [0.0, 1.0]), (1, False, [1.0, 0.0]), (0, True, [0.1, 1.0]), (1, True, [1.0, 0.2])]
    bad = [(None, False, [1.0, 1.0]), (2, False, [1.0, 1.0]), (-1, True, [1.0, 1.0]), (0, None, [1.0, 1.0]), (0, False, None), (0, True, []), (0, False, [nan, 1.0]), (1, False, [inf, 1.0]), (1, True, [None, 1.0])]
    schema = "label int, held boolean, features array<double>"
    one = training.fit(spark.createDataFrame(good, schema), F.col("held"), 2, epochs=5)
    two = training.fit(spark.createDataFrame(good + bad, schema), F.col("held"), 2, epochs=5)
    np.testing.assert_allclose(one.weights, two.weights, atol=1e-12)
    got = training.predict(spark.createDataFrame([*good, *bad, (0, True, [1.0])], schema), one).collect()
    assert [r.predicted_label for r in got] == [0, 1, 0, 1, *[got[4].predicted_label] * 4, *[None] * 6] and got[4].predicted_label is not None
    alone = training.fit(spark.createDataFrame(good[:2], schema), F.col("held"), 2, epochs=9, patience=2)
    assert alone.best_epoch == 1 and len(alone.history) == 3
    for rows, message in ((good[2:], "no rows"), ([], "no rows"), ([*good, (0, False, [1.0])], "entries")):
        with pytest.raises(ValueError, match=message):
            training.fit(spark.createDataFrame(rows, schema), F.col("held"), 2)
    with pytest.raises(ValueError):
        training.predict(spark.createDataFrame(good, schema), one, name="held")


def test_query(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label % 3 for r in rows])
    held = np.array([r.vec_id % 5 == 0 for r in rows])
    w, best, _ = one_machine(x, y, held, 3, 20, 3, 0.5)
    guess = (x @ w[:, :-1].T + w[:, -1]).argmax(1)
    got = sorted(tuple(r) for r in catalogue.queries()["early_stopped_training"](spark, sf).collect())
    assert got == [(r.vec_id, int(a), bool(h), int(g), best) for r, a, h, g in zip(rows, y, held, guess, strict=True)]
