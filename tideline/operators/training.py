"""Training of a linear classifier over all rows, with early stopping.

The model is a softmax regression on feature arrays. An epoch is one pass over
the table: every task adds up the gradient of its own rows and the confusion
counts of its held-out rows, both sums meet by position in one small shuffle,
and a row for each weight and each pair of classes comes to the driver, however
many rows there are. No row leaves its task, there are no samples, and a task
that is run again gives the same sums.

After each epoch the weights are scored on the held-out rows by weighted F1. The
best weights are kept; training ends after `patience` epochs in a row that are
not better, or after `epochs`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.steps import Steps

GRADIENT, PAIR, LOSS = 0, 1, 2


def weighted_f1(pairs: np.ndarray) -> float:
    """The F1 of each class weighted by its rows; pairs[truth, predicted] are counts. 0 without rows."""
    hits, support, guessed = np.diag(pairs), pairs.sum(1), pairs.sum(0)
    f1 = np.divide(2.0 * hits, support + guessed, out=np.zeros(len(pairs)), where=support + guessed > 0)
    return float((f1 * support).sum() / support.sum()) if support.sum() else 0.0


@dataclass
class Linear:
    weights: np.ndarray  # (classes, features + 1); the last column is added to every score
    best_epoch: int = 0
    history: list[tuple[int, float, float]] = field(default_factory=list)  # epoch, loss before it, held-out F1 after it

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:, :-1].T + self.weights[:, -1]


def usable(features: Column, size: int | None = None) -> Column:
    """Arrays of finite numbers, of the given size; null arrays and such with a null, NaN or infinite entry are not."""
    finite = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & (F.size(features) == size if size is not None else F.size(features) > 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, model: Linear) -> dict[tuple[int, int], float]:
    """Sums over all rows: the gradient, the loss and the number of rows to learn from, counts of held-out pairs."""
    classes = len(model.weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, pairs, loss, n = np.zeros_like(model.weights), np.zeros((classes, classes)), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            label, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            x = _matrix(batch.column(2))
            z = model.scores(x)
            np.add.at(pairs, (label[held], z[held].argmax(1)), 1)
            x, z, label = x[~held], z[~held], label[~held]
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            total = p.sum(1, keepdims=True)
            loss += float((np.log(total[:, 0]) - z[np.arange(len(z)), label]).sum())
            p /= total
            p[np.arange(len(p)), label] -= 1
            gradient[:, :-1] += p.T @ x
            gradient[:, -1] += p.sum(0)
            n += len(x)
        kinds = np.repeat([GRADIENT, PAIR, LOSS], [gradient.size, pairs.size, 2])
        at = np.concatenate([np.arange(gradient.size), np.arange(pairs.size), [0, 1]])
        values = np.concatenate([gradient.ravel(), pairs.ravel(), [loss, n]])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(at, pa.int32()), pa.array(values)], ["kind", "at", "value"])

    found = rows.mapInArrow(partial, "kind int, at int, value double").groupBy("kind", "at").agg(F.sum("value").alias("value"))
    return {(r.kind, r.at): r.value for r in found.collect()}


def fit(
    rows: DataFrame, held: Column, classes: int, features: str = "features", label: str = "label", epochs: int = 50, patience: int = 3, rate: float = 0.5, momentum: float = 0.9, decay: float = 0.0
) -> Linear:
    """The weights with the best F1 on the rows for which `held` is true; the others are learned from.

    Steps follow the mean gradient of all rows, with momentum, from weights of zero. Of equal scores the earlier epoch is
    the best. Rows whose label is null or not among 0 .. classes - 1, whose features are null, empty or not all finite, or
    for which `held` is null count for nothing; features of several lengths are an error, and so are no rows to learn from.
    Without held-out rows F1 is 0 in every epoch, so the first epoch's weights come out.
    """
    steps = Steps(rows.sparkSession)
    own = rows.select(F.col(f"`{label}`").cast("int").alias("label"), held.alias("held"), F.col(f"`{features}`").cast("array<double>").alias("x"))
    own = steps.settle(own.filter(F.col("label").between(0, classes - 1) & F.col("held").isNotNull() & usable(F.col("x"))))
    known = own.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.count_if(~F.col("held")).alias("n")).first()
    if not known["n"]:
        raise ValueError("no rows to learn from")
    if known["least"] != known["most"]:
        raise ValueError(f"features of {known['least']} to {known['most']} entries")
    model = Linear(np.zeros((classes, known["least"] + 1)))
    best, best_f1, speed = model.weights, -1.0, np.zeros_like(model.weights)
    losses: list[float] = []
    for epoch in range(epochs + 1):  # the pass that scores an epoch's weights also has the next one's gradient
        sums = _sums(own, model)
        if epoch:
            f1 = weighted_f1(np.array([sums[PAIR, i] for i in range(classes**2)]).reshape(classes, classes))
            model.history.append((epoch, losses[-1], f1))
            if f1 > best_f1:
                best, best_f1, model.best_epoch = model.weights, f1, epoch
            if epoch - model.best_epoch >= patience:
                break
        n = sums[LOSS, 1]
        losses.append(sums[LOSS, 0] / n)
        gradient = np.array([sums[GRADIENT, i] for i in range(model.weights.size)]).reshape(model.weights.shape) / n
        gradient[:, :-1] += decay * model.weights[:, :-1]
        speed = momentum * speed - rate * gradient
        model.weights = model.weights + speed
    model.weights = best
    steps.done()
    return model


def predict(rows: DataFrame, model: Linear, features: str = "features", name: str = "predicted_label") -> DataFrame:
    """rows with the class of the greatest score (of equal ones the first) as `name`; null where the features can't be used."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    weights = model.weights
    x = F.col(f"`{features}`").cast("array<double>")

    @F.pandas_udf("int")
    def classify(column):
        scores = np.stack(column.to_numpy()) @ weights[:, :-1].T + weights[:, -1]
        return type(column)(scores.argmax(1))

    size = weights.shape[1] - 1
    known = usable(x, size)
    guess = classify(F.when(known, x).otherwise(F.array_repeat(F.lit(0.0), size)))
    return rows.withColumn(name, F.when(known, guess))


def history(rows: DataFrame, model: Linear) -> DataFrame:
    """epoch, loss, f1, best: a row for each epoch."""
    found = [(e, loss, f1, e == model.best_epoch) for e, loss, f1 in model.history]
    return rows.sparkSession.createDataFrame(found, "epoch int, loss double, f1 double, best boolean")
