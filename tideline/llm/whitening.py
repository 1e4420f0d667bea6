"""Whitening of embeddings: components of unit variance, without correlation.

Entries are put on an integer lattice, floor(64 * c) + 1000000, so that sums and centred vectors
are exact whatever the order of addition: with n rows and sums S, n * x - S is an integer, and
(n * x - S) / n is rounded once. Spark MLlib's RowMatrix adds up the products of the centred rows
(computeGramianMatrix); only the d by d matrix comes to the driver, where eigh splits it. The
whitening matrix (d by `most` numbers) is broadcast, and rows are projected in batches. Nothing is
grouped by row, id or vector, so hot ids and copies cost nothing.

Defined cases: a vector that is null or empty, or that holds null, NaN or infinite entries, is left
out; entries beyond 2**56 count as that; vectors of several lengths are an error, as they have no
covariance. Components whose eigenvalue is nothing but rounding are left out, so a single vector, or
copies of one, have no component and no row. An empty table gives an empty result. Repeated rows and
ids are rows of their own. deviation is null where it doesn't fit into a long; deviation_text has
it then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import settle, small_batches

FAR = 2.0**62
LONG = 2**63


def lattice(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The key and x, the lattice vector, of each row that has a usable vector."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(False))
    place = lambda c: F.floor(F.greatest(F.least(c.cast("double") * 64, F.lit(FAR)), F.lit(-FAR))) + F.lit(1_000_000).cast("long")
    return rows.filter(usable).select(F.col(key).alias("_id"), F.transform(vector, place).alias("x"))


@dataclass
class Fit:
    """n rows with sums S; values (eigenvalues, falling), vectors (a column for each), trace; exact: whether 64-bit integers hold all deviations."""

    n: int
    sums: list[int]
    exact: bool
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def centre(x: np.ndarray, n: int, sums: list[int], exact: bool) -> np.ndarray:
    """n * x - S, as integers: of 64 bits if exact, else of any size."""
    return n * x - np.array(sums, np.int64) if exact else n * x.astype(object) - np.array(sums, object)


def gramian(vectors: DataFrame, column: str) -> np.ndarray:
    """Sum over the rows of the outer products of an array<double> column, by MLlib."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def fit(points: DataFrame) -> Fit | None:
    """The components of points (_id, x); None if there are no rows."""
    each = points.select(F.posexplode("x").alias("i", "x")).groupBy("i")
    dims = sorted(each.agg(F.count("*").alias("n"), F.try_sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).collect())
    if not dims:
        return None
    n = dims[0]["n"]
    if any(r["n"] != n for r in dims):
        raise ValueError("the vectors have several lengths")
    sums = [r["s"] for r in dims]
    if None in sums:  # beyond a long
        sums = [int(r["s"]) for r in sorted(each.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect())]
    reach = [max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(dims, sums, strict=True)]
    exact = sum(d * d for d in reach) < LONG and all(n * max(abs(r["low"]), abs(r["high"])) < LONG for r in dims)

    def centred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"c": list((centre(np.stack(f["x"].to_numpy()), n, sums, exact) / n).astype(float))})

    covariance = gramian(points.select("x").mapInPandas(centred, "c array<double>"), "c") / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0.0) * len(values) * 2.0**-48
    trace = float(np.trace(covariance))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    return Fit(n, sums, exact, values[real], vectors[:, real], trace)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> tuple[DataFrame, Fit | None]:
    """_id, deviation, deviation_text and whitened (array<double>, a number for each component up to `most`) of each usable row."""
    small_batches(rows.sparkSession)
    points = lattice(rows, key, vector)
    kind = points.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, deviation long, deviation_text string, whitened array<double>"
    found = fit(points)
    if found is None:
        return points.sparkSession.createDataFrame([], schema), None
    n, sums, exact = found.n, found.sums, found.exact
    matrix = points.sparkSession.sparkContext.broadcast(found.vectors[:, :most] / np.sqrt(found.values[:most]))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            apart = centre(np.stack(f["x"].to_numpy()), n, sums, exact)
            total = [int(t) for t in (apart * apart).sum(1)]
            fits = pd.array([t if t < LONG else None for t in total], "Int64")
            text = [None if t < LONG else str(t) for t in total]
            yield pd.DataFrame({"_id": f["_id"], "deviation": fits, "deviation_text": text, "whitened": list((apart / n).astype(float) @ matrix.value)})

    return points.mapInPandas(project, schema), found


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest entry of the covariance of an array<double> column of k numbers minus the identity."""
    means = whitened.select(F.posexplode("whitened").alias("i", "w")).groupBy("i").agg((F.sum("w") / n).alias("m"))
    means = F.array(*[F.lit(r["m"]) for r in sorted(means.collect())])
    centred = whitened.select(F.zip_with("whitened", means, lambda w, m: w - m).alias("c"))
    return float(np.abs(gramian(centred, "c") / n - np.eye(k)).max())


def report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """A row for each usable row and component: the key, component (from 1), n, deviation, deviation_text, whitened, explained, identity_error."""
    out, found = whiten(rows, key, vector, most)
    kind = out.schema["_id"].dataType.simpleString()
    if found is None or not len(found.values):
        empty = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
        return out.sparkSession.createDataFrame([], empty)
    out = settle(out)
    k = min(most, len(found.values))
    worst = identity_error(out, found.n, k)
    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values[:k]])
    pairs = out.select("_id", "deviation", "deviation_text", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("i", "w"))
    return pairs.select(
        F.col("_id").alias(key), (F.col("i") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
        F.col("w.whitened").alias("whitened"), F.col("w.explained").alias("explained"), F.lit(worst).alias("identity_error"), "deviation_text",
    )
