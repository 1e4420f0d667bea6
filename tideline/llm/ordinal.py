"""Cumulative-link ordinal regression on hashed text features.

One weight per hashed feature, shared by all thresholds: a text's score s is the
sum of the weights of the features it has, and P(grade >= k) = sigmoid(s - t_k)
with t_1 < t_2 < ... Grades are the ordered distinct ratings of the labelled
rows, two or more. Features are present or absent, so neither length nor
repetition dilutes a rare one. Only features whose presence goes with the grade
(|correlation| * sqrt(rows) over `z`) get a weight.

The model is fitted on at most `sample` labelled rows, chosen by a hash of their
doc_id; scoring reads every text whole. Defined cases: a null text is empty;
labels without a document and null ratings don't count; a rating repeated for
one document counts each time; with no labels, or one grade only, every text
gets that grade (or grade 0) with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import fresh, only, small_batches
from tideline.llm.textvec import DIGIT, LETTER, MARK, Slice, mix, slices

BITS = 18
RATIO_STEPS = np.array([0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8])


def _index(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h, salt) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(doc, feature) of words and of their first 4, 5, 6 and 7 bytes: word families share a beginning."""
    is_word = s.kind == LETTER
    a, b, doc = s.start[is_word], s.end[is_word], s.doc[is_word]
    docs, found = [doc], [_index(s.hashes(a, b), 1)]
    for n in (4, 5, 6, 7):
        long = b - a >= n
        docs.append(doc[long])
        found.append(_index(s.hashes(a[long], a[long] + n), n))
    return np.concatenate(docs), np.concatenate(found)


def form_features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(doc, feature) of words and of runs of marks and digits."""
    return s.doc, _index(s.hashes(s.start, s.end), 11)


class Forms:
    """Shares that describe a text's form, summed over its slices: upper case, marks, digits, repeated words."""

    def __init__(self, rows: int):
        self.sum = np.zeros((6, rows))
        self.last = (-1, 0)  # document and hash of the last word: the next slice may go on with it

    def add(self, s: Slice) -> None:
        rows = self.sum.shape[1]
        length = s.end - s.start
        count = lambda of, w=None: np.bincount(s.doc[of], None if w is None else w[of], rows)
        word = s.kind == LETTER
        self.sum[0] += count(word)
        self.sum[1] += count(word & (s.upper[s.end] - s.upper[s.start] == length) & (length > 1))
        self.sum[2] += count(s.kind == MARK, length)
        self.sum[3] += count(s.kind == DIGIT, length)
        at = np.flatnonzero(word)
        h = s.hashes(s.start[at], s.end[at])
        same = np.flatnonzero((h[1:] == h[:-1]) & (s.doc[at][1:] == s.doc[at][:-1])) + 1
        self.sum[4] += np.bincount(s.doc[at[same]], None, rows)
        if len(at):
            if (int(s.doc[at[0]]), int(h[0])) == self.last:
                self.sum[4, self.last[0]] += 1
            self.last = (int(s.doc[at[-1]]), int(h[-1]))
        self.sum[5] += count(s.kind == MARK)

    def features(self) -> list[np.ndarray]:
        """For each row the numbers of its features: one for every step that a share is over."""
        words = np.maximum(self.sum[0], 1)
        shares = np.stack([self.sum[1] / words, self.sum[2] / words, self.sum[3] / words, self.sum[4] / words, self.sum[5] / words])
        over = shares[:, :, None] > RATIO_STEPS * np.array([1, 3, 1, 1, 2])[:, None, None]
        names = _index(np.arange(over.shape[0] * over.shape[2], dtype=np.uint64), 21).reshape(over.shape[0], over.shape[2])
        return [names[over[:, i]] for i in range(over.shape[1])]


def features(column: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and distinct features of each text, in order. kind: "words", or "forms" for words and form."""
    rows = len(column)
    place = np.zeros(1 << BITS, np.int64)
    forms = Forms(rows) if kind == "forms" else None
    ready = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def distinct(x: np.ndarray) -> np.ndarray:
        order = np.arange(len(x))
        place[x] = order
        return x[place[x] == order]

    def told(doc: np.ndarray, x: np.ndarray, until: int) -> Iterator[tuple[int, np.ndarray]]:
        ends = np.searchsorted(doc, np.arange(told.next, until), side="right")
        begin = 0
        for row, end in enumerate(ends, told.next):
            yield row, distinct(x[begin:end])
            begin = end
        told.next = until

    told.next = 0
    out: Iterator = iter(())
    held: list[tuple[int, np.ndarray]] = []
    for s in slices(column):
        if forms is not None:
            forms.add(s)
        doc, x = (form_features if forms is not None else word_features)(s)
        order = np.argsort(doc, kind="stable")
        doc, x = np.r_[ready[0], doc[order]], np.r_[ready[1], x[order]]
        if not len(doc):
            continue
        last = int(doc[-1])
        cut = int(np.searchsorted(doc, last))
        out = told(doc[:cut], x[:cut], last)
        if forms is None:
            yield from out
        else:
            held.extend(out)
        tail = distinct(x[cut:])  # the last text may go on in the next slice
        ready = np.full(len(tail), last), tail
    out = told(*ready, rows)
    if forms is None:
        yield from out
        return
    held.extend(out)
    for (row, x), y in zip(held, forms.features(), strict=True):
        yield row, distinct(np.r_[x, y])


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a piece's features, not a batch's, are in memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class Ordinal:
    """weights by feature, thresholds by grade, and the ratings that the grades stand for."""

    kind: str
    grades: list[float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for row, x in features(column, self.kind):
            out[row] = self.weights[x].sum(dtype=np.float64)
        return out


def fit(rows: list[np.ndarray], grade: np.ndarray, kind: str, grades: list[float], by_chance: float = 10, steps: int = 300, l2: float = 2e-3) -> Ordinal:
    """Adam on the mean log-loss; thresholds are a first value and positive gaps, so they stay in order."""
    model = Ordinal(kind, grades)
    k = len(grades) - 1
    if k < 1:
        return model
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    x = np.concatenate(rows)
    seen = np.bincount(x, minlength=1 << BITS)
    mean, spread = grade.mean(), grade.std()
    share = seen / n
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (np.bincount(x, grade[at], 1 << BITS) / n - share * mean) / (np.sqrt(share * (1 - share)) * spread)
    tested = seen > 2
    bound = np.sqrt(2 * np.log(max(tested.sum() / by_chance, 2)))
    strong = tested & (np.nan_to_num(np.abs(r), posinf=0) * np.sqrt(n) > bound)
    names = np.flatnonzero(strong)
    number = np.full(1 << BITS, -1)
    number[names] = np.arange(len(names))
    use = number[x] >= 0
    at, x = at[use], number[x[use]]
    w = np.zeros(len(names))
    above = np.array([(grade >= j).mean() for j in range(1, k + 1)])
    t = -np.log(above / (1 - above))
    u = np.r_[t[:1], np.log(np.maximum(np.diff(t), 1e-2))]
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    sigmoid = lambda q: 1 / (1 + np.exp(-np.clip(q, -40, 40)))
    for step in range(1, steps + 1):
        t = np.cumsum(np.r_[u[:1], np.exp(u[1:])])
        s = np.bincount(x, minlength=0) if not len(x) else np.bincount(at, w[x], n)
        s = np.zeros(n) if len(s) != n else s
        upper = np.where(grade > 0, sigmoid(s - t[np.maximum(grade, 1) - 1]), 1.0)  # P(y >= grade)
        lower = np.where(grade < k, sigmoid(s - t[np.minimum(grade, k - 1)]), 0.0)  # P(y >= grade + 1)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gs = -(du - dl) / n
        gt = np.zeros(k)
        np.add.at(gt, grade[grade > 0] - 1, du[grade > 0] / n)
        np.add.at(gt, grade[grade < k], -dl[grade < k] / n)
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.r_[np.bincount(x, gs[at], len(w)) + l2 * w / max(1, len(w)) if len(w) else [], tail[:1], tail[1:] * np.exp(u[1:])]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, u = w - move[: len(w)], u - move[len(w) :]
    model.weights[names] = w
    model.thresholds = np.cumsum(np.r_[u[:1], np.exp(u[1:])])
    return model


def train(docs: DataFrame, labels: DataFrame, rating: str, kind: str, sample: int = 12_000) -> Ordinal:
    """Fit on at most `sample` labelled rows; their features are found where the texts are.

    A label meets one document: of those that share its doc_id, that with the greatest text.
    """
    small_batches(docs.sparkSession)
    rated = only(labels, "doc_id", rating).filter(F.col(f"`{rating}`").isNotNull() & F.col("doc_id").isNotNull())
    chosen = rated.select("doc_id", F.col(f"`{rating}`").cast("double").alias("rating")).orderBy(F.xxhash64("doc_id"), "doc_id", "rating").limit(sample)
    held = only(docs, "doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    one = held.groupBy("doc_id").agg(F.max("text").alias("text"))  # copies meet within their partitions first
    rows = one.join(F.broadcast(chosen), "doc_id").select("rating", "text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = [f.astype(np.int32) for _, f in features(batch.column("text"), kind)]
            yield pa.RecordBatch.from_arrays([batch.column("rating"), pa.array(x, pa.list_(pa.int32()))], ["rating", "x"])

    got = rows.mapInArrow(found, "rating double, x array<int>").toArrow()
    y = got.column("rating").to_numpy()
    grades = sorted(set(y.tolist()))
    lists = got.column("x").combine_chunks()
    x = [r.values.to_numpy().astype(np.int64) for r in lists]
    return fit(x, np.searchsorted(grades, y), kind, grades)


def grade_texts(docs: DataFrame, model: Ordinal, expected: str, tail: str, at_least: int = 1) -> DataFrame:
    """docs with the expected rating and P(grade >= at_least), for every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 floats
    expected, tail = fresh(docs, expected, tail)

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        values = np.array(m.grades or [0.0])
        for batch in small(batches):
            if len(values) > 1:
                p = m.tails(m.score(batch.column(batch.schema.get_field_index("text"))))
                mean, over = values[0] + p @ np.diff(values), p[:, at_least - 1]
            else:
                mean, over = np.full(batch.num_rows, values[0]), np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean), pa.array(over)], names=[*batch.schema.names, expected, tail])

    schema = docs.select("*", F.lit(0.0).alias(expected), F.lit(0.0).alias(tail)).schema
    return docs.mapInArrow(graded, schema)
