"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased, and what stands between runs of letters and
digits is made one space. An item of n code points may be found with up to `share` * n edits. It is split
into one piece more than that budget, so that at least one piece of any such
occurrence is unchanged. An Aho-Corasick automaton finds exact piece hits in
whole texts; each stretch around hits is verified with Myers' bit-parallel
distance of the whole item against any substring of the stretch. (First a count:
k edits leave all but GRAM * k of the item's runs of GRAM code points, so a
stretch with fewer of them can't hold it.)

An item too short for a single edit must stand between word borders, so that
"a" is not found inside of words. Items of fewer than LEAST code points match
nothing, as they stand in unrelated texts too.

The items of one batch make one broadcast of at most `batch_chars` code points
(or one item); a larger benchmark is matched in several passes over the texts, each
written down before the next, so that a worker holds one batch's automaton. Its
items' patterns are made when they are met, and RECENT of them are kept.

The automaton is the public package pyahocorasick, which workers need too.

Defined cases: null and empty texts match nothing, null and empty items (also
those without letters and digits) match nothing; repeated items match each under its
own item_id, which may be null; one row for each item and text, with the least distance and the
earliest end that has it; texts keep their rows, also repeated ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import Steps, only, small_batches

GRAM, LEAST, RECENT = 5, 8, 4096
_BETWEEN = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _BETWEEN.sub(" ", (text or "").lower()).strip()


def budget(item: str, share: float) -> int:
    return int(share * len(item))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Pattern:
    """Myers' algorithm in Python's long integers: distance of the whole pattern to any substring."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.last = 1 << (self.size - 1)
        self.full = (1 << self.size) - 1
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance and the first position (exclusive end) that has it."""
        up, down, distance, full, where = self.full, 0, self.size, self.full, self.where
        least, end = distance, 0
        for at, c in enumerate(text, 1):
            eq = where.get(c, 0)
            x = eq | down
            d0 = (((eq & up) + up) ^ up) | x
            plus = down | ~(d0 | up) & full
            minus = d0 & up
            if plus & self.last:
                distance += 1
            elif minus & self.last:
                distance -= 1
            plus = plus << 1 & full
            minus = minus << 1 & full
            up = minus | ~(d0 | plus) & full
            down = d0 & plus
            if distance < least:
                least, end = distance, at
        return least, end


class Matcher:
    """The automaton of all items' pieces; built where it is used."""

    def __init__(self, items: list[tuple[int | None, str]], share: float):
        import ahocorasick

        self.items = [(item_id, text, budget(text, share)) for item_id, text in items]
        self.known = lru_cache(RECENT)(self._known)
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                owners.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, held in owners.items():
            self.automaton.add_word(piece, (len(piece), held))
        self.automaton.make_automaton()

    def _known(self, number: int) -> tuple[Pattern, frozenset[str]]:
        text = self.items[number][1]
        return Pattern(text), frozenset(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))

    def matches(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """item_id, distance, budget and end of each item within its budget of some stretch of text."""
        starts: dict[int, set[int]] = {}
        for end, (size, held) in self.automaton.iter(text):
            for number, offset in held:
                starts.setdefault(number, set()).add(end + 1 - size - offset)
        out = []
        for number, found in starts.items():
            item_id, item, k = self.items[number]
            if k == 0:  # the one piece is the item
                whole = [at for at in sorted(found) if text[at - 1 : at] in ("", " ") and text[at + len(item) : at + len(item) + 1] in ("", " ")]
                out += [(item_id, 0, 0, whole[0] + len(item))] if whole else []
                continue
            exact = text.find(item)
            if exact >= 0:
                out.append((item_id, 0, k, exact + len(item)))
                continue
            pattern, grams = self.known(number)
            least, at, low, high = k + 1, 0, None, None
            for start in [*sorted(found), None]:  # starts that are close to each other share a stretch
                if low is not None and (start is None or start > high + 2 * k):
                    begin = max(0, low - k)
                    stretch = text[begin : high + len(item) + k]
                    needed = len(item) - GRAM + 1 - GRAM * k
                    if sum([stretch[i : i + GRAM] in grams for i in range(len(stretch) - GRAM + 1)]) >= needed:
                        distance, end = pattern.best(stretch)
                        if distance < least:
                            least, at = distance, begin + end
                    low = None
                if start is not None:
                    low, high = (start, start) if low is None else (low, start)
            if least <= k:
                out.append((item_id, least, k, at))
        return out


def item_batches(items: DataFrame, batch_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The plain items in lists of at most batch_chars code points, or of one hash bucket of items where that is larger.

    Buckets are so many that one holds an eighth of a list on average; their sizes alone decide which go together.
    """
    length = F.coalesce(F.length("text"), F.lit(0))
    total = items.agg(F.sum(length)).first()[0] or 0
    buckets = max(1, -(-8 * total // batch_chars)) if total > batch_chars else 1
    placed = items.withColumn("_bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)))
    groups: list[list[int]] = [[]]
    room = batch_chars
    for bucket, n in placed.groupBy("_bucket").agg(F.sum(length)).orderBy("_bucket").collect() if buckets > 1 else [(0, total)]:
        if n > room and groups[-1]:
            groups.append([])
            room = batch_chars
        groups[-1].append(bucket)
        room -= n
    for group in groups:
        some = placed if buckets == 1 else placed.filter(F.col("_bucket").isin(group))
        held = sorted(((r.item_id, plain(r.text)) for r in some.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield [(i, t) for i, t in held if len(t) >= LEAST]


def _per_batch(items: DataFrame, share: float, batch_chars: int):
    spark = items.sparkSession
    small_batches(spark)
    for held in item_batches(only(items, "item_id", "text"), batch_chars):
        shared = spark.sparkContext.broadcast((held, share))
        matcher: list[Matcher] = []

        def found(text: str | None, shared=shared, matcher=matcher) -> list[tuple[int, int, int, int]]:
            if not matcher:
                matcher.append(Matcher(*shared.value))
            return matcher[0].matches(plain(text)) if text and shared.value[0] else []

        yield found, shared


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.08, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, distance, budget, end_at (in the plain text) for each item found in a text."""
    parts, steps, used = [], Steps(docs.sparkSession), None
    for found, shared in _per_batch(items, share, batch_chars):
        if parts:
            parts[-1] = steps.settle(parts[-1])
            used.unpersist()
        used = shared

        def match(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in found(t.as_py())]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "distance", "budget", "end_at"])

        parts.append(only(docs, "doc_id", "text").mapInArrow(match, "doc_id long, item_id long, distance int, budget int, end_at long"))
    return reduce(DataFrame.unionByName, parts)


def drop_leaks(docs: DataFrame, items: DataFrame, share: float = 0.08, batch_chars: int = 4_000_000) -> DataFrame:
    """The documents, all columns, in which no test item is found; no shuffle."""
    at, steps, used = docs.columns.index("text"), Steps(docs.sparkSession), None
    for found, shared in _per_batch(items, share, batch_chars):
        if used is not None:  # what the batches so far leave is written, in place of what those before them left
            docs = steps.settle(docs)
            steps.done(docs)
            used.unpersist()
        used = shared

        def clean(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
