"""Mixing sources to target weights by Pfair scheduling.

A source's rows are dealt in a fixed pseudo-random order into blocks of
`block_rows` rows. Of a source with weight w (the weights add up to 1), block j
is released at slot floor(j / w) and due before slot ceil((j + 1) / w); each slot
goes to the released block that is due first. On one slot at a time that meets
every deadline, so at every slot each source is less than one block from its
target share. Weights count exactly: they are taken as fractions, and releases
and deadlines are whole numbers worked out from those, not from rounded shares.

When a source ends, a phase ends: the others share the slots by their weights
anew, so that no row is dropped or repeated. Within a phase the bound holds for
the weights of the sources left.

The schedule follows from the numbers of blocks alone. It is the one step that
runs in one place, in pieces that are written to the shared folder; the rows meet
it by (source, block). Its memory is bounded by the sources and a piece; its time
follows the number of blocks, so a caller with a very large table may choose
larger ones. Blocks are of `block_rows` rows whatever the size of the table. Up to
SOURCES sources can be mixed; more are an error.

Defined cases: a null source is a source of its own; sources without a weight
get the least weight given; weights must be positive; an empty table gives an
empty result. Rows are ordered within a source by a hash of all their columns
(but maps), so rows that repeat in full are interchangeable.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.shared import fresh, shared_dir

NULL = "\0null"
SOURCES = 65_536
PIECE = 1 << 18


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*[x.denominator for x in exact.values()])
    return {s: x.numerator * (common // x.denominator) for s, x in exact.items()}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """source, block and slot of every block, slot by slot: the released block that is due first."""
    left = {s: n for s, n in blocks.items() if n}
    done, at = dict.fromkeys(left, 0), 0
    whole = whole_weights({s: weights[s] for s in left})
    total = sum(whole.values())
    while left:
        waiting = [(0, s, 0) for s in sorted(left)]  # release, source, block of the phase
        ready: list[tuple[int, str, int]] = []  # deadline, source, block
        dealt, slot, open_ = dict.fromkeys(left, 0), 0, True
        while open_:
            while waiting and waiting[0][0] <= slot:
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // whole[s]), s, j))
            _, s, j = heapq.heappop(ready)
            yield s, done[s] + j, at + slot
            slot += 1
            dealt[s] = j + 1
            if open_ := j + 1 < left[s]:
                heapq.heappush(waiting, ((j + 1) * total // whole[s], s, j + 1))
        at += slot
        for s, n in dealt.items():
            done[s] += n
            left[s] -= n
            if not left[s]:
                total -= whole[s]
                del left[s]


def default_weights(counts: dict[str, int]) -> dict[str, float]:
    """Square roots of the sources' sizes: flatter than the corpus, the large sources still ahead."""
    return {s: float(n) ** 0.5 for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 32, bucket_rows: int = 65_536, least_buckets: int = 1024) -> DataFrame:
    """docs, every row once, with `slot`, `block` (of its source), `place` in the block and `target_weight`.

    Ordered by (slot, place) the rows are the mix. Ranks within a source come
    from counts by hash bucket, so a source of any size is ranked in many tasks.
    """
    spark = docs.sparkSession
    slot, block, place, weight, src, order, bucket, rank, before = fresh(docs, "slot", "block", "place", "target_weight", "_source", "_order", "_bucket", "_rank", "_before")
    described = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    rows = docs.withColumns({src: F.coalesce(F.col("source"), F.lit(NULL)), order: F.xxhash64(*described)})
    found = rows.groupBy(src).agg(F.count("*").alias(rank)).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    counts = {r[0]: r[1] for r in found}
    given = dict(weights or default_weights(counts))
    floor = min(given.values(), default=1.0)
    given = {s: given.get(None if s == NULL else s, given.get(s, floor)) for s in counts}
    if any(w <= 0 for w in given.values()):
        raise ValueError("target weights must be positive")
    rows_in_all = sum(counts.values())
    plan = schedule({s: -(-n // block_rows) for s, n in counts.items()}, given)
    path, total, columns = shared_dir(spark), sum(given.values()), [src, block, slot]
    kind = f"`{src}` string, `{block}` long, `{slot}` long, `{weight}` double"
    spark.createDataFrame([], kind).write.parquet(path)
    while piece := list(islice(plan, PIECE)):
        held = [*map(list, zip(*piece, strict=True)), [given[p[0]] / total for p in piece]]
        spark.createDataFrame(pa.table(held, names=[*columns, weight]), kind).write.mode("append").parquet(path)
    placed = spark.read.schema(kind).parquet(path)
    buckets = max(least_buckets, -(-rows_in_all // bucket_rows))
    rows = rows.withColumn(bucket, F.pmod(F.col(order), F.lit(buckets)))
    sizes = rows.groupBy(src, bucket).agg(F.count("*").alias(rank))
    earlier = F.sum(rank).over(Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(src, bucket, F.coalesce(earlier, F.lit(0)).alias(before))
    within = F.row_number().over(Window.partitionBy(src, bucket).orderBy(order))
    ranked = rows.withColumn(rank, within - 1).join(sizes, [src, bucket]).withColumn(rank, F.col(rank) + F.col(before))
    ranked = ranked.withColumn(block, F.floor(F.col(rank) / block_rows)).join(placed, [src, block])
    return ranked.select(*[F.col(f"`{c}`") for c in docs.columns], slot, block, F.pmod(F.col(rank), F.lit(block_rows)).alias(place), weight)
