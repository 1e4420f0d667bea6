"""SimHash near-duplicates by BK-trees.

Distinct fingerprints are brought together by the permuted block tables of
`simhash` (fingerprints within the radius share at least one table key). Each
bucket is indexed by BK-trees whose children are keyed by their Hamming distance
to the parent; a search follows only edges within the radius of the distance to
the node. A tree holds at most about `tree_size` fingerprints. A bucket with
more is cut into shards: each shard's tree is sent to the tasks that hold the
bucket's other shards, and to no others. (Sending every tree to every task, as a
plain broadcast would, compares all with all; the block tables leave out only
pairs that can't be within the radius.)

Trees of many buckets grow level by level in numpy as one forest, and all
queries descend together, so small buckets cost no Python loop each. What comes
out of a bucket is a spanning star for each of its groups, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.components import connected_components
from tideline.llm.shared import Steps, fresh, look_up, text_or_empty
from tideline.llm.simhash import block_tables, explode_terms, hex16, lower_ascii, vote


class Forest:
    """BK-trees over `points` (uint64), one for each value of `unit` (sorted, from 0)."""

    def __init__(self, points: np.ndarray, unit: np.ndarray):
        n = len(points)
        self.points = points
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.full(int(unit.max()) + 1 if n else 0, -1, np.int64)
        self.root[unit[first]] = first
        parents, keys, kids = [], [], []
        waiting = np.ones(n, bool)
        waiting[first] = False
        item = np.flatnonzero(waiting)
        at = self.root[unit[item]]
        while len(item):  # each round places one child for each free edge and moves the others below it
            d = np.bitwise_count(points[item] ^ points[at]).astype(np.int64)
            edge = at * 65 + d
            _, start, inverse = np.unique(edge, return_index=True, return_inverse=True)
            child = item[start]
            parents.append(at[start])
            keys.append(d[start])
            kids.append(child)
            at = child[inverse]
            left = np.ones(len(item), bool)
            left[start] = False
            item, at = item[left], at[left]
        parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        edge = parent * 65 + (np.concatenate(keys) if keys else parent)
        order = np.argsort(edge, kind="stable")
        self.edge = edge[order]
        self.kid = np.concatenate(kids)[order] if kids else parent

    def within(self, query: np.ndarray, unit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index into query, index into points) within the radius, in portions."""
        who = np.arange(len(query))
        at = self.root[unit]
        who, at = who[at >= 0], at[at >= 0]
        while len(who):
            d = np.bitwise_count(query[who] ^ self.points[at]).astype(np.int64)
            hit = d <= radius
            yield who[hit], at[hit]
            low = np.searchsorted(self.edge, at * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, at * 65 + np.minimum(d + radius, 64), side="right")
            many = high - low
            who = np.repeat(who, many)
            start = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many)
            at = self.kid[start + np.arange(len(start))] if len(start) else at[:0]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each pair, and all that have their labels, one label: the least. In place."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label[:] = label[label]


def stars(points: np.ndarray, unit: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int, portion: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (a, b as indices of points) of the links between askers and tree members of one unit."""
    tree, ask = np.flatnonzero(in_tree), np.flatnonzero(asks)
    forest = Forest(points[tree], unit[tree])
    if len(forest.root) <= (top := int(unit.max())):
        forest.root = np.r_[forest.root, np.full(top + 1 - len(forest.root), -1)]
    label = np.arange(len(points))
    crowd = np.bincount(unit[tree], minlength=top + 1)
    cost = np.cumsum(crowd[unit[ask]])
    cut = np.flatnonzero(np.diff(cost // (portion * 2048))) + 1 if len(ask) else []
    for part in np.split(ask, cut):
        for q, p in forest.within(points[part], unit[part], radius):
            merge(label, part[q], tree[p])
    moved = np.flatnonzero(label != np.arange(len(points)))
    return moved, label[moved]


def _bucket_stars(radius: int, least: int = 200_000):
    """A mapInArrow function over rows sorted by unit: table, key, a, b, part, fingerprint."""

    def work(batch: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        cols = {n: batch.column(n).to_numpy() for n in batch.column_names}
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for n in ("table", "key", "a", "b"):
            new[1:] |= cols[n][1:] != cols[n][:-1]
        end = batch.num_rows if last else int(np.flatnonzero(new)[-1])
        rest = None if last else batch.slice(end)
        unit = np.cumsum(new[:end]) - 1
        size = np.bincount(unit)
        keep = size[unit] > 1
        if not keep.any():
            return None, rest
        unit = np.unique(unit[keep], return_inverse=True)[1]
        points = cols["fingerprint"][:end][keep].astype(np.int64).view(np.uint64)
        part, a, b = (cols[n][:end][keep] for n in ("part", "a", "b"))
        u, v = stars(points, unit, part == b, part == a, radius)
        return pa.RecordBatch.from_arrays([pa.array(points[u].view(np.int64)), pa.array(points[v].view(np.int64))], ["u", "v"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows >= least:
                out, held = work(held.combine_chunks(), False)
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            out, _ = work(held.combine_chunks(), True)
            if out is not None:
                yield out

    return run


def fingerprint_links(fingerprints: DataFrame, radius: int = 3, tree_size: int = 4096) -> DataFrame:
    """Edges u, v that connect just those distinct fingerprints that links of at most `radius` bits connect."""
    rows = block_tables(fingerprints.select("fingerprint").distinct(), "fingerprint", radius)
    crowded = rows.groupBy("table", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tree_size)
    crowded = crowded.select("table", "key", F.ceil(F.col("n") / tree_size).cast("int").alias("parts"))
    rows = rows.join(crowded, ["table", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("table", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fingerprint")
    unit = ["table", "key", "a", "b"]
    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_bucket_stars(radius), "u long, v long").distinct()


def shingle_fingerprints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A bit is 1 if over half the XXH64 values (seed 42) of the text's 3-word shingles have it."""
    rows = docs.select(*keys, lower_ascii(text_or_empty()).alias("_text"))
    return vote(explode_terms(rows, "_text", 3), keys)


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, text_hash, fingerprint (bigint) and component_id of each row of docs.

    Votes are counted once for each distinct text of an input partition, so a
    text that fills a third of the table costs no more than its partitions, and
    its votes can't overflow. Fingerprints and components come back to the rows by
    `look_up`, so no text or fingerprint fills a task.

    Defined cases: a null text is an empty one; texts without words all have
    fingerprint zero and so form one group; every row has a row here, also those
    that repeat others in full or that have no doc_id. An empty table gives an
    empty result. Texts are told apart by 64-bit hashes; where a component has no
    doc_id at all, its component_id is null.
    """
    steps = Steps(docs.sparkSession)
    keyed = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("text_hash"), F.spark_partition_id().alias("_part"))
    rows = steps.settle(keyed.drop("text", "_part"))
    votes = shingle_fingerprints(keyed, ["text_hash", "_part"])
    texts = steps.settle(votes.groupBy("text_hash").agg(F.min("fingerprint").alias("fingerprint")))
    owners = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"))
    texts = steps.settle(texts.join(owners.hint("merge"), "text_hash"))
    groups = steps.settle(texts.groupBy("fingerprint").agg(F.min("least").alias("least"), F.count("*").alias("texts")))
    roots = connected_components(fingerprint_links(groups, radius), "u", "v")
    joined = groups.join(roots.withColumnRenamed("node", "fingerprint").hint("merge"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("times"))
    of = steps.settle(look_up(joined.select("fingerprint", "texts", "root"), steps.settle(lowest), ["root"], "times", ["fingerprint"]).drop("root"))
    texts = steps.settle(look_up(texts, of, ["fingerprint"], "texts", ["text_hash"]).select("text_hash", "fingerprint", "component_id", "times"))
    out = look_up(rows, texts, ["text_hash"], "times", ["doc_id"])
    steps.done(rows, texts)
    return out.select("doc_id", "text_hash", "fingerprint", "component_id")


def report(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return near_duplicates(docs, radius).select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """One row of docs for each group: that with the smallest doc_id, rows without one last, then that with the least text hash.

    `marked` holds doc_id, text_hash and _root, which names a row's group and no other. Rows that repeat
    the kept one in full are told apart within the group. Texts are shuffled once.
    """
    number, none, text_hash, copy = fresh(docs, "_number", "_none", "_hash", "_copy")
    kept = marked.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
    id_of = lambda c: [F.coalesce(c, F.lit(0).cast("long")), c.isNull()]
    kept = kept.select(*[x.alias(n) for x, n in zip(id_of(F.col("k.doc_id")), (number, none), strict=True)], F.col("k.text_hash").alias(text_hash))
    keys = [number, none, text_hash]
    rows = docs.withColumns(dict(zip(keys, [*id_of(F.col("doc_id").cast("long")), F.xxhash64(text_or_empty())], strict=True))).join(kept.hint("merge"), keys)
    again = Window.partitionBy(*keys).orderBy(F.lit(0))
    return rows.withColumn(copy, F.row_number().over(again)).filter(F.col(copy) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One document of each group of three-word fingerprints that links of at most `radius` bits connect."""
    steps = Steps(docs.sparkSession)
    marked = near_duplicates(docs, radius)
    prints = steps.settle(marked.select("doc_id", "text_hash", "fingerprint"))
    groups = prints.select("fingerprint").distinct()
    roots = connected_components(fingerprint_links(groups, radius), "u", "v").select(F.col("node").alias("fingerprint"), F.col("root").alias("_root"))
    of = prints.join(roots.hint("merge"), "fingerprint", "left").select("doc_id", "text_hash", F.coalesce("_root", "fingerprint").alias("_root"))
    return first_of_groups(docs, of)
