"""The registered queries of the interval, signal and curation operators, and their DuckDB SQL.

The driver tables stand in for recordings: `events` has a recording for each
user, a source for each event type and intervals of `value` minutes from `ts`;
times are whole microseconds. `embeddings` holds signals of 64 samples. Every
query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import arrays, text
from tideline.operators import chunks, curation, drivers, intervals, labels, metrics, relational, signals, stretch, sweeps, training
from tideline.operators.runs import Run
from tideline.operators.steps import settle, shared_dir
from tideline.sources import text as annotations
from tideline.sources.parts import write_parts_once
from tideline.streaming import state

US = 1_000_000
CHUNK = 6 * 3600 * US
CELL = 24 * 3600 * US
SOURCES = ("click", "view", "error")
KEY = ["user_id"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- intervals


def events_iv(spark: SparkSession, sf: str, *sources: str) -> DataFrame:
    """user_id, source, start, end; all sources, or the given ones."""
    e = table(spark, sf, "events")
    if sources:
        e = e.filter(F.col("event_type").isin(*sources))
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    iv = e.select("user_id", F.col("event_type").alias("source"), start.alias("start"), (start + F.round(F.col("value") * 60e6).cast("bigint")).alias("end"))
    return intervals.well_formed(iv)


def total_span(iv: DataFrame) -> DataFrame:
    return iv.groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


IV = """iv AS (
  SELECT user_id, event_type AS source, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60e6) AS BIGINT) AS e
  FROM events WHERE CAST(round(value * 60e6) AS BIGINT) > 0)"""
SPAN = "span AS (SELECT user_id, min(s) AS s, max(e) AS e FROM iv WHERE {where} GROUP BY user_id)"


def islands(name: str, keys: str, source: str, where: str = "true") -> str:
    """Union of each key's intervals by the running greatest end."""
    return f"""{name} AS (
  SELECT {keys}, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(CASE WHEN s <= top THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM (
      SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM {source} WHERE {where}))
  GROUP BY {keys}, isle)"""


def classes(sources: str, most: int) -> str:
    """cls(user_id, n, s, e): how many of the sources are active, by counting at every elementary stretch."""
    return f"""WITH {IV}, {islands('solid', 'user_id, source', 'iv', f"source IN ({sources})")},
{SPAN.format(where=f"source IN ({sources})")},
pts AS (SELECT user_id, s AS t FROM solid UNION SELECT user_id, e FROM solid UNION SELECT user_id, s FROM span UNION SELECT user_id, e FROM span),
el AS (SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e FROM pts),
cnt AS (
  SELECT el.user_id, el.s, el.e, least(count(solid.s), {most}) AS n
  FROM el LEFT JOIN solid ON solid.user_id = el.user_id AND solid.s <= el.s AND solid.e >= el.e
  WHERE el.e IS NOT NULL GROUP BY ALL),
cls AS (
  SELECT user_id, n, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY user_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM cnt))
  GROUP BY user_id, n, g)"""


THREE, TWO = "'click', 'view', 'error'", "'click', 'view'"


@query(classes(THREE, 2) + "SELECT user_id, CAST(n AS INTEGER) AS n_active, CAST(sum(e - s) AS BIGINT) AS micros FROM cls GROUP BY ALL")
def speaker_count_durations(spark: SparkSession, sf: str) -> DataFrame:
    iv = events_iv(spark, sf, *SOURCES)
    cls = intervals.active_classes(iv, total_span(iv), KEY, "source", 2, CELL)
    return cls.groupBy("user_id", F.col("cls").cast("int").alias("n_active")).agg(F.sum(F.col("end") - F.col("start")).alias("micros"))


def _solid(spark: SparkSession, sf: str, source: str) -> DataFrame:
    return intervals.merge(events_iv(spark, sf, source), KEY, CELL)


def _pairs(a: str, b: str) -> str:
    return f"SELECT a.user_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM {a} a JOIN {b} b ON a.user_id = b.user_id AND greatest(a.s, b.s) < least(a.e, b.e)"


_SOLIDS = ",\n".join(islands(x, "user_id", "iv", f"source = '{x}'") for x in ("click", "view", "error"))


@query(f'WITH {IV}, {_SOLIDS} SELECT user_id, s AS start_us, e AS end_us FROM ({_pairs("click", "view")})')
def iv_intersect(spark: SparkSession, sf: str) -> DataFrame:
    out = intervals.intersect(_solid(spark, sf, "click"), _solid(spark, sf, "view"), KEY, CELL)
    return out.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f'WITH {IV}, {_SOLIDS}, two AS ({_pairs("click", "view")}) SELECT user_id, s AS start_us, e AS end_us FROM ({_pairs("two", "error")})')
def iv_intersect3(spark: SparkSession, sf: str) -> DataFrame:
    two = intervals.intersect(_solid(spark, sf, "click"), _solid(spark, sf, "view"), KEY, CELL)
    out = intervals.intersect(two, _solid(spark, sf, "error"), KEY, CELL)
    return out.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"WITH {IV}, {islands('m', 'user_id', 'iv')} SELECT user_id, s AS start_us, e AS end_us FROM m")
def iv_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge(events_iv(spark, sf), KEY, CELL).select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(
    f"WITH {IV}, {islands('m', 'user_id', 'iv')} SELECT user_id, e AS start_us, nxt AS end_us FROM "
    "(SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt FROM m) WHERE nxt IS NOT NULL"
)
def iv_complement(spark: SparkSession, sf: str) -> DataFrame:
    iv = events_iv(spark, sf)
    return intervals.complement(iv, total_span(iv), KEY, CELL).select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(
    f"WITH {IV}, {islands('m', 'user_id', 'iv')} SELECT user_id, count(*) AS n_speech, CAST(sum(e - s) AS BIGINT) AS speech_us, "
    "CAST(max(e) - min(s) - sum(e - s) AS BIGINT) AS silence_us FROM m GROUP BY user_id"
)
def iv_array_form(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and lengths of the array form, from the sweep's rows: no recording becomes one array."""
    iv = events_iv(spark, sf)
    labels_ = intervals.labelled_segments(iv, KEY, lambda d: F.array((d > 0).cast("int")), total_span(iv), CELL)
    of = lambda speech: F.when(F.col("label") == speech, F.col("end") - F.col("start"))
    zero = F.lit(0).cast("long")
    return labels_.groupBy("user_id").agg(F.count(of(1)).alias("n_speech"), F.coalesce(F.sum(of(1)), zero).alias("speech_us"), F.coalesce(F.sum(of(0)), zero).alias("silence_us"))


@query(classes(TWO, 2) + "SELECT user_id, ['non_speech', 'one_spk', 'two_spk'][n + 1] AS label, s AS start_us, e AS end_us FROM cls")
def labels_2src(spark: SparkSession, sf: str) -> DataFrame:
    iv = events_iv(spark, sf, "click", "view")
    return intervals.speaker_labels(iv, total_span(iv), KEY, "source", 2, CELL).select("user_id", "label", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(
    classes(THREE, 3) + ",\nmany AS (SELECT user_id, s, e FROM cls WHERE n >= 2), " + islands("both_", "user_id", "many") + """
SELECT user_id, ['non_speech', 'one_spk', 'two_spk', 'three_spk'][n + 1] AS label, s AS start_us, e AS end_us FROM cls
UNION ALL SELECT user_id, 'two_or_three_spk', s, e FROM both_"""
)
def labels_3src(spark: SparkSession, sf: str) -> DataFrame:
    iv = events_iv(spark, sf, *SOURCES)
    return intervals.speaker_labels(iv, total_span(iv), KEY, "source", 3, CELL).select("user_id", "label", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_kept FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <> l_quantity GROUP BY o_orderkey")
def zero_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("start"), F.col("l_quantity").cast("double").alias("end"))).alias("iv"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return joined.select("o_orderkey", F.coalesce(F.size(arrays.drop_empty(F.col("iv"))), F.lit(0)).cast("long").alias("n_kept"))


# ------------------------------------------------------------------- chunks


def from_start(spark: SparkSession, sf: str, sources: int) -> tuple[DataFrame, DataFrame]:
    """The sources' intervals, counted from each recording's start, and the recordings: user_id, duration.

    The recordings' spans are settled, so that events are read twice: for them, and for the intervals.
    """
    iv = events_iv(spark, sf, *SOURCES[:sources])
    span = settle(total_span(iv).select("user_id", F.col("start").alias("t0"), (F.col("end") - F.col("start")).alias("duration")))
    moved = iv.join(span.select("user_id", "t0"), "user_id").withColumns({"start": F.col("start") - F.col("t0"), "end": F.col("end") - F.col("t0")}).drop("t0")
    return moved, span.select("user_id", "duration")


def labelled(spark: SparkSession, sf: str, sources: int) -> tuple[DataFrame, DataFrame]:
    """Labels with their priority, and the recordings' durations."""
    iv, rec = from_start(spark, sf, sources)
    spans = rec.select("user_id", F.lit(0).cast("long").alias("start"), F.col("duration").alias("end"))
    cls = intervals.active_classes(iv, spans, KEY, "source", sources, CELL)
    return cls.select("user_id", F.get(F.array(*map(F.lit, intervals.SPEAKERS)), F.col("cls").cast("int")).alias("label"), (F.col("cls") + 1).cast("int").alias("priority"), "start", "end"), rec


def _labels_sql(sources: str, most: int) -> str:
    return (
        classes(sources, most)
        + """,
rec AS (SELECT user_id, s AS t0, e - s AS dur FROM span),
lab AS (SELECT cls.user_id, n, s - t0 AS s, e - t0 AS e FROM cls JOIN rec USING (user_id))"""
    )


def _chunk_sql(sources: str, most: int, n: str) -> str:
    return (
        _labels_sql(sources, most)
        + f""",
grid AS (SELECT user_id, unnest(range(CAST({n} AS BIGINT))) AS chunk FROM rec WHERE {n} > 0),
part AS (
  SELECT grid.user_id, chunk, n, sum(least(e, (chunk + 1) * {CHUNK}) - greatest(s, chunk * {CHUNK})) AS d
  FROM grid JOIN lab ON lab.user_id = grid.user_id AND s < (chunk + 1) * {CHUNK} AND e > chunk * {CHUNK} GROUP BY ALL)"""
    )


_MAJORITY = """,
best AS (SELECT *, d = max(d) OVER (PARTITION BY user_id, chunk) AS top FROM part)
SELECT grid.user_id, grid.chunk, ['non_speech', 'one_spk', 'two_spk', 'three_spk'][min(n) FILTER (WHERE top) + 1] AS label,
       CAST(count(*) FILTER (WHERE top) AS INTEGER) AS n_tied
FROM grid LEFT JOIN best ON best.user_id = grid.user_id AND best.chunk = grid.chunk GROUP BY grid.user_id, grid.chunk"""
_DROPPED = f"((dur + {CHUNK} - 1) // {CHUNK} - 1)"


@query(_chunk_sql(TWO, 2, _DROPPED) + _MAJORITY)
def chunk_majority(spark: SparkSession, sf: str) -> DataFrame:
    own, rec = labelled(spark, sf, 2)
    return chunks.majority(own, chunks.grid(rec, KEY, "duration", CHUNK), KEY, CHUNK)


@query(_chunk_sql(THREE, 3, _DROPPED) + _MAJORITY)
def chunk_majority_3src(spark: SparkSession, sf: str) -> DataFrame:
    own, rec = labelled(spark, sf, 3)
    return chunks.majority(own, chunks.grid(rec, KEY, "duration", CHUNK), KEY, CHUNK)


@query(
    _chunk_sql(TWO, 2, f"(dur // {CHUNK})")
    + """,
sums AS (SELECT grid.user_id, grid.chunk, coalesce(sum(d) FILTER (n = 0), 0) AS a, coalesce(sum(d) FILTER (n = 1), 0) AS b, coalesce(sum(d) FILTER (n = 2), 0) AS c
  FROM grid LEFT JOIN part ON part.user_id = grid.user_id AND part.chunk = grid.chunk GROUP BY grid.user_id, grid.chunk)
SELECT user_id, chunk, CASE WHEN a > b AND a > c THEN 'non_speech' WHEN b > a AND b > c THEN 'one_spk' ELSE 'two_spk' END AS label FROM sums"""
)
def chunk_sparse_rule(spark: SparkSession, sf: str) -> DataFrame:
    own, rec = labelled(spark, sf, 2)
    return chunks.sparse_rule(own, chunks.grid(rec, KEY, "duration", CHUNK, "full"), KEY, CHUNK)


@query(
    f"""WITH {IV}, src AS (SELECT * FROM iv WHERE source IN ({THREE})), rec AS (SELECT user_id, min(s) AS t0, max(e) - min(s) AS dur FROM src GROUP BY user_id),
grid AS (SELECT user_id, t0, unnest(range(CAST((dur + {CHUNK} - 1) // {CHUNK} AS BIGINT))) AS chunk FROM rec)
SELECT grid.user_id, chunk, CAST(least(count(src.s), 2) AS INTEGER) AS label
FROM grid LEFT JOIN src ON src.user_id = grid.user_id AND src.s - t0 < (chunk + 1) * {CHUNK} AND src.e - t0 > chunk * {CHUNK} GROUP BY grid.user_id, chunk"""
)
def chunk_overlap_count(spark: SparkSession, sf: str) -> DataFrame:
    iv, rec = from_start(spark, sf, 3)
    return chunks.overlap_count(iv, chunks.grid(rec, KEY, "duration", CHUNK, "keep"), KEY, CHUNK)


#: Times in seconds as doubles; every other start is on a border of cells and chunks.
_SECONDS = f"""sec AS (SELECT user_id, source, CASE WHEN s % 2 = 0 THEN floor(s / 1e6 / 3600) * 3600e0 ELSE s / 1e6 END AS s, e / 1e6 AS e FROM iv),
src AS (SELECT * FROM sec WHERE source IN ({TWO}) AND s < e)"""


def seconds_iv(spark: SparkSession, sf: str) -> DataFrame:
    iv = events_iv(spark, sf, "click", "view")
    hour = F.floor(F.col("start") / F.lit(1e6) / 3600) * F.lit(3600.0)
    return iv.withColumns({"start": F.when(F.col("start") % 2 == 0, hour).otherwise(F.col("start") / F.lit(1e6)), "end": F.col("end") / F.lit(1e6)})


@query(f"""WITH {IV}, {_SECONDS} SELECT a.user_id, greatest(a.s, b.s) AS start_s, least(a.e, b.e) AS end_s
FROM src a JOIN src b ON a.user_id = b.user_id AND a.source = 'click' AND b.source = 'view' AND greatest(a.s, b.s) < least(a.e, b.e)""")
def iv_intersect_seconds(spark: SparkSession, sf: str) -> DataFrame:
    iv = seconds_iv(spark, sf)
    out = intervals.intersect(iv.filter("source = 'click'"), iv.filter("source = 'view'"), KEY, 3600.0)
    return out.select("user_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query(f"WITH {IV}, {_SECONDS}, {islands('m', 'user_id', 'src')} SELECT user_id, s AS start_s, e AS end_s FROM m")
def iv_merge_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge(seconds_iv(spark, sf), KEY, 86400.0).select("user_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


#: Chunks of 0.6 s: an event is labelled by its type and lasts value / 50 s from 0, 0.1, ... 59.9 s on; many end on chunk borders.
_TENTHS = """lab AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'non_speech' WHEN 'view' THEN 'one_spk' ELSE 'two_spk' END AS label,
(event_id % 600) / 10e0 AS s, (event_id % 600 + event_id // 600 % 20) / 10e0 AS e FROM events WHERE event_id IS NOT NULL),
grid AS (SELECT user_id, c AS chunk, round(c * 0.6e0, 1) AS b, round((c + 1) * 0.6e0, 1) AS f FROM (SELECT DISTINCT user_id FROM lab) t, range(100) r(c))"""


@query(f"""WITH {_TENTHS}, p AS (SELECT user_id, chunk, label, list_reduce(list(least(e, f) - greatest(s, b) ORDER BY greatest(s, b), least(e, f)), lambda x, y: x + y) AS d
FROM grid JOIN lab USING (user_id) WHERE greatest(s, b) < least(e, f) GROUP BY ALL),
q AS (SELECT user_id, chunk, coalesce(max(d) FILTER (label = 'non_speech'), 0) AS non, coalesce(max(d) FILTER (label = 'one_spk'), 0) AS one, coalesce(max(d) FILTER (label = 'two_spk'), 0) AS two FROM grid LEFT JOIN p USING (user_id, chunk) GROUP BY ALL)
SELECT user_id, chunk, CASE WHEN non > one AND non > two THEN 'non_speech' WHEN one > non AND one > two THEN 'one_spk' ELSE 'two_spk' END AS label FROM q""")
def chunk_sparse_tenths(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse rule on chunks of 0.6 s, whose borders are rounded to tenths, with labels that end on chunk borders."""
    e = table(spark, sf, "events").filter("event_id is not null and user_id is not null")
    label = F.when(F.col("event_type") == "click", "non_speech").when(F.col("event_type") == "view", "one_spk").otherwise("two_spk")
    start = F.col("event_id") % 600
    length = F.floor(F.col("event_id") / 600) % 20
    lab = e.select("user_id", label.alias("label"), (start / F.lit(10.0)).alias("start"), ((start + length) / F.lit(10.0)).alias("end"))
    grid = chunks.grid(e.select("user_id").distinct().withColumn("duration", F.lit(60.0)), KEY, "duration", 0.6, "full")
    return chunks.sparse_rule(lab, grid, KEY, 0.6, decimals=1)


@query(f"""WITH {IV}, {_SECONDS}, hits AS (SELECT user_id, CAST(floor(s / 3600) AS BIGINT) + i AS chunk, s, e FROM src, range(60) r(i))
SELECT user_id, chunk, CAST(least(count(*), 2) AS INTEGER) AS label FROM hits WHERE s < (chunk + 1) * 3600e0 AND e > chunk * 3600e0 GROUP BY ALL""")
def chunk_overlap_seconds(spark: SparkSession, sf: str) -> DataFrame:
    iv = seconds_iv(spark, sf)
    met = chunks.overlaps(iv, KEY, 3600.0).select("user_id", "chunk").distinct()
    return chunks.overlap_count(iv, met, KEY, 3600.0)


@query(
    _labels_sql(TWO, 2)
    + f""",
own AS (SELECT user_id, n, s, e FROM lab UNION ALL SELECT user_id, 9, s, e FROM lab WHERE n = 1),
met AS (SELECT user_id, unnest(range(s // {CHUNK}, (e - 1) // {CHUNK} + 1)) AS chunk, n, s, e FROM own),
cut AS (SELECT user_id, chunk, n, greatest(s, chunk * {CHUNK}) AS s, least(e, (chunk + 1) * {CHUNK}) AS e FROM met)
SELECT user_id, chunk, ['non_speech', 'one_spk', 'two_spk'][min(n) + 1] AS label, s AS start_us, e AS end_us FROM cut WHERE s < e GROUP BY user_id, chunk, s, e"""
)
def closed_overlap_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every one_spk interval is there twice, the second time under another label: the first stays."""
    own, _ = labelled(spark, sf, 2)
    twice = own.unionByName(own.filter("label = 'one_spk'").withColumns({"label": F.lit("other"), "priority": F.lit(9)}))
    return chunks.labels_in_chunks(twice, KEY, CHUNK).select("user_id", "chunk", "label", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(
    """WITH g AS (SELECT doc_id, unnest(range(CAST(ceil(n_chars / 1000.0) AS BIGINT))) AS i FROM documents WHERE n_chars > 0)
SELECT doc_id, i AS chunk,
  concat_ws('_', doc_id, round(i * 0.6::DOUBLE, 3), round(i * 0.6::DOUBLE + 0.6::DOUBLE, 3)) AS rounded_name,
  concat_ws('_', doc_id, round(i * 0.6::DOUBLE, 1), round((i + 1) * 0.6::DOUBLE, 1)) AS sparse_name,
  concat_ws('_', doc_id, i * 0.6::DOUBLE, i * 0.6::DOUBLE + 0.6::DOUBLE) AS plain_name FROM g"""
)
def chunk_names(spark: SparkSession, sf: str) -> DataFrame:
    grid = chunks.grid(table(spark, sf, "documents"), ["doc_id"], "n_chars", 1000, "keep")
    name, i = F.col("doc_id").cast("string"), F.col("chunk")
    return grid.select("doc_id", "chunk", text.chunk_name(name, i, 0.6).alias("rounded_name"), text.sparse_chunk_name(name, i, 0.6).alias("sparse_name"), text.chunk_name(name, i, 0.6, None).alias("plain_name"))


# ------------------------------------------------------------------ signals


def _signal_rows(df: DataFrame, cut: Column) -> DataFrame:
    parts = df.select("vec_id", F.posexplode(cut).alias("chunk", "x"))
    return parts.select("vec_id", F.col("chunk").cast("int").alias("chunk"), F.size("x").alias("n"), F.get("x", 0).alias("first_amp"), F.element_at("x", -1).alias("last_amp"))


def _cut_sql(n: str, size: int) -> str:
    return (
        f"WITH g AS (SELECT vec_id, embedding AS a, unnest(range(CAST({n} AS BIGINT))) AS chunk FROM embeddings), "
        f"c AS (SELECT vec_id, chunk, a[chunk * {size} + 1 : (chunk + 1) * {size}] AS x FROM g) "
        "SELECT vec_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(x) AS INTEGER) AS n, x[1] AS first_amp, x[len(x)] AS last_amp FROM c"
    )


@query(_cut_sql("len(embedding) // 24", 24))
def signal_chunks_full(spark: SparkSession, sf: str) -> DataFrame:
    return _signal_rows(table(spark, sf, "embeddings"), arrays.full_chunks(F.col("embedding"), 24))


@query(_cut_sql("ceil(len(embedding) / 24.0)", 24))
def signal_chunks_tail(spark: SparkSession, sf: str) -> DataFrame:
    return _signal_rows(table(spark, sf, "embeddings"), arrays.tail_chunks(F.col("embedding"), 24))


def _ranges(*pairs: tuple[float, float]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in pairs])


@query(
    "WITH s AS (SELECT vec_id, embedding AS a, unnest([{'k': 0, 'f': 8, 't': 24}, {'k': 1, 'f': 40, 't': 56}]) AS r FROM embeddings) "
    "SELECT vec_id, CAST(r.k AS INTEGER) AS chunk, 16 AS n, a[r.f + 1] AS first_amp, a[r.t] AS last_amp FROM s"
)
def segment_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _signal_rows(table(spark, sf, "embeddings"), curation.segments_of(F.col("embedding"), _ranges((0.5, 1.5), (2.5, 3.5)), 16))


_POWER = "list_sum(list_transform(embedding[{a}:{b}], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


def _power_of(*pairs: tuple[float, float]) -> Column:
    return arrays.power(F.flatten(curation.segments_of(F.col("embedding"), _ranges(*pairs), 16)))


@query(f"SELECT vec_id, round(({_POWER.format(a=1, b=16)} + {_POWER.format(a=33, b=48)}) / 32, 9) AS power FROM embeddings")
def signal_power(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(_power_of((0.0, 1.0), (2.0, 3.0)), 9).alias("power"))


@query(
    f"SELECT vec_id, round(10 * log10({_POWER.format(a=17, b=32)} / {_POWER.format(a=1, b=16)}), 6) AS one_spk_snr, "
    f"round(10 * log10({_POWER.format(a=33, b=64)} / 2 / {_POWER.format(a=1, b=16)}), 6) AS two_spk_snr FROM embeddings"
)
def snr(spark: SparkSession, sf: str) -> DataFrame:
    noise = _power_of((0.0, 1.0))
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.snr(_power_of((1.0, 2.0)), noise), 6).alias("one_spk_snr"), F.round(arrays.snr(_power_of((2.0, 4.0)), noise), 6).alias("two_spk_snr"))


@query(
    "SELECT vec_id, 40 AS n_cut, embedding[40] AS last_cut, 100 AS n_padded, embedding[64] AS at_63, CAST(0 AS FLOAT) AS at_99 FROM embeddings"
)
def pad_truncate(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("embedding")
    cut, padded = arrays.pad_truncate(a, 40), arrays.pad_truncate(a, 100)
    return table(spark, sf, "embeddings").select("vec_id", F.size(cut).alias("n_cut"), F.element_at(cut, -1).alias("last_cut"), F.size(padded).alias("n_padded"), F.get(padded, 63).alias("at_63"), F.get(padded, 99).alias("at_99"))


@query(
    "SELECT vec_id, CAST(least(len(embedding), 1 + vec_id % 70) AS INTEGER) AS n_a, CAST(least(len(embedding), 1 + vec_id % 70) AS INTEGER) AS n_b, embedding[least(len(embedding), 1 + vec_id % 70)] AS last_a, "
    "CAST(greatest(least(len(embedding), 1 + vec_id % 70) - 1, 0) AS INTEGER) AS n_dropped FROM embeddings"
)
def trim_common(spark: SparkSession, sf: str) -> DataFrame:
    names = F.sequence(F.lit(1).cast("long"), 1 + F.col("vec_id") % 70)
    a, b = arrays.trim_common(F.col("embedding"), names)
    return table(spark, sf, "embeddings").select("vec_id", F.size(a).alias("n_a"), F.size(b).alias("n_b"), F.element_at(a, -1).alias("last_a"), F.size(arrays.drop_last(a)).alias("n_dropped"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted FROM embeddings")
def argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).alias("predicted"))


def _spans_of(names: tuple[str, ...], *pairs: tuple[float, float] | None) -> list[Column]:
    return [(_ranges(p) if p else F.slice(_ranges((0.0, 0.0)), 1, 0)).alias(n) for n, p in zip(names, pairs, strict=True)]


@query(
    f"SELECT vec_id, round({_POWER.format(a=1, b=16)} / 16, 9) AS non_speech_signal, round({_POWER.format(a=17, b=32)} / 16, 9) AS one_spk_signal, round({_POWER.format(a=33, b=64)} / 32, 9) AS two_spk_signal, "
    f"round(10 * log10({_POWER.format(a=17, b=32)} / {_POWER.format(a=1, b=16)}), 6) AS one_snr, round(10 * log10({_POWER.format(a=33, b=64)} / 2 / {_POWER.format(a=1, b=16)}), 6) AS two_snr, "
    "1e0 AS non_speech_period, 1e0 AS one_spk_period, 2e0 AS two_spk_period FROM embeddings"
)
def recording_features(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", *_spans_of(labels.LABELS[2], (0.0, 1.0), (1.0, 2.0), (2.0, 4.0)))
    out = labels.recording_features(e, F.col("embedding"), 16, curation.segments_of)
    powers, periods = [f"{n}_signal" for n in labels.LABELS[2]], [f"{n}_period" for n in labels.LABELS[2]]
    return out.select("vec_id", *[F.round(p, 9).alias(p) for p in powers], F.round("one_spk_SNR", 6).alias("one_snr"), F.round("two_spk_SNR", 6).alias("two_snr"), *periods)


@query(
    "WITH k AS (SELECT vec_id, embedding, unnest([0, 1, 1, 2]) AS label, unnest([1, 17, 41, 49]) AS a, unnest([16, 16, 8, 16]) AS n FROM embeddings WHERE vec_id % 10 > 3) "
    "SELECT CAST(vec_id AS VARCHAR) AS audio_id, CAST(label AS INTEGER) AS label, CAST(n AS INTEGER) AS n, embedding[a] AS first_amp, embedding[a + n - 1] AS last_amp FROM k"
)
def segment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The segment driver: training recordings, zero-length ranges gone, one row a segment."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("audio_id"), "vec_id", F.col("embedding").alias("amp"))
    ranges = e.select("audio_id", _ranges((0.0, 1.0), (2.0, 2.0)).alias("non_speech"), _ranges((1.0, 2.0), (2.5, 3.0)).alias("one_spk"), _ranges((3.0, 4.0)).alias("overlaps"))
    splits = e.select("audio_id", F.when(F.col("vec_id") % 10 > 3, "training").otherwise("evaluation").alias("split"))
    rows = drivers.segment_signals(e, ranges, 2, 16, splits)
    codes = {c: F.lit(i) for c, i in text.CLASS_CODE.items()}
    each = F.explode(F.array(*[F.struct(k.alias("label"), F.col(f"{c}_signal").alias("segments")) for c, k in codes.items()])).alias("x")
    out = rows.select("audio_id", each).select("audio_id", "x.label", F.explode("x.segments").alias("x"))
    return out.select("audio_id", "label", F.size("x").alias("n"), F.get("x", 0).alias("first_amp"), F.element_at("x", -1).alias("last_amp"))


_CHUNK_ROWS = (
    "WITH g AS (SELECT vec_id, embedding, unnest(range(3)) AS i FROM embeddings WHERE {where}), "
    "c AS (SELECT *, (CASE WHEN i = 0 THEN 1 WHEN i = 1 THEN {tie} ELSE 2 END) AS cls FROM g) "
    "SELECT CAST(vec_id AS VARCHAR) AS audio_id, CAST(cls AS INTEGER) AS label, CAST(least(16, {cut}) AS INTEGER) AS n, embedding[i * 16 + 1] AS first_amp, "
    "concat_ws('_', vec_id, round(i * 0.5::DOUBLE, {places}), round(i * 0.5::DOUBLE + 0.5::DOUBLE, {places})) AS chunk_filenames FROM c"
)


def _annotated(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    """Signals of 2 seconds at 32 samples; classes that tie in the second chunk; the last chunk has no grid or no signal."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("audio_id"), "vec_id", F.col("embedding").alias("amp"))
    parts = [("one_spk", 2, 0.0, 0.45), ("non_speech", 1, 0.45, 0.75), ("two_spk", 3, 0.75, 2.0)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(p).alias("priority"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, p, a, b in parts])).alias("x")
    recordings = e.select("audio_id", F.lit(2.0 if rule == "majority" else 1.9).alias("duration"))
    splits = e.select("audio_id", F.when(F.col("vec_id") % 10 > 3, "evaluation").otherwise("training").alias("split"))
    return drivers.annotate_chunks(e.select("audio_id", "amp"), e.select("audio_id", rows).select("audio_id", "x.*"), recordings, 0.5, 32, rule, splits if rule == "majority" else None)


def _curated(rows: DataFrame) -> DataFrame:
    return rows.select("audio_id", "label", F.size("input_values").alias("n"), F.get("input_values", 0).alias("first_amp"), "chunk_filenames")


@query(_CHUNK_ROWS.format(where="vec_id % 10 > 3", tie=0, cut=16, places=3))
def chunk_annotation(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk driver and the curation of its rows: evaluation recordings, first of the tied classes."""
    return _curated(drivers.curate(_annotated(spark, sf, "majority"), "evaluation"))


@query(_CHUNK_ROWS.format(where="vec_id % 2 = 0", tie=2, cut=10, places=1))
def chunk_annotation_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the sparse rule, of one partition of the input, encoded to 10 samples."""
    return _curated(drivers.curate(_annotated(spark, sf, "sparse"), "sparse_test", True, 10, 1.0, part=F.col("audio_id").cast("long") % 2 == 0))


# --------------------------------------------------------------- relational


@query("SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_merge(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "inner").select("c_custkey", "c_nationkey", "n_nationkey", "n_name")


@query(
    "SELECT c_custkey, o_orderkey AS first_order, coalesce(o_totalprice, 0) AS first_price FROM customer LEFT JOIN "
    "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n = 1"
)
def first_match_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    out = relational.first_match(c, o, "c_custkey", ["o_orderkey"], ["o_orderkey", "o_totalprice"])
    return out.select("c_custkey", F.col("o_orderkey").alias("first_order"), F.coalesce("o_totalprice", F.lit(0.0)).alias("first_price"))


_BUCKET = "CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) % 10"
_KEY = "concat(CAST(doc_id AS VARCHAR), source)"


def _doc_key() -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.col("source"))


@query(f"SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM documents WHERE {_BUCKET.format(key=_KEY)} > 3)")
def semi_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    split = relational.hash_split(docs.select("doc_id", "source"), _doc_key(), 3, "training", "evaluation")
    return docs.join(split.filter("split = 'evaluation'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


@query(
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND l_suppkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
)
def anti_unaligned(spark: SparkSession, sf: str) -> DataFrame:
    unaligned = table(spark, sf, "labels").filter("toxic = 1")
    return relational.without_each(table(spark, sf, "lineitem"), unaligned, "doc_id", ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query(
    "WITH bad AS (SELECT doc_id FROM labels WHERE toxic = 1) "
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (FROM bad) AND l_suppkey NOT IN (FROM bad) AND l_linenumber NOT IN (FROM bad)"
)
def anti_three(spark: SparkSession, sf: str) -> DataFrame:
    unaligned = table(spark, sf, "labels").filter("toxic = 1")
    return relational.without_each(table(spark, sf, "lineitem"), unaligned, "doc_id", ["l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return relational.value_counts(table(spark, sf, "events"), "event_type")


@query(
    "SELECT concat(o_orderkey, '-1-1_', o_custkey, '-2-2') AS audio_id, o_totalprice::DOUBLE / 16000 AS duration, concat(o_orderkey, '-1-1') AS source_1, concat(o_custkey, '-2-2') AS source_2 FROM orders "
    "WHERE o_orderkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND o_custkey NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"
)
def enrich_mixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Mixture ids taken apart, without those that name an unaligned utterance."""
    o, bad = table(spark, sf, "orders"), table(spark, sf, "labels")
    name = lambda c, tail: F.concat(F.col(c).cast("string"), F.lit(tail))
    mixtures = o.select(F.concat_ws("_", name("o_orderkey", "-1-1"), name("o_custkey", "-2-2")).alias("mixture_ID"), F.col("o_totalprice").cast("double").alias("length"))
    unaligned = bad.filter("toxic = 1").select(name("doc_id", "-1-1").alias("timing")).unionByName(bad.filter("quality = 0").select(name("doc_id", "-2-2").alias("timing")))
    return labels.enrich(mixtures, unaligned, 2)


_SPARSE_MIX = """WITH m AS (SELECT o_orderkey AS k, o_orderkey % 5 AS a, o_orderkey % 3 AS b FROM orders),
r AS (SELECT concat('sparse/', k) AS audio_id, unnest([{'l': 'non_speech', 's': 0e0, 'e': 1e0}, {'l': 'one_spk', 's': 1e0, 'e': 4e0 + b}, {'l': 'two_spk', 's': 4e0 + b, 'e': 7e0 + a}, {'l': 'one_spk', 's': 7e0 + a, 'e': 12e0},
 {'l': 'non_speech', 's': 12e0, 'e': 20.125e0}, {'l': 'speech_times', 's': 1e0, 'e': 12e0}]) AS x FROM m)
SELECT audio_id, x.l AS label, x.s AS start_s, x.e AS end_s FROM r WHERE x.s < x.e"""


@query(_SPARSE_MIX)
def sparse_mixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of nested mixture records whose noise is the span; one source reaches past its end."""
    k = F.col("o_orderkey")
    span = lambda a, b: F.struct(F.lit(a).cast("double").alias("start") if not isinstance(a, Column) else a.cast("double").alias("start"), b.cast("double").alias("stop"), F.lit("x").alias("source"))
    rows = table(spark, sf, "orders").select(
        k.alias("mixture_name"), F.array(span(1, 7 + k % 5), span(3, F.lit(4))).alias("s1"), F.array(span(4 + k % 3, F.lit(12))).alias("s2"), F.array(span(0, F.lit(20.12504))).alias("noise"),
    )
    flat = annotations.records(rows, "mixture_name", ["s1", "s2", "noise"])
    out = labels.sparse_mixture_labels(flat, 2, F.lit("sparse/"))
    return out.select("audio_id", "label", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query(
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND n_chars > 0 "
    "AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 20000)"
)
def anti_multi(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    errors = [labels.filter("toxic = 1"), labels.filter("quality = 0"), docs.filter("n_chars > 20000 or n_chars <= 0")]
    return relational.without(docs, errors, "doc_id").select("doc_id", "lang")


@query(
    "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS DOUBLE) AS price FROM customer "
    "UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_retailprice FROM part"
)
def union_missing_cols(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    p = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return relational.union_all([c, p])


@query(f"SELECT doc_id, {_BUCKET.format(key=_KEY)} AS bucket, CASE WHEN {_BUCKET.format(key=_KEY)} <= 3 THEN 'training' ELSE 'evaluation' END AS split FROM documents")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("bucket", text.hash_bucket(_doc_key()))
    return relational.hash_split(docs, _doc_key(), 3, "training", "evaluation").select("doc_id", "bucket", "split")


_MODELLING = (
    f"SELECT doc_id, lang, CASE WHEN lang IN ('de', 'fr') THEN 'test' WHEN lang = 'en' AND {_BUCKET.format(key=_KEY)} <= 3 OR lang = 'es' AND {_BUCKET.format(key=_KEY)} <= 4 "
    "THEN 'training' ELSE 'evaluation' END AS split FROM documents WHERE lang IN ('en', 'es', 'de', 'fr')"
)


@query(_MODELLING)
def modelling_dataset(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return relational.modelling_dataset(docs, "lang", _doc_key(), {"en": 3, "es": 4}, ["de", "fr"]).select("doc_id", "lang", "split")


@query(f"SELECT lang, split, count(*) AS n FROM ({_MODELLING}) GROUP BY lang, split")
def split_audit(spark: SparkSession, sf: str) -> DataFrame:
    return relational.value_counts(modelling_dataset(spark, sf), "lang", "split")


@query(
    "WITH t AS (SELECT role, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), '-') AS nxt FROM conversations), "
    "p AS (SELECT CASE upper(role[1]) || upper(nxt[1]) WHEN 'UA' THEN 'pair' WHEN 'AU' THEN 'pair' ELSE upper(role[1]) || upper(nxt[1]) END AS pair FROM t) "
    "SELECT pair, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM p), 9) AS percent FROM p GROUP BY pair"
)
def group_percent(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("nxt", F.coalesce(F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("-")))
    pair = F.concat(F.upper(F.substring("role", 1, 1)), F.upper(F.substring("nxt", 1, 1)))
    pairs = turns.select(text.recode(pair, {"UA": "pair", "AU": "pair"}).alias("pair"))
    return relational.percent_of_total(pairs, "pair").select("pair", "n", F.round("percent", 9).alias("percent"))


@query(
    "WITH m AS (SELECT min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM lineitem) "
    "SELECT CAST(least(floor((l_extendedprice::DOUBLE - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, m GROUP BY bin"
)
def histogram20(spark: SparkSession, sf: str) -> DataFrame:
    return relational.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20)


@query("SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def mean_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 400 + 1 AS part FROM events")
def batch_partition(spark: SparkSession, sf: str) -> DataFrame:
    return relational.numbered_batches(table(spark, sf, "events").select("event_id"), ["event_id"], 400)


@query(
    "SELECT count(*) AS n_files, count(*) FILTER (lang <> 'en') AS n_bad_type, count(*) FILTER (doc_id % 7 = 0) AS n_bad_rate, count(*) FILTER (source = 'src0') AS n_bad_channels, "
    "count(*) FILTER (n_chars <= 0 OR n_chars > 5000) AS n_bad_duration, count(*) FILTER (lang <> 'en' OR doc_id % 7 = 0 OR source = 'src0' OR n_chars <= 0 OR n_chars > 5000) AS n_bad FROM documents"
)
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", "WAV").otherwise("FLAC").alias("file_type"), F.when(F.col("doc_id") % 7 == 0, 8000).otherwise(16000).alias("sampling_rate"),
        F.when(F.col("source") == "src0", 2).otherwise(1).alias("channels"), F.col("n_chars").alias("duration"),
    )
    return relational.quality_report(relational.quality_flags(files, 16000, 5000))


@query("SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 OR quality = 0")
def error_ids(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return labels.filter("toxic = 1").select("doc_id").unionByName(labels.filter("quality = 0").select("doc_id")).distinct()


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def first_five(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate").limit(5)


# ------------------------------------------------------------------ parsing


@query(r"SELECT page_id, unnest(regexp_extract_all(url, '\d{2,5}')) AS timing FROM pages")
def regex_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit(r"\d{2,5}"), F.lit(0))).alias("timing"))


@query(
    "WITH d AS (SELECT doc_id, n_chars AS n FROM documents) "
    "SELECT doc_id, CAST(n AS DOUBLE) AS start_time, CAST(n + 10 AS DOUBLE) AS stop_time FROM d UNION ALL SELECT doc_id, CAST(n + 15 AS DOUBLE), CAST(n + 30 AS DOUBLE) FROM d"
)
def alignment_ranges(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    times = F.concat_ws(",", *[(n + k).cast("string") for k in (0, 5, 10, 15, 20, 30, 40)])
    line = F.concat(F.col("doc_id").cast("string"), F.lit(' ",A,B,,C,D,E," "'), times, F.lit('"'))
    ranges = annotations.speech_ranges(annotations.alignments(table(spark, sf, "documents").select(line.alias("value"))))
    iv = ranges.select(F.col("unique_id").cast("bigint").alias("doc_id"), F.explode(arrays.zip_intervals(F.col("start_time"), F.col("stop_time"))).alias("r"))
    return iv.select("doc_id", F.col("r.start").alias("start_time"), F.col("r.end").alias("stop_time"))


@query(
    "SELECT 'rec' || user_id AS file_id, CAST(event_id AS DOUBLE) AS \"start\", CAST(event_id + event_id % 9 + 1 AS DOUBLE) AS \"end\", event_type AS speaker FROM events"
)
def rttm_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    line = F.concat(F.lit("SPEAKER rec"), F.col("user_id").cast("string"), F.lit(" 1 "), F.col("event_id").cast("string"), F.lit("  "), (F.col("event_id") % 9 + 1).cast("string"), F.lit(" <NA> <NA> "), F.col("event_type"), F.lit(" <NA> <NA>"))
    return annotations.rttm(e.select(line.alias("value")), speaker=True)


@query(
    "SELECT l_orderkey AS mixture_name, 's1' AS source, l_linenumber AS stop, l_quantity AS size, CAST(NULL AS DOUBLE) AS tax FROM lineitem WHERE l_linenumber % 2 = 1 "
    "UNION ALL SELECT l_orderkey, 's2', l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_linenumber % 2 = 0"
)
def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.col("l_linenumber") % 2 == 1
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("mixture_name")).agg(
        F.collect_list(F.when(odd, F.struct(F.col("l_linenumber").alias("stop"), F.col("l_quantity").alias("size")))).alias("s1"),
        F.collect_list(F.when(~odd, F.struct(F.col("l_linenumber").alias("stop"), F.col("l_quantity").alias("size"), F.col("l_tax").alias("tax")))).alias("s2"),
    )
    return annotations.records(lines, "mixture_name", ["s1", "s2"])


@query(
    "SELECT event_id, CAST(user_id AS VARCHAR) || '-' || event_type AS source_1, CAST(event_id AS VARCHAR) || '-' || event_type AS source_2 FROM events"
)
def lookahead_split(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda c: F.concat(F.col(c).cast("string"), F.lit("-"), F.col("event_type"))
    mixture = F.concat_ws("_", part("user_id"), part("event_id"))
    rows = table(spark, sf, "events").withColumn("m", mixture)
    return rows.select("event_id", text.split_mixture(F.col("m"), 0).alias("source_1"), text.split_mixture(F.col("m"), 1).alias("source_2"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# ------------------------------------------------- curation, metrics, scoring


@query(
    "SELECT vec_id, 0 AS label, CAST(16 AS INTEGER) AS n, embedding[1] AS first_amp FROM embeddings UNION ALL SELECT vec_id, 1, 16, embedding[17] FROM embeddings "
    "UNION ALL SELECT vec_id, 1, 16, embedding[33] FROM embeddings UNION ALL SELECT vec_id, 2, 16, embedding[49] FROM embeddings"
)
def unpivot_explode(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("embedding")
    e = table(spark, sf, "embeddings").select(
        curation.segments_of(a, _ranges((0.0, 1.0)), 16).alias("non_speech_signal"), curation.segments_of(a, _ranges((1.0, 2.0), (2.0, 3.0)), 16).alias("one_spk_signal"),
        curation.segments_of(a, _ranges((3.0, 4.0)), 16).alias("two_spk_signal"), "vec_id",
    )
    tagged = e.select(*[F.transform(c, lambda s: F.concat(F.array(F.col("vec_id").cast("double")), s.cast("array<double>"))).alias(c) for c in ("non_speech_signal", "one_spk_signal", "two_spk_signal")])
    rows = curation.training_rows(tagged)
    return rows.select(F.get("input_values", 0).cast("bigint").alias("vec_id"), "label", (F.size("input_values") - 1).alias("n"), F.get("input_values", 1).cast("float").alias("first_amp"))


@query(
    "WITH g AS (SELECT vec_id, label, embedding, unnest(range(4)) AS i FROM embeddings) "
    "SELECT CAST(vec_id AS VARCHAR) AS audio_id, CAST((label + i) % 3 AS INTEGER) AS label, embedding[i * 16 + 1] AS first_amp, concat_ws('_', vec_id, i) AS chunk_filenames FROM g"
)
def aligned_explode(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, text.CLASS_CODE))
    name_of = lambda i: F.array(F.get(names, ((F.col("label") + i) % 3).cast("int")), F.lit("tied"))
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("audio_id"), arrays.full_chunks(F.col("embedding"), 16).alias("amp_chunks"), F.transform(F.sequence(F.lit(0), F.lit(3)), name_of).alias("chunks_class"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat_ws("_", "vec_id", i.cast("string"))).alias("chunk_filenames"),
    )
    return curation.evaluation_rows(e).select("audio_id", "label", F.get("input_values", 0).alias("first_amp"), "chunk_filenames")


def _pairs_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("truth"), arrays.argmax(F.col("embedding")).alias("a"))
    return metrics.pair_counts(e.withColumn("predicted", F.col("a") % 3), "truth", "predicted")


_PAIRS = "p AS (SELECT CAST(label % 3 AS INTEGER) AS t, CAST((list_position(embedding, list_max(embedding)) - 1) % 3 AS INTEGER) AS g FROM embeddings)"
_SCORES = f"""WITH {_PAIRS}, k AS (SELECT t AS c FROM p UNION SELECT g FROM p),
n AS (SELECT c, (SELECT count(*) FROM p WHERE t = c) AS sup, (SELECT count(*) FROM p WHERE g = c) AS gue, (SELECT count(*) FROM p WHERE t = c AND g = c) AS hit FROM k),
r AS (SELECT c, sup, hit, CASE WHEN gue = 0 THEN 0e0 ELSE hit::DOUBLE / gue END AS pr, CASE WHEN sup = 0 THEN 0e0 ELSE hit::DOUBLE / sup END AS re FROM n),
s AS (SELECT *, CASE WHEN pr + re = 0 THEN 0e0 ELSE 2 * pr * re / (pr + re) END AS f FROM r)"""


@query(f"WITH {_PAIRS} SELECT t AS truth, count(*) FILTER (g = 0) AS pred_0, count(*) FILTER (g = 1) AS pred_1, count(*) FILTER (g = 2) AS pred_2 FROM p GROUP BY t")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_pairs_of(spark, sf), [0, 1, 2])


@query(
    _SCORES
    + """ SELECT CAST(c AS VARCHAR) AS name, round(pr, 9) AS precision, round(re, 9) AS recall, round(f, 9) AS f1, CAST(sup AS BIGINT) AS support FROM s
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit)::DOUBLE / sum(sup), 9), CAST(sum(sup) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(pr), 9), round(avg(re), 9), round(avg(f), 9), CAST(sum(sup) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(pr * sup) / sum(sup), 9), round(sum(re * sup) / sum(sup), 9), round(sum(f * sup) / sum(sup), 9), CAST(sum(sup) AS BIGINT) FROM s"""
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    report = metrics.classification_report(_pairs_of(spark, sf))
    return report.select("name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_SCORES + " SELECT round(sum(f * sup) / sum(sup), 9) AS f1 FROM s")
def weighted_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.classification_report(_pairs_of(spark, sf)).filter("name = 'weighted avg'").select(F.round("f1", 9).alias("f1"))


def linear_scorer(signals: list[np.ndarray]) -> np.ndarray:
    """A fixed scorer that stands in for a model: mean, spread and slope of a signal."""
    x = np.stack([np.r_[np.mean(s), np.std(s), s[-1] - s[0]] for s in (np.asarray(s, np.float64) for s in signals)])
    return x @ np.array([[1.0, -1.0, 0.2], [-0.5, 1.0, 0.1], [0.3, 0.0, 1.0]]).T


@query(
    "WITH e AS (SELECT vec_id, CAST(label % 3 AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) > 10), "
    "f AS (SELECT vec_id, label, list_avg(x) AS m, list_aggregate(x, 'stddev_pop') AS d, x[len(x)] - x[1] AS c FROM e), "
    "z AS (SELECT vec_id, label, [m - d + 0.2 * c, d - 0.5 * m + 0.1 * c, 0.3 * m + c] AS z FROM f) "
    "SELECT vec_id, label, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS predicted_label FROM z"
)
def batched_scoring(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("label"), F.col("embedding").alias("input_values"))
    return curation.predict(e, linear_scorer, ["vec_id"], least=10)


@query()
def early_stopped_training(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier of all embeddings, trained until the F1 of every fifth has not risen for three epochs; its guesses."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.pmod("label", F.lit(3)).cast("int").alias("label"), "embedding", F.coalesce(F.col("vec_id") % 5 == 0, F.lit(False)).alias("held"))
    model = training.fit(rows, F.col("held"), 3, "embedding", epochs=20)
    guessed = training.predict(rows, model, "embedding")
    return guessed.select("vec_id", "label", "held", "predicted_label", F.lit(model.best_epoch).alias("best_epoch"))


# ---------------------------------------------------------------- streams


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one stream: user_id, source, start, end."""
    path = f"{sf}/events.parquet"
    ts = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 60e6).cast("bigint"))
    # As a pattern, as a stream takes a single file by a pattern only.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{{events}}.parquet")
    return events.select("user_id", F.col("event_type").alias("source"), ts.alias("start"), end.alias("end"))


#: What the watermark reaches when all events have come: an hour less than their latest start, in whole milliseconds.
_MARK = "mark AS (SELECT (max(s) // 1000 - 3600000) * 1000 AS mark FROM iv)"


@query(f"WITH {IV}, {islands('m', 'user_id', 'iv')}, {_MARK} SELECT user_id, s AS start_us, e AS end_us FROM m, mark WHERE e <= mark")
def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The union of each user's intervals as a stream gives it, up to the watermark."""
    out = state.drained(state.merged(_stream(spark, sf), KEY, "1 hour"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query(
    f"""WITH {IV}, {_MARK},
part AS (SELECT user_id, source, c, greatest(s, c * {CHUNK}) AS s, least(e, (c + 1) * {CHUNK}) AS e FROM (SELECT *, unnest(range(s // {CHUNK}, (e - 1) // {CHUNK} + 1)) AS c FROM iv)),
{islands('solid', 'user_id, c, source', 'part')},
pts AS (SELECT user_id, c, s AS t FROM solid UNION SELECT user_id, c, e FROM solid UNION SELECT user_id, c, c * {CHUNK} FROM solid UNION SELECT user_id, c, (c + 1) * {CHUNK} FROM solid),
el AS (SELECT user_id, c, t AS s, lead(t) OVER (PARTITION BY user_id, c ORDER BY t) AS e FROM pts),
cnt AS (SELECT el.user_id, el.c, el.s, el.e, least(count(solid.s), 2) AS n FROM el LEFT JOIN solid ON solid.user_id = el.user_id AND solid.c = el.c AND solid.s <= el.s AND solid.e >= el.e
  WHERE el.e IS NOT NULL GROUP BY ALL),
tot AS (SELECT user_id, c, n, sum(e - s) AS t FROM cnt GROUP BY ALL),
best AS (SELECT user_id, c, min(n) AS n, count(*) AS tied FROM (SELECT *, max(t) OVER (PARTITION BY user_id, c) AS top FROM tot) WHERE t = top GROUP BY ALL)
SELECT user_id, CAST(c AS BIGINT) AS chunk, ['non_speech', 'one_spk', 'two_spk'][n + 1] AS label, CAST(tied AS INTEGER) AS n_tied FROM best, mark WHERE (c + 1) * {CHUNK} <= mark"""
)
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each user's chunks as a stream gives it, up to the watermark."""
    return state.drained(state.classed_chunks(_stream(spark, sf), KEY, "source", CHUNK, 2, "1 hour"))


# ---------------------------------------------------------------- long signals in blocks

_SAMPLES = "e AS (SELECT vec_id, len(embedding) AS n, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS k FROM embeddings)"
_BLOCK = 16


def _blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    return signals.blocks(table(spark, sf, "embeddings"), ["vec_id"], "embedding", _BLOCK)


@query(f"""WITH {_SAMPLES}, m AS (SELECT vec_id, unnest(range(CAST(ceil(max(n) * 3 / 2) AS BIGINT))) AS i FROM e GROUP BY vec_id),
t AS (SELECT vec_id, i, x, i * 2 - k * 3 AS j FROM m JOIN e USING (vec_id) WHERE abs(i * 2 - k * 3) <= 24)
SELECT vec_id, i, round(sum(x * CASE WHEN j = 0 THEN 1 ELSE sin(pi() * j / 3) / (pi() * j / 3) END * 0.5 * (1 + cos(pi() * j / 25))), 6) + 0e0 AS x FROM t GROUP BY vec_id, i""")
def signal_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Signals at three halves of their rate, block by block."""
    out = signals.samples(signals.resample(_blocks_of(spark, sf), ["vec_id"], _BLOCK, 16000, 24000), ["vec_id"])
    return out.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(f"""WITH {_SAMPLES}, m AS (SELECT vec_id, unnest(range(CAST(ceil(max(n) * 2e0 / 3) AS BIGINT))) AS i FROM e GROUP BY vec_id),
t AS (SELECT vec_id, i, x, i * 3 - k * 2 AS j FROM m JOIN e USING (vec_id) WHERE abs(i * 3 - k * 2) <= 24)
SELECT vec_id, i, round(sum(x * 2 / 3 * CASE WHEN j = 0 THEN 1 ELSE sin(pi() * j / 3) / (pi() * j / 3) END * 0.5 * (1 + cos(pi() * j / 25))), 6) + 0e0 AS x FROM t GROUP BY vec_id, i""")
def signal_resample_down(spark: SparkSession, sf: str) -> DataFrame:
    """Signals at two thirds of their rate, block by block."""
    out = signals.samples(signals.resample(_blocks_of(spark, sf), ["vec_id"], _BLOCK, 24000, 16000), ["vec_id"])
    return out.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(f"""WITH {_SAMPLES}, r AS (SELECT CAST(j AS BIGINT) AS j, pow(0.95e0, j) * cos(0.7e0 * j) AS h FROM range(40) t(j))
SELECT vec_id, k + j AS i, round(sum(x * h), 6) + 0e0 AS x FROM e, r GROUP BY vec_id, k + j""")
def signal_reverb(spark: SparkSession, sf: str) -> DataFrame:
    """Signals convolved with a response of 40 samples, longer than a block."""
    response = [0.95**j * float(np.cos(0.7 * j)) for j in range(40)]
    out = signals.samples(signals.reverb(_blocks_of(spark, sf), ["vec_id"], _BLOCK, response), ["vec_id"])
    return out.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


def _noise_sql(inside: str = "TRUE") -> str:
    u = lambda what, part, counter: f"(('0x' || substr(md5('7:{what}:' || {counter}), {8 * part + 1}, 8))::BIGINT / 4294967296e0)"
    at = "vec_id || ':' || k"
    place = u("place", 0, "vec_id || ':' || k // 20")
    return f"""WITH {_SAMPLES}, z AS (SELECT vec_id, k, x, CASE WHEN {inside.format(start=f"CAST(floor({place} * 16) AS BIGINT)")} THEN sqrt(-2 * ln(1 - {u("noise", 0, at)})) * cos(2 * pi() * {u("noise", 1, at)}) ELSE 0 END AS z FROM e),
g AS (SELECT vec_id, CASE WHEN sum(x * x) > 0 AND sum(z * z) > 0 THEN sqrt(sum(x * x) / (sum(z * z) * 10)) ELSE 0 END AS g FROM z GROUP BY vec_id)
SELECT vec_id, k AS i, round(x + z * g, 6) + 0e0 AS x FROM z JOIN g USING (vec_id)"""


@query(_noise_sql())
def signal_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with Gaussian noise 10 dB below them."""
    out = signals.samples(signals.add_noise(_blocks_of(spark, sf), ["vec_id"], 10.0, 7), ["vec_id"])
    return out.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(_noise_sql("k % 20 >= {start} AND k % 20 < {start} + 5"))
def signal_short_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with noise 10 dB below them, in five of every twenty samples."""
    out = signals.samples(signals.add_noise(_blocks_of(spark, sf), ["vec_id"], 10.0, 7, 20, 5), ["vec_id"])
    return out.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


def _stretched_sql(n: int, d: int) -> str:
    """CTEs up to st (vec_id, i, x): the samples at speed n / d by frames of 16 samples, 4 apart, with Fourier sums written out."""
    window = "(0.5e0 - 0.5e0 * cos(2 * pi() * j / 16))"
    return f"""{_SAMPLES}, len AS (SELECT vec_id, max(n) AS n, CAST(ceil(max(n) * {d}e0 / {n}) AS BIGINT) AS m FROM e GROUP BY vec_id),
bins AS (SELECT CAST(b AS BIGINT) AS b FROM range(9) t(b)), js AS (SELECT CAST(j AS BIGINT) AS j, {window} AS w FROM range(16) t(j)),
near AS (SELECT vec_id, x, k, unnest(range(greatest(0, (k - 4) // 4), (k + 8) // 4 + 1)) AS q FROM e),
sums AS (SELECT vec_id, q, b, sum(x * w * cos(2 * pi() * b * j / 16)) AS re, -sum(x * w * sin(2 * pi() * b * j / 16)) AS im FROM near JOIN js ON j = k - 4 * q + 8, bins GROUP BY vec_id, q, b),
spec AS (SELECT vec_id, q, b, sqrt(re * re + im * im) AS mag, atan2(im, re) AS ang FROM sums),
fr AS (SELECT vec_id, unnest(range((m - 1 + 8) // 4 + 1)) AS t FROM len),
two AS (SELECT fr.vec_id, t, bins.b, (t * {n} % {d}) / {d}e0 AS past, coalesce(a.mag, 0) AS m0, coalesce(z.mag, 0) AS m1, coalesce(a.ang, 0) AS a0, coalesce(z.ang, 0) AS a1 FROM fr JOIN bins ON TRUE
  LEFT JOIN spec a ON a.vec_id = fr.vec_id AND a.q = t * {n} // {d} AND a.b = bins.b LEFT JOIN spec z ON z.vec_id = fr.vec_id AND z.q = t * {n} // {d} + 1 AND z.b = bins.b),
ph AS (SELECT vec_id, t, b, (1 - past) * m0 + past * m1 AS mag, first_value(a0) OVER o + sum(a1 - a0) OVER o - (a1 - a0) AS phase FROM two WINDOW o AS (PARTITION BY vec_id, b ORDER BY t)),
y AS (SELECT vec_id, 4 * t - 8 + j AS i, w, w * sum(CASE WHEN b IN (0, 8) THEN 1 ELSE 2 END * mag * cos(phase + 2 * pi() * b * j / 16)) / 16 AS y FROM ph, js GROUP BY vec_id, t, j, w),
st AS (SELECT vec_id, i, sum(y) / sum(w * w) AS x FROM y JOIN len USING (vec_id) WHERE i >= 0 AND i < m GROUP BY vec_id, i)"""


@query(f"WITH {_stretched_sql(3, 2)} SELECT vec_id, i, round(x, 6) + 0e0 AS x FROM st")
def signal_stretch(spark: SparkSession, sf: str) -> DataFrame:
    """Signals at three halves of their speed, with the pitch as it was."""
    out = signals.samples(stretch.stretch(_blocks_of(spark, sf), ["vec_id"], _BLOCK, Fraction(3, 2), 16), ["vec_id"])
    return out.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(f"""WITH {_stretched_sql(2, 3)}, back AS (SELECT vec_id, unnest(range(n)) AS i FROM len),
t AS (SELECT vec_id, back.i, x, back.i * 3 - st.i * 2 AS j FROM back JOIN st USING (vec_id) WHERE abs(back.i * 3 - st.i * 2) <= 24)
SELECT vec_id, i, round(sum(x * 2 / 3 * CASE WHEN j = 0 THEN 1 ELSE sin(pi() * j / 3) / (pi() * j / 3) END * 0.5 * (1 + cos(pi() * j / 25))), 6) + 0e0 AS x FROM t GROUP BY vec_id, i""")
def signal_pitch(spark: SparkSession, sf: str) -> DataFrame:
    """Signals a fifth (3/2) higher, as long as they were."""
    out = signals.samples(stretch.shift_pitch(_blocks_of(spark, sf), ["vec_id"], _BLOCK, Fraction(3, 2), 16), ["vec_id"])
    return out.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


# ---------------------------------------------------------------- sweeps in slices that follow the data


@query(_SQL["iv_merge"])
def sweep_merge(spark: SparkSession, sf: str) -> DataFrame:
    return sweeps.merge(events_iv(spark, sf), KEY).select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(_SQL["iv_complement"])
def sweep_complement(spark: SparkSession, sf: str) -> DataFrame:
    iv = events_iv(spark, sf)
    return sweeps.complement(iv, total_span(iv), KEY).select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"WITH {IV}, {_SOLIDS}, common AS ({_pairs('click', 'view')}), {islands('m', 'user_id', 'common')} SELECT user_id, s AS start_us, e AS end_us FROM m")
def sweep_intersect(spark: SparkSession, sf: str) -> DataFrame:
    """What clicks and views have in common; touching parts are one."""
    out = sweeps.intersect_sets([events_iv(spark, sf, source) for source in ("click", "view")], KEY)
    return out.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(_SQL["speaker_count_durations"])
def sweep_count_durations(spark: SparkSession, sf: str) -> DataFrame:
    iv = events_iv(spark, sf, *SOURCES)
    cls = sweeps.active_classes(iv, total_span(iv), KEY, "source", 2)
    return cls.groupBy("user_id", F.col("cls").cast("int").alias("n_active")).agg(F.sum(F.col("end") - F.col("start")).alias("micros"))


# ---------------------------------------------------------------- runs


@query(
    "WITH s AS (SELECT *, 1 AS position, 'read' AS stage FROM events UNION ALL SELECT *, 2, 'long' FROM events WHERE value >= 10), "
    "c AS (SELECT position, stage, count(*) AS n, count(*) - count(event_id) AS n1, count(*) - count(user_id) AS n2, count(*) - count(ts) AS n3, count(*) - count(value) AS n4, "
    "count(*) FILTER (value < 60) AS e1, count(*) FILTER (event_type = 'error') AS e2 FROM s GROUP BY ALL), "
    "u AS (SELECT position, stage, unnest(['rows', 'nulls', 'nulls', 'nulls', 'nulls', 'errors', 'errors']) AS kind, "
    "unnest([NULL, 'event_id', 'user_id', 'ts', 'value', 'short', 'failed']) AS name, unnest([n, n1, n2, n3, n4, e1, e2]) AS n FROM c) "
    "SELECT CAST(position AS INTEGER) AS position, stage, kind, name, n FROM u"
)
def observed_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, nulls and errors of two stages, counted while they are written."""
    run = Run(spark)
    errors = {"short": F.col("value") < 60, "failed": F.col("event_type") == "error"}
    read = run.stage("read", table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type"), errors)
    run.stage("long", read.filter("value >= 10"), errors)
    return run.table().filter("kind <> 'nulls' or name <> 'event_type'").drop("run")


@query(
    "WITH p AS (SELECT user_id, value, (row_number() OVER (ORDER BY event_id, user_id, ts, event_type, value) - 1) // 400 + 1 AS part FROM events) "
    "SELECT part, count(*) AS n, min(user_id) AS least_user, max(value) AS most FROM p GROUP BY part"
)
def resumable_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of 400 events, listed in a manifest once they are whole."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    made = write_parts_once(events, shared_dir(spark), ["event_id", "user_id", "ts", "event_type", "value"], 400)
    return made.groupBy("part").agg(F.count("*").alias("n"), F.min("user_id").alias("least_user"), F.max("value").alias("most"))
