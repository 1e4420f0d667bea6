"""Line dedup by overlapping windows of three lines.

Lines are what stands between line feeds; for hashing they are trimmed. Every
window of three consecutive lines is hashed; a window that occurs more than once
in the table is repeated. Its first occurrence, by (doc_id, text hash, line), is
left alone; the lines of all later ones are covered, and covered lines go. Where
later occurrences overlap, their lines merge into one covered run.

Defined cases: a null text stays null; a text of fewer than three lines has no
window and stays as it is; rows that repeat a doc_id and text are one occurrence
each and share one fate (if they hold the first occurrence, all keep it); within
a text, lines of a later occurrence go even where it overlaps the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays
from tideline.llm.shared import fresh, look_up, settle, text_or_empty

SIZE = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def window_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), i (first line of the window, from 0), h1, h2."""
    base = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), F.transform(lines_of(text_or_empty()), lambda x: F.btrim(x)).alias("ls"))
    base = base.filter(F.size("ls") >= SIZE)
    windows = F.arrays_zip(*[F.slice("ls", k + 1, F.size("ls") - (SIZE - 1)).alias(f"l{k}") for k in range(SIZE)])
    rows = base.select("doc_id", "th", F.posexplode(windows).alias("i", "w"))
    parts = [F.col(f"w.l{k}") for k in range(SIZE)]
    return rows.select("doc_id", "th", "i", F.xxhash64(*parts).alias("h1"), F.hash(*parts).alias("h2"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th and `covered`, the positions of the lines that go, for texts that lose some."""
    windows = window_hashes(docs)
    place = F.struct("doc_id", "th", "i")
    first = settle(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = look_up(windows, first, ["h1", "h2"], "n", ["doc_id", "th", "i"]).filter(place != F.col("first"))
    starts = later.groupBy("doc_id", "th").agg(F.collect_set("i").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (SIZE - 1)))))
    return starts.select("doc_id", "th", covered.alias("covered"))


def drop_repeated_lines(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """docs with repeated windows' later occurrences cut from `text`; `removed` names a column for the number of lines cut."""
    key_id, key_hash, covered = fresh(docs, "_id", "_th", "_covered")
    cut = covered_lines(docs).select(F.col("doc_id").alias(key_id), F.col("th").alias(key_hash), F.col("covered").alias(covered))
    same = F.col("doc_id").eqNullSafe(F.col(key_id)) & (F.xxhash64(text_or_empty()) == F.col(key_hash))
    rows = docs.join(cut, same, "left")

    def kept(ls: Column) -> Column:  # the lines come as one value, split once for a text
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(covered)), lambda i: F.get(ls, i)), "\n")

    text = F.when(F.col(covered).isNull(), F.col("text")).otherwise(arrays.bind(lines_of(F.col("text")), kept))
    number = [F.coalesce(F.size(covered), F.lit(0)).alias(removed)] if removed else []
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *number)


ORACLE = """
WITH ls AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
win AS (
  SELECT doc_id, i, trim(line, ' ') AS a,
         lead(trim(line, ' '), 1) OVER (PARTITION BY doc_id ORDER BY i) AS b,
         lead(trim(line, ' '), 2) OVER (PARTITION BY doc_id ORDER BY i) AS c
  FROM ls),
occ AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth
  FROM win WHERE c IS NOT NULL),
cov AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM occ WHERE nth > 1)
SELECT ls.doc_id,
       coalesce(string_agg(CASE WHEN cov.i IS NULL THEN line END, chr(10) ORDER BY ls.i), '') AS text,
       CAST(count(cov.i) AS INTEGER) AS lines_removed
FROM ls LEFT JOIN cov ON cov.doc_id = ls.doc_id AND cov.i = ls.i
GROUP BY ls.doc_id
"""
