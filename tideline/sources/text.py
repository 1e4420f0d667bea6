"""Readers of annotation text: ids, forced alignments, RTTM, nested JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import arrays
from tideline.functions.text import UTTERANCE_ID


def ids_in(df: DataFrame, column: str, pattern: str = UTTERANCE_ID) -> DataFrame:
    """timing: every match of the pattern, a row each."""
    return df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("timing"))


def text_files(spark: SparkSession, path: str, glob: str = "*.txt", whole: bool = False) -> DataFrame:
    """value and file of all matching files below path."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=whole)
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def alignments(lines: DataFrame, column: str = "value") -> DataFrame:
    """unique_id, words, timing of lines `id "w,w,,w" "t,t,t"`; a number that is none raises an error.

    Outer commas are stripped, so that the first word is the leading silence's successor; inner empty words are pauses.
    """
    parts = F.split(F.col(column), '"')
    words = F.split(F.btrim(F.get(parts, 1), F.lit(",")), ",")
    timing = F.transform(F.split(F.btrim(F.get(parts, 3), F.lit(", ")), ","), lambda x: F.btrim(x).cast("double"))
    return lines.filter(F.col(column).contains('"')).select(F.btrim(F.get(parts, 0)).alias("unique_id"), words.alias("words"), timing.alias("timing"))


def speech_ranges(df: DataFrame) -> DataFrame:
    """df with pause_start_time, pause_stop_time, start_time, stop_time from words and timing.

    A pause is an empty word i, from timing[i] to timing[i + 1]; speech runs from timing[0] to timing[-2] between the pauses.
    """
    pauses = arrays.positions_of(F.col("words"), F.lit(""))
    df = df.withColumns({"pause_start_time": arrays.gather(F.col("timing"), pauses), "pause_stop_time": arrays.gather(F.col("timing"), pauses, 1)})
    first, last = F.slice("timing", 1, 1), F.filter(F.array(F.try_element_at("timing", F.lit(-2))), lambda x: x.isNotNull())
    return df.withColumns({"start_time": F.concat(first, "pause_stop_time"), "stop_time": F.concat("pause_start_time", last)})


def rttm(lines: DataFrame, column: str = "value", speaker: bool = False, keep: list[str] | None = None) -> DataFrame:
    """file_id, start, end (and speaker) of RTTM lines: fields 1, 3, 3 + 4 (and 7), split at white space; `keep` names columns to carry."""
    f = F.split(F.btrim(F.col(column)), r"\s+")
    start, length = F.get(f, 3).cast("double"), F.get(f, 4).cast("double")
    more = [F.get(f, 7).alias("speaker")] if speaker else []
    return lines.filter(F.size(f) > 4).select(F.get(f, 1).alias("file_id"), start.alias("start"), (start + length).alias("end"), *more, *(keep or []))


def rttm_files(spark: SparkSession, path: str, speaker: bool = False) -> DataFrame:
    """All RTTM files below path; of several files with one file_id, the last by name replaces the others."""
    rows = rttm(text_files(spark, path, "*.rttm"), speaker=speaker, keep=["file"])
    last = rows.groupBy("file_id").agg(F.max("file").alias("file"))
    return rows.join(last, ["file_id", "file"], "left_semi").drop("file")


def records(df: DataFrame, meta: str, columns: list[str]) -> DataFrame:
    """meta, source and the fields of each struct in each named array column; fields that a column lacks are null.

    `source` is the column's name; a field of that name in the structs gives way to it.
    """

    def rows(c: str) -> DataFrame:
        fields = [n for n in df.schema[c].dataType.elementType.names if n.lower() != "source"]
        return df.select(meta, F.lit(c).alias("source"), F.explode(c).alias("_r")).select(meta, "source", *[F.col(f"_r.`{n}`") for n in fields])

    frames = [rows(c) for c in columns]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def mixture_json(spark: SparkSession, path: str, sources: list[str]) -> DataFrame:
    """Rows of the nested mixture metadata files below path."""
    return records(spark.read.option("multiLine", True).json(path), "mixture_name", sources)


def parts_of(spark: SparkSession, path: str, contains: str | None = None, prefix: str | None = None, suffix: str | None = None, part: int | None = None) -> DataFrame:
    """The Parquet files below path whose name has all that is given; part n stands as `_part{n}_` in it.

    Names are matched before any file is opened, by the reader's own glob.
    """
    for piece in (contains, prefix, suffix):
        if piece and set(piece) & set("*?[]{}\\"):
            raise ValueError(f"{piece!r} must be plain text")
    inner = [x for x in (f"*_part{part}_*" if part is not None else None, f"*{contains}*" if contains else None) if x]
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix or ''}{inner[0] if inner else '*'}{suffix or ''}").parquet(path)
    return rows.filter(F.col("_metadata.file_name").contains(contains)) if contains else rows


def csv_if_sound(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV files at path; none at all, empty files and lines that don't fit the schema give no rows and no error."""
    kept = f"{schema}, _broken string"
    try:
        rows = spark.read.schema(kept).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    # Every field must be read for a line to be found broken, also where only rows are counted.
    whole = F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in rows.columns if c != "_broken"])) >= 0
    return rows.filter(F.col("_broken").isNull() & whole).drop("_broken")


def info_csv(spark: SparkSession, path: str) -> DataFrame:
    """All *_info.csv files below path as text columns; resource forks (._*) are passed over."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_info.csv").csv(path, header=True)
    return files.filter(~F.col("_metadata.file_name").startswith("._"))


def as_list(text: Column, kind: str = "array<array<double>>") -> Column:
    """Lists that a CSV file holds as text."""
    return F.from_json(text, kind)
