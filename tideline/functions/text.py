"""Names, ids and recodes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Id pattern, classes and sex pairs of the corpora.
UTTERANCE_ID = r"\d{3,5}-\d{3,7}-\d{3,5}"
CLASS_CODE = {"non_speech": 0, "one_spk": 1, "two_spk": 2}
SEX_PAIR = {"FM": "1M1F", "MF": "1M1F", "FF": "FF", "MM": "MM"}
RATES = {"wav8k": 8000, "wav16k": 16000}


def split_mixture(mixture: Column, part: int) -> Column:
    """Part 0, 1 or 2 of an id whose parts stand between underscores that a digit follows."""
    return F.get(F.split(mixture, r"_(?=\d)"), part)


def recode(c: Column, codes: dict) -> Column:
    """codes[c], or c itself where there is no code (kept as text)."""
    if not codes:
        return c
    table = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])
    found = F.try_element_at(table, c)
    return F.coalesce(found, c) if all(isinstance(v, str) for v in codes.values()) else found


def round_half_even(x: Column, decimals: int) -> Column:
    """The decimal nearest to the exact binary value of a double; only true ties go to the even digit.

    Spark's own round works on the shortest decimal text of a double, where 2.675 looks like a tie and isn't one.
    The error of x * 10**decimals is worked out exactly from halves of both factors. For |x| * 10**decimals < 2**53.
    """
    scale, cut = float(10**decimals), 134217729.0
    high_s = cut * scale - (cut * scale - scale)
    product = x * F.lit(scale)
    high = x * F.lit(cut) - (x * F.lit(cut) - x)
    low = x - high
    error = ((high * F.lit(high_s) - product) + high * F.lit(scale - high_s) + low * F.lit(high_s)) + low * F.lit(scale - high_s)
    whole = F.floor(product)
    half = product - whole - F.lit(0.5)
    up = (half > 0) | ((half == 0) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2)) == 1))))
    return (whole + up.cast("long")).cast("double") / F.lit(scale)


def chunk_name(audio_id: Column, i: Column, seconds: float, decimals: int | None = 3) -> Column:
    """id_start_end with the start i*c and the end i*c + c in seconds, rounded, or as they are."""
    start = i * F.lit(seconds)
    end = start + F.lit(seconds)
    if decimals is not None:
        start, end = round_half_even(start, decimals), round_half_even(end, decimals)
    return F.concat_ws("_", audio_id, start.cast("string"), end.cast("string"))


def sparse_chunk_name(audio_id: Column, i: Column, seconds: float) -> Column:
    """As chunk_name with one decimal, the end being (i + 1) * c."""
    return F.concat_ws("_", audio_id, round_half_even(i * F.lit(seconds), 1).cast("string"), round_half_even((i + 1) * F.lit(seconds), 1).cast("string"))


def label_file_name(split: str, wave: str, part: str | None = None) -> str:
    """train-100, both, part1 -> train_100_both_part1_2mix_osd_labels.parquet.gzip"""
    return "_".join(x for x in (split.replace("-", "_"), wave, part, "2mix_osd_labels.parquet.gzip") if x)


def lower_suffix(name: Column) -> Column:
    """The last four characters in lower case."""
    return F.concat(F.substring(name, F.lit(1), F.greatest(F.length(name) - 4, F.lit(0))), F.lower(F.right(name, F.lit(4))))


def last_part(path: Column, stem: bool = False) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "") if stem else name


def sampling_rate(wave: str) -> int:
    if wave not in RATES:
        raise ValueError(f"no such wave type: {wave!r}")
    return RATES[wave]


def hash_bucket(key: Column, buckets: int = 10) -> Column:
    """A bucket that every engine can compute: the first 32 bits of MD5 modulo `buckets`."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
