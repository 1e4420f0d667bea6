"""The library's scalar functions for use in SQL, as functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_IV = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE>>"

#: name: (arguments, result type, expression)
FUNCTIONS = {
    "hash_bucket": ("k STRING", "BIGINT", "pmod(cast(conv(substring(md5(k), 1, 8), 16, 10) AS BIGINT), 10)"),
    "signal_power": ("a ARRAY<FLOAT>", "DOUBLE", "try_divide(aggregate(a, 0D, (s, x) -> s + cast(x AS DOUBLE) * cast(x AS DOUBLE)), size(a))"),
    "snr_db": ("signal DOUBLE, noise DOUBLE", "DOUBLE", "10 * log10(try_divide(signal, noise))"),
    "argmax0": ("a ARRAY<DOUBLE>", "INT", "CASE WHEN size(a) > 0 THEN cast(array_position(a, array_max(a)) - 1 AS INT) END"),
    "total_length": (f"iv {_IV}", "DOUBLE", "aggregate(iv, 0D, (s, x) -> s + (x.end - x.start))"),
    "drop_empty": (f"iv {_IV}", _IV, "filter(iv, x -> x.start <> x.end)"),
    "intersect_intervals": (
        f"a {_IV}, b {_IV}",
        _IV,
        "filter(flatten(transform(a, x -> transform(b, y -> named_struct('start', greatest(x.start, y.start), 'end', least(x.end, y.end))))), z -> z.start < z.end)",
    ),
    "split_mixture": ("id STRING, part INT", "STRING", r"get(split(id, '_(?=[0-9])'), part)"),
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions for this session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
