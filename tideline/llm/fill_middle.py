"""Fill-in-the-middle transformation of texts.

A text is cut into tokens, runs of ASCII letters or single other code points, and at two ranks
into prefix, middle and suffix, which are written in another order with sentinels between them. The
worker looks at a text as a numpy array of its UTF-32 code points: a token begins wherever two
neighbours are not both letters. Ranks and form come from the SHA-256 of the document's id, so they
don't depend on partitions or retries.

Defined cases: a null text is an empty one; an empty text, and one that holds a sentinel already,
stays plain; a null id counts as an empty string in the hash; repeated rows come out alike. Texts of
any length are worked on whole, one at a time; batches that leave a worker hold about `BATCH` bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
BATCH = 1 << 24


def token_starts(points: np.ndarray) -> np.ndarray:
    """Where the tokens of a code point array begin, and its end."""
    folded = points | 32
    letter = (folded >= 97) & (folded <= 122)
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(begins), len(points))


def cut(doc_id: int | None, text: str, plain_from: int, spm_below: int) -> tuple:
    """n, form, prefix and middle lengths in code points, output."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = token_starts(points)
    n = len(starts) - 1
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()[:16])
    if not n or h3 % 100 >= plain_from or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(starts[low]), int(starts[high])
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, None)))
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and the whole output of each row of docs.

    Of 100 documents about `plain_from` are cut, and of those about `spm_below` have the suffix first.
    """
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for one in batches:
            for doc_id, text in zip(one.column(0), one.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                if rows and held + len(text) > BATCH:
                    yield batch()
                    rows, held = [], 0
                rows.append((doc_id, *cut(doc_id, text, plain_from, spm_below)))
                held += len(text)
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: no piece holds a sentinel, so the sentinels tell the pieces apart."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(piece, F.lit(1)), F.get(piece, F.lit(3)), F.get(piece, F.lit(2)))
    spm = F.concat(F.get(piece, F.lit(2)), F.get(piece, F.lit(3)), F.get(piece, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(cuts: DataFrame) -> DataFrame:
    """The rows of `transform` with digests of output and restored text in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), back)


ORACLE = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
    FROM documents
), r AS (
    SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS i, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS j,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), p AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:least(i, j)], '') AS a, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS b,
           array_to_string(u[greatest(i, j) + 1:], '') AS c
    FROM r
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
