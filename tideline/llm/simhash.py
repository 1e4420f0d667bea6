"""SimHash document fingerprints, and a search for fingerprints within a Hamming radius.

Everything here is DataFrame code. Each term of a text has a 64-bit hash and a
weight; each bit of the hash votes with that weight for or against the same bit
of the fingerprint. Votes are counted in 32 sums of two 32-bit lanes each, so
that a plain hash aggregate does the counting, with map-side partial sums.

Defined cases: a null text is an empty text; a text without words has
fingerprint zero; a text of fewer words than a shingle has one term, the whole
word sequence; equal texts have equal fingerprints. The votes of one text may
weigh up to 2**31 in all, which a text of 2 GB (Spark's limit) can't exceed.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.shared import look_up, only, settle, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
TWO_LANES = 0x0000000100000001
LOW_LANE = 0xFFFFFFFF


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """Words between runs of ASCII white space; an empty array for a text without words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def explode_terms(df: DataFrame, text: str, width: int = 3, split: bool = True) -> DataFrame:
    """One row per shingle of `width` words, repeats included, as column `term`.

    A row without words stays as one row with a null term. split=False: the column holds the words.
    """
    whole = F.struct(F.concat_ws(" ", "_words").alias("w0"), *[F.lit(None).cast("string").alias(f"w{i}") for i in range(1, width)])
    full = F.size("_words") - (width - 1)
    zipped = F.arrays_zip(*[F.slice("_words", i + 1, F.greatest(full, F.lit(0))).alias(f"w{i}") for i in range(width)])
    shingles = F.when(full > 0, zipped).when(F.size("_words") > 0, F.array(whole))
    rest = [c for c in df.columns if c != text]
    rows = df.withColumn("_words", word_array(F.col(text)) if split else F.col(text)).select(*rest, shingles.alias("_shingles"))
    rows = rows.select(*rest, F.explode_outer("_shingles").alias("_s"))
    joined = F.concat_ws(" ", *[F.col(f"_s.w{i}") for i in range(width)])
    return rows.select(*rest, F.when(F.col("_s").isNotNull(), joined).alias("term"))


def vote(terms: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """A row for each key with its `fingerprint`; a bit is 1 if over half the weight has it."""
    h, one = F.col("_h"), F.lit(1).cast("long")
    rows = terms.select(*keys, F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("_h"), (one if weight is None else weight.cast("long")).alias("_w"))
    lanes = [F.sum((F.shiftrightunsigned(h, k) if k else h).bitwiseAND(F.lit(TWO_LANES)) * F.col("_w")).alias(f"_l{k}") for k in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("_w").alias("_total"), *lanes)
    bits = []
    for k in range(32):
        for bit, count in ((k, F.col(f"_l{k}").bitwiseAND(F.lit(LOW_LANE))), (k + 32, F.shiftrightunsigned(f"_l{k}", 32))):
            bits.append(F.when(count * 2 > F.col("_total"), F.shiftleft(one, bit)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def hex16(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of the 64 bits in which two fingerprints agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def term_weight() -> Column:
    """Long shingles tell more than short ones, which common words make up: the length, 31 at most."""
    return F.least(F.length("term"), F.lit(31))


def table_masks(radius: int) -> list[int]:
    """Masks of the permuted tables: 64 bits in radius + 3 blocks; a table's key is any 3 of them.

    Two fingerprints that differ in at most `radius` bits differ in as many
    blocks at most, so they agree on all bits of at least one mask.
    """
    n = radius + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(blocks, 3)]


def block_tables(fingerprints: DataFrame, column: str, radius: int) -> DataFrame:
    """Each row once for each permuted table, with its `table` number and its `key`.

    Masking is the permutation: bits of the mask in front, the others cut off;
    equal keys are what sorting the permuted table would bring together.
    """
    keys = F.array(*[F.col(column).bitwiseAND(F.lit(m)) for m in table_masks(radius)])
    return fingerprints.select("*", F.posexplode(keys).alias("table", "key"))


def count_within(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, chunk: int = 1024) -> DataFrame:
    """For each distinct `fingerprint` of queries, `n_near`: rows of fingerprints within the radius.

    All rows count, those equal to the query too. Buckets are cut into chunks of
    about `chunk` distinct fingerprints, so a bucket of near copies makes rows in
    proportion to its chunks, not to its pairs. A pair that several tables find
    counts in the first of them.
    """
    masks = table_masks(radius)
    asked = block_tables(only(queries, "fingerprint").distinct(), "fingerprint", radius).withColumnRenamed("fingerprint", "q")
    known = block_tables(only(fingerprints, "fingerprint").groupBy("fingerprint").agg(F.count("*").alias("n")), "fingerprint", radius)
    # Exploding multiplies rows behind the planner's back: without the hints it would broadcast sides that grow with the data.
    known = known.join(asked.select("table", "key").distinct().hint("merge"), ["table", "key"], "left_semi")
    sizes = known.groupBy("table", "key").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    chunks = (
        known.join(sizes.hint("merge"), ["table", "key"])
        .withColumn("c", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")))
        .groupBy("table", "key", "c")
        .agg(F.collect_list(F.struct("fingerprint", "n")).alias("held"))
    )
    every = F.array(*[F.lit(m) for m in masks])

    def found(x: Column) -> Column:
        diff = x["fingerprint"].bitwiseXOR(F.col("q"))
        first = ~F.exists(F.slice(every, 1, F.col("table")), lambda m: diff.bitwiseAND(m) == 0)
        return F.when((F.bit_count(diff) <= radius) & first, x["n"]).otherwise(F.lit(0).cast("long"))

    hits = asked.join(chunks.hint("merge"), ["table", "key"]).select("q", F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + found(x)).alias("n"))
    return hits.groupBy(F.col("q").alias("fingerprint")).agg(F.sum("n").alias("n_near"))


def with_next(docs: DataFrame, block_rows: int = 512, most_cuts: int = 16384) -> DataFrame:
    """Each text with that of the next document by descending doc_id; the first follows the last.

    Rows go to blocks of about `block_rows` rows by quantiles of doc_id (`most_cuts`
    at most; beyond that many blocks, the range between two quantiles is cut evenly),
    so no window spans the table; only a block's head is looked up across blocks.
    The rows of a doc_id that fills blocks, and rows without doc_id, which come last,
    are dealt to blocks by the hash of their text. Only rows that repeat each other
    in full, or share a doc_id of less than 1 in `most_cuts` rows, stay in one block.
    Columns: _block and _rn (the row's place), doc_id, text, next_text, next_block, next_rn.
    Rows with one doc_id follow each other by the hash of their text.
    """
    docs = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    known = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    wanted = max(1, known["n"] // block_rows)
    side = max(2, math.ceil(math.sqrt(min(most_cuts, wanted))))
    parts = max(1, -(-wanted // side**2))
    low, high = known["low"] or 0, known["high"] or 0
    shares = [i / side**2 for i in range(1, side**2)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * side**2)).alias("c")).first()["c"] or []
    cuts = [*cuts, *[high] * (side**2 - len(cuts))]
    rows = [cuts[i * side : (i + 1) * side] for i in range(side)]
    outer = F.array(*[F.lit(r[-1]) for r in rows[:-1]])
    nested = lambda table: F.array(*[F.array(*[F.lit(x) for x in r]) for r in table])
    inner = nested([r[:-1] for r in rows])
    below = lambda cut: F.size(F.filter(cut, lambda x: x < F.col("doc_id")))
    placed = docs.withColumn("_i", below(outer)).withColumn("_j", below(F.get(inner, F.col("_i"))))
    here = F.col("_i") * side + F.col("_j")
    block = here
    if parts > 1:
        ends = nested([[float(x) for x in [rows[i - 1][-1] if i else low, *r]] for i, r in enumerate(rows)])
        placed = placed.withColumn("_e", F.get(ends, F.col("_i")))
        begin, end = F.get("_e", F.col("_j")), F.get("_e", F.col("_j") + 1)
        even = F.floor(F.coalesce(F.try_divide(F.col("doc_id").cast("double") - begin, end - begin), F.lit(0.0)) * parts)
        block = here * parts + F.greatest(F.least(even, F.lit(parts - 1)), F.lit(0))
    bits = max(0, min(20, (wanted - 1).bit_length()))
    hashed = F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(-(2**63))), 64 - bits) if bits else F.lit(0).cast("long")
    # An id that is two quantiles fills blocks of its own: it is the largest in its block, and its rows are cut by their hash.
    filling = [[cuts[k] == cuts[min(k + 1, side**2 - 1)] and k < side**2 - 1 or parts > 1 for k in range(i * side, (i + 1) * side)] for i in range(side)]
    at = lambda table: F.get(F.get(nested(table), F.col("_i")), F.col("_j"))
    within = F.when(at(filling) & (F.col("doc_id") == at(rows)), F.lit(2**bits) - hashed).otherwise(F.lit(0).cast("long"))
    number = F.when(F.col("doc_id").isNull(), -1 - hashed).otherwise(block.cast("long") * (2**bits + 1) + within)
    placed = placed.withColumn("_block", number).select("_block", "doc_id", "text")
    order = Window.partitionBy("_block").orderBy(F.col("doc_id").desc(), F.xxhash64("text"))
    run = placed.select("_block", "doc_id", "text", F.row_number().over(order).alias("_rn"), F.lead("text").over(order).alias("_lead"))
    heads = run.filter("_rn = 1").select(F.col("_block").alias("_hb"), F.col("text").alias("_head"))
    blocks = placed.select("_block").distinct()
    ring = Window.orderBy(F.col("_block").desc())  # one row a block
    after = blocks.select(F.col("_block").alias("_at"), F.coalesce(F.lead("_block").over(ring), F.max("_block").over(Window.partitionBy())).alias("_nb"))
    heads = after.join(heads, F.col("_nb") == F.col("_hb")).drop("_hb")
    joined = run.join(heads, (F.col("_block") == F.col("_at")) & F.col("_lead").isNull(), "left")
    return joined.select(
        "_block", "_rn", "doc_id", "text", F.coalesce("_lead", "_head").alias("next_text"),
        F.when(F.col("_lead").isNotNull(), F.col("_block")).otherwise(F.col("_nb")).alias("next_block"),
        F.when(F.col("_lead").isNotNull(), F.col("_rn") + 1).otherwise(F.lit(1)).alias("next_rn"),
    )


def fingerprints(docs: DataFrame, keys: list[str], width: int = 3, text: str = "text") -> DataFrame:
    """`fingerprint` for each row's key: lower-cased words, shingles of `width` words weighted by their length."""
    rows = docs.select(*keys, F.lower(text_or_empty(text)).alias("_text"))
    terms = explode_terms(rows, "_text", width)
    return vote(terms, keys, F.when(F.col("term").isNotNull(), term_weight()).otherwise(F.lit(1)))


def edited_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and how alike they are.

    The edited text has its last third replaced by the start of the next
    document. Documents whose doc_id is divisible by 20 are also looked up among
    all fingerprints: `n_near` counts the other documents within the radius; it
    is null for the rest. A repeated row is a document of its own.
    """
    place = ["_block", "_rn"]
    run = with_next(docs)
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    both = run.select(*place, "doc_id", "next_block", "next_rn", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    slim = both.select(*place, "doc_id", "next_block", "next_rn", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    texts = both.select(*place, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    texts = texts.select(*place, "x.kind", F.col("x.t").alias("text"))
    votes = fingerprints(texts, [*place, "kind"])
    pair = votes.groupBy(*place).agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    marks = settle(slim.join(pair, place))
    after = marks.select(F.col("_block").alias("next_block"), F.col("_rn").alias("next_rn"), F.col("fingerprint").alias("next_fingerprint"))
    near = count_within(marks.filter("doc_id % 20 = 0"), marks, radius)
    times = marks.groupBy("fingerprint").agg(F.count("*").alias("times"))
    near = settle(near.join(times.hint("merge"), "fingerprint"))
    out = look_up(marks.join(after, ["next_block", "next_rn"]), near, ["fingerprint"], "times", ["_block", "_rn"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fingerprint")).alias("fingerprint"), hex16(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.col("n_near") - 1).alias("n_near"),
    )
