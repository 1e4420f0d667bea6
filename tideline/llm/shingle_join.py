"""Similarity join of texts by the Jaccard similarity of their word n-grams, as groups of linked texts.

A text is the set of hashes of its runs of `width` words (ASCII letters lower-cased); two texts
link if 100 * common >= percent * all. Texts with equal words are one text throughout. The join
is exact: bounds leave out only pairs that can't link, and every other pair is compared once.

1. Suspects. By hash order, a linked text shares a known number of its first n-grams with the first
   of another; texts that share fewer leave before any whole set is moved.
2. Stars. Texts that hold the same most widespread n-gram are compared with one of them, the
   centre, whose n-grams are the most widespread: the original of many copies; and with that
   centre's own centre. Texts that are at least half alike to a centre orbit it, and are kept as
   their difference from it.
3. Pairs of one orbit. If x and y differ from the centre by dx and dy n-grams, they differ from each
   other by dx + dy - 2 * (common differences). A pair that links without a common difference
   links through the centre; all others meet in lists of a common difference, by rare-first
   prefixes. There again all are first compared with one, the nearest to the centre.
4. Other pairs meet in lists of a common n-gram, by rare-first prefixes of whole sets.

In 3 and 4 only n-grams count that several groups hold, and the lists are joined with themselves
under the length filter, the positional filter (what is left of both after the common n-gram) and
the suffix filter (what is left, part by part: an n-gram can only be common within its part). Lists
are joined in blocks of bounded size. Pairs within one group are never made.

Defined cases: a null text is an empty one; a text of fewer than `width` words is one n-gram, its
whole sequence; repeated rows and rows without an id keep their rows. Sets and texts are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import connected_components
from tideline.llm.shared import Steps, look_up, text_or_empty
from tideline.llm.simhash import lower_ascii, word_array

PARTS, STRIDE, STRIDES = 8, 16, 8  # of the suffix filter
TOP = 8  # n-grams by which centres find each other
BLOCK = 256  # rows of a list that one task compares with as many others
EXTRA = 5  # percent of a text's n-grams by which the prefix in hash order is longer than one common n-gram needs


def ceil_of(value: Column, times: int, by: int) -> Column:
    """ceil(value * times / by) of integers."""
    return F.floor((value * times + (by - 1)) / by)


class Rule:
    """What width and percent mean for set sizes, in integers."""

    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent

    def own(self, n: Column) -> Column:
        """The least number of n-grams that a text of n has in common with one that it links with."""
        return ceil_of(n, self.percent, 100)

    def enough(self, common: Column, n: Column, m: Column) -> Column:
        return common * (100 + self.percent) >= (n + m) * self.percent

    def close(self, apart: Column, n: Column, m: Column) -> Column:
        """The same by the number of n-grams that one of the two has alone."""
        return apart * (100 + self.percent) <= (n + m) * (100 - self.percent)

    def sizes(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def most_apart(self, n: Column) -> Column:
        """The most n-grams that a text of n and one that it links with have alone."""
        return F.floor(n * (100 - self.percent) / self.percent)


def lower_letters(text: Column) -> Column:
    """A-Z in lower case and nothing else: by `lower`, unless the text has another capital letter, or a sign that Java does not know."""
    others = text.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}&&[^\x00-\x7F]]")
    return F.when((F.octet_length(text) > F.length(text)) & others, lower_ascii(text)).otherwise(F.lower(text))


def words_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, _words, and _key (equal for equal sequences of words) of each row."""
    rows = docs.select(*columns, word_array(lower_letters(text_or_empty())).alias("_words"))
    return rows.withColumn("_key", F.xxhash64("_words"))


def shingle_set(width: int) -> Column:
    """Distinct hashes of the runs of _words, in order of the hash."""
    starts = F.sequence(F.lit(1), F.size("_words") - (width - 1))
    many = F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, width)))
    return F.when(F.size("_words") >= width, F.sort_array(F.array_distinct(many))).otherwise(F.array("_key"))


def _extra(n: Column) -> Column:
    return F.greatest(ceil_of(n, EXTRA, 100), F.lit(1))


def mark(docs: DataFrame, rule: Rule, *columns: str) -> DataFrame:
    """The columns, text_hash, _key, n and `first`, the first n-grams in hash order, of each row."""
    hashed = docs.select(*columns, "text", F.xxhash64(text_or_empty()).alias("text_hash"))
    rows = words_of(hashed, *columns, "text_hash").withColumn("_set", shingle_set(rule.width)).withColumn("n", F.size("_set"))
    shipped = F.least(F.col("n"), F.col("n") - rule.own(F.col("n")) + _extra(F.col("n")))
    n = F.when(F.size("_words") > 0, F.col("n")).otherwise(0).alias("n")
    return rows.select(*columns, "text_hash", "_key", n, F.slice("_set", F.lit(1), shipped.cast("int")).alias("first"))


def suspects(marked: DataFrame, rule: Rule) -> DataFrame:
    """_key, and text_hash of one of its rows, of the texts of which enough first n-grams are first n-grams of others too."""
    grams = marked.select("_key", F.explode("first").alias("h"))
    once = grams.groupBy("h").agg(F.min("_key").alias("_key"), F.max("_key").alias("_other")).filter("_key = _other")
    alone = once.groupBy("_key").agg(F.count("*").alias("alone"))
    texts = marked.filter("n > 0").groupBy("_key").agg(F.max("n").alias("n"), F.max(F.size("first")).alias("shipped"), F.min("text_hash").alias("text_hash"))
    met = F.col("shipped") - F.coalesce("alone", F.lit(0))
    return texts.join(alone.hint("merge"), "_key", "left").filter(met >= _extra(rule.own(F.col("n")))).select("_key", "text_hash")


def texts_of(docs: DataFrame, asked: DataFrame, slots: int = 1 << 20) -> DataFrame:
    """The (settled, distinct) texts asked for, once each.

    A bitmap of their hashes' places among `slots`, of fixed size, is broadcast first, so that most
    other texts are not shuffled; it lets none of those asked for go. Copies meet within their
    partition first.
    """
    slot = F.pmod(F.col("text_hash"), F.lit(slots))
    word, bit = F.floor(slot / 64).alias("_word"), slot.bitwiseAND(F.lit(63)).cast("int")
    bits = asked.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("_word").agg(F.bit_or("b").alias("_bits"))
    rows = docs.select(text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("text_hash")).select("*", word)
    likely = rows.join(F.broadcast(bits), "_word").filter(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1)
    return likely.groupBy("text_hash").agg(F.first("text").alias("text")).join(asked.hint("merge"), "text_hash").select("text")


def met_grams(sets: DataFrame, steps: Steps) -> DataFrame:
    """_key, n, x (those of its n-grams that other texts have too, the rarest first) and fame, how widespread they are."""
    rows = sets.select("_key", "n", F.explode("_set").alias("h"))
    held = rows.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1")
    met = rows.join(held.hint("merge"), "h").groupBy("_key", "n").agg(F.sort_array(F.collect_list(F.struct("many", "h"))).alias("x"), F.sum("many").alias("fame"))
    return met.select("_key", "n", (F.col("fame") / F.col("n")).alias("fame"), F.transform("x", lambda y: y["h"]).alias("x"))


def components(found: DataFrame, steps: Steps) -> DataFrame:
    """_key and _root of the texts that the edges found connect."""
    return steps.settle(connected_components(found, "u", "v").select(F.col("node").alias("_key"), F.col("root").alias("_root")))


def rooted(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows with the _root of their _key: a text without links is its own."""
    return rows.join(of.hint("merge"), "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))


def joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of a table of one row a key; a sort-merge join, in which Spark splits keys that many rows have."""
    return rows.join(table.hint("merge"), keys)


def with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The pairs u, v with the value of each in the table (_key, value), as u_value and v_value."""
    for end in ("v", "u"):
        pairs = joined(pairs, table.select(F.col("_key").alias(end), F.col(value).alias(f"{end}_value")), [end])
    return pairs


def centres(met: DataFrame, steps: Steps) -> DataFrame:
    """u, n, v, m, near: the texts beside their centre (near = 1) and their centre's centre (near = 0).

    Centres with a common n-gram among their TOP most widespread ones have the most famous of them
    as their centre, which brings together the copies that lack the n-gram most copies have.
    """
    home = met.select(F.element_at("x", -1).alias("h"), F.col("_key").alias("u"), "n", "fame")
    best = F.max(F.struct("fame", F.col("_key").alias("v"), F.col("n").alias("m"))).alias("c")
    size = home.groupBy("h").agg(F.count("*").alias("times"), F.max(F.struct("fame", F.col("u").alias("v"), F.col("n").alias("m"))).alias("c")).filter("times > 1")
    size = steps.settle(size.select("h", "c"))
    top = met.join(size.select(F.col("c.v").alias("_key")).hint("merge"), "_key", "left_semi")
    top = steps.settle(top.select("_key", "n", "fame", F.explode(F.slice(F.reverse("x"), 1, TOP)).alias("g")))
    above = joined(top.select("_key", "g"), top.groupBy("g").agg(best), ["g"]).groupBy(F.col("_key").alias("v")).agg(F.max("c").alias("cc"))
    size = size.withColumn("v", F.col("c.v")).join(above.hint("merge"), "v").select("h", "c", "cc")
    both = F.explode(F.array(F.struct(F.lit(0).alias("near"), F.col("cc.v").alias("v"), F.col("cc.m").alias("m")), F.struct(F.lit(1).alias("near"), F.col("c.v").alias("v"), F.col("c.m").alias("m"))))
    return joined(home, size, ["h"]).select("u", "n", both.alias("y")).select("u", "n", "y.*")


def listed(lists: DataFrame, met: DataFrame, steps: Steps) -> DataFrame:
    """u, n, v, m, near: the texts of each list (h, _key) beside its most famous one (near = 2)."""
    lists = steps.settle(lists.join(met.select("_key", "n", "fame").hint("merge"), "_key"))
    size = lists.groupBy("h").agg(F.count("*").alias("times"), F.max(F.struct("fame", F.col("_key").alias("v"), F.col("n").alias("m"))).alias("c")).filter("times > 1")
    return joined(lists, size.select("h", "c"), ["h"]).select(F.col("_key").alias("u"), "n", "c.v", "c.m", F.lit(2).alias("near"))


def stars(pairs: DataFrame, sets: DataFrame, rule: Rule, steps: Steps) -> DataFrame:
    """u, v, n, m, apart, linked of the pairs (u, n, v, m, near) that are not too different in size.

    For each text's nearest centre (near < 2) of which it is half alike: `differ`, the n-grams that one of them has alone.
    """
    half = F.least("n", "m") * 2 >= F.greatest("n", "m")
    pairs = steps.settle(pairs.filter((F.col("u") != F.col("v")) & half).groupBy("u", "v", "n", "m").agg(F.min("near").alias("near")))
    both = with_both(pairs, sets, "_set").withColumn("apart", F.col("n") + F.col("m") - 2 * F.size(F.array_intersect("u_value", "v_value")))
    differ = F.concat(F.array_except("u_value", "v_value"), F.array_except("v_value", "u_value"))
    orbits = (F.col("near") < 2) & (F.col("apart") * 3 <= F.col("n") + F.col("m"))
    linked = rule.close(F.col("apart"), F.col("n"), F.col("m"))
    star = steps.settle(both.select("u", "v", "n", "m", "near", "apart", linked.alias("linked"), F.when(orbits, differ).alias("differ")))
    first = star.filter("differ is not null").groupBy("u").agg(F.min("near").alias("first"))
    star = star.join(first.hint("merge"), "u", "left")
    return steps.settle(star.withColumn("differ", F.when(F.col("near") == F.col("first"), F.col("differ"))).drop("near", "first"))


def prefixes(rows: DataFrame, keys: list[str], kept: list[str], needed: Column, steps: Steps) -> DataFrame:
    """Lists by rare-first prefixes: keys, h, kept, rest and tail.

    rows: keys, h, kept (with _key and _group), _root. Only n-grams h count that several
    roots and several groups hold. needed: how many of them a pair has in common at least.
    rest: how many of the row's n-grams are left from h on; tail: how many after it, by part
    (counted anew every STRIDE places, or STRIDES times, so some of those before it count too).
    """
    held = rows.groupBy(*keys, "h").agg(F.count("*").alias("many"), *[f(c).alias(f"{c}{i}") for c in ("_root", "_group") for i, f in enumerate((F.min, F.max))])
    held = held.filter("_root0 <> _root1 and _group0 <> _group1").select(*keys, "h", "many")
    some = rows.join(held.hint("merge"), [*keys, "h"]).groupBy(*keys, *kept).agg(F.sort_array(F.collect_list(F.struct("many", "h"))).alias("x")).withColumn("x", F.transform("x", lambda y: y["h"]))
    first = (F.size("x") + 1 - needed).cast("int")
    part = lambda b: lambda p: F.size(F.filter(F.slice("x", b + 2, F.size("x")), lambda y: F.pmod(y, F.lit(PARTS)) == p))
    parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
    stride = F.greatest(F.lit(STRIDE), F.ceil(first / STRIDES).cast("int"))
    tails = F.transform(F.sequence(F.lit(0), F.col("first") - 1, F.col("stride")), lambda b: F.transform(parts, part(b)))
    some = some.withColumn("first", first).filter("first > 0").withColumn("stride", stride).withColumn("tails", tails)
    place = F.transform(F.slice("x", F.lit(1), F.col("first")), lambda h, i: F.struct(h.alias("h"), (F.size("x") - i).alias("rest"), F.get("tails", F.floor(i / F.col("stride")).cast("int")).alias("tail")))
    return steps.settle(some.select(*keys, *kept, F.explode(place).alias("y")).select(*keys, "y.h", *kept, "y.rest", "y.tail"))


def several(lists: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
    """The rows, with _root and the length `times` of their list, of the lists that several roots and several groups hold."""
    rows = rooted(lists, of)
    size = rows.groupBy(*keys).agg(F.count("*").alias("many"), *[f(c).alias(f"{c}{i}") for c in ("_root", "_group") for i, f in enumerate((F.min, F.max))])
    return joined(rows, size.filter("_root0 <> _root1 and _group0 <> _group1").select(*keys, F.col("many").alias("times")), keys)


def fits(a: str, b: str, needed, rule: Rule) -> Column:
    """Length, positional and suffix filter of two rows of a list; needed(common, a, b) tells whether so many in common can be enough."""
    x = lambda side, c: F.col(f"{side}.{c}")
    after = reduce(lambda s, t: s + t, [F.least(x(a, "tail")[p], x(b, "tail")[p]) for p in range(PARTS)])
    apart = (x(a, "_root") != x(b, "_root")) & (x(a, "_group") != x(b, "_group")) & rule.sizes(x(a, "n"), x(b, "n"))
    return apart & needed(F.least(x(a, "rest"), x(b, "rest")), a, b) & needed(after + 1, a, b)


def meet(rows: DataFrame, keys: list[str], needed, rule: Rule) -> DataFrame:
    """The pairs u, v of rows of one list that pass the filters, once each; rows: as `several` gives them."""
    parts = F.floor((F.col("times") + (BLOCK - 1)) / BLOCK)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_key"), parts)).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    unit = [*keys, "_low", "_high"]
    rows = rows.withColumn("_low", F.least("_part", "_with")).withColumn("_high", F.greatest("_part", "_with"))
    a, b = rows.filter("_part = _low").alias("a"), rows.filter("_part = _high").hint("merge").alias("b")
    same = reduce(lambda p, q: p & q, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in unit])
    once = (F.col("a._part") < F.col("b._part")) | (F.col("a._key") < F.col("b._key"))
    met = a.join(b, same & once & fits("a", "b", needed, rule))
    return met.select(F.least("a._key", "b._key").alias("u"), F.greatest("a._key", "b._key").alias("v")).distinct()


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def within_orbits(star: DataFrame, found: DataFrame, of: DataFrame, rule: Rule, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """found and of, with the links between texts of one orbit that lead to other groups."""
    orbit = steps.settle(star.filter("differ is not null").select(F.col("v").alias("c"), F.col("u").alias("_key"), "n", "apart", "differ"))
    keys = ["c", "h"]
    rows = rooted(orbit.select("c", "_key", "n", "apart", F.explode("differ").alias("h")), of).withColumn("_group", F.col("_key"))
    needed = F.greatest(F.col("apart") - rule.most_apart(F.col("n")), F.lit(1))
    lists = prefixes(rows, ["c"], ["_key", "_group", "n", "apart"], needed, steps)

    def enough(common: Column, a: str, b: str) -> Column:
        return rule.close(F.col(f"{a}.apart") + F.col(f"{b}.apart") - 2 * common, F.col(f"{a}.n"), F.col(f"{b}.n"))

    def compared(pairs: DataFrame) -> DataFrame:
        """Of the settled pairs (of one orbit) those that link."""
        both = with_both(pairs, orbit.withColumn("value", F.struct("n", "apart", "differ")), "value")
        apart = F.col("u_value.apart") + F.col("v_value.apart") - 2 * F.size(F.array_intersect("u_value.differ", "v_value.differ"))
        return steps.settle(both.filter(rule.close(apart, F.col("u_value.n"), F.col("v_value.n"))).select("u", "v"))

    held = several(lists, keys, of).drop("times")
    met = joined(held, held.groupBy(*keys).agg(F.min(F.struct("apart", "_key", "_group", "n", "_root", "rest", "tail")).alias("z")), keys)
    met = met.select(F.struct(*[c for c in met.columns if c != "z"]).alias("y"), "z").filter((F.col("y._key") != F.col("z._key")) & fits("y", "z", enough, rule))
    tried = steps.settle(unordered(met.select(F.col("y._key").alias("u"), F.col("z._key").alias("v"))).distinct())
    if tried.isEmpty():
        return found, of
    found = steps.settle(found.unionByName(compared(tried)))
    of = components(found, steps)
    rest = meet(several(lists, keys, of), keys, enough, rule)
    rest = steps.settle(rest.join(tried.hint("merge"), ["u", "v"], "left_anti"))
    if rest.isEmpty():
        return found, of
    found = steps.settle(found.unionByName(compared(rest)))
    return found, components(found, steps)


def across(met: DataFrame, star: DataFrame, sets: DataFrame, found: DataFrame, of: DataFrame, rule: Rule, steps: Steps) -> DataFrame:
    """of, with every other link that leads to other groups."""
    orbits = star.filter("differ is not null")
    group = orbits.select(F.col("u").alias("_key"), F.col("v").alias("_group")).unionByName(orbits.select(F.col("v").alias("_key"), F.col("v").alias("_group"))).distinct()
    grouped = met.join(group.groupBy("_key").agg(F.min("_group").alias("_group")).hint("merge"), "_key", "left").withColumn("_group", F.coalesce("_group", "_key"))
    rows = rooted(grouped.select("_key", "_group", "n", F.explode("x").alias("h")), of)
    lists = prefixes(rows, [], ["_key", "_group", "n"], rule.own(F.col("n")), steps)
    pairs = meet(several(lists, ["h"], of), ["h"], lambda common, a, b: rule.enough(common, F.col(f"{a}.n"), F.col(f"{b}.n")), rule)
    pairs = steps.settle(pairs.join(unordered(star).distinct().hint("merge"), ["u", "v"], "left_anti"))
    if pairs.isEmpty():
        return of
    both = with_both(pairs, sets.withColumn("value", F.col("_set")), "value")
    common = F.size(F.array_intersect("u_value", "v_value"))
    links = both.filter(rule.enough(common, F.size("u_value"), F.size("v_value"))).select("u", "v")
    return components(steps.settle(found.unionByName(links)), steps)


def groups(marked: DataFrame, docs: DataFrame, rule: Rule, steps: Steps, more_lists=None) -> DataFrame:
    """_key and _root of the texts that link with others: the least key that links reach.

    marked: settled, as `mark` makes it of docs. more_lists: makes lists (h, _key) of the suspects'
    _key and _words, in which texts are compared with one as well.
    """
    asked = steps.settle(suspects(marked, rule))
    held = steps.settle(words_of(texts_of(docs, asked)))
    sets = steps.settle(held.select("_key", shingle_set(rule.width).alias("_set")).withColumn("n", F.size("_set")))
    met = steps.settle(met_grams(sets, steps))
    pairs = centres(met, steps)
    if more_lists:
        pairs = pairs.unionByName(listed(more_lists(held), met, steps))
    star = stars(pairs, sets, rule, steps)
    found = steps.settle(star.filter("linked").select("u", "v"))
    of = components(found, steps)
    found, of = within_orbits(star, found, of, rule, steps)
    return across(met, star, sets, found, of, rule, steps)


def link_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach, of each row of docs.

    A text without words has no shingle and links with nothing: its component_id is its own doc_id.
    Where no row of a group has a doc_id, component_id is null. An empty table gives an empty result.
    """
    steps, rule = Steps(docs.sparkSession), Rule(width, percent)
    marked = steps.settle(mark(docs, rule, "doc_id"))
    of = groups(marked, docs, rule, steps)
    texts = marked.filter("n > 0").groupBy("_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"))
    texts = steps.settle(rooted(texts, of))
    lowest = steps.settle(texts.groupBy("_root").agg(F.min("least").alias("component_id"), F.count("*").alias("texts")))
    table = steps.settle(look_up(texts.select("_key", "_root", "times"), lowest, ["_root"], "texts", ["_key"]).select("_key", "times", "component_id"))
    with_words = look_up(marked.filter("n > 0").select("_key", "doc_id", "n"), table, ["_key"], "times", ["doc_id"])
    out = with_words.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = marked.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = steps.settle(out.unionByName(none))
    steps.done(out)
    return out


#: Pairs with a common n-gram are counted out in full, so this is for tables of some thousands of documents.
ORACLE = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: md5_number(array_to_string(w[i:i + 3], ' ')))) WHEN len(w) > 0 THEN [md5_number(array_to_string(w, ' '))] ELSE [] END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s), c AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common, any_value(x.n) AS n, any_value(y.n) AS m FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM c WHERE 100 * common >= 85 * (n + m - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(least(doc_id, (SELECT min(b) FROM r WHERE r.a = doc_id)), doc_id) AS component_id FROM s
"""
