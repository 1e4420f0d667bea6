"""Similarity join, fill-in-the-middle and whitening against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.oracle import compare
from tideline.llm import fill_middle, queries, shingle_join, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def shingles(text, width=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_groups(rows, width=4, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=key)


def groups_of(spark, rows, width=4, percent=85, **more):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n", "2 as _key", "3 as h", "4 as _root", "5 as U")
    return sorted((tuple(r) for r in shingle_join.link_groups(df, width, percent).collect()), key=lambda r: tuple((x is None, x) for x in r))


def family(rng, first, n, changed, length):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    for i in range(n):
        w = list(base)
        for q in rng.sample(range(length), changed):
            w[q] = f"z{rng.randrange(10**9)}"
        yield first + i, " ".join(w)


@pytest.mark.parametrize("block", [256, 5])
def test_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(5)
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, ""), (4, None), (5, " \t"), (None, ""), (6, "One"), (7, "one"), (8, "one two")]
    rows += [(9, "a b c d a b c d a b c d"), (9, "b c d a b c d a b c d a"), (10, "d a b c d a b c d"), (11, "one"), (11, "one")]
    rows += [*family(rng, 100, 50, 2, 40), *family(rng, 200, 60, 1, 30), *family(rng, 300, 40, 6, 200), *family(rng, 400, 30, 3, 90)]
    passage = [f"p{i}" for i in range(40)]
    rows += [(500 + i, " ".join(passage + [f"q{rng.randrange(9999)}" for _ in range(9 + i % 3)])) for i in range(40)]
    chain = [f"c{j}" for j in range(100)]
    for i in range(25):
        chain = [*chain[: 97 - 3 * i], *[f"d{i}x{j}" for j in range(3)], *chain[100 - 3 * i :]]
        rows.append((600 + i, " ".join(chain)))
    rows += [(700, " ".join(f"long{i % 900}" for i in range(30_000))), (701, " ".join(f"long{i % 900}" for i in range(29_500)))]
    assert groups_of(spark, rows) == brute_groups(rows)


def test_join_of_nothing(spark):
    assert groups_of(spark, []) == []
    assert groups_of(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("changed", [1, 3])
def test_no_pair_twice_and_no_more_than_rows(spark, monkeypatch, changed):
    """Texts that are all one group, or hardly link at all, with most pairs just under the threshold: comparisons follow the rows."""
    plain, seen = shingle_join.with_both, []

    def counted(pairs, *more):
        seen.extend(tuple(sorted(p)) for p in pairs.select("u", "v").collect())
        return plain(pairs, *more)

    monkeypatch.setattr(shingle_join, "with_both", counted)
    for n in (200, 800):
        rows = [*family(random.Random(0), 0, n, changed, 90)]
        seen.clear()
        assert groups_of(spark, rows, 5, 80) == brute_groups(rows, 5, 80)
        assert len(seen) == len(set(seen)) <= 2 * n


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_ngram_jaccard_join"])
def test_queries_match_sql(spark, sf, name):
    compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def slow_cut(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_matches_and_comes_back(spark):
    rng = random.Random(2)
    bits = ["a", "Zz", " ", "\n", "é", "漢", "😀", "<", "P>", "S>", "M>", "<P", "@", "[", "`", "{", "0", "Ł"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(None, None), (None, "x y"), (1, ""), (2, None), (7, "a<P>b"), (7, "a<P>b"), (900, "word " * 200_000), (901, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n", "'x' as form", "'y' as output")
    cuts = fill_middle.transform(docs)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, cuts.collect()), key=key) == sorted((slow_cut(*r) for r in rows), key=key)
    back = cuts.select(fill_middle.restored(cuts.output, cuts.form).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t in rows)
    assert {r.form for r in cuts.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_middle.digests(fill_middle.transform(docs.limit(0))).count() == 0


VECS = "vec_id long, embedding array<float>"


def brute_whitening(rows, most=32):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in x]
    centred = np.array(apart, np.longdouble) / n
    values, vectors = np.linalg.eigh((centred.T @ centred / n).astype(float))
    return [i for i, _ in kept], n, [sum(a * a for a in v) for v in apart], centred.astype(float), values[::-1], vectors[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * 0.2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [(7, rows[7][1])] * 150  # a third are copies
    rows += [(1000, None), (1001, []), (1002, [None] + [0.0] * 39), (1003, [math.nan] + [0.0] * 39), (1004, [math.inf] + [0.0] * 39), (None, rows[3][1])]
    df = spark.createDataFrame(rows, VECS).selectExpr("*", "1 as x", "2 as _id", "3 as n")
    got = whitening.report(df).collect()
    ids, n, deviation, centred, values, vectors = brute_whitening(rows)
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert sorted(by, key=str) == sorted(set(ids), key=str)
    for i, d in zip(ids, deviation, strict=True):
        assert {r.deviation for r in by[i]} == {d}
    for k in range(32):
        want = centred @ vectors[:, k] / math.sqrt(values[k])
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        have = np.array([mine[i] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert math.isclose(next(r.explained for r in got if r.component == k + 1), values[k] / values.sum(), rel_tol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECS)
    assert whitening.report(frame([])).count() == 0
    assert whitening.report(frame([(1, None), (2, [])])).count() == 0
    assert whitening.report(frame([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0  # no variance, no component
    flat = whitening.report(frame([(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [0.5, 4.0])])).collect()
    assert len(flat) == 3 and math.isclose(flat[0].explained, 1.0) and flat[0].identity_error < 1e-9
    far = whitening.report(frame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.deviation is None for r in far if r.vec_id < 3} == {True} and all(int(r.deviation_text) > 2**63 for r in far if r.vec_id < 3)
    with pytest.raises(ValueError, match="several lengths"):
        whitening.report(frame([(1, [0.5]), (2, [0.5, 1.0])]))


def test_whitening_query(spark, sf):
    got = queries.queries()["op11_embedding_whitening"](spark, sf)
    assert got.count() == 32 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.first().identity_error < 1e-4


def test_lower_letters_changes_ascii_only(spark):
    rows = [(f"{chr(c)} ABC x",) for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000] + [(f"{chr(c)}Z",) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", shingle_join.lower_letters(df.t).alias("low")).collect()
    assert all(r.low == "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.t) for r in got)
