"""Fingerprints, near-duplicate groups and line windows against brute force."""

import hashlib
import math
import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tideline.llm import bktree, components, line_windows, near_sets, shingle_join, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def contract_fingerprint(t):
    w = words(t)
    terms = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in terms]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [contract_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, f"{prints[i]:016x}", min(least[find(i)])) for i, (d, _) in enumerate(rows))


def some_texts(seed=1):
    rng = random.Random(seed)
    bag = ["the", "Of", "and", "ÉTÉ", "x1", "ß", "thing", "ONE", "two", "three", "—", "a b"]
    text = lambda n: " ".join(rng.choice(bag) + str(rng.randrange(40)) for _ in range(n))
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "One\x0btwo\x0c"), (8, "a b c")]
    for i in range(20, 60):
        t = text(rng.randrange(3, 200))
        out.append((i, t))
        if i % 3 == 0:
            out.append((i + 100, t))
        if i % 4 == 0:
            w = t.split(" ")
            w[-1] = "changed"
            out.append((i + 200, " ".join(w)))
    return out


def test_near_duplicates_match_brute_force(spark):
    rows = some_texts()
    rows += [(1, rows[0][1]), (20, rows[8][1]), (20, "another text under the same id")]  # repeated rows stay rows
    got = sorted(tuple(r) for r in bktree.report(docs_of(spark, rows)).collect())
    assert got == brute_components(rows)
    odd = bktree.report(docs_of(spark, [(None, "p q r s"), (None, "p q r s"), (3, "p q r s"), (None, "t u v")]).selectExpr("*", "1 as text_hash", "2 as `_part`", "3 as fingerprint"))
    assert sorted((r.doc_id or 0, r.component_id or -1) for r in odd.collect()) == [(0, -1), (0, 3), (0, 3), (3, 3)]


def test_near_duplicates_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in bktree.report(docs).collect())
    assert got == brute_components(rows)


def test_keep_one_keeps_rows_and_columns(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "quite another text here"), (9, None)]
    docs = docs_of(spark, rows).selectExpr("*", "1 as fingerprint", "2 as component_id", "3 as `_copy`")
    out = bktree.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 9]
    assert bktree.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 4096])
def test_links_of_split_buckets(spark, size):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    points = set(base)
    for b in base:
        for _ in range(25):
            points.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    roots = {r.node: r.root for r in components.connected_components(bktree.fingerprint_links(df, 3, size), "u", "v").collect()}
    group = {p: p for p in signed}

    def find(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, p in enumerate(signed):
        for q in signed[:i]:
            if ((p ^ q) & (1 << 64) - 1).bit_count() <= 3:
                a, b = sorted((find(p), find(q)))
                group[b] = a
    assert {p: roots.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_forest_finds_all(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.r_[base, base[:20] ^ np.uint64(5), base[:9] ^ np.uint64(1 << 40)]
    unit = np.sort(np.arange(len(points)) % 4)
    forest = bktree.Forest(points, unit)
    got = {(q, p) for a, b in forest.within(points, unit, 3) for q, p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if unit[i] == unit[j] and int(points[i] ^ points[j]).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("hub", [10_000, 1])
def test_chain_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0), "a", "b").count() == 0


def weighted(t):
    w = (t or "").lower()
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    terms = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [(xxhash.xxh64_intdigest(x.encode(), seed=42), min(len(x), 31)) for x in terms]
    total = sum(k for _, k in h)
    return sum(1 << b for b in range(64) if 2 * sum(k for x, k in h if x >> b & 1) > total)


def brute_edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = set()
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + after[:third]
        f, g, h = weighted(t), weighted(e), weighted(after)
        near = None if d % 20 else sum((f ^ weighted(x)).bit_count() <= 3 for _, x in rows) - 1
        out.add((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{f:016x}", f"{g:016x}", 1 - (f ^ g).bit_count() / 64, 1 - (f ^ h).bit_count() / 64, near))
    return out


def test_edited_fingerprints(spark, sf):
    rows = some_texts()
    assert {tuple(r) for r in simhash.edited_fingerprints(docs_of(spark, rows)).collect()} == brute_edited(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in simhash.edited_fingerprints(docs_of(spark, rows)).collect()} == brute_edited(rows)


def test_next_document_over_many_blocks(spark):
    ids = [*range(0, 900, 3), 10**12, -4]
    rows = [(i, f"text {i}") for i in ids]
    got = {r.doc_id: r.next_text for r in simhash.with_next(docs_of(spark, rows), 4).collect()}
    order = sorted(ids, reverse=True)
    assert got == {d: f"text {order[(k + 1) % len(order)]}" for k, d in enumerate(order)}


def test_next_document_beyond_the_cuts(spark):
    """More blocks than cuts: ranges between two are cut evenly; rows without an id come last by their text's hash."""
    rng = random.Random(7)
    ids = rng.sample(range(10**9), 400) + [7 * 10**9, -(10**9)]
    rows = [(i, f"text {i}") for i in ids] + [(None, f"none {i}") for i in range(50)]
    got = simhash.with_next(docs_of(spark, rows), 4, 16).collect()
    assert len({r._block for r in got}) > 60
    texts = [t for _, t in sorted(rows, key=lambda r: -r[0] if r[0] is not None else math.inf)]
    last = [r.next_text for r in got if r.doc_id == -(10**9)]
    assert last[0].startswith("none")
    by = {r.text: r.next_text for r in got}
    assert all(by[a] == b for a, b in zip(texts[:401], texts[1:402], strict=True))
    seen, at = set(), texts[0]
    while at not in seen:  # one ring over all rows
        seen.add(at)
        at = by[at]
    assert len(seen) == len(rows) and at == texts[0]


def test_next_document_where_many_share_an_id(spark):
    """A third of all rows have one doc_id; they fill blocks of their own, in the order of their texts' hashes."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(700, f"same {i}") for i in range(1000)]
    for most in (16384, 16):
        got = simhash.with_next(docs_of(spark, rows), 16, most).collect()
        assert max(Counter(r._block for r in got).values()) < 100
        by = {r.text: r.next_text for r in got}
        ids = {t: i for i, t in rows}
        at, ring = "text 1999", []
        for _ in rows:
            ring.append(at)
            at = by[at]
        assert at == "text 1999" and len(set(ring)) == len(rows)
        assert [ids[t] for t in ring] == sorted((i for i, _ in rows), reverse=True)
        same = [t for t in ring if ids[t] == 700]
        assert same == sorted(same, key=lambda t: xxhash.xxh64_intdigest(t, 42) ^ 1 << 63)


def test_edited_fingerprints_of_few_rows(spark):
    assert simhash.edited_fingerprints(docs_of(spark, []).limit(0)).count() == 0
    out = simhash.edited_fingerprints(docs_of(spark, [(1, "abc"), (1, "abc"), (1, None)])).collect()
    assert len(out) == 3


def brute_lines(rows):
    seen, cut = {}, defaultdict(set)
    for d, t in sorted(rows, key=lambda r: r[0]):
        ls = [x.strip(" ") for x in (t or "").split("\n")]
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if w in seen:
                cut[d] |= {i, i + 1, i + 2}
            else:
                seen[w] = 1
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut[d]) for d, t in rows}


def test_line_windows(spark, sf):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "q\nq\nq\nq\nq"), (7, " a \nb\nc\nd\ne"), (8, "\n\n\n\n")]
    docs = docs_of(spark, rows).selectExpr("*", "1 as covered", "2 as `_covered`")
    out = line_windows.drop_repeated_lines(docs, "lines_removed")
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows)
    assert out.columns == [*docs.columns, "lines_removed"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.text for r in line_windows.drop_repeated_lines(docs).collect()} == brute_lines(rows)
    again = docs_of(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])
    assert sorted(r.text for r in line_windows.drop_repeated_lines(again).collect()) == ["", "a\nb\nc", "a\nb\nc"]


def test_long_texts_take_time_in_proportion(spark):
    block = "\n".join(f"line {i} of a long text" for i in range(100_000))
    docs = docs_of(spark, [(1, block), (2, "first\n" + block + "\nlast")])
    began = time.perf_counter()
    out = {r.doc_id: r for r in line_windows.drop_repeated_lines(docs, "gone").collect()}
    assert out[1].text == block and out[2].text == "first\nlast" and out[2].gone == 100_000
    assert time.perf_counter() - began < 60


def test_windows_that_most_texts_hold(spark, monkeypatch):
    rows = [(i, f"a{i}\nx\ny\nz\nb{i}") for i in range(600)]
    assert {r.doc_id: r.text for r in line_windows.drop_repeated_lines(docs_of(spark, rows)).collect()} == brute_lines(rows)


def test_keep_one_holds_unrelated_groups_apart(spark):
    a, b, c, d = "one two three four", "red green blue yellow", "sun moon stars sky", "sea lake river pond"
    rows = [(None, a), (None, a), (None, b), (None, c), (8, c), (5, d), (5, "up down left right"), (9, "up down left right"), (7, "x y z w"), (7, "x y z w"), (None, None)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in bktree.keep_one(docs_of(spark, rows)).collect())
    assert kept == sorted([(0, a), (0, b), (8, c), (5, d), (5, "up down left right"), (7, "x y z w"), (0, "")])


def brute_jaccard_kept(rows, share=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)})
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= share * (len(sets[i]) + len(sets[j]) - common):
                group[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited_copies(rng, first, size, copies, edits):
    base = [f"w{rng.randrange(3000)}" for _ in range(size)]
    out = [(first, " ".join(base))]
    for k in range(copies):
        w = list(base)
        for e in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"new{k}x{e}"
        out.append((first - 1 - k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_near_sets_match_brute_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(12)
    rows = some_texts()
    for g in range(25):
        rows += edited_copies(rng, 1000 + 100 * g, rng.randrange(6, 300), 4, 5)
    rows += edited_copies(rng, 9000, 60, 60, 1)  # the copies reach each other only by their original
    rows += [(9100 + i, " ".join([f"p{j}" for j in range(30)] + [f"q{rng.randrange(9999)}" for _ in range(90)])) for i in range(40)]
    chain = [f"c{j}" for j in range(100)]  # each within reach of the next only, all with the same passage
    for i in range(30):
        chain = [*chain[:97 - 3 * i], *[f"d{i}x{j}" for j in range(3)], *chain[100 - 3 * i :]]
        rows.append((9200 + i, " ".join(chain)))
    rows += [(9300 + i, " ".join([f"z{j}" for j in range(40)] + [f"y{i}x{j}" for j in range(6)])) for i in range(40)]  # mostly one passage, none alike
    docs = docs_of(spark, rows)
    kept = bktree.first_of_groups(docs, near_sets.roots(docs))
    assert sorted(r.doc_id for r in kept.collect()) == brute_jaccard_kept(rows)


def test_near_dedup_stage_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == brute_jaccard_kept(rows)
    odd = docs_of(spark, [(None, "a b c"), (None, "d e f"), (4, "d e f"), (None, None), (None, " "), (7, "A b C"), (7, "A b C")])
    assert sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, odd, sf).collect()) in ([(0, ""), (4, "d e f"), (7, "A b C")], [(0, " "), (4, "d e f"), (7, "A b C")])
    assert corpus_pipeline.near_dedup(spark, odd.limit(0), sf).count() == 0
