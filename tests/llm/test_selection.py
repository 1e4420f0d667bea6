"""Ordinal regression, edit matching, mixing and the pipeline against brute force."""

import math
import random
import time
from collections import Counter
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_near_text import brute_jaccard_kept, brute_lines
from tests.oracle import compare
from tideline.llm import ordinal, pfair, piece_match, queries
from tideline.llm.textvec import slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_features_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " ", *[" ".join(rng.choice(["Été", "a", "b!!", "12", "ÉTÉ", "***", "word"]) + str(rng.randrange(99)) for _ in range(rng.randrange(400))) for _ in range(30)]]
    column = pa.array(texts, pa.string())
    for kind in ("words", "forms"):
        whole = [set(x.tolist()) for _, x in ordinal.features(column, kind)]
        monkeypatch.setattr("tideline.llm.textvec.SLICE", 97)
        cut = [set(x.tolist()) for _, x in ordinal.features(column, kind)]
        monkeypatch.undo()
        assert whole == cut and len(whole) == len(texts)
    s = next(slices(pa.array(["Été ÉTÉ été", "été"])))
    assert len(set(s.hashes(s.start, s.end).tolist())) == 1


def test_ordinal_regression_of_four_grades():
    rng = np.random.default_rng(4)
    n = 3000
    x = [np.flatnonzero(rng.random(60) < 0.2) for _ in range(n)]
    true = rng.standard_normal(60) * 2
    clear = np.array([true[r].sum() for r in x])
    s = clear + rng.logistic(size=n) * 0.5
    cuts = np.quantile(s, [0.3, 0.6, 0.85])
    y = np.searchsorted(cuts, s)
    model = ordinal.fit(x[:2000], y[:2000], "words", [0.0, 1.0, 2.0, 3.0])
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([model.weights[r].sum() for r in x[2000:]]))
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = tails.sum(axis=1)
    best = np.mean(np.searchsorted(cuts, clear[2000:]) == y[2000:])  # what the true weights reach through the noise
    assert np.mean(np.abs(expected.round() - y[2000:]) <= 1) > 0.97 and np.mean(expected.round() == y[2000:]) > best - 0.1


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    for rating, kind, at, least in (("quality", "forms", queries.KEEP_AT, 0.99), ("toxic", "words", queries.TOXIC_AT, 0.97)):
        model = ordinal.train(docs, fit, rating, kind)
        rows = ordinal.grade_texts(docs.join(held, "doc_id"), model, "e", "p").collect()
        assert np.mean([(r.p >= at) == (r[rating] == 1) for r in rows]) >= least


@pytest.mark.parametrize(("rating", "kind"), [("quality", "forms"), ("toxic", "words")])
def test_grades_against_plain_sums(spark, sf, rating, kind):
    """Every document of the table: the score is the sum of its distinct features' weights, the tails are sigmoids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ordinal.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), rating, kind)
    for r in ordinal.grade_texts(docs, model, "e", "p").collect():
        (_, found), = ordinal.features(pa.array([r.text]), kind)
        score = sum(float(model.weights[i]) for i in set(found.tolist()))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(tails[0] - r.p) < 1e-6 and abs(model.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, model.grades, model.grades[1:], strict=False)) - r.e) < 1e-6


def test_word_features_by_hand():
    """The features of a text are those of its words and their beginnings, whatever stands between them."""
    rng = random.Random(4)
    one = lambda w: {int(x) for _, f in ordinal.features(pa.array([w]), "words") for x in f}
    for _ in range(40):
        w = ["".join(rng.choice("abcxyz") for _ in range(rng.randrange(1, 10))) for _ in range(rng.randrange(0, 12))]
        (_, found), = ordinal.features(pa.array([rng.choice([" ", ", ", " 12 ", "\n"]).join(w)]), "words")
        assert set(found.tolist()) == set().union(*map(one, w)) and len(found) == len(set(found.tolist()))
    assert one("Abcdef") == one("abcdef") and one("abcdxx") & one("abcdyy") and not one("abxx") & one("abyy") and one("中文") == one("中 文")


def test_ordinal_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 60000, "en", "s", 0), (3, "x", "en", "s", 0)], DOCS).selectExpr("*", "1 as expected", "2 as E", "3 as tail")
    none = ordinal.train(docs, spark.createDataFrame([], "doc_id long, quality int"), "quality", "forms")
    out = ordinal.grade_texts(docs, none, "expected", "tail")
    assert out.count() == 4 and out.columns[: len(docs.columns)] == docs.columns and out.columns[-2:] == ["expected_", "tail_"]
    same = ordinal.train(docs, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None), (99, 0)], "doc_id long, quality int"), "quality", "words")
    assert same.grades == [1.0]
    assert ordinal.grade_texts(docs.limit(0), none, "e", "t").count() == 0


def distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edit(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, what = rng.randrange(len(s)), rng.randrange(3)
        if what == 0:
            s[i] = rng.choice("xyz ")
        elif what == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def test_myers_and_pieces_against_dynamic_programming():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8)))
    for _ in range(60):
        p, t = edit(rng, " ".join(word() for _ in range(rng.randrange(1, 12))), 1) or "a", " ".join(word() for _ in range(30))
        assert piece_match.Pattern(p).best(t)[0] == distance_in(p, t)
    items = [(i, piece_match.plain(" ".join(word() for _ in range(rng.randrange(8, 20))))) for i in range(12)]
    matcher = piece_match.Matcher(items, 0.08)
    for _ in range(60):
        parts = [" ".join(word() for _ in range(10))]
        for _ in range(rng.randrange(3)):
            parts += [edit(rng, rng.choice(items)[1], rng.randrange(0, 9)), word()]
        text = piece_match.plain(" ".join(parts))
        got = {m[0]: m[1] for m in matcher.matches(text)}
        want = {i: d for i, t in items if (d := distance_in(t, text)) <= piece_match.budget(t, 0.08)}
        assert got == want


def test_leaks(spark, sf):
    item = "The quick brown fox jumps over the lazy dog while nobody in the village looks at it"
    docs = spark.createDataFrame([(1, "before " + item.upper().replace(" ", " \n ") + " after", "en", "s", 1), (2, item.replace("lazy", "lzy"), "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (5, "clean text", "en", "s", 1)], DOCS).selectExpr("*", "7 as item_id", "8 as distance")
    items = spark.createDataFrame([(10, item), (11, None), (12, " "), (13, item), (14, "absent words only")], "item_id long, text string")
    for chars in (4_000_000, 100):
        assert sorted((r.doc_id, r.item_id, r.distance) for r in piece_match.leaks(docs, items, batch_chars=chars).collect()) == [(1, 10, 0), (1, 13, 0), (2, 10, 1), (2, 13, 1)]
        kept = piece_match.drop_leaks(docs, items, batch_chars=chars)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    assert piece_match.leaks(docs, items.limit(0)).count() == 0 and piece_match.leaks(docs.limit(0), items).count() == 0
    assert piece_match.drop_leaks(docs, items.limit(0)).count() == 5


def test_short_items_and_batches(spark):
    texts = [(1, "a banana split"), (2, "we saw anna karenina today"), (3, "nothing to see"), (4, "anna karenina"), (5, "hannah karenina"), (6, "Anna -- KARENINA!")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS)
    items = spark.createDataFrame([(1, "A!"), (2, "anna karenina")], "item_id long, text string")
    kept = lambda chars: sorted(r.doc_id for r in piece_match.drop_leaks(docs, items, share=0.05, batch_chars=chars).collect())
    assert kept(4_000_000) == kept(10) == [1, 3, 5]
    rng = random.Random(1)
    many = spark.createDataFrame([(i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(10, 60)))) for i in range(300)], "item_id long, text string")
    batches = list(piece_match.item_batches(many, 2000))
    assert 5 < len(batches) < 20 and sum(map(len, batches)) == 300 - sum(len(piece_match.plain(r.text)) < piece_match.LEAST for r in many.collect())
    assert all(sum(len(t) for _, t in b) <= 2000 for b in batches)


def test_leaks_of_items_without_id(spark):
    item = "The quick brown fox jumps over the lazy dog while nobody in the village looks at it"
    docs = spark.createDataFrame([(1, "before " + item, "en", "s", 1), (5, "clean text", "en", "s", 1)], DOCS)
    items = spark.createDataFrame([(None, item), (3, item), (None, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in piece_match.leaks(docs, items).collect()} == {(1, None), (1, 3)}
    assert [r.doc_id for r in piece_match.drop_leaks(docs, items.filter("item_id is null")).collect()] == [5]


def greatest_deviation(order, weights):
    """Over all slots and sources: |slots of the source so far - weight * slots|, in exact numbers of the total weight."""
    whole = pfair.whole_weights(weights)
    total, slots = sum(whole.values()), np.arange(1, len(order) + 1).astype(object)  # Python's whole numbers
    place = {s: i for i, s in enumerate(whole)}
    numbers = np.array([place[s] for s in order])
    return max(Fraction(np.abs(np.cumsum(numbers == i).astype(object) * total - slots * w).max(), total) for i, w in enumerate(whole.values()))


def test_schedules_keep_within_a_block_of_the_given_weights():
    rng = random.Random(8)
    cases = [{"a": 0.6, "b": 0.3994, "c": 0.0006}, {"a": 2 / 3, "b": 1 / 3}, {"hot": 139.5, "x": 45.25, "tiny": 1e-5 + 0.0}, *[{f"s{i}": rng.choice([rng.random() + 1e-3, 1, 7, rng.random() ** 5 + 1e-4]) for i in range(rng.randrange(1, 40))} for _ in range(30)]]
    for weights in cases:
        order = [s for s, _, _ in islice(pfair.schedule(dict.fromkeys(weights, 10**6), weights), 3000)]
        assert greatest_deviation(order, weights) < 1
    weights = {"a": 0.6, "b": 0.3994, "c": 0.0006}
    order = [s for s, _, _ in islice(pfair.schedule(dict.fromkeys(weights, 10**7), weights), 10**6)]
    assert len(order) == 10**6 and greatest_deviation(order, weights) < 1


def test_schedules_deal_every_block_once():
    rng = random.Random(3)
    for _ in range(50):
        blocks = {f"s{i}": rng.randrange(0, 60) for i in range(rng.randrange(1, 12))}
        weights = {s: rng.random() + 0.01 for s in blocks}
        out = list(pfair.schedule(blocks, weights))
        assert [t for _, _, t in out] == list(range(sum(blocks.values())))
        assert all([j for s, j, _ in out if s == x] == list(range(n)) for x, n in blocks.items())
    assert list(pfair.schedule({}, {})) == []


def test_mix(spark, sf, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "t", "en", rng.choice(["a", "a", "a", "b", None]), 1) for i in range(500)] + [(7, "t", "en", "a", 1)] * 3
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "map('k', 1) as m", "1 as slot_")
    weights = {"a": 0.5, "b": 0.25, None: 0.25}
    monkeypatch.setattr(pfair, "PIECE", 13)
    out = pfair.mix(docs, weights, block_rows=5, bucket_rows=16, least_buckets=1)
    got = out.collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    blocks = {}
    for r in got:
        blocks.setdefault(r.slot, []).append(r)
    assert sorted(blocks) == list(range(len(blocks)))
    assert all(len({(r.source, r.block) for r in b}) == 1 and sorted(r.place for r in b) == list(range(len(b))) and len(b) <= 5 for b in blocks.values())
    order = [str(blocks[s][0].source) for s in range(len(blocks))]
    end = min(max(i for i, s in enumerate(order) if s == x) for x in set(order)) + 1
    assert greatest_deviation(order[:end], {"a": 0.5, "b": 0.25, "None": 0.25}) < 1
    assert {(r.source, r.target_weight) for r in got} == set(weights.items())
    assert max(r.place for r in pfair.mix(docs, weights, block_rows=5).collect()) == 4  # blocks don't grow with the table
    assert pfair.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pfair.mix(docs, {"a": 0.0})
    again = {(r.doc_id, r.slot) for r in pfair.mix(docs.repartition(7), weights, 5, bucket_rows=16, least_buckets=1).collect()}
    assert {x for x in again if x[0] != 7} == {(r.doc_id, r.slot) for r in got if r.doc_id != 7}
    monkeypatch.setattr(pfair, "SOURCES", 2)
    with pytest.raises(ValueError):
        pfair.mix(docs, weights)


def test_mix_query_against_the_schedule(spark, sf):
    got = queries.op5_source_mixing(spark, sf).collect()
    counts = Counter(r.source for r in got)
    assert sum(counts.values()) == spark.read.parquet(f"{sf}/documents.parquet").count()
    plan = {(s, j): t for s, j, t in pfair.schedule({s: -(-n // 32) for s, n in counts.items()}, pfair.default_weights(counts))}
    assert all(plan[r.source, r.block] == r.slot for r in got)
    assert Counter((r.source, r.block) for r in got) == Counter({(s, j): min(32, counts[s] - 32 * j) for s, j in plan})


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()} == brute_lines(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == brute_jaccard_kept(rows)
    items = [(r.item_id, piece_match.plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()}
    assert not any(t in piece_match.plain(x) for d, x in rows if d in clean for _, t in items)
    assert all(d in clean for d, x in rows if not any(t[:40] in piece_match.plain(x) or t[-40:] in piece_match.plain(x) for _, t in items))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    assert np.mean([(d in kept) == (labels[d] == 1) for d in labels if d in dict(rows)]) > 0.97


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 50
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (None, "c d", "en", "s", 3), (1, "c d", "en", "s", 3), (2, "e f", None, "s", 3)], DOCS).selectExpr("*", "1 as slot", "2 as covered")
    docs, want = odd, {"line_dedup": 6, "near_dedup": 4, "decontaminate": 4, "mix": 4}
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf)
        assert docs.columns[: len(odd.columns)] == odd.columns
        assert docs.count() == want[name]
    assert sorted((r.doc_id or 0, r.text or "") for r in docs.collect()) == [(0, "a b"), (1, ""), (1, "c d"), (2, "e f")]
    assert corpus_pipeline.quality(spark, odd, sf).columns == odd.columns
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_line_query_matches_sql(spark, sf):
    compare(spark, sf, queries.op3_line_dedup, queries.oracle_sql()["op3_line_dedup"])


def test_labels_meet_one_document_each(spark, monkeypatch):
    seen = []
    plain = ordinal.fit
    monkeypatch.setattr(ordinal, "fit", lambda x, *more: seen.append(len(x)) or plain(x, *more))
    docs = spark.range(3000).selectExpr("7L as doc_id", "concat('word ', id) as text").unionByName(spark.range(40).selectExpr("100 + id as doc_id", "concat('good ', id) as text"))
    labels = spark.createDataFrame([(7, 1), (7, 0), *[(100 + i, i % 2) for i in range(40)]], "doc_id long, quality int")
    ordinal.train(docs, labels, "quality", "forms", sample=10)
    ordinal.train(docs, labels, "quality", "forms")
    assert seen == [10, 42]


def test_many_sources_keep_their_shares():
    blocks = {f"s{i}": 1 + i % 7 for i in range(3000)}
    weights = pfair.default_weights(blocks)
    began = time.time()
    dealt = list(pfair.schedule(blocks, weights))
    assert time.time() - began < 20
    assert sorted((s, b) for s, b, _ in dealt) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    assert [slot for _, _, slot in dealt] == list(range(len(dealt)))
