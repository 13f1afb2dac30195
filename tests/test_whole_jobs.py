"""Queries and operators that do the whole of what a narrower one with fixed SQL does a part of."""

from __future__ import annotations

import numpy as np

from folioframe.catalogue import QUERIES
from folioframe.operators import containment, matching


def tables(spark, path, **rows):
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_token_overlap_takes_all_words(spark, tmp_path):
    docs = {1: "Ein Bär im Wald", 2: "the bear in the wood", 3: "naïve мир bär", 4: None, 5: "x y z"}
    items = {1: "bär мир im", 2: "wood bear", 3: "x y"}
    sf = tables(spark, tmp_path, documents=(list(docs.items()), "doc_id long, text string"), benchmark=(list(items.items()), "item_id long, text string"))
    words = lambda t: {w for w in (t or "").lower().split() if len(w) > 1}
    want = []
    for i, t in items.items():
        best = sorted((-n, d) for d, x in docs.items() if (n := len(words(t) & words(x))))[:5]
        want += [(i, d, -n, k + 1) for k, (n, d) in enumerate(best)]
    assert len(want) == 3
    got = QUERIES["token_overlap_words"](spark, sf)
    assert sorted((r.item_id, r.doc_id, r.n, r["rank"]) for r in got.collect()) == sorted(want)


def test_common_tokens_salted(spark, monkeypatch):
    rows = spark.createDataFrame([(k, ["hot", f"t{k % 3}", f"t{k % 3}"]) for k in range(9)], "a long, k array<string>")
    count = lambda: sorted(map(tuple, matching.common_tokens(rows, rows.withColumnRenamed("a", "b"), "a", "b", "k").collect()))
    broadcast = count()
    monkeypatch.setattr(matching, "BROADCAST_BYTES", -1)
    assert count() == broadcast == sorted((b, a, 1 + (a % 3 == b % 3)) for a in range(9) for b in range(9))


def test_fuzzy_ratio_reads_whole_texts(spark, tmp_path):
    sf = tables(spark, tmp_path, benchmark=([(4, "a b c d e " * 20 + "x" * 100), (8, "a b c d e " * 20 + "y" * 100)], "item_id long, text string"))
    assert sorted((r.item_id, r.other) for r in QUERIES["fuzzy_ratio"](spark, sf).collect()) == [(4, 4), (8, 8)]


def test_exact_locator_lines(spark, tmp_path):
    docs = [(1, "nothing here\nSecond line, here"), (2, "second line here\nshort")]
    sf = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(1, "First of two\nsecond LINE here\nshort")], "item_id long, text string"))
    assert sorted(map(tuple, QUERIES["exact_locator_lines"](spark, sf).select("item_id", "line_no", "n_places").collect())) == [(1, 1, 0), (1, 2, 2), (1, 3, 0)]


def test_best_of_all_others(spark, tmp_path):
    items = {1: "red green blue", 5: "one two three", 9: "red green blue gold", 20: "one two four"}
    sf = tables(spark, tmp_path, benchmark=(list(items.items()), "item_id long, text string"))
    best = {r.item_id: (r.other, r.similarity) for r in QUERIES["catalogue_best"](spark, sf).filter("rank = 1").collect()}
    assert best == {1: (9, 0.75), 9: (1, 0.75), 5: (20, 0.666667), 20: (5, 0.666667)}


def test_window_locator(spark, tmp_path):
    a, b = "A first turn of words", "and a second one."
    turns = [(1, 1, a), (1, 2, b), (2, 1, f"{a} {b}"), (3, 1, "short")]
    sf = tables(spark, tmp_path, conversations=(turns, "conv_id long, turn int, text string"))
    assert [tuple(r) for r in QUERIES["window_locator"](spark, sf).collect()] == [(2, 1, 2)]


def test_nearest_vectors(spark):
    gen = np.random.default_rng(1)
    data = gen.normal(size=(40, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "i long, v array<float>")
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    want = {(i, j, k + 1) for i in range(40) for k, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (-score[i, j], j))[:5])}
    assert {(r.i, r.other, r["rank"]) for r in matching.nearest(rows, "i", "v", block=7).collect()} == want


def test_nulls_have_the_last_places(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=([(k,) for k in range(130)], "doc_id long"), labels=([(k, k % 2) for k in range(0, 130, 3)] + [(1, None)], "doc_id long, toxic int"))
    toxic = {k: k % 2 for k in range(0, 130, 3)}
    want = sorted(range(130), key=lambda k: (-toxic.get(k, -1), k))
    got = QUERIES["nulls_last_places"](spark, sf).orderBy("place").collect()
    assert [r.doc_id for r in got] == want and [r.place for r in got] == list(range(1, 131)) and got[-1].toxic is None


def test_needles_of_few_words_are_contained(spark):
    docs, needles = {1: "a b c d e f", 2: "b", 3: "x a b", 4: "", 5: None}, {1: "b", 2: "a b", 3: "b c d", 4: "c d e f", 5: "a b c d e", 6: "f a", 7: ""}
    d = spark.createDataFrame(list(docs.items()), "d long, t string")
    n = spark.createDataFrame(list(needles.items()), "n long, s string")
    got = containment.occurrences(d, n, "d", "t", "n", "s").select("d", "n").distinct()
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, t in docs.items() for j, s in needles.items() if t and s and f" {s} " in f" {t} ")
