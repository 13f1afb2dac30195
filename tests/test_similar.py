"""Similarity joins and the multi-pattern automaton against brute force over all pairs."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest

from folioframe.catalogue import QUERIES
from folioframe.operators import blocks, containment, matching, similar


def ratios(left, right, least):
    return sorted((i, j, round(r, 6)) for i, a in left for j, b in right if a is not None and b is not None and (r := SequenceMatcher(None, a, b).ratio()) >= least)


def texts(gen, n):
    """Random texts and edited copies, short ones and repeats among them."""
    made = ["", "a", "b", "ab", "ba", "aab", "ééé", "😀😀", "x" * 50, "xy" * 120, None, "a" * 230 + "bcd" * 3]
    for _ in range(n):
        base = "".join(gen.choice("abcde é😀") for _ in range(gen.randint(1, 60)))
        for edits in (0, 1, 3, 8):
            own = list(base)
            for _ in range(min(edits, len(own))):
                k = gen.randrange(len(own))
                own[k : k + 1] = gen.choice(([], ["z"], [own[k], "q"]))
            made.append("".join(own))
    return list(enumerate(made))


@pytest.mark.parametrize("least", [0.81, 0.82, 0.95, 1.0])
def test_edit_similar_finds_every_pair(spark, monkeypatch, least):
    rows = texts(random.Random(2), 30)
    l, r = spark.createDataFrame(rows, "i long, a string"), spark.createDataFrame(rows, "j long, b string")
    got = lambda: sorted(map(tuple, similar.edit_similar(l, r, "i", "a", "j", "b", least=least).collect()))
    want = ratios(rows, rows, least)
    assert got() == want
    monkeypatch.setattr(matching, "BROADCAST_BYTES", -1)
    assert got() == want
    assert similar.edit_similar(l.filter("false"), r, "i", "a", "j", "b", least=least).count() == 0


def test_the_filters_leave_out_most_pairs(spark):
    gen = random.Random(3)
    rows = [(k, "".join(gen.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))) for k in range(200)]
    l, r = spark.createDataFrame(rows, "i long, a string"), spark.createDataFrame(rows, "j long, b string")
    assert similar.similar_pairs(l, r, "i", "a", "j", "b").count() < 8_000  # of 40,000


def test_the_least_count_is_one_or_more():
    for least in (0.81, 0.82, 0.9, 1.0):
        for a in range(1, 60):
            for b in range(a, 120):
                m = similar.least_matched(least, a + b)
                if b > 1 and m <= a:
                    assert 3 * m - a - b - 1 >= 1


def test_common_subsequence():
    gen = random.Random(4)
    for _ in range(200):
        a, b = ("".join(gen.choice("abc") for _ in range(gen.randint(0, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert similar.common_subsequence(a, b) == best[-1][-1]


def test_edit_similar_within_keys(spark):
    rows = [(k, k % 2, t) for k, t in enumerate(["one two three", "one two thre", "one two three", "other", None])]
    l = spark.createDataFrame(rows, "i long, u int, t string")
    got = similar.edit_similar(l, l.withColumnRenamed("i", "j"), "i", "t", "j", "t", on=["u"]).collect()
    assert sorted((r.i, r.j) for r in got) == [(0, 0), (0, 2), (1, 1), (2, 0), (2, 2), (3, 3)]


def test_overlapping(spark):
    gen = random.Random(5)
    l = [(k, k % 2, [f"w{gen.randrange(12)}" for _ in range(gen.randint(0, 8))]) for k in range(60)]
    r = [(k, k % 3, [f"w{gen.randrange(12)}" for _ in range(gen.randint(0, 10))]) for k in range(60)]
    for least in (0.5, 0.82, 1.0):
        want = sorted((u, i, j, round(n / len(set(a)), 6)) for i, u, a in l for j, v, b in r if u == v and a and (n := len(set(a) & set(b))) and n >= least * len(set(a)) - 1e-9)
        got = similar.overlapping(spark.createDataFrame(l, "i long, u int, k array<string>"), spark.createDataFrame(r, "j long, u int, k array<string>"), "i", "j", "k", least=least, on=["u"])
        assert sorted(map(tuple, got.collect())) == want


def test_fuzzy_ratio_query(spark, tmp_path):
    """The five best scans of every item, of all items: scans lose letters or have others."""
    gen = random.Random(6)
    base = " ".join(gen.choice("the other thin tree stood there with us".split()) for _ in range(30))
    items = {k: base if k % 3 else base[::-1] + str(k) for k in range(9)} | {20: "e", 21: "", 22: None}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    swap = str.maketrans("aeiourst", "eiouatsr")
    scan = lambda k, t: t if t is None or k % 4 == 0 else t.replace("th", "tb") if k % 4 == 1 else t.replace("e", "") if k % 4 == 2 else t.translate(swap)
    pairs = ratios(items.items(), [(k, scan(k, t)) for k, t in items.items()], 0.82)
    want = [(i, j, r, n) for i in items for n, (r, j) in enumerate(sorted(((r, j) for a, j, r in pairs if a == i), key=lambda x: (-x[0], x[1]))[:5], 1)]
    assert sorted(map(tuple, QUERIES["fuzzy_ratio"](spark, str(tmp_path)).collect())) == sorted(want)


# -- the automaton


def places(pages, needles):
    """(doc, needle, start, end, first page, last page), by search at every word."""
    docs = {}
    for d, p, t in sorted(pages, key=lambda x: x[1]):
        docs.setdefault(d, []).append((p, t or ""))
    out = []
    for d, own in docs.items():
        text, starts, at = "\n".join(t for _, t in own), [], 0
        for _, t in own:
            starts.append(at)
            at += len(t) + 1
        spans = [m.span() for m in re.finditer(r"[^ \t\n\r\f\x0B]+", text)]
        said = [text[a:z] for a, z in spans]
        page = lambda x, own=own, starts=starts: own[max(k for k, s in enumerate(starts) if s <= x)][0]
        for n, words in {(n, tuple(re.findall(r"[^ \t\n\r\f\x0B]+", w or ""))) for n, w in needles}:
            for k in range(len(said) - len(words) + 1 if words else 0):
                if tuple(said[k : k + len(words)]) == words:
                    a, z = spans[k][0], spans[k + len(words) - 1][1]
                    out.append((d, n, a, z, page(a), page(z - 1)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [containment.BLOCK_BYTES, 20])
def test_located_equals_search(spark, block_bytes):
    gen = random.Random(7)
    says = lambda n: "".join(gen.choice(["a", "b", "é", "😀", "a b", "aa"]) + gen.choice([" ", "  ", "\t", "\n", " "]) for _ in range(n))
    pages = [(d, p, says(gen.randint(0, 12))) for d in range(12) for p in range(6)] + [(20, 0, None), (20, 2, "a"), (20, 5, " b"), (None, 0, "a b"), (21, 0, "")]
    needles = [(1, "a"), (2, "a b"), (3, "b  a\na"), (4, "😀 é"), (5, ""), (6, None), (7, " \n"), (8, "a a b a"), (8, "a a b a"), (9, "a b"), (None, "aa b"), (10, "never said")]
    own = spark.createDataFrame(pages, "d long, p int, t string"), spark.createDataFrame(needles, "n long, w string")
    got = containment.located(*own, "d", "p", "t", "n", "w", block_bytes=block_bytes)
    assert got.columns == ["d", "n", "start", "end", "first_page", "last_page"]
    assert sorted(map(tuple, got.collect()), key=str) == places(pages, needles)
    assert containment.located(own[0].filter("false"), own[1], "d", "p", "t", "n", "w").count() == 0
    assert containment.located(own[0], own[1].filter("false"), "d", "p", "t", "n", "w").count() == 0


def test_needles_with_text_ids_in_repeated_rows(spark):
    docs, needles = [(1, "x y x"), (1, "x y x"), (2, None)], [("p", "x"), ("q", "y x")]
    got = containment.occurrences(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(needles, "n string, w string"), "d", "t", "n", "w")
    assert sorted(map(tuple, got.collect())) == sorted([(1, "p", 0, 1), (1, "p", 4, 5), (1, "q", 2, 5)] * 2)


@pytest.mark.parametrize("of_larger", [False, True])
def test_best_common_by_index_and_by_join(spark, monkeypatch, of_larger):
    gen = random.Random(8)
    rows = [(k, [f"w{gen.randrange(20)}" for _ in range(gen.randint(0, 9))]) for k in range(60)] + [(99, None), (None, ["w1"])]
    want = []
    for i, a in rows:
        scored = []
        for j, b in rows:
            if None not in (i, j, a, b) and i != j and (n := len(set(a) & set(b))):
                larger = max(len(set(a)), len(set(b)))
                scored.append((-((2_000_000 * n + larger) // (2 * larger) if of_larger else n), j))
        want += [(i, j, -s, k) for k, (s, j) in enumerate(sorted(scored)[:5], 1)]
    own = spark.createDataFrame(rows, "i long, k array<string>").repartition(4)
    got = lambda: sorted(map(tuple, matching.best_common(own.withColumnRenamed("i", "j"), own, "j", "i", "k", of_larger=of_larger, others_only=True).collect()))
    assert got() == sorted(want)
    monkeypatch.setattr(matching, "BROADCAST_BYTES", -1)
    assert got() == sorted(want)


def test_runs_of_ids(spark):
    gen = random.Random(9)
    rows = [(g, i) for g in (0, 1, None) for i in sorted(gen.sample(range(200), 120))]
    want, before = [], None
    for g, i in rows:
        if before == (g, i - 1):
            want[-1][3] += 1
        else:
            want.append([g, 1 + (want[-1][1] if want and want[-1][0] == g else 0), i, 1])
        before = g, i
    got = blocks.runs_of_ids(spark.createDataFrame(rows, "g int, i long").repartition(3), ["g"], "i")
    assert sorted(map(list, got.collect()), key=str) == sorted(want, key=str)
