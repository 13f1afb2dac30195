"""Radix-sorted suffixes, ranked search and spelling variants, against brute force on small tables that hold the odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from folioframe.llm import lexical, suffixes, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns with the names that operators use inside.
EXTRA = "doc string, body string, chunk int, row int, term string, n int, word string"


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame([(*r, "doc", "body", 1, 2, "term", 3, "word") for r in rows], f"{schema}, {EXTRA}").repartition(parts)


# -- suffixes


def kept_bytes(rows, depth=50):
    """Brute force: of each row what is left, and its maximal removed runs."""
    order = lambda d: (d is None, d)
    first: dict[bytes, tuple] = {}
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - depth + 1):
            s = raw[p : p + depth]
            first[s] = min(first.get(s, order(d)), order(d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - depth + 1):
            if first[raw[p : p + depth]] < order(d):
                gone[p : p + depth] = [True] * depth
        spans = [(a, a + len(m)) for m, a in ((m.group(), m.start()) for m in re.finditer("1+", "".join("01"[g] for g in gone)))]
        out.append((d, len(raw), sum(gone), len(spans), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def suffix_rows():
    gen = random.Random(3)
    text = lambda n: "".join(gen.choice("abcdefgh é日\n") for _ in range(n))
    passage, other = text(160), text(70)
    rows = [(k, f"{text(gen.randint(0, 90))}{passage}{text(gen.randint(0, 90))}") for k in range(40, 0, -1)]  # a common passage with other bytes beside it
    rows += [(50 + k, passage[a : a + n]) for k, (a, n) in enumerate([(0, 49), (0, 50), (10, 51), (60, 100), (100, 40)])]
    rows += [(60, "z" * 400), (61, "z" * 49), (62, "z" * 50), (63, "ab" * 300), (64, "b" + "ab" * 40), (65, "x" + "z" * 60)]  # strings that overlap themselves
    rows += [(70, other), (70, other), (70, f"{other}{text(5)}"), (71, f"{other}!{passage}"), (None, passage), (None, passage), (None, text(80)), (80, None), (81, ""), (82, "é")]
    rows += [(90, text(30_000)), (91, text(2_000))]
    rows += [(92, rows[-2][1][7_000:21_000]), (93, rows[-1][1]), (94, rows[-1][1])]
    return rows


@pytest.mark.parametrize(("chunk_bytes", "hot"), [(suffixes.CHUNK_BYTES, suffixes.HOT), (9_000, suffixes.HOT), (9_000, 2)])
def test_op11_equals_brute_force(spark, chunk_bytes, hot):
    """One chunk, many chunks, and many with each suffix dealt by its own bytes."""
    rows = suffix_rows()
    got = suffixes.remove_repeated_bytes(frame(spark, rows), chunk_bytes=chunk_bytes, hot=hot, with_kept=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=key) == sorted(kept_bytes(rows), key=key)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_op11_empty_table(spark):
    assert suffixes.op11_rows(frame(spark, [(1, "a")]).filter("false")).count() == 0


def test_radix_passes_give_the_equal_groups():
    gen = random.Random(8)
    for depth in (8, 40, 50, 53):
        raw = b"".join(gen.choice([b"abcabc", b"ab", b"q" * 30, bytes([gen.randrange(256)])]) for _ in range(300))
        starts = np.array(sorted(gen.sample(range(len(raw) - depth), 200)))
        member, new = suffixes.repeated_suffixes(np.frombuffer(raw, np.uint8), starts, depth)
        groups = defaultdict(set)
        for k, at in enumerate(starts.tolist()):
            groups[raw[at : at + depth]].add(k)
        want = [groups[s] for s in sorted(groups) if len(groups[s]) > 1]
        cuts = np.flatnonzero(new).tolist()
        assert [set(member[a:z].tolist()) for a, z in zip(cuts, [*cuts[1:], len(member)], strict=True)] == want  # in the order of their bytes


# -- lexical search


def ranking(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    said = [(d, Counter(term.findall((t or "").translate(LOWER)))) for d, t in docs]
    said = [(d, c) for d, c in said if c]
    n_docs, n_terms = len(said), sum(c.total() for _, c in said)
    df = Counter(t for _, c in said for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(term.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in said:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(qf * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, qf in terms.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "candidates", "listed"), [(lexical.SEED, lexical.CANDIDATES, lexical.LISTED), (1, 3, 10)])
def test_op12_equals_brute_force(spark, seed, candidates, listed):
    """With lists broadcast, and with few seeds and lists joined by salt; ties, repeats, nulls and odd texts in both."""
    gen = random.Random(4)
    words = [f"w{k}" for k in range(200)] + ["É", "日本", "x_y", "the", "The"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: " ".join(gen.choices(words, weights, k=n))
    docs = [(k, text(gen.randint(1, 60))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, " ?! "), (None, text(20)), (None, "w150 w151"), (403, "w150 w151"), (403, "w150 w151"), (404, "w150,W151\x00the"), (405, "w3 " * 5000)]
    items = [(k, text(gen.randint(1, 25))) for k in range(12)] + [(20, "w150 w151 w151"), (21, None), (22, "unheard"), (23, "?"), (24, "the w0 w1"), (24, "É"), (None, "w1")]
    own = frame(spark, docs)
    got = lexical.rank_documents(own, frame(spark, items, "item_id long, text string"), seed=seed, candidates=candidates, listed=listed)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranking(docs, items)


def test_op12_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), frame(spark, [(1, "a b")], "item_id long, text string")
    assert lexical.op12_rows(docs.filter("false"), items).count() == 0
    assert lexical.op12_rows(docs, items.filter("false")).count() == 0
    assert [tuple(r) for r in lexical.op12_rows(docs, items).collect()] == ranking([(1, "a b")], [(1, "a b")])


# -- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(counts):
    near_to = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in near_to.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near_to[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def damaged(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_op13_equals_brute_force(spark):
    gen = random.Random(6)
    words = ["".join(gen.choice("abçÉÿ×") for _ in range(gen.randint(6, 10))) for _ in range(300)] + ["Q" * 3000, "Q" * 2999, "q" * 3000]
    rows = [(k, " ".join(gen.choices(words, [1 / (j + 1) for j in range(len(words))], k=80))) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "日本 abcabca,abcabca_abcabcab9Abcabcab"), (None, "abcabcA abcabca"), (None, "abcabcA abcabca"), (73, "q" * 3000 + " " + "q" * 2999 + "\x00" + "Q" * 2999)]
    counts = damaged(rows)
    got = variants.op13_rows(frame(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(tuple(r) for r in got) == variants_of(counts)
    assert any(r.form for r in got)


@pytest.mark.parametrize(("top", "largest"), [(0, 10**6), (3, 10**6), (1, 4), (3, 1)])
def test_near_words_at_any_depth_of_partitions(spark, top, largest):
    """Prefixes of more than `largest` words go on to longer ones, words that end there too."""
    gen = random.Random(9)
    words = {"".join(gen.choice("abé") for _ in range(gen.randint(1, 7))) for _ in range(250)} | {"aaaaaaa" + "b" * k for k in range(6)}
    got = variants.near_words(spark.createDataFrame([(w,) for w in words], "word string"), top=top, largest=largest).collect()
    want = {(a, b) for a in words for b in words if a != b and near(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_op13_follows_forms_and_ties(spark):
    """A chain of three, ties to the smallest word, and one short of ten times."""
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "bbbbbbx": 2, "bbbbbby": 20, "bbbbbbz": 20, "ccccccc": 5, "cccccccc": 49, "ddddddd": 3}
    got = variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(tuple(r) for r in got) == variants_of(counts)
    assert {r.word: r.root for r in got}["aaaaaaa"] == "aaaabbb"


def test_op13_empty_table(spark):
    assert variants.op13_rows(frame(spark, [(1, "abcdefgh abcdefgh")]).filter("false")).count() == 0
    assert variants.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
