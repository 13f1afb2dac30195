"""Evidence operators that SQL can't express, against plain Python."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from folioframe.operators import evidence as E


def kept(text: str, keywords: list[str], width: int = 900, apart: int = 240, most: int = 6) -> list[str]:
    """Hits of each keyword in turn."""
    low, lefts, out = text.lower(), [], []
    for k in keywords:
        for at in (i for i in non_overlapping(low, k.lower())):
            left = max(0, at - width // 2)
            if len(out) < most and all(abs(left - x) >= apart for x in lefts):
                lefts.append(left)
                out.append(text[left : at + width // 2])
    return out


def non_overlapping(text: str, word: str) -> list[int]:
    at, out = text.find(word), []
    while at >= 0:
        out.append(at)
        at = text.find(word, at + len(word))
    return out


def test_keyword_windows(spark):
    gen = random.Random(5)
    texts = ["", "isbn", "ISBN isbn", "aaaa" * 300]
    texts += [" ".join(gen.choice(["word", "ISBN", "copyright", "other", "x" * 90, "a.b"]) for _ in range(n)) for n in (5, 40, 150)]
    keys = ["isbn", "copyright", "a.b", "aa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", E.keyword_windows(F.col("t"), keys).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: kept(t, keys) for i, t in enumerate(texts)}


def test_fuzzy_windows(spark):
    gen = random.Random(6)
    says = lambda n: " ".join(gen.choice("red fox runs over lazy dogs today".split()) for _ in range(n))
    raw = [("u", p, k, says(4)) for p in range(3) for k in range(5)] + [("u", 0, 9, " "), ("v", 0, 0, "alone")]
    clean = [(k, "u", says(7)) for k in range(6)] + [(9, "w", "nothing"), (10, "v", "!")]
    got = E.fuzzy_windows(spark.createDataFrame(clean, "id int, unit string, text string"), spark.createDataFrame(raw, "unit string, page int, n int, raw string"), ["unit"], "page", "n", id_="id", text="text", raw="raw").collect()
    want = {}
    for id_, unit, text in clean:
        scored = []
        for page in range(3):
            rows = sorted(r for r in raw if r[0] == unit and r[1] == page)
            for first in range(len(rows)):
                for size in range(1, 7):
                    window = " ".join(r[3] for r in rows[first : first + size])
                    if first + size > len(rows) or not window.strip():
                        continue
                    a, b = ("".join(c for c in x.lower() if c.isalnum()) for x in (text, window))
                    want_, have = ({w for w in x.split() if len(w) > 1 and w.isalpha()} for x in (text, window))
                    ratio, overlap = SequenceMatcher(None, a, b).ratio() if a or b else 0.0, len(want_ & have) / len(want_) if want_ else 0.0
                    scored.append((-max(round(ratio, 6), round(overlap, 6)), -round(overlap, 6), size, page, rows[first][2]))
        want[id_] = sorted(x for x in scored if -x[0] >= 0.82)[:5]
    assert sum(map(len, want.values())) > 3
    for id_ in want:
        assert sorted((-r.score, -r.token_overlap, r.n_rows, r.page, r["first"]) for r in got if r.id == id_) == want[id_]


def test_windows_of_large_units_are_dealt_and_not_moved(spark, capsys):
    gen = random.Random(8)
    says = lambda n: " ".join(gen.choice("red fox runs over lazy dogs today".split()) for _ in range(n))
    raw = [(u, p, k, says(3)) for u, pages in (("u", 9), ("v", 2)) for p in range(pages) for k in range(4)] + [("w", None, 0, "red fox")] * 3 + [(None, 0, 0, "red fox")]
    clean = [(k, "uvw"[k % 3], says(6)) for k in range(12)] + [(20, "w", "red fox"), (21, "w", None), (22, None, "red fox"), (None, "w", "red fox")]
    tables = spark.createDataFrame(clean, "id int, unit string, text string"), spark.createDataFrame(raw, "unit string, page int, n int, raw string")
    run = lambda **how: E.fuzzy_windows(*tables, ["unit"], "page", "n", id_="id", text="text", raw="raw", **how)
    take = lambda frame: sorted(map(str, frame.collect()))
    assert len(take(run())) > 10 and take(run(block=5)) == take(run())
    run().explain()
    moved = [x.split("hashpartitioning(")[1] for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(" in x]
    assert len(moved) == 3 and sum("__block" in x for x in moved) == 2  # rows, clean texts, and what is found by id


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "doc string, page int, n int, text string")
    assert E.short_matches(rows.withColumnRenamed("n", "id"), rows, "doc", "page", "n", id_="id", text="text", raw="text").count() == 0
    assert E.fold_lines(rows, "doc", "n", "text", opens=F.lit(False), closes=F.lit(False)).count() == 0
    assert E.nearby_page(rows, "doc", "n", "text").count() == 0
