"""Publishing whole or not at all, gates and their refresh, and table grids, against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioframe.operators import closures, gates, grids
from folioframe.sources import publish

# -- publishing


def test_publish_switches_whole_versions(spark, tmp_path):
    root, rows = f"file:{tmp_path}/mirror", lambda keys: spark.createDataFrame([(k, k % 3) for k in keys], "key long, part long")
    left = lambda: sorted(r.key for r in publish.published(spark, root).collect())
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root)
    publish.publish(rows(range(10)), root, ["part"])
    old = publish.published(spark, root)
    assert left() == list(range(10))
    publish.publish(rows(range(3, 8)), root, ["part"])
    assert left() == [3, 4, 5, 6, 7] and old.count() == 10  # a reader of the version before still has it whole

    def refuses(written):
        assert written.count() == 2
        raise RuntimeError("not this one")

    with pytest.raises(RuntimeError):
        publish.publish(rows([1, 2]), root, ["part"], check=refuses)
    with pytest.raises(Exception, match="(?i)division|DIVIDE"):
        publish.publish(rows([1, 2]).withColumn("part", F.expr("1 / (key - 1)").cast("long")), root, ["part"])
    assert left() == [3, 4, 5, 6, 7]
    assert publish.remove_old(spark, root) == 1 and left() == [3, 4, 5, 6, 7] and publish.remove_old(spark, root) == 0
    publish.publish(rows([]), root)
    assert left() == []


def test_prefixes_are_guarded(spark, tmp_path):
    assert publish.guarded_prefix("clean//m1/./r", "clean") == "clean/m1/r/"
    for unsafe in ("", "/", "clean", "clean/", "raw/m1", "clean/../raw/m1", "cleaner/m1", "clean\\..\\x"):
        with pytest.raises(ValueError, match="unsafe"):
            publish.guarded_prefix(unsafe, "clean")
    root = str(tmp_path / "store")
    publish.publish(spark.createDataFrame([("clean/m1/a",), ("clean/m1/b",), ("clean/m10/a",), ("raw/m1/a",), (None,)], "key string"), root)
    with pytest.raises(ValueError, match="unsafe"):
        publish.delete_prefix(spark, root, "key", "raw/m1", "clean")
    assert publish.delete_prefix(spark, root, "key", "clean/m1", "clean") == 2 and publish.delete_prefix(spark, root, "key", "clean/m1", "clean") == 0
    assert {r.key for r in publish.published(spark, root).collect()} == {"clean/m10/a", "raw/m1/a", None}


# -- gates


def gates_by_hand(outcomes, quality):
    of = defaultdict(list)
    for d, *rest in outcomes:
        of[d].append(rest)
    out = []
    for d, score, status, table in quality:
        own = [x for x in of[d] if x[0] != "correction"]
        blocking = sum(bool(o and b) for _, _, o, b, _ in own)
        tables = [x for x in own if x[0] in ("table", "formula")]
        open_tables = sum(bool(o and b) for _, _, o, b, _ in tables)
        bare = sum(not e for p, _, _, _, e in of[d] if p == "correction")
        states = ["review" if blocking else "pass", ("review" if open_tables else "pass") if tables else table, "fail" if bare else "pass"]
        accepted = "fail" if "fail" in states else "review" if "review" in states else "pass"
        told = ",".join(sorted(f"{k}={n}" for k, n in Counter(x[1] or "" for x in own).items()))
        out.append((d, len(own), sum(not o for _, _, o, _, _ in own), blocking, open_tables, len(of[d]) - len(own), bare, *states, accepted, "pass" if accepted == "pass" and (score or 0) >= 90 else status, told))
    return sorted(out)


def test_refresh_equals_recomputation(spark):
    gen = random.Random(14)
    outcomes = [(gen.randrange(40), gen.choice(["table", "formula", "image", "correction"]), gen.choice(["a", "b", None]), gen.choice([True, False, None]), gen.choice([True, True, False, None]), gen.choice([True, True, True, False, None])) for _ in range(150)]
    outcomes += [outcomes[0]] * 2
    quality = [(d, gen.choice([80, 90, 95, None]), "review", gen.choice(["pass", "review"])) for d in range(45)]
    schema = "doc int, packet string, decision string, open boolean, blocking boolean, evidence boolean"
    rows, scores = spark.createDataFrame(outcomes, schema), spark.createDataFrame(quality, "doc int, score int, quality_status string, table_status string")
    full = gates.gates(rows, scores, "doc")
    assert sorted(map(tuple, full.collect())) == gates_by_hand(outcomes, quality)

    later = [(d, p, "accepted" if d % 5 == 0 and o else c, False if d % 5 == 0 and o else o, b, e) for d, p, c, o, b, e in outcomes if d != 7] + [(43, "image", "a", True, True, None)]
    now = spark.createDataFrame(later, schema)
    changed = gates.changed_documents(gates.state_of(rows, "doc"), now, "doc")
    touched = {d for d, _, _, o, _, _ in outcomes if d % 5 == 0 and o} | {7, 43}
    assert {r.doc for r in changed.collect()} == touched
    got = gates.refresh(full, changed, now, scores, "doc")
    assert sorted(tuple(r)[:-1] for r in got.select("doc", *gates.GATES, "refreshed").select(*full.columns, "refreshed").collect()) == gates_by_hand(later, quality)
    assert {r.doc for r in got.filter("refreshed").collect()} == touched
    by_rule = gates.closed(rows, F.col("doc") % 5 == 0).filter("doc <> 7").unionByName(now.filter("doc = 43"))
    assert sorted(map(tuple, by_rule.collect()), key=str) == sorted(later, key=str)
    assert gates.changed_documents(gates.state_of(rows, "doc"), rows.repartition(5), "doc").count() == 0


# -- grids


def grid_by_hand(cells):
    """Each cell in turn at the first place of its row where all its columns are free."""
    taken, out = {}, []
    last = max(r for r, *_ in cells)
    for row, _, text, h, w in sorted(cells, key=lambda c: c[:2]):
        h, w, x = max(1, h or 1), max(1, w or 1), 0
        while any((row, x + j) in taken for j in range(w)):
            x += 1
        for y in range(row, row + h):
            for j in range(w):
                taken[y, x + j] = text
                if y <= last:
                    out.append((y, x + j, text, (y, j) == (row, 0)))
    return out


def test_spans_are_laid_out(spark):
    gen = random.Random(15)
    tables = {t: [(r, p, f"{t}.{r}.{p}" if gen.random() > 0.2 else gen.choice(["", None, " "]), gen.choice([1, 1, 2, 3, 0, None]), gen.choice([1, 1, 2, 3, -1, None])) for r in range(gen.randint(1, 5)) for p in range(gen.randint(1, 4))] for t in range(40)}
    cells = spark.createDataFrame([(t, *c) for t, own in tables.items() for c in own], "t int, row int, place int, text string, rowspan int, colspan int")
    squares = grids.laid_out(cells, "t")
    want = {t: grid_by_hand(own) for t, own in tables.items()}
    assert sorted(map(tuple, squares.collect()), key=str) == sorted(((t, *s) for t, own in want.items() for s in own), key=str)
    for r in grids.ragged(squares, "t").collect():
        own = want[r.t]
        assert (r.height, r.width, r.n_missing) == (h := max(s[0] for s in own) + 1, w := max(s[1] for s in own) + 1, h * w - len(own)) and r.n_empty == sum(not (s[2] or "").strip() for s in own)
    assert grids.laid_out(cells.filter("false"), "t").count() == 0


def test_paradigms_are_rebuilt(spark):
    head = ["Affirmative", "Negative", "Questions", "Short answers"]
    good = [head, ["I am&amp;\nyou are\r\nhe is", "I amyou arehe is", "Am I? Are you? Is he?", "Yes, I am. No, you are not. Yes, he is."]]
    tables = {1: good, 2: [head, [*good[1][:3], "Yes, I am."]], 3: [head[:3], good[1][:3]], 4: [["A", "B", "C", "D"], good[1]], 5: [*good, ["a", "b", "c", "d"]], 6: [head, ["", None, "x", "y"]], 7: [head]}
    cells = spark.createDataFrame([(t, r, p, c, 1, 1) for t, rows in tables.items() for r, row in enumerate(rows) for p, c in enumerate(row)], "t int, row int, place int, text string, rowspan int, colspan int")
    got = defaultdict(dict)
    for r in grids.reflowed(cells, "t").collect():
        got[r.t][r.y, r.x] = r.text
    want = [head, ["I am&", "I am", "Am I?", "Yes, I am."], ["you are", "you are", "Are you?", "No, you are not."], ["he is", "he is", "Is he?", "Yes, he is."]]
    assert got[1] == {(y, x): c for y, row in enumerate(want) for x, c in enumerate(row)}
    for t in range(2, 8):
        assert got[t] == {(y, x): c for y, row in enumerate(tables[t]) for x, c in enumerate(row)}


# -- closures


def test_image_only_texts(spark):
    texts = {"![a](b.png)": True, " ![](x.png) <img alt=q src=\"y.png\" width=3>\n![c](d.png)": True, "![a](b.png) x": False, "": False, "x": False, "<img src=c.png>": False, "![a](http://far/b.png)": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", closures.image_only(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == texts


def test_closures_are_made_once(spark):
    schema = "doc int, outcome_id string, block_id string, packet_type string, status string, decision string, blocking boolean, crop string, crop_status string"
    rows = [(1, "i", "b", closures.IMAGE, "closed", "accepted_by_rule", False, "c.png", "created"), (1, "f", "b", closures.FORMULA, "open", None, True, None, None), (1, "g", "z", closures.FORMULA, "open", "", True, "", ""), (2, "f", "b", closures.FORMULA, "open", None, True, None, None), (2, "t", None, "table", "open", None, None, None, None)]
    outcomes = spark.createDataFrame(rows, schema)
    blocks = spark.createDataFrame([(d, b, "![a](b.png)", None) for d in (1, 2) for b in ("b", "z")], "doc int, block_id string, markdown string, text string")
    verdicts = closures.image_only_formulas(outcomes, blocks, "doc")
    assert {(r.doc, r.outcome_id, r.reason, r.evidence) for r in verdicts.collect()} == {(1, "f", "image_only_formula_covered_by_image", "i"), (1, "g", "closed_image_outcome_missing", None), (2, "f", "closed_image_outcome_missing", None)}
    once = closures.closed_by_rule(outcomes, verdicts, "doc")
    assert {(r.doc, r.outcome_id): r.closing for r in once.collect()} == {(1, "i"): None, (1, "f"): "newly_closed", (1, "g"): None, (2, "f"): None, (2, "t"): None}
    again = closures.closed_by_rule(once.drop("closing"), verdicts, "doc")
    assert again.filter("closing = 'newly_closed'").count() == 0 and again.filter("closing = 'already_closed'").count() == 1
    told = once.filter("doc = 1 and outcome_id = 'f'").first()
    assert (told.status, told.decision, told.blocking, told.crop_status) == ("closed", "non_blocking", False, closures.RECLASSIFIED)
    report = {r.doc: r for r in closures.closure_report(once, verdicts, "doc").collect()}
    assert (report[1].closed_count, report[1].open_blocking_count, report[1].newly_closed, report[1].skipped) == (2, 1, 1, "image_only_formula/closed_image_outcome_missing=1")
    assert report[2].decisions == "=2" and closures.closure_report(once.filter("false"), verdicts, "doc").count() == 0
