"""Cell coverage, grouping policies and layout walks against plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioframe.operators import coverage, grouping
from folioframe.sources import layout

# -- cell coverage


def best_window(cells, rows, share=0.9):
    """All windows of up to 18 rows of each page, cell by cell: each takes the first free row of its text."""
    cells = [c for c in cells if c.strip()]
    if len(cells) < 6:
        return None
    best = None
    for page in sorted({p for p, *_ in rows}):
        own = sorted((r for r in rows if r[0] == page and r[2].strip() and r[3] is not None), key=lambda r: r[1])
        for a in range(len(own)):
            for z in range(a, min(len(own), a + 18)):
                used, chars = [], 0
                for c in cells:
                    at = next((k for k in range(a, z + 1) if k not in used and own[k][2] == c), None)
                    if at is not None:
                        used.append(at)
                        chars += len(c)
                x, y = len(used) / len(cells), chars / sum(map(len, cells))
                if not used or x < share or y < share:
                    continue
                box = [f(own[k][3][j] for k in used) for j, f in enumerate((min, min, max, max))]
                score = round((x + y) / 2 - (z - a + 1) * 0.001 - max((box[2] - box[0]) * (box[3] - box[1]), 1) * 1e-8, 9)
                if best is None or score > best[0]:
                    best = score, (page, own[a][1], own[z][1], len(used), round(x, 6), round(y, 6), round((x + y) / 2, 4), box)
    return best and best[1]


def test_cell_windows_equal_all_windows(spark):
    gen = random.Random(11)
    tables, rows, want = [], [], []
    for d in range(40):
        words = [gen.choice(["a", "bb", "ccc", "dd", "e", "ffff", "g"]) for _ in range(gen.randint(4, 10))]
        cells = [*words, "", "  "]
        own = []
        for page in range(2):
            texts = [w for w in words if gen.random() > 0.06]
            gen.shuffle(texts)
            for _ in range(gen.randint(0, 6)):
                texts.insert(gen.randint(0, len(texts)), gen.choice(["a", "noise", " ", "ccc"]))
            own += [(page, k * 3, t, [gen.randint(0, 50), gen.randint(0, 50), gen.randint(51, 99), gen.randint(51, 99)] if gen.random() > 0.03 else None) for k, t in enumerate(texts)]
        tables.append((d, 1, cells))
        rows += [(d, *r) for r in own]
        if (found := best_window(cells, own)) is not None:
            want.append((d, 1, *found))
    tables.append((99, 1, None))
    rows += [(0, None, 1, "a", [1, 1, 2, 2]), (100, 0, 0, "a", [1, 1, 2, 2])]
    t, r = spark.createDataFrame(tables, "d int, n int, cells array<string>"), spark.createDataFrame(rows, "d int, page int, o int, t string, box array<int>")
    got = coverage.cell_windows(t, r, "d", "n", "cells", "page", "o", "t", "box")
    assert len(want) > 10 and sorted((*x[:-1], x.box) for x in got.collect()) == sorted(want)
    assert coverage.cell_windows(t.filter("false"), r, "d", "n", "cells", "page", "o", "t", "box").count() == 0


# -- grouping policies


def by_hand(blocks):
    """Both state machines, block by block: (id, starter, groups and questions, covered)."""
    out, pg, pq, gg, gq = [], None, None, None, None
    for id_, kind, text, gap in blocks:
        starter = None
        said = " ".join((text or "").split())
        if kind not in ("unit_opener", "section", "reading_passage"):
            if said.strip("* ").lower() in ("practice", "act 1"):
                starter = "section_label"
            elif said.lower().startswith(("choose ", "circle ")):
                starter = "instruction_paragraph"
            elif said.endswith(":") and len(said) <= 120:
                starter = "colon_label"
        pc = gc = False
        if kind in ("unit_opener", "section", "reading_passage"):
            pg = pq = gg = gq = None
        elif starter:
            pg, pq, gg, gq = id_, None, id_, None
        elif kind == "paragraph" and len(said) > 180:
            gg = gq = None
        elif kind == "question":
            pc, gc = bool(gap and pg), bool(gap and gg)
            pq = gq = id_
        elif kind == "table" and gap:
            pc, gc = bool(pg or pq), bool(gq)
        out.append((id_, starter, pg, pq, gg, gq, pc, gc))
    return out


@pytest.mark.parametrize("size", [1, 3, 100_000])
def test_policies_over_ranges(spark, size):
    gen = random.Random(12)
    rows, want = [], []
    for d in range(8):
        blocks = [(f"{d}-{k}", gen.choice(["question", "question", "table", "paragraph", "paragraph", "section", "option", "reading_passage"]), gen.choice(["Practice", "** Act 1 *", "Choose one", "Words:", "x", "y " * 100, "z", "7. what?", None]), gen.random() < 0.6) for k in range(gen.randint(1, 40))]
        rows += [(d if d else None, k * 2, *b) for k, b in enumerate(blocks)]
        want += by_hand(blocks)
    frame = spark.createDataFrame(rows, "doc int, n int, id string, type string, md string, gap boolean").repartition(3)
    done = grouping.simulate(frame, "doc", order="n", id_="id", type_="type", markdown="md", gap="gap", size=size)
    got = done.select("id", "starter", "persistent_group", "persistent_question", "guarded_group", "guarded_question", "persistent_covered", "guarded_covered").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {x[6] for x in want} == {x[7] for x in want} == {True, False}
    counts = grouping.policy_counts(done, ["doc"], type_="type", gap="gap").agg(F.sum("virtual_groups"), F.sum("persistent_covered_questions") + F.sum("persistent_covered_tables"), F.sum("guarded_covered_questions") + F.sum("guarded_covered_tables")).first()
    assert tuple(counts) == (sum(x[1] is not None for x in want), sum(x[6] for x in want), sum(x[7] for x in want))
    assert grouping.simulate(frame.filter("false"), "doc", order="n", id_="id", type_="type", markdown="md", gap="gap").count() == 0


# -- layouts


def nodes_by_hand(text):
    """The walk by recursion."""
    try:
        pages = json.loads(text)["pdf_info"]
    except (TypeError, ValueError, KeyError):
        return []
    out = []

    def walk(node, page, path):
        if isinstance(node, list):
            for k, x in enumerate(node):
                walk(x, page, f"{path}[{k}]")
        elif isinstance(node, dict):
            said = node["text"] if isinstance(node.get("text"), str) else " ".join(s.get("content") or "" for line in node.get("lines") or [] for s in line.get("spans") or []).strip(" ")
            raw = node.get("bbox") or node.get("poly") or []
            box = [float(x) for x in raw] if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in raw) else []
            if len(box) >= 8 and len(box) % 2 == 0:
                box = [min(box[::2]), min(box[1::2]), max(box[::2]), max(box[1::2])]
            if said and len(box) == 4:
                out.append((page, path, node.get("type") or node.get("category_type"), said, box))
            else:
                for k in layout.BELOW:
                    if node.get(k) is not None:
                        walk(node[k], page, f"{path}.{k}")

    for k, p in enumerate(pages):
        walk(p, p.get("page_idx", k), f"[{k}]")
    return out


def test_layout_nodes_equal_the_recursive_walk(spark):
    gen = random.Random(13)

    def node(depth):
        n = {"type": gen.choice(["text", "title"])} if gen.random() > 0.3 else {"category_type": "other"}
        if gen.random() > 0.4:
            n["bbox"] = gen.choice([[1, 2, 3, 4], [1.5, 2, 30, 4], [True, 1, 2, 3], [1, 2, 3], [], ["1", 2, 3, 4]])
        if gen.random() > 0.6:
            n["poly"] = gen.choice([[5, 1, 9, 1, 9, 8, 5, 8], [1, 2, 3, 4], [1, 2, 3, 4, 5]])
        if gen.random() > 0.5:
            n["text"] = gen.choice(["said", "", "ünï 😀", 5])
        if gen.random() > 0.6:
            n["lines"] = [{"spans": [{"content": "a"}, {"content": "b"}]}, {"spans": []}, {"spans": [{"content": "c"}]}]
        if depth:
            for k in layout.BELOW:
                if gen.random() > 0.5:
                    below = [node(depth - 1) for _ in range(gen.randint(0, 3))]
                    n[k] = gen.choice([below, [below], node(depth - 1), 7])
        return n

    docs = [json.dumps({"pdf_info": [node(4) | ({"page_idx": 9} if gen.random() > 0.5 else {}) for _ in range(gen.randint(0, 3))]}) for _ in range(30)]
    docs += [None, "", "bad", "{}", '{"pdf_info": []}', '{"pdf_info": [{"blocks": ' + "[" * 12 + '{"bbox": [1, 2, 3, 4], "text": "deep"}' + "]" * 12 + "}]}"]
    frame = spark.createDataFrame(list(enumerate(docs)), "i int, j string")
    got = layout.layout_nodes(frame, "i", "j").collect()
    want = [(i, *n) for i, d in enumerate(docs) for n in nodes_by_hand(d)]
    assert len(want) > 40 and Counter((r.i, r.page_idx, r.path, r.type, r.text, tuple(r.bbox)) for r in got) == Counter((*w[:5], tuple(w[5])) for w in want)
    assert "Python" not in layout.layout_nodes(frame, "i", "j")._jdf.queryExecution().executedPlan().toString()


def test_no_level_of_a_layout_is_read_from_json_again(spark):
    frame = spark.createDataFrame([(1, '{"pdf_info": [{"bbox": [1, 2, 3, 4], "text": "a"}, {"blocks": [{"bbox": [1, 2, 3, 4], "text": "b"}]}]}')], "i int, j string")
    got = layout.layout_nodes(frame, "i", "j")
    assert sorted((r.page_idx, r.path, r.text) for r in got.collect()) == [(0, "[0]", "a"), (1, "[1].blocks[0]", "b")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("LogicalRDD", "LocalRelation", "variant_get", "Generate") if x in plan]


def test_cells_of_orders_are_made_once(spark):
    from folioframe.plans.table_queries import QUERIES

    plan = QUERIES["cell_coverage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "__full" in plan


def test_levels_of_a_layout_are_written_together(spark, monkeypatch):
    """Six levels in two writes, an object's keys looked up once a level; numbers of several kinds make one box."""
    text = '{"pdf_info": [{"para_blocks": [{"blocks": [[{"blocks": {"blocks": [{"bbox": [1, 2.5, 1e3, 4], "text": "deep", "type": "t"}, 5, null]}}]]}, {"poly": [1, null, 3, 4], "text": "no box"}]}]}'
    writes, plans, write = [], [], layout.stored

    def counted(rows):
        writes.append(rows.columns)
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows)

    monkeypatch.setattr(layout, "stored", counted)
    got = layout.layout_nodes(spark.createDataFrame([(1, text)], "i int, j string"), "i", "j")
    assert [(r.page_idx, r.path, r.type, r.text, r.bbox) for r in got.collect()] == [(0, "[0].para_blocks[0].blocks[0][0].blocks.blocks[0]", "t", "deep", [1.0, 2.5, 1000.0, 4.0])]
    assert len(writes) == 2 and plans[0].count("para_blocks: variant") + plans[0].count("para_blocks:variant") <= 2 * layout.AT_ONCE


def test_rows_and_tables_are_moved_once_and_windows_never(spark):
    """With no side small enough to send to all: one move of rows, one of tables, none of windows."""
    from folioframe.operators import coverage

    rows = spark.createDataFrame([(1, 0, k, "abc"[k % 3], [0, k, 5, k + 1]) for k in range(9)], "doc int, page int, o int, t string, box array<int>")
    tables = spark.createDataFrame([(1, 1, list("abcabc"))], "doc int, n int, cells array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = coverage.cell_windows(tables.repartition("doc"), rows.repartition("doc"), "doc", "n", "cells", "page", "o", "t", "box")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert [(r.doc, r.page, r["first"], r["last"], r.n_matched) for r in got.collect()] == [(1, 0, 0, 5, 6)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_windows_across_stretches_of_a_page(spark, monkeypatch):
    from folioframe.operators import coverage

    gen = random.Random(3)
    text = [gen.choice("abcdefgh") for _ in range(300)]
    rows = spark.createDataFrame([(1, 0, k, t, [0, k, 5, k + 1]) for k, t in enumerate(text)], "doc int, page int, o int, t string, box array<int>")
    tables = spark.createDataFrame([(1, n, text[a : a + 7]) for n, a in enumerate(range(0, 280, 3))], "doc int, n int, cells array<string>")
    found = []
    for block in (1024, 18, 19):
        monkeypatch.setattr(coverage, "BLOCK", block)
        got = coverage.cell_windows(tables, rows, "doc", "n", "cells", "page", "o", "t", "box")
        found.append(sorted(map(str, got.collect())))
    assert len(found[0]) == 94 and found[0] == found[1] == found[2]
