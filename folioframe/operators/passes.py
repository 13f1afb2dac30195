"""Passes over one document at a time whose state no window expresses: applyInPandas by document."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: Markers that a short line can consist of.
SHORT_MARKER = re.compile(r"^(?:[①-⑳]|[0-9]{1,2}[.)]?|[A-Z])$")
STRUCTURAL = ("unit", "section")


def _per_document(rows: DataFrame, doc: str, order: str, schema: str, function: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return rows.groupBy(doc).applyInPandas(lambda pdf: function(pdf.sort_values(order, kind="stable").reset_index(drop=True)), schema)


def merge_short_markers(rows: DataFrame) -> DataFrame:
    """Blocks (doc, id, line_start, line_end, type, text): a block that is one short marker joins the block
    before it if at most three lines part them and that is no unit or section; else it goes before the next one under the same rule."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        held: dict | None = None
        for b in pdf.to_dict("records"):
            if held is not None:
                if b["line_start"] - held["line_end"] <= 3 and b["type"] not in STRUCTURAL:
                    b = b | {"text": f"{held['text']} {b['text']}", "line_start": held["line_start"]}
                else:
                    out.append(held | {"type": "isolated_marker"})
                held = None
            if b["type"] in ("paragraph", "caption", "note", "question") and SHORT_MARKER.match(b["text"].strip()):
                last = out[-1] if out else None
                if last and last["type"] not in STRUCTURAL and b["line_start"] - last["line_end"] <= 3:
                    last["text"], last["line_end"] = f"{last['text']} {b['text']}", b["line_end"]
                else:
                    held = b
            else:
                out.append(b)
        if held is not None:
            out.append(held | {"type": "isolated_marker"})
        return pd.DataFrame(out, columns=list(pdf.columns))

    return _per_document(rows, "doc", "line_start", "doc string, id string, line_start int, line_end int, type string, text string", run)


def continue_questions(rows: DataFrame) -> DataFrame:
    """Blocks (doc, pos, number, path, group_id): an ungrouped numbered question joins the nearest numbered one
    within seven blocks before it with the same path and a number one or two less; groups propagate."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows_ = pdf.to_dict("records")
        for k, b in enumerate(rows_):
            if b["group_id"] or pd.isna(b["number"]):
                continue
            for a in reversed(rows_[max(0, k - 7) : k]):
                if not pd.isna(a["number"]) and a["path"] == b["path"] and 1 <= b["number"] - a["number"] <= 2 and a["group_id"]:
                    b["group_id"] = a["group_id"]
                    break
        return pd.DataFrame(rows_, columns=list(pdf.columns))

    return _per_document(rows, "doc", "pos", "doc string, pos int, number double, path string, group_id string", run)


def merge_source_blocks(rows: DataFrame) -> DataFrame:
    """Blocks (doc, pos, type, box, text): of the same type and box, one whose text holds the other's takes its
    place in the list, the longest stays. Containment isn't transitive, so the scan keeps its order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for b in pdf.to_dict("records"):
            twin = next((k for k in kept if (k["type"], k["box"]) == (b["type"], b["box"]) and (k["text"] in b["text"] or b["text"] in k["text"])), None)
            if twin is None:
                kept.append(b)
            elif len(b["text"]) > len(twin["text"]):
                twin["text"] = b["text"]
        return pd.DataFrame(kept, columns=list(pdf.columns))

    return _per_document(rows, "doc", "pos", "doc string, pos int, type string, box string, text string", run)


def vocabulary_pairs(rows: DataFrame) -> DataFrame:
    """Blocks (doc, pos, type, text): each word bank with the numbered questions before it, at most twelve back,
    none of them used twice; (doc, bank, question)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for k, b in enumerate(pdf.to_dict("records")):
            if b["type"] != "word_bank":
                continue
            for a in reversed(pdf.iloc[max(0, k - 12) : k].to_dict("records")):
                if a["type"] in (*STRUCTURAL, "word_bank"):
                    break
                if a["type"] == "question" and a["pos"] not in used:
                    used.add(a["pos"])
                    out.append((b["doc"], b["pos"], a["pos"]))
        return pd.DataFrame(out, columns=["doc", "bank", "question"])

    return _per_document(rows, "doc", "pos", "doc string, bank int, question int", run)


def assign_excerpts(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks (page, pos, text) and chunks (page, idx, chunk): each block in turn takes the chunk with the best
    score (120 equal, 80 contained, else the share of common words); a chunk taken before counts a quarter less."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = [(int(i), " ".join(str(c).lower().split())) for i, c in zip(right["idx"], right["chunk"], strict=True)]
        used: set[int] = set()
        out = []
        for page, pos, text in left.sort_values("pos")[["page", "pos", "text"]].itertuples(index=False):
            own, best = " ".join(str(text).lower().split()), (0.0, 0)
            for i, chunk in texts:
                a, b = set(own.split()), set(chunk.split())
                score = 120.0 if own == chunk else 80.0 if own and own in chunk else len(a & b) / max(1, len(a | b))
                score = score * 0.75 if i in used else score
                if (score, -i) > (best[0], -best[1]) and score > 0:
                    best = score, i
            if best[0] > 0:
                used.add(best[1])
                out.append((page, pos, best[1], round(best[0], 6)))
        return pd.DataFrame(out, columns=["page", "pos", "idx", "score"])

    return blocks.groupBy("page").cogroup(chunks.groupBy("page")).applyInPandas(run, "page int, pos int, idx int, score double")


def cell_coverage(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Tables (doc, table, cells) and evidence rows (doc, pos, text): the window of at most 18 rows that covers the
    most cells, each row used once; reported if nine tenths of six cells or more are covered."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ordered = right.sort_values("pos")
        positions, texts = ordered["pos"].tolist(), ordered["text"].tolist()
        out = []
        for doc, table, cells in left[["doc", "table", "cells"]].itertuples(index=False):
            cells, best = [c for c in cells if c], None
            if len(cells) < 6:
                continue
            for first in range(len(texts)):
                free, covered = list(range(first, min(len(texts), first + 18))), 0
                last = first
                for c in cells:
                    at = next((k for k in free if texts[k] == c), None)
                    if at is not None:
                        free.remove(at)
                        covered, last = covered + 1, max(last, at)
                key = (covered, -(last - first))
                if best is None or key > best[0]:
                    best = key, positions[first], positions[last]
            if best and best[0][0] >= 0.9 * len(cells):
                out.append((doc, table, best[1], best[2], best[0][0] / len(cells)))
        return pd.DataFrame(out, columns=["doc", "table", "first", "last", "coverage"])

    return tables.groupBy("doc").cogroup(rows.groupBy("doc")).applyInPandas(run, "doc string, table int, first int, last int, coverage double")
