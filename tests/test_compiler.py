"""The block table on odd rows, and its attachments by hand."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from folioframe.catalogue import ORACLE, QUERIES
from folioframe.operators import blocks as B
from folioframe.operators import compiler as C


def test_odd_lines_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n<!-- x -->\n"), (4, "### Deep\nthe text\nWord Link\nmore:\n# A\n### C\n#### D\nx")], "doc long, text string")
    got = C.standard_blocks(B.lines(docs, "doc", "text"), "doc", "line_no", "line")
    rows = [(r.doc, r.block_id, r.type, r.subtype, r.path) for r in got.orderBy("block_no").collect()]
    assert rows == [
        (4, "b-00001", "reading_passage", "passage_heading", ["Deep"]),
        (4, "b-00002", "reading_passage", "paragraph", ["Deep"]),
        (4, "b-00003", "vocabulary_box", "section_label", ["Deep"]),
        (4, "b-00004", "note", "label", ["Deep"]),
        (4, "b-00005", "unit_opener", "heading", ["A"]),
        (4, "b-00006", "reading_passage", "passage_heading", ["A", "C"]),
        (4, "b-00007", "heading", "", ["A", "C", "D"]),
        (4, "b-00008", "paragraph", "", ["A", "C", "D"]),
    ]
    none = C.with_relations(C.standard_blocks(B.lines(docs.limit(0), "doc", "text"), "doc", "line_no", "line", workbook=True), "doc")
    assert none.count() == C.relation_summary(none, ["doc"]).count() == C.table_attachments(none, "doc").count() == 0


def test_attachment_families_and_figures(spark):
    text = "# U\nLook at the scatter plot\n## S\nSee the scatter plot.\n<table>Distance and airfare</table>\nplain"
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    rows = C.with_relations(C.standard_blocks(B.lines(docs, "doc", "text"), "doc", "line_no", "line", workbook=True), "doc")
    (only,) = C.table_attachments(rows, "doc").collect()
    assert (only.group_id, only.family) == ("workbook-table-attachment:b-00005", "exercise_scatter_plot_data_table")
    sizes = spark.createDataFrame([(None, 5, "", None), (100, 200, "", None), (900, 900, "____", None), (900, 900, "", "question"), (900, 900, "We use it", None), (900, 900, "", None)], "w int, h int, c string, p string")
    roles = sizes.select(C.figure_role(F.col("w"), F.col("h"), F.col("c"), F.col("p"), F.array().cast("array<string>")).alias("r")).collect()
    assert [r.r for r in roles] == ["needs_dimension_review", "helper_icon", "exercise_key_figure", "exercise_key_figure", "explanation_key_figure", "decorative"]


@pytest.mark.parametrize("name", ["relation_audit", "gap_runs", "gap_tables", "grouping_members", "grouping_policies"])
def test_word_boundaries_beside_other_letters_are_those_of_the_sql(spark, tmp_path, name):
    """Lines that begin with a signal word and go on in letters beyond ASCII, at all places of a document."""
    said = ["Inöver von", "Wörter äpast", "Theä über Useß", "Chooseö passiveé", "öwe useä past"]
    docs = [(k, "\n".join(f"{said[(k + n) % 5]}{'x' * (k // 5 % 7)}" for n in range(40))) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
