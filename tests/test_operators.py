"""Operators without SQL, against plain Python."""

from __future__ import annotations

import io
import json
import zipfile
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import blocks, matching, passes
from folioframe.plans.fixture_queries import _HEADINGS
from folioframe.sources import readers, sinks
from folioframe.streaming import queue


def test_positional_heading_path(spark):
    h = spark.sql(f"SELECT * FROM {_HEADINGS}")
    stacks, want = {}, {}
    for r in sorted(h.collect(), key=lambda r: (r.doc, r.n)):
        stacks[r.doc] = [*stacks.get(r.doc, [])[: r.level - 1], r.title]
        want[r.doc, r.n] = list(stacks[r.doc])
    got = {(r.doc, r.n): r.path for r in blocks.heading_path_positional(h, "doc", "n", "level", "title").collect()}
    assert got == want
    assert got["d1", 7] == ["Part Two", "Skip C", "Skip D"]


def test_sequence_ratio(spark):
    rows = [(1, "abcd", "bcde"), (2, "", ""), (3, None, "x"), (4, "a" * 300, "ab" * 150)]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", matching.sequence_ratio("a", "b").alias("x")).collect()}
    assert got[3] is None
    for i, a, b in rows:
        if a is not None:
            assert abs(got[i] - SequenceMatcher(None, a, b).ratio()) < 1e-12


def test_math_and_catalogue_keys(spark):
    row = spark.createDataFrame([(r"\frac{a}{b} \times \sqrt{x} ___", "The 2019 Grammar of English a b1")], "m string, t string").select(X.math_key(F.col("m")), X.catalogue_tokens(F.col("t"))).first()
    assert row[0] == "fracaoverbtimessqrtx"
    assert row[1] == ["grammar", "english", "b1"]


def test_short_markers(spark):
    rows = [("d", "1", 1, 1, "paragraph", "Intro"), ("d", "2", 2, 2, "paragraph", "3."), ("d", "3", 9, 9, "section", "Part"), ("d", "4", 10, 10, "paragraph", "B"), ("d", "5", 11, 11, "paragraph", "answer"), ("d", "6", 30, 30, "paragraph", "7")]
    got = passes.merge_short_markers(spark.createDataFrame(rows, "doc string, id string, line_start int, line_end int, type string, text string")).orderBy("line_start").collect()
    assert [(r.type, r.text) for r in got] == [("paragraph", "Intro 3."), ("section", "Part"), ("paragraph", "B answer"), ("isolated_marker", "7")]


def test_continuation_propagates(spark):
    rows = [("d", 1, 1.0, "p", "g1"), ("d", 2, 2.0, "p", None), ("d", 3, 4.0, "p", None), ("d", 4, 9.0, "p", None), ("d", 5, 5.0, "q", None)]
    got = passes.continue_questions(spark.createDataFrame(rows, "doc string, pos int, number double, path string, group_id string")).orderBy("pos").collect()
    assert [r.group_id for r in got] == ["g1", "g1", "g1", None, None]


def test_source_blocks_merge(spark):
    rows = [("d", 1, "text", "1,2", "ab"), ("d", 2, "text", "1,2", "abc"), ("d", 3, "text", "1,2", "zz"), ("d", 4, "text", "9,9", "ab")]
    got = passes.merge_source_blocks(spark.createDataFrame(rows, "doc string, pos int, type string, box string, text string")).orderBy("pos").collect()
    assert [r.text for r in got] == ["abc", "zz", "ab"]


def test_pairs_excerpts_and_cells(spark):
    v = spark.createDataFrame([("d", 1, "question", ""), ("d", 2, "question", ""), ("d", 3, "word_bank", ""), ("d", 4, "section", ""), ("d", 5, "word_bank", "")], "doc string, pos int, type string, text string")
    assert {(r.bank, r.question) for r in passes.vocabulary_pairs(v).collect()} == {(3, 1), (3, 2)}
    b = spark.createDataFrame([(0, 1, "one two"), (0, 2, "one two"), (0, 3, "nothing")], "page int, pos int, text string")
    c = spark.createDataFrame([(0, 0, "One  two"), (0, 1, "zero one two three")], "page int, idx int, chunk string")
    assert [(r.pos, r.idx, r.score) for r in passes.assign_excerpts(b, c).orderBy("pos").collect()] == [(1, 0, 120.0), (2, 0, 90.0)]
    t = spark.createDataFrame([("d", 1, ["a", "b", "c", "d", "e", "f"]), ("d", 2, ["a"])], "doc string, table int, cells array<string>")
    e = spark.createDataFrame([("d", i, x) for i, x in enumerate("zabcdefz")], "doc string, pos int, text string")
    assert [(r.table, r["first"], r["last"], r.coverage) for r in passes.cell_coverage(t, e).collect()] == [(1, 1, 6, 1.0)]


def test_lines_count_all_line_ends(spark):
    text = "a\r\nb\x0bc d\n"
    got = blocks.lines(spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, t string"), "i", "t").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == list(enumerate(text.splitlines(), 1))


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 3}\nnot json\n{"a": 4}\n')
    read = lambda **k: sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path), "a int", **k).collect())
    assert read() == [1, 2, 3, 4]
    assert read(mode="all_or_nothing") == [1, 2]
    assert read(limit=1) == [1, 3]
    try:
        read(mode="raise")
    except Exception as error:
        assert "bad JSON line" in str(error)
    else:
        raise AssertionError


def test_tables_archives_images_layout(spark):
    html = "<table><tr><th>A &amp; b</th><td>x<br>y</td></tr><tr><td>1</td></table>"
    rows = spark.createDataFrame([(html,), (None,)], "h string").select(readers.table_rows("h").alias("t")).collect()
    assert [[(c.tag, c.text) for c in row] for row in rows[0].t] == [[("th", "A & b"), ("td", "x\ny")], [("td", "1")]]
    assert rows[1].t == []
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("a/b.md", "text")
        z.writestr("../evil", "no")
    files = spark.createDataFrame([("x.zip", bytearray(body.getvalue())), ("junk", bytearray(b"nothing"))], "path string, content binary")
    assert [(r.archive, r.member, bytes(r.body)) for r in readers.archive_members(files).collect()] == [("x.zip", "a/b.md", b"text")]
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (20).to_bytes(2, "big") + (30).to_bytes(2, "big") + bytes(10)
    got = spark.createDataFrame([(bytearray(png),), (bytearray(jpeg),), (None,), (bytearray(b"GIF89a\x05\x00\x06\x00"),)], "c binary").select(readers.image_dimensions("c").alias("d")).collect()
    assert [(r.d.width, r.d.height, r.d.area) for r in got] == [(300, 200, 60000), (30, 20, 600), (None, None, None), (5, 6, 30)]
    layout = {"pdf_info": [{"page_idx": 4, "para_blocks": [{"type": "text", "bbox": [1, 2, 3, 4], "lines": [{"spans": [{"content": "hi"}]}]}, {"type": "x", "bbox": [True, 1, 2, 3], "text": "no"}, {"blocks": [{"category_type": "t", "poly": [5, 1, 9, 1, 9, 8, 5, 8], "text": "in"}]}]}]}
    got = spark.createDataFrame([(json.dumps(layout),), ("bad",)], "j string").select(readers.layout_blocks("j").alias("b")).collect()
    assert [(b.page_idx, b.type, b.text, b.bbox) for b in got[0].b] == [(4, "text", "hi", [1, 2, 3, 4]), (4, "t", "in", [5, 1, 9, 8])]
    assert got[1].b == []


def test_listings_and_sinks(spark, tmp_path):
    keys = ["p/m1/r1/manifest.json", "p/m1/r2/other.json", "p/m2/r1/manifest.json", "p/a.PDF"]
    listed = spark.createDataFrame([(k, "t", 1) for k in keys], "key string, last_modified string, size long")
    assert {(r.material, r.run) for r in readers.two_level_manifests(listed, "p/").collect()} == {("m1", "r1"), ("m2", "r1")}
    assert readers.pdfs(listed).count() == 1
    rows = spark.createDataFrame([(1, keys[1], keys[0]), (2, "none", keys[2]), (3, "no", "no")], "i int, a string, b string")
    assert {r.i: r.resolved for r in readers.first_existing(rows, ["a", "b"], listed).collect()} == {1: keys[1], 2: keys[2], 3: None}
    refs = sinks.with_refs(rows, "clean", "a", ["i", "b"]).collect()
    assert json.loads(refs[0].body)["i"] == 1 and refs[0].size == len(refs[0].body)
    assert [r.key for r in sinks.extra(listed, listed.limit(3)).collect()] == [keys[3]]
    assert sinks.backup_plan(listed, 3).select("truncated").distinct().first()[0] is True
    assert sinks.twin_markers(rows.withColumn("s", F.lit("done")), "i", "a", "s").count() == 6
    sinks.write_jsonl(rows, str(tmp_path / "out"))
    assert readers.read_jsonl(spark, str(tmp_path / "out"), "i int, a string").count() == 3
    md = spark.createDataFrame([("d", 0, 2, "b"), ("d", 0, 1, "a"), ("d", 1, 1, "c")], "doc string, page int, ord int, text string")
    assert sinks.page_markdown(md, "doc", "page", "ord", "text").first().markdown == "## Page 1\n\na\n\nb\n\n## Page 2\n\nc"


def test_stream_of_messages(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.json").write_text(json.dumps({"file_id": k if k != 3 else None, "user_id": 1, "parse_method": "auto", "status": "running", "at": f"2024-01-01T00:0{k}:00Z"}) + "\n")
    stream = queue.messages(spark, str(folder), slots=2)
    done, failed = str(tmp_path / "done"), str(tmp_path / "failed")
    queue.process(stream, lambda rows: rows.select("file_id"), done, failed, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.file_id for r in spark.read.parquet(done).collect()) == [0, 1, 2, 4]
    assert spark.read.parquet(failed).count() == 1
    for name, frame, mode in (("pg", queue.progress(stream), "complete"), ("hr", queue.hourly(stream), "complete"), ("on", queue.once(stream), "append")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {r.percent for r in spark.table("pg").collect()} == {50}
    assert spark.table("hr").selectExpr("sum(n)").first()[0] == 5
    assert spark.table("on").count() == 5
