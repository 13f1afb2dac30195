"""The standard block table over the lines of all documents, which get markdown marks by their place; the SQL folds line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import blocks as B
from folioframe.operators import compiler as C
from folioframe.operators import grouping as G
from folioframe.plans.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: Marks put before a line, by its place; a mark that ends in a full line (the last four) stands alone.
MARKS = [
    "# Unit ", "## Lesson ", "### Passage ", "#### Editing advice ", "![f](img/a.png) ", "<table><tr><td>", "<table><tr><td>Examples and explanation: ", "$$", "▲ ", "Exercise 1 ", "2 Circle ", "3 word ",
    "4 ____ ", "B. ", "5. ", "6. We use ", "a) ", "____ ", "Detail ", "See the bar diagram: ", "<!-- note -->", "Reading Comprehension", "Before You Read", "Word list:",
]
_ALONE = 4


def marked(docs: DataFrame, marks: list[str] = MARKS, alone: int = _ALONE) -> DataFrame:
    lines = B.lines(docs, "doc_id", "text")
    place = ((F.col("doc_id") * 7 + F.col("line_no") * 5 + F.length("line")) % len(marks)).cast("int")
    mark = F.get(F.array(*(F.lit(m) for m in marks)), place)
    return lines.select("doc_id", "line_no", F.when(place >= len(marks) - alone, mark).otherwise(F.concat(mark, "line")).alias("line"))


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _has(pattern: str, what: str = "md") -> str:
    return f"regexp_matches({what}, {_q(pattern)})"


def _class_sql(workbook: bool, inside: bool) -> str:
    """The class of a line as type/subtype, in SQL."""
    head = f"WHEN {_has(C.GROUP_HEADING, "regexp_replace(md, '^#+\\s*', '')")} THEN 'question_group/exercise_section'" if workbook else ""
    deep = "'section/lesson_heading'" if workbook else "CASE level WHEN 3 THEN 'reading_passage/passage_heading' ELSE 'heading/' END"
    book = f"""WHEN {_has(C.EXERCISE_HEADING)} OR {_has(C.INSTRUCTION)} OR {_has(C.UNNUMBERED_INSTRUCTION)} OR {_has(C.QUESTION_INSTRUCTION)} THEN 'question_group/exercise_instruction'
 WHEN {_has(C.NUMBERED_ITEM)} THEN CASE WHEN {_has(C.BLANK)} THEN 'question/fill_blank' ELSE 'question/exercise_item' END""" if workbook else ""
    rest = "WHEN true THEN 'reading_passage/paragraph'" if inside else "WHEN length(md) <= 80 AND ends_with(md, ':') THEN 'note/label'"
    labels = " ".join(f"WHEN {_q(k)} THEN '{v}/section_label'" for k, v in C.LABELS.items())
    return f"""CASE WHEN level IS NOT NULL THEN CASE {head} WHEN level = 1 THEN 'unit_opener/heading' WHEN level = 2 THEN 'section/lesson_heading' ELSE {deep} END
 WHEN lower(md) IN {_in(C.LABELS)} THEN CASE lower(md) {labels} END
 WHEN {_has(C.IMAGE)} THEN 'captioned_figure/' WHEN {_has(C.TABLE)} THEN 'table/{"table_question" if workbook else ""}' WHEN starts_with(md, '$$') OR ends_with(md, '$$') THEN 'formula/' WHEN {_has(C.CAPTION)} THEN 'caption/' {book}
 WHEN {_has(C.PART)} THEN 'question_group/exercise_part' WHEN {_has(C.QUESTION)} THEN 'question/' WHEN {_has(C.OPTION)} THEN 'option/' WHEN {_has(C.BLANK)} THEN 'answer_blank/'
 WHEN {" OR ".join(f"starts_with(lower(md), {_q(s)})" for s in C.MARKER_STARTS)} THEN '{"reading_passage/reading_marker" if inside else "note/exercise_marker"}' {rest} ELSE 'paragraph/' END"""


def _blocks_sql(workbook: bool, marks: list[str] = MARKS, alone: int = _ALONE) -> str:
    """Common tables up to `b`: a fold over the blocks of each document that carries the heading stack, the open passage, group and question."""
    alone, n = len(marks) - alone, len(marks)
    end = "split_part(kind, '/', 1)"
    return f"""WITH RECURSIVE l AS (SELECT doc_id, i AS line_no, l[i] AS raw FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''))),
k AS (SELECT *, (doc_id * 7 + line_no * 5 + length(raw)) % {n} AS k FROM l),
m AS (SELECT doc_id, line_no, regexp_replace(CASE WHEN k >= {alone} THEN mark ELSE mark || raw END, '^\\s+|\\s+$', '', 'g') AS md FROM (SELECT *, ([{", ".join(_q(x) for x in marks)}])[k + 1] AS mark FROM k)),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, nullif(length(regexp_extract(md, {_q(C.HEADING)}, 1)), 0) AS level, trim(regexp_replace(regexp_extract(md, {_q(C.HEADING)}, 2), '\\s+', ' ', 'g')) AS title FROM m WHERE md <> '' AND NOT {_has(C.COMMENT)}),
c AS (SELECT *, {_class_sql(workbook, True)} AS within, {_class_sql(workbook, False)} AS without FROM h),
f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS path, false AS inside, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS q, '' AS kind, CAST(NULL AS BIGINT) AS parent_no FROM c
 UNION ALL SELECT doc_id, n, path, inside, CASE WHEN {end} IN {_in(C.STRUCTURAL)} THEN 0 WHEN {end} IN {_in(C.GROUPS)} THEN n ELSE g END,
  CASE WHEN {end} IN {_in(C.STRUCTURAL + C.GROUPS)} THEN 0 WHEN {end} = 'question' THEN n ELSE q END, kind,
  CASE WHEN {end} = 'question' THEN nullif(g, 0) WHEN {end} IN {_in(C.CHILDREN)} THEN nullif(CASE WHEN q > 0 THEN q ELSE g END, 0) END
  FROM (SELECT *, CASE WHEN inside THEN within ELSE without END AS kind FROM (SELECT c.doc_id, c.n, c.within, c.without, f.g, f.q, CASE WHEN c.level IS NULL THEN f.path ELSE list_append(f.path[1:c.level - 1], c.title) END AS path,
   CASE WHEN c.level IS NOT NULL THEN c.level = 3 AND {str(not workbook).lower()} WHEN lower(c.md) IN {_in(C.PASSAGE_STOPS)} THEN false ELSE f.inside END AS inside FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1))),
r AS (SELECT f.doc_id, f.n, line_no, md, path, split_part(kind, '/', 1) AS type, split_part(kind, '/', 2) AS subtype, parent_no, lag(md) OVER w AS pm, lead(md) OVER w AS nm, lag({end}) OVER w AS pt, lead({end}) OVER w AS nt FROM f JOIN c ON f.doc_id = c.doc_id AND f.n = c.n WINDOW w AS (PARTITION BY f.doc_id ORDER BY f.n)),
b AS (SELECT * EXCLUDE (subtype), printf('b-%05d', n) AS block_id, CASE WHEN type = 'table' AND subtype = 'table_question' AND parent_no IS NULL AND ({" OR ".join(_has(p, "concat_ws(chr(10), pm, md, nm)") for p in C.TABLE_SIGNALS)}) THEN 'explanation_table' ELSE subtype END AS subtype FROM r)
"""


_COLUMNS = "doc_id, block_id, line_no, type, subtype, array_to_string(path, ' > ') AS path, CASE WHEN parent_no IS NOT NULL THEN printf('b-%05d', parent_no) END AS parent_id"


def _listed(docs: DataFrame, workbook: bool) -> DataFrame:
    rows = C.with_relations(C.standard_blocks(marked(docs), "doc_id", "line_no", "line", workbook=workbook), "doc_id")
    return rows.select("doc_id", "block_id", F.col("line_start").alias("line_no"), "type", "subtype", F.array_join("path", " > ").alias("path"), C.block_id(F.col("parent_no")).alias("parent_id"))


@R.over("standard_blocks_reading", "documents", sql=f"{_blocks_sql(False)} SELECT {_COLUMNS} FROM b")
def _(docs: DataFrame) -> DataFrame:
    return _listed(docs, False)


@R.over("standard_blocks_workbook", "documents", sql=f"{_blocks_sql(True)} SELECT {_COLUMNS} FROM b")
def _(docs: DataFrame) -> DataFrame:
    return _listed(docs, True)


def _workbook(docs: DataFrame) -> DataFrame:
    return C.with_relations(C.standard_blocks(marked(docs), "doc_id", "line_no", "line", workbook=True), "doc_id")


_ATTACHED = "type = 'table' AND subtype = 'table_question' AND parent_no IS NULL AND nt IS DISTINCT FROM 'table' AND contains(lower(concat_ws(' ', pm, nm)), 'bar diagram')"


@R.over("table_attachments", "documents", sql=f"""{_blocks_sql(True)}
SELECT doc_id, 'workbook-table-attachment:' || block_id AS group_id, 'example_bar_diagram_table_model' AS family FROM b WHERE {_ATTACHED}""")
def _(docs: DataFrame) -> DataFrame:
    return C.table_attachments(_workbook(docs), "doc_id").select("doc_id", "group_id", "family")


def _counters(which: dict[str, str]) -> str:
    out = []
    for name, where in which.items():
        out += [f"count(*) FILTER ({where}) AS {name}", f"count(*) FILTER ({where} AND parent_no IS NOT NULL) AS parented_{name}", f"count(*) FILTER ({where} AND parent_no IS NULL) AS orphan_{name}"]
    return ", ".join(out)


_SUMMARY = f"""count(*) FILTER (type IN {_in(C.GROUPS)}) AS question_groups, count(*) FILTER (type = 'question') AS questions, count(*) FILTER (type = 'question' AND parent_no > 0) AS grouped_questions,
 count(*) FILTER (type = 'question' AND parent_no IS NULL) AS ungrouped_questions, count(*) FILTER (type = 'question' AND subtype = 'fill_blank') AS fill_blank_questions,
 {_counters({"options": "type = 'option'", "answer_blanks": "type = 'answer_blank'", "table_questions": "type = 'table' AND subtype = 'table_question'", "figure_relation_candidates": "type = 'captioned_figure'"})}"""


@R.over("relation_summary", "documents", sql=f"{_blocks_sql(True)} SELECT doc_id, {_SUMMARY} FROM b GROUP BY doc_id")
def _(docs: DataFrame) -> DataFrame:
    return C.relation_summary(_workbook(docs), ["doc_id"])


@R.over("relation_deltas", "documents", sql=f"""{_blocks_sql(True)}
SELECT doc_id, question_groups + n AS question_groups, parented_table_questions + n AS parented_table_questions, orphan_table_questions - n AS orphan_table_questions
FROM (SELECT doc_id, {_SUMMARY}, count(*) FILTER ({_ATTACHED}) AS n FROM b GROUP BY doc_id)""")
def _(docs: DataFrame) -> DataFrame:
    rows = _workbook(docs)
    attached = C.table_attachments(rows, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return C.relation_delta(C.relation_summary(rows, ["doc_id"]).join(attached, "doc_id", "left"), n, n).select("doc_id", "question_groups", "parented_table_questions", "orphan_table_questions")


#: Widths and heights of figures follow from their places: a third is unknown, a third small.
_WIDTH, _HEIGHT = "CASE n % 3 WHEN 0 THEN 100 WHEN 1 THEN 640 END", "CASE n % 3 WHEN 0 THEN 90 WHEN 1 THEN 480 END"


@R.over("relation_audit", "documents", sql=f"""{_blocks_sql(True)}, a AS (SELECT *, concat_ws(chr(10), coalesce(pm, ''), coalesce(nm, '')) AS around FROM b WHERE parent_no IS NULL),
e AS (SELECT *, CASE WHEN n % 3 = 2 THEN 'review' WHEN n % 3 = 0 THEN 'icon' WHEN {_has(C.BLANK, "around")} THEN 'exercise' WHEN {_has(C.FIGURE_SIGNAL, "around")} OR len(path) > 0 THEN 'explanation' ELSE 'decorative' END AS role FROM a)
SELECT doc_id, block_id, CASE
 WHEN type = 'question' THEN CASE WHEN len(list_filter(path, lambda p: contains(lower(p), 'editing advice'))) > 0 THEN 'numbered_editing_advice_not_exercise_item' WHEN {_has(C.NUMBERED_EXPLANATION)} THEN 'numbered_grammar_explanation_not_exercise_item' ELSE 'question_without_exercise_group' END
 WHEN type = 'table' THEN CASE WHEN subtype = 'explanation_table' THEN 'grammar_explanation_table_not_exercise_table' ELSE 'table_question_without_exercise_group' END
 WHEN role = 'icon' THEN 'small_helper_icon_should_use_compact_nearby_rendering' WHEN role = 'explanation' THEN 'explanation_figure_without_exercise_parent'
 WHEN role = 'exercise' AND (coalesce(pt IN ('unit_opener', 'section', 'captioned_figure'), false) OR coalesce(nt IN ('section', 'paragraph'), false)) THEN 'unit_or_explanation_figure_requires_visual_review_not_exercise_parent'
 WHEN role = 'exercise' THEN 'content_figure_without_exercise_or_explanation_parent' ELSE 'unclassified_orphan_figure' END AS reason
FROM e WHERE type IN ('question', 'table', 'captioned_figure')""")
def _(docs: DataFrame) -> DataFrame:
    size = lambda small, large: F.when(F.col("block_no") % 3 == 0, small).when(F.col("block_no") % 3 == 1, large)
    context = F.concat_ws("\n", F.coalesce("previous_markdown", F.lit("")), F.coalesce("next_markdown", F.lit("")))
    role = C.figure_role(size(100, 640), size(90, 480), context, F.lit(None).cast("string"), F.col("path"))
    return C.relation_audit(_workbook(docs), role).select("doc_id", "block_id", F.split_part("finding", F.lit("/"), F.lit(2)).alias("reason"))


#: Marks of the lines that the grouping policies read; the last three stand alone.
GROUP_MARKS = ["# Unit ", "", "<table><tr><td>", "1. ", "", "2. We use ", "3 word ", "", "4 ____ ", "Circle the answer. ", "", "<table><tr><th>Examples and explanation: ", "", "Act 1", "**Practice**", "Word list:"]
_STARTS = "(?i)^(?:Choose|Complete|Write|Look|Read|Find|Correct|Fill|Circle|Answer|Ask|Tell|Work|Determine|Classify|Evaluate|Simplify|Solve|Graph|Use|Draw|Estimate|Compare|Order|Match|Name|Identify|Explain|Describe|Select|Calculate|Convert|Round|Model|Represent|Make|Copy|Connect|Decide|Show)\\b"
#: A fold over the blocks of each document: the open group and question of both policies (p, g: persistent, guarded) as block numbers.
_GROUPS = f"""{_blocks_sql(True, GROUP_MARKS, 3)},
t AS (SELECT *, regexp_replace(md, '\\s+', ' ', 'g') AS said FROM b),
u AS (SELECT *, CASE WHEN type IN ('unit_opener', 'section', 'reading_passage') THEN NULL WHEN lower(trim(said, '* ')) IN ('assessment practice', 'do you know how?', 'do you understand?', 'practice', 'practice & problem solving', 'leveled practice', 'reflect', 'act 1', 'act 2', 'act 3', 'sequel') THEN 'section_label'
 WHEN {_has(_STARTS, "said")} THEN 'instruction_paragraph' WHEN ends_with(said, ':') AND length(said) <= 120 THEN 'colon_label' END AS starter,
 parent_no IS NULL AND ((type = 'question' AND NOT {_has(C.NUMBERED_EXPLANATION)}) OR (type = 'table' AND subtype = 'table_question')) AS gap FROM t),
v AS (SELECT *, CASE WHEN type IN ('unit_opener', 'section', 'reading_passage') THEN 'reset' WHEN starter IS NOT NULL THEN 'starter' WHEN type = 'paragraph' AND length(said) > 180 THEN 'long' END AS step FROM u),
s AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pg, CAST(NULL AS BIGINT) AS pq, CAST(NULL AS BIGINT) AS gg, CAST(NULL AS BIGINT) AS gq FROM v
 UNION ALL SELECT v.doc_id, v.n, CASE WHEN step = 'reset' THEN NULL WHEN step = 'starter' THEN v.n ELSE pg END, CASE WHEN step IN ('reset', 'starter') THEN NULL WHEN type = 'question' THEN v.n ELSE pq END,
 CASE WHEN step IN ('reset', 'long') THEN NULL WHEN step = 'starter' THEN v.n ELSE gg END, CASE WHEN step IN ('reset', 'starter', 'long') THEN NULL WHEN type = 'question' THEN v.n ELSE gq END FROM s JOIN v ON v.doc_id = s.doc_id AND v.n = s.n + 1),
x AS (SELECT v.*, pg, pq, gg, gq, gap AND step IS NULL AND CASE type WHEN 'question' THEN pg IS NOT NULL ELSE pg IS NOT NULL OR pq IS NOT NULL END AS pc, gap AND step IS NULL AND CASE type WHEN 'question' THEN gg IS NOT NULL ELSE gq IS NOT NULL END AS gc FROM v JOIN s ON v.doc_id = s.doc_id AND v.n = s.n)"""


def _gapped(docs: DataFrame) -> DataFrame:
    """The blocks with a flag of those that the audit calls a gap of the profile; the text before is kept for these only."""
    rows = C.with_relations(C.standard_blocks(marked(docs, GROUP_MARKS, 3), "doc_id", "line_no", "line", workbook=True), "doc_id")
    rows = rows.withColumn("gap", F.coalesce(F.startswith(C.audit_finding(F.lit("helper_icon")), F.lit("real_profile_gap/")), F.lit(False)))
    return rows.select("doc_id", "block_no", "block_id", "type", "markdown", "gap", *(F.when(F.col("gap"), F.col(c)).alias(c) for c in ("previous_markdown", "previous_type", "next_type")))


def _simulated(docs: DataFrame) -> DataFrame:
    rows = _gapped(docs).drop("previous_markdown", "previous_type", "next_type")
    return G.simulate(rows, "doc_id", order="block_no", id_="block_id", type_="type", markdown="markdown", gap="gap", size=16)


_ID = "CASE WHEN {0} IS NOT NULL THEN printf('b-%05d', {0}) END AS {1}"


@R.over("grouping_members", "documents", sql=f"""{_GROUPS}
SELECT doc_id, block_id, starter, {_ID.format("pg", "persistent_group")}, {_ID.format("pq", "persistent_question")}, {_ID.format("gg", "guarded_group")}, {_ID.format("gq", "guarded_question")}, pc AS persistent_covered, gc AS guarded_covered FROM x""")
def _(docs: DataFrame) -> DataFrame:
    """The open group and question at every block under both policies."""
    return _simulated(docs).select("doc_id", "block_id", "starter", "persistent_group", "persistent_question", "guarded_group", "guarded_question", "persistent_covered", "guarded_covered")


_OF = ", ".join(f"count(*) FILTER (gap AND type = '{kind}' AND {c}) AS {policy}_covered_{kind}s, count(*) FILTER (gap AND type = '{kind}' AND NOT {c}) AS {policy}_remaining_{kind}s" for policy, c in (("persistent", "pc"), ("guarded", "gc")) for kind in ("question", "table"))


@R.over("grouping_policies", "documents", sql=f"""{_GROUPS}
SELECT doc_id, count(*) FILTER (step = 'starter') AS virtual_groups, count(*) FILTER (starter = 'section_label') AS section_label_starters, count(*) FILTER (starter = 'instruction_paragraph') AS instruction_paragraph_starters, count(*) FILTER (starter = 'colon_label') AS colon_label_starters,
 count(*) FILTER (step = 'reset') AS hard_section_resets, count(*) FILTER (step = 'long') AS long_paragraph_resets, {_OF},
 count(*) FILTER (type = 'table' AND pc AND pq IS NOT NULL) AS tables_in_open_questions, count(*) FILTER (type = 'table' AND pc AND pq IS NULL) AS tables_in_groups_only FROM x GROUP BY doc_id""")
def _(docs: DataFrame) -> DataFrame:
    """What each policy would cover, by document."""
    return G.policy_counts(_simulated(docs), ["doc_id"], type_="type", gap="gap")


_BEFORE = "regexp_replace(coalesce(pm, ''), '\\s+', ' ', 'g')"
_LABELS_IN = "lower(trim({0}, '* ')) IN ('assessment practice', 'do you know how?', 'do you understand?', 'practice', 'practice & problem solving', 'leveled practice', 'reflect', 'act 1', 'act 2', 'act 3', 'sequel')"


@R.over("gap_runs", "documents", sql=f"""{_GROUPS},
gq AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g, {_BEFORE} AS before, CASE WHEN regexp_matches(said, '^[0-9]{{1,3}}\\.\\s+') THEN 'number_dot_question' WHEN regexp_matches(said, '^[0-9]{{1,3}}\\s+\\S+') THEN 'number_space_fragment_or_question' WHEN regexp_matches(said, '\\$.*\\$|\\\\frac|\\\\begin') THEN 'math_text'
  WHEN contains(said, '?') THEN 'question_mark_text' WHEN length(said) > 240 THEN 'long_text' ELSE 'other_question_like_text' END AS shape FROM v WHERE gap AND type = 'question'),
gr AS (SELECT *, CASE WHEN before = '' AND shape = 'number_dot_question' THEN 'missing_front_context' WHEN before = 'TOPICS' THEN 'front_matter_topic_list_artifact' WHEN {_LABELS_IN.format("before")} THEN 'section_label_should_start_group' WHEN {_has(_STARTS, "before")} THEN 'instruction_paragraph_should_start_group'
  WHEN pt = 'question' THEN 'continues_existing_ungrouped_question_run' WHEN regexp_matches(before, '^[A-Z]$') THEN 'part_letter_should_start_group' WHEN ends_with(before, ':') THEN 'colon_label_should_start_group' ELSE 'unknown_or_manual_group_boundary' END AS starter_of FROM gq),
gc AS (SELECT doc_id, g, string_agg(shape || '=' || k, ',' ORDER BY shape || '=' || k) AS shapes FROM (SELECT doc_id, g, shape, count(*) AS k FROM gr GROUP BY doc_id, g, shape) GROUP BY doc_id, g)
SELECT doc_id, min(n) AS first_no, max(n) AS last_no, count(*) AS run_length, arg_min(starter_of, n) AS starter, any_value(shapes) AS shapes FROM gr JOIN gc USING (doc_id, g) GROUP BY doc_id, g""")
def _(docs: DataFrame) -> DataFrame:
    """Runs of questions that nothing groups, with why they begin and what they look like."""
    return G.gap_runs(_gapped(docs), "doc_id")


@R.over("gap_tables", "documents", sql=f"""{_GROUPS}
SELECT doc_id, n AS block_no, CASE WHEN pt = 'question' OR nt = 'question' THEN 'table_adjacent_to_question_should_attach' WHEN {_has(_STARTS, "before")} THEN 'table_after_instruction_should_attach' WHEN {_LABELS_IN.format("before")} THEN 'table_after_section_label_should_attach'
 WHEN regexp_matches(lower(said), 'answer|definition|example') THEN 'table_may_be_exercise_or_explanation_needs_visual_review' ELSE 'table_manual_group_boundary' END AS bucket FROM (SELECT *, {_BEFORE} AS before FROM v WHERE gap AND type = 'table')""")
def _(docs: DataFrame) -> DataFrame:
    """What each table that nothing groups may belong to."""
    return G.gap_tables(_gapped(docs), "doc_id")
